"""Corpus-wide counts of 64-bit keys without a row for each key.

Documents are dealt to batches by a hash of doc_id. Each batch sends its sorted distinct keys to
ranges of the key space as blocks of 4-byte remainders; a range adds up how many times each key occurs
and answers to each batch which of the block's keys occur more than once, and how often. Both moves are
ordinary Spark exchanges of binary rows, so a lost executor only costs a recomputation, and a key that
every document has arrives once from each batch, already counted there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.session import ship_package, small_arrow_batches

from .kernels import release, text_buffers

BATCH_BYTES = 4 << 20
TASK_BYTES = 16 << 20  # of texts whose batches one task holds, one after the other
RANGE_KEYS = 1 << 20
TASK_RANGES = 4
ANSWERS = "batch int, range int, at binary, n binary"


def batched(docs: DataFrame, extra: list[str] | None = None) -> tuple[DataFrame, int, int]:
    """(documents by batch, tasks, bytes of all texts). Rows without doc_id are left out.

    The number of tasks comes from the bytes, so that what one holds doesn't grow with the corpus.
    """
    ship_package(docs.sparkSession)
    small_arrow_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BATCH_BYTES))
    cols = ["doc_id", "text", *(extra or [])]
    part = docs.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("batch"), *cols)
    tasks = max(1, -(-total // TASK_BYTES))
    return part.repartition(tasks, "batch"), tasks, total


def one_of_each(table: pa.Table) -> pa.Table:
    """Of rows with the same doc_id the one with the smallest text (null first), by doc_id."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table
    ids = table.column("doc_id").to_numpy()
    if len(ids) > 1 and (same := ids[1:] == ids[:-1]).any():
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last_null = table.column("text").is_null().to_numpy()
        pick = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)]):
            nulls = np.flatnonzero(last_null[a:b])
            pick.append(a + int(nulls[0]) if len(nulls) else a)
        table = table.take(pa.array(pick))
    return table


def _split(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each range begins in the sorted keys."""
    edge = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, edge), len(keys))


def _low(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)


def repeated_keys(docs: DataFrame, keys_of: Callable[[list], list[np.ndarray]], expected: int) -> tuple[DataFrame, int]:
    """(answers by batch, bits of a range) for the keys that ``keys_of`` finds in the texts. Counts are exact up to 254 in a
    batch and 65534 in all, and as many or more beyond; who asks only compares them and tells one from more."""
    bits = max(0, int(np.ceil(np.log2(max(1, expected / RANGE_KEYS)))))

    def send(key, table):
        release()
        table = one_of_each(table)
        found = keys_of(text_buffers(table.column("text")))
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        edge = _split(keys, bits)
        low, n = _low(keys, bits), np.minimum(n, 255).astype(np.uint8)
        some = [r for r in range(1 << bits) if edge[r] < edge[r + 1]]
        return pa.table({
            "range": pa.array(some, pa.int32()), "batch": pa.array([key[0].as_py()] * len(some), pa.int32()),
            "low": pa.array([low[edge[r] : edge[r + 1]].tobytes() for r in some], pa.binary()),
            "n": pa.array([n[edge[r] : edge[r + 1]].tobytes() for r in some], pa.binary()),
        })

    def count(key, table):
        release()
        lows = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("low")]
        ns = [np.frombuffer(x.as_py(), np.uint8) for x in table.column("n")]
        _, inverse = np.unique(np.concatenate(lows), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(ns))
        each = np.minimum(total[inverse], 65535).astype(np.uint16)
        out, at = {"batch": [], "at": [], "n": []}, 0
        for b, x in zip(table.column("batch").to_pylist(), lows):
            mine = each[at : at + len(x)]
            at += len(x)
            often = np.flatnonzero(mine > 1)
            if len(often):
                out["batch"].append(b)
                out["at"].append(often.astype(np.uint32).tobytes())
                out["n"].append(mine[often].tobytes())
        return pa.table({"batch": pa.array(out["batch"], pa.int32()), "range": pa.array([key[0].as_py()] * len(out["at"]), pa.int32()), "at": pa.array(out["at"], pa.binary()), "n": pa.array(out["n"], pa.binary())})

    blocks = docs.groupBy("batch").applyInArrow(send, "range int, batch int, low binary, n binary")
    blocks = blocks.repartition(max(1, (1 << bits) // TASK_RANGES), "range")
    return blocks.groupBy("range").applyInArrow(count, ANSWERS), bits


def counts_of(keys: np.ndarray, answers: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number in the whole corpus of each of ``keys``, which may repeat; the sorted distinct keys' own)."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    n = np.ones(len(distinct), np.uint16)
    edge = _split(distinct, bits)
    for r, at, x in zip(answers.column("range").to_pylist(), answers.column("at").to_pylist(), answers.column("n").to_pylist()):
        n[edge[r] + np.frombuffer(at, np.uint32).astype(np.int64)] = np.frombuffer(x, np.uint16)
    return n[inverse], n

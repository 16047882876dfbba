"""Packing by first-fit decreasing over a tournament tree of bin capacities.

A document's ids are cut every ``length`` of them, so all pieces but a document's last fill a sequence. Pieces
are dealt to randomised groups (by a hash of doc_id and start) of a bounded expected size, and each group packs its own:
longest first, each into the first sequence with room, which the tree of largest remaining capacities finds in
logarithmic time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.session import materialize, ship_package, small_arrow_batches

from .tokens import encoder, groups, vocabulary

LENGTH = 2048
GROUP_PIECES = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size; sizes must be descending and at most ``capacity``."""
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    at, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < s:
                node += 1
        at[i], offset[i] = node - leaves, capacity - tree[node]
        tree[node] -= s
        node >>= 1
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node >>= 1
    return at, offset


def pieces(docs: DataFrame, vocab: str, end_id: int, length: int) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut every ``length`` ids. A null text is empty."""
    ship_package(docs.sparkSession)
    small_arrow_batches(docs.sparkSession)

    def cut(batches):
        tokens, end = encoder(vocab), np.array([end_id], np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for a, b in groups(texts):
                flat, size = tokens.encode(texts[a:b])
                at = 0
                for i, k in zip(ids[a:b], size.tolist()):
                    own = np.concatenate([flat[at : at + k], end]).astype("<u4")
                    at += k
                    rows += [(i, s, min(length, len(own) - s), zlib.crc32(own[s : s + length].tobytes()), len(own)) for s in range(0, len(own), length)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocab: str | None = None, end_id: int = 1, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece with its sequence and place there.

    Every row of ``docs`` is packed, those with a repeated or null doc_id too; a null or empty text is its end id.
    sequence_id: group * 2**32 + the sequence's number in the group. An empty table gives no piece.
    """
    all_ = materialize(pieces(docs, vocab or vocabulary("word_bpe_49k.json"), end_id, length), "pieces")
    n = max(1, -(-all_.count() // group_pieces))

    def fill(key, table):
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        at, offset = first_fit_decreasing(order.column("length").to_numpy(), length)
        order = order.drop_columns(["part"])
        return order.append_column("sequence_id", pa.array(at + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    dealt = all_.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)))
    return dealt.groupBy("part").applyInArrow(fill, PACKED)

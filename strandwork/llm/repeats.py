"""Suffix-array dedup: remove every byte under a 100-byte string that also starts earlier in the corpus.

Every window of ``length`` bytes holds one anchor: the leftmost smallest hash among its 32-byte strings. Equal
windows have equal anchors at equal places, so windows only have to be compared within an anchor, and only
anchors that occur at least twice in the corpus (counted exactly, see blocks.py) send anything: the bytes of
the windows that they stand for. Equal stretches within a batch of documents are dealt with there, so a passage
that a third of all documents share arrives once from each batch.

The windows under an anchor are suffixes that are sorted by mergesort. Two suffixes are compared by
their common extension, found by binary search over prefix polynomial hashes, so a comparison takes
a logarithmic number of steps. Neighbours that the hashes call equal are verified on the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .blocks import TASK_BYTES, batched, counts_of, one_of_each, repeated_keys
from .kernels import U64, chunks, mix, prefix_hash, release, slice_hash, spread, text_buffers

GRAM = 32
CELL_ROWS = 1 << 13
SHARE = 1000  # occurrences of an anchor that one share of its places is meant for
OCCURRENCES = "cell int, anchor long, rel int, doc_id long, lo int, batch int, share int, turn int, bytes binary"
SPANS = "doc_id long, batch int, starts array<int>, ends array<int>"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place, by doubling."""
    h, width, k = data.astype(U64) + U64(1), 1, 0
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = mix(h[:-width] * U64(0xD6E8FEB86659FD93) + h[width:], k) if width in (8, 32) else h[:-width] * U64(0xD6E8FEB86659FD93 + 2 * k) + h[width:]
            width *= 2
            k += 1
    return mix(h, 99)


def anchors(texts: list, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: anchor hashes, their places, and the first and last window start of each."""
    empty = (np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    out = []
    span = length - GRAM + 1  # places of a window's anchor
    for a, b in chunks([len(t) for t in texts], 1 << 18):
        part = texts[a:b]
        data = np.frombuffer(b"".join(part), np.uint8)
        if len(data) < length:
            out += [empty] * len(part)
            continue
        h = _gram_hashes(data)
        place_bits = U64(max(1, int(len(data)).bit_length()))
        keyed = (h >> place_bits << place_bits) | np.arange(len(h), dtype=U64)
        low, width = keyed, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            rest = span - width
            low = np.minimum(low[: len(low) - rest], low[rest:])
        best = (low & ((U64(1) << place_bits) - U64(1))).astype(np.int64)  # for each window start
        edge = np.cumsum([0] + [len(t) for t in part])
        for i in range(len(part)):
            lo, hi = int(edge[i]), int(edge[i + 1]) - length + 1
            if hi <= lo:
                out.append(empty)
                continue
            mine = best[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            last = np.append(first[1:], len(mine)) - 1
            out.append((h[mine[first]], mine[first] - lo, first, last))
    return out


def _common(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Length of the common extension of the suffixes at x and y, at most ``length``."""
    low = np.zeros(len(x), np.int64)
    equal = slice_hash(prefix, x, x + length) == slice_hash(prefix, y, y + length)
    low[equal] = length
    todo = np.flatnonzero(~equal)
    a, b = x[todo], y[todo]
    lo, hi = np.zeros(len(todo), np.int64), np.full(len(todo), length - 1, np.int64)
    for _ in range(int(length).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = slice_hash(prefix, a, a + mid) == slice_hash(prefix, b, b + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    low[todo] = lo
    return low


def _before(data: np.ndarray, prefix: np.ndarray, x: np.ndarray, y: np.ndarray, length: int, or_equal: np.ndarray) -> np.ndarray:
    """Whether the suffix at x sorts before that at y."""
    n = _common(prefix, x, y, length)
    last = len(data) - 1
    return np.where(n >= length, or_equal, data[np.minimum(x + n, last)] < data[np.minimum(y + n, last)])


def suffix_sort(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes ``at`` (first ``length`` bytes count) within their buckets: a stable bottom-up
    mergesort of all buckets at once. bucket is ascending."""
    order = np.arange(len(at))
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(at)))
    start_of, size_of = np.repeat(begin, size), np.repeat(size, size)
    rank = np.arange(len(at)) - start_of
    run = 1
    while run < size.max(initial=0):
        active = np.flatnonzero(size_of > run)
        r, n = rank[active], size_of[active]
        mine = r // run
        other = mine ^ 1
        lo = np.minimum(other * run, n)
        hi = np.minimum(lo + run, n)
        first = lo.copy()
        left = (mine & 1) == 0
        x, base = at[order[active]], start_of[active]
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # place of each element in the run beside its own
            mid = (lo[open_] + hi[open_]) >> 1
            y = at[order[base[open_] + mid]]
            # an element of the left run goes before equal ones of the right run
            less = _before(data, prefix, y, x[open_], length, ~left[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        new = base + np.minimum(mine, other) * run + (r - mine * run) + (lo - first)
        moved = order[active]
        order[new] = moved
        run *= 2
    return order


def _same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    out = np.ones(len(x), bool)
    for a in range(0, len(x), 1 << 13):
        k = np.arange(length)
        out[a : a + (1 << 13)] = (data[x[a : a + (1 << 13), None] + k] == data[y[a : a + (1 << 13), None] + k]).all(axis=1)
    return out


def later_windows(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, age: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``at`` equal an older one (by ``age``, all different) of their bucket."""
    prefix = prefix_hash(data)
    by = np.lexsort((age, bucket))
    at_, bucket_ = at[by], bucket[by]
    order = suffix_sort(data, prefix, at_, bucket_, length)
    x = at_[order]
    same = np.zeros(len(x), bool)
    if len(x) > 1:
        near = np.flatnonzero(bucket_[1:] == bucket_[:-1]) + 1
        equal = _common(prefix, x[near - 1], x[near], length) >= length
        near = near[equal]
        same[near[_same_bytes(data, x[near - 1], x[near], length)]] = True
    out = np.zeros(len(at), bool)
    out[by[order]] = same  # the sort is stable, so the first of equal windows is the oldest
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; those that touch become one."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def repeated_spans(part: DataFrame, total: int, length: int = 100, occurrences_a_share: int = SHARE) -> DataFrame:
    """(doc_id, batch, starts, ends) of bytes under windows that start earlier too; a doc_id has several rows.

    The places that an anchor can have in a window are dealt to shares, more of them the more often the corpus holds the
    anchor (1 to all ``length`` - 31 places), so the windows of a very common one are sorted by several tasks. Windows that are
    equal have their anchor at the same place, so every share settles its windows for good, and their number changes no answer.
    """
    answers, bits = repeated_keys(part, lambda t: [x[0] for x in anchors(t, length)], total * 2 // (length - GRAM + 2))
    cells = max(1, total // (40 * CELL_ROWS))

    def occurrences(key, table, back):
        release()
        table = one_of_each(table)
        ids, texts = table.column("doc_id").to_numpy(), text_buffers(table.column("text"))
        found = anchors(texts, length)
        n = np.array([len(x[0]) for x in found], np.int64)
        keys = np.concatenate([x[0] for x in found]) if found else np.zeros(0, U64)
        df, _ = counts_of(keys, back, bits)
        often = np.flatnonzero(df > 1)
        doc = np.repeat(np.arange(len(found)), n)[often]
        place, first, last = (np.concatenate([x[k] for x in found])[often] if found else np.zeros(0, np.int64) for k in (1, 2, 3))
        keys = keys[often]
        rows: dict[tuple, int] = {}
        keep, covered = [], []
        for i, (k, d, p, a, b) in enumerate(zip(keys.tolist(), doc.tolist(), place.tolist(), first.tolist(), last.tolist())):
            # documents and places ascend, so the first of equal stretches is the oldest of the batch
            if rows.setdefault((k, p - a, bytes(texts[d][a : b + length])), i) == i:
                keep.append(i)
            else:
                covered.append(i)
        kept = np.array(keep, np.int64)
        share = np.clip(df[often][kept] // occurrences_a_share, 1, length - GRAM + 1).astype(np.int64)
        turn = spread(np.zeros(len(kept), np.int64), share)
        kept, share = np.repeat(kept, share), np.repeat(share, share)
        keys = np.where(turn > 0, mix(keys[kept] + turn.astype(U64), 7), keys[kept])  # shares are anchors of their own
        cell = (mix(keys, 3) % U64(cells)).astype(np.int32)
        stretch = [bytes(texts[d][a : b + length]) for d, a, b in zip(doc[kept].tolist(), first[kept].tolist(), last[kept].tolist())]
        batch = key[0].as_py()
        # stretches that equal an older one of the batch need no bytes: as spans of their document (rel = -1, anchor
        # holds the end), dealt by document, so that a very common passage doesn't meet in one cell
        gone: tuple[list, list, list] = ([], [], [])
        for d in np.unique(doc[covered]).tolist() if covered else []:
            a, b = np.searchsorted(doc[covered], [d, d + 1])
            mine = np.array(covered[a:b])
            start, end = merged(first[mine], last[mine] + length)
            gone[0].extend([d] * len(start))
            gone[1].extend(start.tolist())
            gone[2].extend(end.tolist())
        own = (mix(ids[gone[0]].astype(np.int64).view(U64), 4) % U64(cells)).astype(np.int32) if gone[0] else np.zeros(0, np.int32)
        n = len(gone[0])
        return pa.table({
            "cell": pa.array(np.concatenate([cell, own])), "anchor": pa.array(np.concatenate([keys.view(np.int64), np.array(gone[2], np.int64)])),
            "rel": pa.array(np.concatenate([(place - first)[kept], np.full(n, -1)]).astype(np.int32)),
            "doc_id": pa.array(np.concatenate([ids[doc[kept]], ids[gone[0]]]) if n else ids[doc[kept]], pa.int64()), "lo": pa.array(np.concatenate([first[kept], np.array(gone[1], np.int64)]).astype(np.int32)),
            "batch": pa.array(np.full(len(kept) + n, batch, np.int32)), "share": pa.array(np.concatenate([share, np.ones(n, np.int64)]).astype(np.int32)),
            "turn": pa.array(np.concatenate([turn, np.zeros(n, np.int64)]).astype(np.int32)), "bytes": pa.array([*stretch, *[None] * n], pa.binary()),
        })

    def spans(key, table):
        release()
        rel = table.column("rel").to_numpy()
        ids, batch, lo = (table.column(c).to_numpy() for c in ("doc_id", "batch", "lo"))
        whole = np.flatnonzero(rel < 0)
        doc, start, end = [whole], [lo[whole].astype(np.int64)], [table.column("anchor").to_numpy()[whole]]
        part = np.flatnonzero(rel >= 0)
        anchor = table.column("anchor").to_numpy()[part]
        _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
        part = part[count[group] > 1]
        # the oldest of equal stretches stands for them; the others are covered
        pieces = table.column("bytes").take(pa.array(part)).to_pylist()
        anchor, share, turn = (table.column(c).to_numpy()[part] for c in ("anchor", "share", "turn"))
        age = np.lexsort((lo[part], ids[part]))
        seen: dict[tuple, int] = {}
        alone = []
        late = []
        for i in age.tolist():
            if seen.setdefault((int(anchor[i]), int(rel[part[i]]), pieces[i]), i) == i:
                alone.append(i)
            else:
                late.append(i)
        if late:
            late = np.array(late)
            doc.append(part[late])
            start.append(lo[part[late]].astype(np.int64))
            end.append(start[-1] + np.array([len(pieces[i]) for i in late.tolist()]))
        alone = np.array(alone, np.int64)  # oldest first
        if len(alone):
            _, group, count = np.unique(anchor[alone], return_inverse=True, return_counts=True)
            pick = count[group] > 1
            alone, group = alone[pick], group[pick]
        if len(alone):
            sizes = np.array([len(pieces[i]) for i in alone.tolist()], np.int64)
            data = np.frombuffer(b"".join(pieces[i] for i in alone.tolist()), np.uint8)
            base = np.cumsum(sizes) - sizes
            windows = sizes - length + 1
            at = spread(base, windows)
            owner = np.repeat(np.arange(len(alone)), windows)
            offset = rel[part[alone]].astype(np.int64)[owner] - (at - base[owner])  # of the anchor in the window
            mine = offset % share[alone[owner]] == turn[alone[owner]]
            owner, at, offset = owner[mine], at[mine], offset[mine]
            bucket = group[owner] * (length + 1) + offset
            gone = later_windows(data, at, bucket, owner, length)
            owner, at = owner[gone], at[gone]
            doc.append(part[alone[owner]])
            start.append(lo[part[alone[owner]]] + at - base[owner])
            end.append(start[-1] + length)
        doc, start, end = np.concatenate(doc), np.concatenate(start), np.concatenate(end)
        by = np.lexsort((start, ids[doc]))
        doc, start, end = doc[by], start[by], end[by]
        out: dict[str, list] = {"doc_id": [], "batch": [], "starts": [], "ends": []}
        edge = np.flatnonzero(np.concatenate([[True], ids[doc][1:] != ids[doc][:-1]])) if len(doc) else []
        for a, b in zip(edge, [*edge[1:], len(doc)] if len(doc) else []):
            s, e = merged(start[a:b], end[a:b])
            out["doc_id"].append(int(ids[doc[a]]))
            out["batch"].append(int(batch[doc[a]]))
            out["starts"].append(s.astype(np.int32))
            out["ends"].append(e.astype(np.int32))
        lists = {k: pa.array(out[k], pa.list_(pa.int32())) for k in ("starts", "ends")}
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "batch": pa.array(out["batch"], pa.int32()), **lists})

    found = part.select("batch", "doc_id", "text").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(occurrences, OCCURRENCES)
    return found.repartition(max(1, -(-total // TASK_BYTES)), "cell").groupBy("cell").applyInArrow(spans, SPANS)


def _by_document(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    got: dict[int, list] = {}
    for d, s, e in zip(table.column("doc_id").to_pylist(), table.column("starts").to_pylist(), table.column("ends").to_pylist()):
        x = got.setdefault(d, [[], []])
        x[0] += s
        x[1] += e
    return {d: merged(np.array(s, np.int64), np.array(e, np.int64)) for d, (s, e) in got.items()}


def without(text, start: np.ndarray, end: np.ndarray) -> bytes:
    edge = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
    return b"".join(bytes(text[edge[i] : edge[i + 1]]) for i in range(0, len(edge), 2))


def repeat_report(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends): what ``drop_repeats`` removes.

    A null text is empty; of repeated doc_ids the smallest text counts (null first) and rows without doc_id
    are left out; texts shorter than ``length`` lose nothing; other columns aren't read.
    """
    import hashlib

    part, _, total = batched(docs)

    def report(key, table, spans):
        release()
        table = one_of_each(table)
        cut, none = _by_document(spans), (np.zeros(0, np.int64),) * 2
        ids, texts = table.column("doc_id").to_pylist(), text_buffers(table.column("text"))
        got = [cut.get(d, none) for d in ids]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([int((e - s).sum()) for s, e in got], pa.int64()), "n_spans": pa.array([len(s) for s, _ in got], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(without(t, s, e)).hexdigest() for t, (s, e) in zip(texts, got)], pa.string()),
            "starts": pa.array([s for s, _ in got], pa.list_(pa.int64())), "ends": pa.array([e for _, e in got], pa.list_(pa.int64())),
        })

    return part.groupBy("batch").cogroup(repeated_spans(part, total, length).groupBy("batch")).applyInArrow(
        report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    )


def drop_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; every row stays, those without doc_id as they are.

    Of rows that share a doc_id only those with its smallest text are cut (see ``repeat_report``).

    A character of which only a part is left goes as well. Columns may have any names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = {c: f"c{i}" for i, c in enumerate(others)}
    part, _, total = batched(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(a) for c, a in inner.items()]), list(inner.values()))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text"], *[T.StructField(inner[c], docs.schema[c].dataType) for c in others]])

    def cut_out(key, table, spans):
        release()
        cut = _by_document(spans)
        texts = text_buffers(table.column("text"))
        new = table.column("text").to_pylist()
        ids = table.column("doc_id").to_pylist()
        smallest: dict = {}  # the text that stands for a repeated doc_id; None first
        for d, x in zip(ids, new):
            if d in cut:
                smallest[d] = x if d not in smallest else None if x is None or smallest[d] is None else min(x, smallest[d])
        for i, d in enumerate(ids):
            if d in cut and new[i] is not None and new[i] == smallest[d]:
                new[i] = without(texts[i], *cut[d]).decode("utf-8", "ignore")
        return table.set_column(table.schema.get_field_index("text"), "text", pa.array(new, pa.string())).select(["doc_id", "text", *inner.values()])

    out = part.groupBy("batch").cogroup(repeated_spans(part, total, length).groupBy("batch")).applyInArrow(cut_out, schema)
    out = out.unionByName(docs.where("doc_id is null").select("doc_id", "text", *[F.col(f"`{c}`").alias(a) for c, a in inner.items()]))
    return out.select("doc_id", "text", *[F.col(a).alias(c) for c, a in inner.items()]).select(*[f"`{c}`" for c in docs.columns])

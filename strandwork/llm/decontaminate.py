"""Benchmark decontamination by the q-gram lemma.

Texts are compared with A-Z and other letters lower-cased and each run of white space as one space.
An item of m characters that occurs with at most e edits shares at least T = (m - q + 1) - q * e of its
q-grams with the text, all within e + 1 neighbouring diagonals (place in the text minus place in the item).
Bands of 2 * (e + 1) diagonals that overlap by half hold any such stretch whole, so shared q-grams
are counted for each item and band, bands of at least T are kept, and each is verified by banded alignment
of the whole item against the stretch. The bound makes the filter lossless within the edit budget.
Items of over LONG characters are looked for in overlapping pieces too, with the same lemma and alignment, so that excerpts
of them are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.session import ship_package, small_arrow_batches

from .kernels import U64, chunks, mix

Q = 10
EDIT_RATE = 0.08
LONG = 400  # characters; longer items are looked for in pieces too
PIECE = 300  # characters of a piece; one begins every PIECE / 2, so PIECE * 3 / 2 characters in a row hold one whole
BLOCK_BYTES = 4 << 20  # of benchmark text that is sent to the workers at once
ALIGNED_CELLS = 1 << 20  # of bands that are aligned at once
HITS = "doc_id long, item_id long, start_char long, end_char long, edits long"

_WHITE = np.zeros(0x3002, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_BLOOM_BITS = 22


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def normal_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the compared form, the place in ``text`` of each)."""
    codes = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    white = _WHITE[np.minimum(codes, 0x3001)]
    keep = np.flatnonzero(~white | ~np.concatenate([[False], white[:-1]]))
    return np.where(white, np.uint32(32), codes)[keep], keep


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points from each place, put together from stretches whose widths are powers of two."""
    if len(codes) < q:
        return np.zeros(0, U64)
    n, out, at, width = len(codes) - q + 1, np.zeros(len(codes) - q + 1, U64), 0, 1
    part = codes.astype(U64) + U64(1)
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                out = out * U64(0xD6E8FEB86659FD93) + part[at : at + n] * U64(0x9FB21C651E98DF25 + 2 * width)
                at += width
            if width * 2 > q:
                return mix(out)
            part = part[:-width] * U64(0xC2B2AE3D27D4EB4F) + part[width:]
            width *= 2


class Items:
    """The benchmark's q-grams with their postings, and the edit budget of each item.

    Pieces of long items stand after the items as items of their own; ``of`` is the item that each belongs to.
    """

    def __init__(self, rows: list[tuple[int, str]], q: int, rate: float) -> None:
        self.q = q
        self.ids, self.codes = [], []
        for i, t in rows:
            c = normal_codes(t.strip())[0]
            if len(c):
                self.ids.append(i)
                self.codes.append(c)
        self.of = list(range(len(self.codes)))
        for k, c in enumerate(self.codes[:]):
            if len(c) > LONG:
                starts = [*range(0, len(c) - PIECE, PIECE // 2), len(c) - PIECE]
                self.codes += [c[a : a + PIECE] for a in starts]
                self.of += [k] * len(starts)
        m = np.array([len(c) for c in self.codes], np.int64)
        # the lemma needs T >= 1; items shorter than q are looked for as they are
        self.edits = np.maximum(0, np.minimum((m * rate).astype(np.int64), (m - q) // q))
        self.need = np.maximum(1, m - q + 1 - q * self.edits)
        self.m = m
        g = [grams(c, q) for c in self.codes]
        keys = np.concatenate(g) if g else np.zeros(0, U64)
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        at = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[by], return_index=True, return_counts=True)
        self.item, self.at = item[by].astype(np.int64), at[by].astype(np.int64)
        self.bloom = np.zeros(1 << _BLOOM_BITS, bool)
        self.bloom[(self.keys >> U64(64 - _BLOOM_BITS)).astype(np.int64)] = True
        self.short = [k for k in range(len(self.m)) if self.m[k] < q]
        # added to diagonals, so that none is negative
        self.shift = 1 << (int(self.m.max(initial=0)) + int(self.edits.max(initial=0)) + 1).bit_length()

    def candidates(self, codes: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first diagonal) of the bands with enough shared q-grams. edge: where documents begin."""
        none = (np.zeros(0, np.int64),) * 3
        h = grams(codes, self.q)
        pos = np.flatnonzero(self.bloom[(h >> U64(64 - _BLOOM_BITS)).astype(np.int64)]) if len(h) and len(self.keys) else none[0]
        k = np.searchsorted(self.keys, h[pos])
        ok = k < len(self.keys)
        ok[ok] = self.keys[k[ok]] == h[pos[ok]]
        pos, k = pos[ok], k[ok]
        doc = np.searchsorted(edge, pos, "right") - 1
        inside = pos + self.q <= edge[doc + 1]
        pos, k, doc = pos[inside], k[inside], doc[inside]
        n = self.count[k]
        if not len(n):
            return none
        entry = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, pos = self.item[entry], np.repeat(pos, n)
        step = self.edits[item] + 1
        diag = pos - self.at[entry] + self.shift
        band = diag // step
        # a hit counts in the band that begins at its step and in the one before
        key = (item << 42) | band
        keys, n = np.unique(key, return_counts=True)
        after = np.searchsorted(keys, keys + 1)
        after = np.where((after < len(keys)) & (keys[np.minimum(after, len(keys) - 1)] == keys + 1), n[np.minimum(after, len(keys) - 1)], 0)
        before_key = keys - 1
        lone = ~np.isin(before_key, keys, assume_unique=True)
        all_keys = np.concatenate([keys, before_key[lone]])
        all_n = np.concatenate([n + after, n[lone]])
        item = all_keys >> 42
        good = all_n >= self.need[item]
        item, band = item[good], all_keys[good] & ((1 << 42) - 1)
        low = band * (self.edits[item] + 1) - self.shift
        # the band may begin in the document before: every document that it touches is tried
        out = []
        for i, d in zip(item.tolist(), low.tolist()):
            a = max(0, int(np.searchsorted(edge, max(0, d - int(self.edits[i])), "right")) - 1)
            b = int(np.searchsorted(edge, min(d + 2 * int(self.edits[i]) + 2 + int(self.m[i]), int(edge[-1]) - 1), "right")) - 1
            out += [(x, i, d) for x in range(a, b + 1)]
        return tuple(np.array(out, np.int64).T) if out else none

    def verify(self, codes: np.ndarray, edge: np.ndarray, doc: np.ndarray, item: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, edits) of the bands in which the item occurs within its budget."""
        by = np.argsort(self.m[item], kind="stable")  # those aligned together are about as long as each other
        doc, item, low = doc[by], item[by], low[by]
        # cells of a row of the tables, and of the items side by side, that are held at once
        cells = np.maximum(4 * self.edits[item] + 3, self.m[item])
        out, a = [], 0
        while a < len(doc):
            b = a + 1
            while b < min(len(doc), a + 256) and (b + 1 - a) * cells[b] <= ALIGNED_CELLS:
                b += 1
            out += self._align(codes, edge, doc[a:b], item[a:b], low[a:b])
            a = b
        return out

    def _align(self, codes, edge, doc, item, low):
        if not len(doc):
            return []
        e, m = self.edits[item], self.m[item]
        low = low - e
        width = int((4 * e + 3).max())
        rows = int(m.max())
        lo, hi = edge[doc], edge[doc + 1]
        big, unit = np.int64(1 << 60), np.int64(1 << 30)
        k = np.arange(width)
        start = low[:, None] + k  # of the stretch, if it begins on that diagonal
        fine = (start >= lo[:, None]) & (start <= hi[:, None]) & (k < (4 * e + 3)[:, None])
        d = np.where(fine, k, big)  # edits * unit + the diagonal on which it began
        best = np.full(len(doc), big)
        best_end = np.zeros(len(doc), np.int64)
        pattern = np.zeros((len(doc), rows), np.uint32)
        for r, i in enumerate(item.tolist()):
            pattern[r, : self.m[i]] = self.codes[i]
        for row in range(1, rows + 1):
            at = low[:, None] + (row - 1) + k  # the text character that diagonal k takes in this row
            inside = (at >= lo[:, None]) & (at < hi[:, None])
            char = codes[np.clip(at, 0, len(codes) - 1)]
            d2 = np.where(inside, d + unit * (char != pattern[:, row - 1, None]), big)
            d2[:, :-1] = np.minimum(d2[:, :-1], d[:, 1:] + unit)  # the item has a character more
            d2 = np.minimum.accumulate(d2 - k * unit, axis=1) + k * unit  # the text has characters more
            end = low[:, None] + row + k
            d = np.where((end >= lo[:, None]) & (end <= hi[:, None]), d2, big)
            done = np.flatnonzero(m == row)
            if len(done):
                j = np.argmin(d[done], axis=1)
                best[done] = d[done, j]
                best_end[done] = low[done] + row + j
        got = np.flatnonzero(best < (e + 1) * unit)
        return [(int(doc[r]), int(item[r]), int(low[r] + best[r] % unit), int(best_end[r]), int(best[r] // unit)) for r in got.tolist()]


def find_in(texts: list[str], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) in characters of the text; of overlapping finds of an item the closest, and
    those of its pieces only where none of the whole is."""
    for a, b in chunks([len(t) for t in texts], 1 << 18):
        part = texts[a:b]
        joined = "\n".join(part) + "\n"
        codes, origin = normal_codes(joined)
        begins = np.cumsum([0] + [len(t) + 1 for t in part])
        edge = np.searchsorted(origin, begins)
        found = items.verify(codes, edge, *items.candidates(codes, edge))
        for i in items.short:
            found += [(d, i, s, s + int(items.m[i]), 0) for d in range(len(part)) for s in _exact(codes, int(edge[d]), int(edge[d + 1]), items.codes[i])]
        last: dict[tuple[int, int], int] = {}
        found = [(d, items.of[i], items.of[i] != i, s, e, n) for d, i, s, e, n in found]
        for d, i, _, s, e, n in sorted(found, key=lambda x: (x[0], x[1], x[2], x[5], x[3], x[4])):
            spans = last.setdefault((d, i), [])
            if all(e <= x or s >= y for x, y in spans):
                spans.append((s, e))
                yield a + d, i, int(origin[s] - begins[d]), int(origin[e - 1] + 1 - begins[d]), n


def _exact(codes: np.ndarray, lo: int, hi: int, item: np.ndarray) -> list[int]:
    ok = np.ones(max(0, hi - lo - len(item) + 1), bool)
    for k, c in enumerate(item.tolist()):
        ok &= codes[lo + k : lo + k + len(ok)] == c
    return (lo + np.flatnonzero(ok)).tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, edits): places of ``docs`` where a benchmark item occurs.

    An item occurs where a stretch of the text is within floor(edit_rate * its length) edits of it (fewer for
    items so short that the lemma would find nothing; items shorter than q must occur as they are). Of an item of over LONG
    characters a piece of PIECE characters is enough: the row is then the piece's place and its edits. Null or
    blank items never occur and null texts hold none; rows of repeated ids are judged each on their own. The benchmark is
    sent to the workers in blocks of at most BLOCK_BYTES (one longer item is a block of its own; pieces count), each against all rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_arrow_batches(spark)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text") * F.when(F.length("text") > LONG, 3).otherwise(1))).first()[0] or 0
    blocks = -(-total // (BLOCK_BYTES // 2)) or 1
    out = None
    for block in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().orderBy("item_id", "text").collect()]
        sent = spark.sparkContext.broadcast(rows)

        def search(batches, sent=sent):
            index = Items(sent.value, q, edit_rate)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                got = list(find_in([t or "" for t in batch.column(1).to_pylist()], index)) if index.ids else []
                cols = list(zip(*[(ids[d], index.ids[i], s, e, n) for d, i, s, e, n in got])) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start_char", "end_char", "edits"])

        hits = docs.select("doc_id", "text").mapInArrow(search, HITS)
        out = hits if out is None else out.unionByName(hits)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` without the documents in which a benchmark item occurs; rows without doc_id stay."""
    hit = contamination(docs, benchmark, q, edit_rate).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, docs.doc_id == hit.hit_id, "left_anti")

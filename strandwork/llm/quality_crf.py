"""Document quality by a linear-chain conditional random field over lines.

Every line with a word gets features of its own and of the lines before and after it; the chain labels each
line good or bad. A document's quality is the mean of its lines' forward-backward marginals, weighted by
their lengths, put through a logistic curve fitted to the labels. Lines have no labels of their own: each starts
with its document's, and lines of bad documents that the first fit finds surely good are turned before the second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandwork.session import materialize, ship_package, small_arrow_batches

from .kernels import _SPACE, U64, chunks, mix, prefix_hash, slice_hash, text_buffers

TRAIN_DOCS = 4000  # labelled documents that the model is fitted on, at most; taken by hash of doc_id
TRAIN_LINES = 256_000  # lines of all of them: whole documents are taken until there are as many, the first of each label always
BLOCK = 256  # places of a longer chain are passed in blocks of so many at once
KEEP_FROM = 0.3

_CLASS = np.zeros((6, 256), np.int32)
_CLASS[0, [ord(c) for c in "#*$%&<>"]] = 1
_CLASS[1, ord("|")] = 1
_CLASS[2, ord("!")] = 1
_CLASS[3, 65:91] = 1
_CLASS[4, 48:58] = 1
_CLASS[5, 128:256] = 1
N_FEATURES = 12


def line_features(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (features of its lines with a word, their lengths in bytes)."""
    out = []
    for a, b in chunks([len(t) for t in texts]):
        part = texts[a:b]
        data = np.frombuffer(b"\n".join(bytes(t) for t in part) + b"\n", np.uint8)
        doc_edge = np.cumsum([0] + [len(t) + 1 for t in part])
        end = np.flatnonzero(data == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        space = _SPACE[data]
        ws = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        we = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        line = np.searchsorted(start, ws, "right") - 1
        words = np.bincount(line, minlength=len(start)).astype(float)
        h = mix(slice_hash(prefix_hash(data), ws, we)) if len(ws) else np.zeros(0, U64)
        doc = np.searchsorted(doc_edge, ws, "right") - 1
        again = np.zeros(len(ws), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        length = (end - start).astype(float)
        per = np.maximum(words, 1)
        count = []
        for c in _CLASS:
            total = np.concatenate([[0], np.cumsum(c[data], dtype=np.int64)])
            count.append(total[end] - total[start])
        repeats = np.bincount(line, weights=again, minlength=len(start))
        begins = data[np.minimum(start, len(data) - 1)]
        closes = data[np.maximum(end - 1, 0)]
        f = np.stack([
            np.minimum(count[0] / per, 3), np.minimum(count[1] / per, 2), np.minimum(count[2] / per, 3), count[3] / np.maximum(length, 1), count[4] / np.maximum(length, 1),
            count[5] / np.maximum(length, 1), repeats / per, np.log1p(words) / 5, np.minimum(length / per, 30) / 10, (begins >= 97) & (begins <= 122), (closes == 46) | (closes == 63),
            np.minimum(length / per, 60) > 20,
        ], 1).astype(np.float32)
        cut = np.searchsorted(start, doc_edge)
        for i in range(len(part)):
            lo, hi = int(cut[i]), int(cut[i + 1])
            with_word = np.flatnonzero(words[lo:hi] > 0) + lo
            out.append((f[with_word], length[with_word]))
    return out


def with_neighbours(f: np.ndarray) -> np.ndarray:
    """[1, own features, the line before's, the line after's]; none beyond the ends."""
    none = np.zeros((1, N_FEATURES), np.float32)
    return np.concatenate([np.ones((len(f), 1), np.float32), f, np.concatenate([none, f[:-1]]), np.concatenate([f[1:], none])], 1) if len(f) else np.zeros((0, 1 + 3 * N_FEATURES), np.float32)


class Chains:
    """Forward and backward passes over many chains at once; each step takes one place of every block.

    A chain of more than BLOCK places is cut into blocks. What enters a block is the product of the 2 x 2 maps of those
    before it, so the steps of a long chain are about three blocks and the number of its blocks.
    """

    def __init__(self, sizes: list[int]) -> None:
        size = np.array(sizes, np.int64)
        count = -(-size // BLOCK)
        chain, self.cut = np.repeat(np.arange(len(size)), count), np.cumsum(size)[:-1]
        nth = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
        self.at = (np.cumsum(size) - size)[chain] + nth * BLOCK
        self.size = np.minimum(BLOCK, size[chain] - nth * BLOCK)
        self.order = np.argsort(-self.size, kind="stable")
        self.longest = int(self.size.max(initial=0))
        self.alive = self._alive(self.size[self.order])
        # (blocks by size whose map is used, those of each level, the step to the block that they lead to)
        left = count[chain] - 1 - nth
        self.ways = [self._way(np.flatnonzero(left > 0), nth, 1), self._way(np.flatnonzero(nth > 0), left, -1)]

    def _alive(self, size: np.ndarray) -> list[int]:
        return [int(np.searchsorted(-size, -k, "left")) for k in range(int(size.max(initial=0)) + 1)]  # those longer than k

    def _way(self, blocks: np.ndarray, level: np.ndarray, step: int) -> tuple[np.ndarray, list[np.ndarray], int]:
        blocks = blocks[np.argsort(-self.size[blocks], kind="stable")]
        by = np.argsort(level[blocks], kind="stable")
        return blocks, np.split(by, np.flatnonzero(np.diff(level[blocks][by])) + 1) if len(by) else [], step

    def _enter(self, e: np.ndarray, a: np.ndarray, way) -> np.ndarray:
        """The message into the first place of each block in this direction; 0 at an end of a chain."""
        blocks, levels, step = way
        into = np.ones((2, len(self.at)))
        if not len(blocks):
            return np.zeros(len(self.at))
        size = self.size[blocks]
        first = self.at[blocks] if step > 0 else self.at[blocks] + size - 1
        maps = np.repeat(np.eye(2)[:, :, None], len(blocks), axis=2)
        for k, n in enumerate(self._alive(size)[:-1]):
            up, low = maps[0, :, :n] * np.exp(e[first[:n] + step * k]), maps[1, :, :n]
            new = np.stack([a[0, 0] * up + a[0, 1] * low, a[1, 0] * up + a[1, 1] * low])
            maps[:, :, :n] = new / new.max(axis=(0, 1))
        for some in levels:
            v = np.einsum("abn,bn->an", maps[:, :, some], into[:, blocks[some]])
            into[:, blocks[some] + step] = v / v.sum(axis=0)
        return np.log(into[0] / into[1])

    def messages(self, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of state 1 from the places up to each one, and from those after it. e holds emission
        log-odds, chain after chain; t log weights of transitions."""
        fwd, bwd = np.zeros(len(e)), np.zeros(len(e))
        x = np.exp(t)
        ahead = self._enter(e, np.array([[x[1, 1], x[0, 1]], [x[1, 0], x[0, 0]]]), self.ways[0])[self.order]
        behind = self._enter(e, np.array([[x[1, 1], x[1, 0]], [x[0, 1], x[0, 0]]]), self.ways[1])
        first = self.at[self.order]
        for k in range(self.longest):
            at = first[: self.alive[k]] + k
            if k == 0:
                r = e[at] + ahead
            else:
                r = r[: len(at)]
                r = e[at] + np.logaddexp(r + t[1, 1], t[0, 1]) - np.logaddexp(r + t[1, 0], t[0, 0])
            fwd[at] = r
        bwd[self.at + self.size - 1] = behind
        for k in range(self.longest - 2, -1, -1):
            at = first[: self.alive[k + 1]] + k
            s = e[at + 1] + bwd[at + 1]
            bwd[at] = np.logaddexp(s + t[1, 1], t[1, 0]) - np.logaddexp(s + t[0, 1], t[0, 0])
        return fwd, bwd


def marginal_logits(emission: list[np.ndarray], t: np.ndarray) -> list[np.ndarray]:
    """Log-odds of state 1 at each place of each chain."""
    if not emission:
        return []
    chains = Chains([len(x) for x in emission])
    fwd, bwd = chains.messages(np.concatenate(emission), t)
    return np.split(fwd + bwd, chains.cut)


def fit_chain(x: list[np.ndarray], y: list[np.ndarray], steps: int = 100, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the likelihood of the lines' labels (Adam on the exact gradient)."""
    width = x[0].shape[1]
    flat, label = np.concatenate(x), np.concatenate(y)
    pair = [np.stack([v[:-1], v[1:]], 1) for v in y if len(v) > 1]
    pair = np.concatenate(pair) if pair else np.zeros((0, 2), int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (pair[:, 0], pair[:, 1]), 1)
    size = [len(v) for v in x]
    chains = Chains(size)
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(size) - 1] = False
    left = np.flatnonzero(inner)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, steps + 1):
        w, t = theta[:width], theta[width:].reshape(2, 2)
        e = np.clip(flat @ w, -30, 30)
        fwd, bwd = chains.messages(e, t)
        p = 1 / (1 + np.exp(-np.clip(fwd + bwd, -40, 40)))
        # P(right = b | left = a) from what is right of a place; with the left marginal it gives the pairs
        back = bwd[left + 1] + e[left + 1]
        one = 1 / (1 + np.exp(-np.clip(back + (t[1, 1] - t[1, 0]), -40, 40)))
        zero = 1 / (1 + np.exp(-np.clip(back + (t[0, 1] - t[0, 0]), -40, 40)))
        pl = p[left]
        want = np.array([[((1 - pl) * (1 - zero)).sum(), ((1 - pl) * zero).sum()], [(pl * (1 - one)).sum(), (pl * one).sum()]])
        g = np.concatenate([flat.T @ (label - p), (seen - want).ravel()]) / len(flat) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:width], theta[width:].reshape(2, 2)


class Model:
    """score(texts) -> P(good) of each."""

    def __init__(self, w, t, curve, prior: float) -> None:
        self.w, self.t, self.curve, self.prior = w, t, curve, prior

    def goodness(self, lines: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        e = [np.clip(with_neighbours(f) @ self.w, -30, 30) for f, _ in lines]
        p = [1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in marginal_logits(e, self.t)]
        return np.array([float((q * n).sum() / n.sum()) if len(q) else np.nan for q, (_, n) in zip(p, lines)])

    def score(self, texts: list) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.prior)
        m = self.goodness(line_features(texts))
        return np.where(np.isnan(m), self.prior, _curve(self.curve, m))


def _stretch(m: np.ndarray) -> np.ndarray:
    m = np.clip(m, 1e-4, 1 - 1e-4)
    return np.log(m / (1 - m))


def _curve(c: tuple[float, float], m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(c[0] + c[1] * _stretch(np.nan_to_num(m, nan=0.5)), -40, 40)))


def train(lines: list[tuple[np.ndarray, np.ndarray]], quality: list[int]) -> Model:
    prior = float(np.mean(quality)) if quality else 1.0
    some = [k for k, (f, _) in enumerate(lines) if len(f)]
    if len({quality[k] for k in some}) < 2:
        return Model(None, None, None, prior)
    x, label = [with_neighbours(lines[k][0]) for k in some], np.array([quality[k] for k in some])
    y = [np.full(len(v), q) for v, q in zip(x, label)]
    w, t = fit_chain(x, y)
    for k, q in enumerate(label):
        if q == 0:
            p = marginal_logits([np.clip(x[k] @ w, -30, 30)], t)[0]
            good = p > 2
            if not good.all():
                y[k] = np.where(good, 1, 0)
    w, t = fit_chain(x, y)
    model = Model(w, t, (0.0, 1.0), prior)
    z = np.stack([np.ones(len(some)), _stretch(model.goodness([lines[k] for k in some]))], 1)
    c = np.array([0.0, 1.0])
    for _ in range(30):  # Newton's method with a weak pull to the start
        p = 1 / (1 + np.exp(-np.clip(z @ c, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(2)
        c = c + np.linalg.solve(h, z.T @ (label - p) - 0.5 * (c - np.array([0.0, 1.0])))
    model.curve = (float(c[0]), max(float(c[1]), 1e-3))
    return model


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS) -> Model:
    """A model from the whole texts of at most ``sample`` labelled documents outside fold 0, fewer if they are long
    (TRAIN_LINES). Repeated labels count as their smallest."""
    ship_package(docs.sparkSession)
    small_arrow_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(fold("doc_id") != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` pairs of numbers
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")

    def features(batches):
        for batch in batches:
            texts = text_buffers(batch.column(1))
            for a, b in chunks([len(t) for t in texts]):
                lines = line_features(texts[a:b])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], batch.column(2)[a:b].cast(pa.int32()), pa.array([len(n) for _, n in lines], pa.int64()),
                    pa.array([f.astype(np.float32).tobytes() for f, _ in lines], pa.binary()), pa.array([n.tobytes() for _, n in lines], pa.binary()),
                ], names=["doc_id", "quality", "n_lines", "f", "n"])

    found = materialize(picked.mapInArrow(features, "doc_id long, quality int, n_lines long, f binary, n binary"), "features")
    sizes = found.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.sum("n_lines").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most ``sample`` rows
    taken, total, seen = [], 0, set()
    for r in sizes:
        label = int(r[1] > 0)
        if total < TRAIN_LINES or (label not in seen and r[2]):
            taken.append(r[0])
            total += r[2]
            if r[2]:
                seen.add(label)
    if len(taken) < len(sizes):
        found = found.where(F.col("doc_id").isin(taken))
    rows = sorted(found.select("doc_id", "quality", "f", "n").collect(), key=lambda r: (r[0], bytes(r[2])))
    lines = [(np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r[3], np.float64)) for r in rows]
    return train(lines, [int(r[1] > 0) for r in rows])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name``: P(good), 0 to 1. A text without words (null too) gets the share of good labels."""
    ship_package(docs.sparkSession)
    small_arrow_batches(docs.sparkSession)
    others = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(F.col("text").alias("t"), *[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, others)])

    def run(batches):
        for batch in batches:
            s = model.score(text_buffers(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), *batch.columns[1:]], names=["s", *others])

    out = plain.mapInArrow(run, T.StructType([T.StructField("s", T.DoubleType()), *plain.drop("t").schema.fields]))
    return out.select(*[F.col(a).alias(c) for c, a in zip(docs.columns, others)], F.col("s").alias(name))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at least KEEP_FROM; columns may have any names."""
    name = "s" + "_" * max(len(c) for c in docs.columns)
    return score(docs, fit(docs, labels), name).where(F.col(name) >= KEEP_FROM).drop(name)

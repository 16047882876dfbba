"""Token ids of whole texts by a vocabulary file of the tokenizers library, at the speed of a word cache.

The library splits a text before its merges run, and a single space or line break between two characters
that aren't white space is always such a split. So the ids of a text are those of its pieces one after the
other, and pieces recur: their words, without marks behind them, are encoded by the library once for each worker and
kept in a bounded cache. Splitting and telling pieces apart is done on Arrow columns, so only a group's distinct words are looked up.
A text with any other run of white space is encoded whole. Steps that lean on what a vocabulary does to letters
(lowering before the cache, cutting marks off a word, encoding many words as one text) are only taken for plain
letters, whose normal form and lower case are one letter each wherever they stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernels import spread

CACHE_PIECES = 800_000
MARKS = ".,;:!?|*#$%&"
# up to Latin Extended-B nothing composes with a neighbour; U+0130 lowers to two characters
UNSAFE = re.compile("[^\x00-\u012f\u0131-\u024f]")


def _plain_letter(c: str) -> bool:
    return c.isalpha() and not UNSAFE.match(c)


PLAIN_LETTERS = pa.array([chr(c) for c in range(0x250) if _plain_letter(chr(c))], pa.large_string())


class _Numbers(dict):
    """Numbers strings in the order in which they are first asked for; ``new`` holds those since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, p: str) -> int:
        n = self[p] = len(self)
        self.new.append(p)
        return n


class Encoder:
    """encode(texts) -> (ids of all texts one after the other, number of ids of each text)."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._borders()
        self.clear()

    def _borders(self) -> None:
        """How ids tell where a word begins or ends, if the vocabulary keeps that."""
        tokens = lambda t: self.tokenizer.encode(t, add_special_tokens=False).tokens
        texts = [self.tokenizer.id_to_token(i) or "x" for i in range(self.tokenizer.get_vocab_size())]
        self.opens = self.closes = None
        if tokens("a b\nc") == ["a", "\u0120b", "\u010a", "c"]:
            self.opens = np.array([t[0] in "\u0120\u010a" for t in texts])
        elif tokens("a b\nc") == ["a</w>", "b</w>", "c</w>"]:
            self.closes = np.array([t.endswith("</w>") for t in texts])
        self.lower = tokens("Ab") == tokens("ab") and self.closes is not None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def clear(self) -> None:
        self.known = _Numbers()
        self.tails: dict[str, list[int]] = {"": []}
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and number for each word): many are encoded as one text where their borders can be told from the ids."""
        plain = lambda w: w[1:].isalpha() and (w.isascii() or not UNSAFE.search(w))
        joined, alone = [], []
        for k, w in enumerate(words):
            (joined if self.opens is not None or self.closes is not None and plain(w) else alone).append(k)
        many = ["".join([words[k] for k in joined[a : a + 512]]) for a in range(0, len(joined), 512)]
        got = self.tokenizer.encode_batch_fast([*many, *(words[k] for k in alone)], add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in got]
        n = np.zeros(len(words), np.int64)
        order = joined + alone
        if many:
            own = np.concatenate(ids[: len(many)])
            edge = np.append(np.flatnonzero(self.opens[own]), len(own)) if self.opens is not None else np.append(0, np.flatnonzero(self.closes[own]) + 1)
            if len(edge) == len(joined) + 1:
                n[joined] = np.diff(edge)
            else:  # this vocabulary's borders don't tell words: each on its own
                each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[k] for k in joined], add_special_tokens=False)]
                ids[: len(many)] = each
                n[joined] = [len(x) for x in each]
        n[alone] = [len(x) for x in ids[len(ids) - len(alone) :]]
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), start, n

    def _learn(self, words: list[str]) -> None:
        """Add words; size -1 marks one that doesn't stand between single spaces or line breaks."""
        size, start = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        good = []
        for k, w in enumerate(words):
            inner = w.strip()
            if inner and (inner == w or w[0] == "\n" and len(inner) == len(w) - 1):
                good.append(k)
        if good:
            ids, begin, n = self._ids_of([words[k] if words[k][0] == "\n" else " " + words[k] for k in good])
            size[good], start[good] = n, len(self.ids) + begin
            self.ids = np.concatenate([self.ids, ids])
        self.size, self.start = np.concatenate([self.size, size]), np.concatenate([self.start, start])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each piece, -1 as in ``_learn``) of distinct pieces.

        Marks after a plain letter are split from it in any case, so a piece is its word and its tail of marks.
        """
        word = pc.utf8_rtrim(pieces, MARKS)
        word = pc.if_else(pc.is_in(pc.utf8_slice_codeunits(word, -1), value_set=PLAIN_LETTERS), word, pieces)
        distinct = word.dictionary_encode()
        names = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        of = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        of = of[distinct.indices.to_numpy()]
        size, start = self.size[of], self.start[of]
        odd = size < 0
        size = np.maximum(size, 0)
        marks = pc.subtract(pc.binary_length(pieces), pc.binary_length(word)).to_numpy()
        cut = np.flatnonzero((marks > 0) & ~odd)
        tails = [p[-k:] for p, k in zip(pieces.take(pa.array(cut)).to_numpy(zero_copy_only=False).tolist(), marks[cut].tolist())]
        new = list(dict.fromkeys(t for t in tails if t not in self.tails))
        for t, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.tails[t] = e.ids
        more = np.zeros(len(pieces), np.int64)
        tail = [self.tails[t] for t in tails]
        more[cut] = [len(t) for t in tail]
        total = size + more
        begin = np.cumsum(total) - total
        ids = np.empty(int(total.sum()), np.uint32)
        ids[spread(begin, size)] = self.ids[spread(start, size)]
        ids[spread((begin + size)[cut], more[cut])] = np.array([i for t in tail for i in t], np.uint32)
        total[odd] = -1
        return ids, total

    def _lowered(self, t: str) -> str:
        """The text in lower case where the vocabulary does just that, so that fewer pieces are kept; else as it is."""
        if not t.isascii() and UNSAFE.search(t):
            return t
        low = t.lower()
        return t if any(x in low for x in self.special) else low

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_PIECES or len(self.tails) > CACHE_PIECES:
            self.clear()
        if self.lower:
            texts = [self._lowered(t) for t in texts]
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        edge = split.offsets.to_numpy().astype(np.int64)
        every = split.flatten()
        # a first piece follows no space: it goes to the library as it is, with no cache
        inner = np.ones(len(every), bool)
        inner[edge[:-1]] = False
        heads = every.take(pa.array(edge[:-1])).to_pylist()
        pieces = every.filter(pa.array(inner)).dictionary_encode()
        edge -= np.arange(len(edge))
        counts = np.diff(edge)
        ids, size = self._pieces(pieces.dictionary)
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        at = pieces.indices.to_numpy()
        size, start = size[at], start[at]
        odd = np.flatnonzero(size < 0)
        plain = np.ones(len(texts), bool)
        plain[np.searchsorted(edge, odd, "right") - 1] = False
        for i, h in enumerate(heads):
            if plain[i] and h and (h[0].isspace() or h[-1].isspace()) or not h and counts[i]:
                plain[i] = False
        size = np.maximum(size, 0)
        flat = ids[spread(start, size)]
        cut = np.concatenate([[0], np.cumsum(size)])[edge]
        first = self.tokenizer.encode_batch_fast([h if plain[i] else texts[i] for i, h in enumerate(heads)], add_special_tokens=False)
        parts, n = [], []
        for i, e in enumerate(first):
            parts.append(np.array(e.ids, np.uint32))
            n.append(len(e.ids))
            if plain[i]:
                parts.append(flat[cut[i] : cut[i + 1]])
                n[-1] += cut[i + 1] - cut[i]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(n, np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def groups(texts: list[str], limit: int = 1 << 20):
    """Ranges of texts of about ``limit`` characters, so that the arrays in work stay small."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def vocabulary(name: str) -> str:
    """Where the public tokenizers' file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)

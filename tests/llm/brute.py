"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_inside(item, text):
    """Least edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(texts, n, percent):
    """{id: (set size, smallest id reachable)}"""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(texts, length=100):
    """{id: (bytes, removed, spans, sha256 of the rest)}"""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(b[s : s + length])
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = WORD.findall(text)
    count = {}
    for k in range(len(w) - 7):
        count.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {k + j for ks in count.values() if len(ks) > 1 for k in ks for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base_places(text):
    """(n_words, places, first, last, labels)"""
    w = LICENCE_WORD.findall((text or "").translate(LOWER))
    found = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def licence_labels(text, df, n):
    """(labels, score) by trying every template at every start; df, n: documents with each word, and all."""
    from strandwork.llm.license_scan import LEAST_SHARE, SHIFT, TEMPLATES

    w = LICENCE_WORD.findall((text or "").translate(LOWER))
    idf = lambda x: math.log((n + 1) / (df.get(x, 0) + 1)) + 1
    best, found = 0.0, set()
    for label, body, phrases in TEMPLATES:
        body = body.split()
        weight = [idf(x) for x in body]
        for s in range(-len(body) - SHIFT, len(w) + SHIFT):
            near = " " + " ".join(w[max(0, s - SHIFT) : max(0, s + len(body) + SHIFT)]) + " "
            if not all(f" {p} " in near for p in phrases):
                continue
            share = sum(v for i, (x, v) in enumerate(zip(body, weight)) if x in w[max(0, s + i - SHIFT) : max(0, s + i + SHIFT + 1)]) / sum(weight)
            if share >= LEAST_SHARE:
                best = max(best, share)
                found.add(label)
    base = {x for x in base_places(text)[4].split(",") if x}
    return ",".join(sorted(found | base)), best or float(bool(base))


def fits_whole(sizes, room):
    """Whether groups of these sizes (largest first) fit whole into the rooms, by trying all ways."""
    if not sizes:
        return True
    for r in sorted(set(room), reverse=True):
        if r >= sizes[0]:
            left = list(room)
            left[left.index(r)] -= sizes[0]
            if fits_whole(sizes[1:], left):
                return True
    return False


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))

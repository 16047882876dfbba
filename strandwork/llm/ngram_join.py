"""N-gram Jaccard join: multiple-global-order filtering.

Two sets that are similar enough share an element of their prefixes under *every* global order of the
elements. Three orders are used: rarest first (counts over the whole corpus, ties by hash) and two
seeded hash orders. The rare-first order generates candidates, the other two must agree (the filters
are intersected), and what is left is verified on the whole sets.

Candidates aren't emitted as pairs of rows. Documents with the same set are first replaced by the smallest. Those
that share rare-first prefix elements, directly or through others, form a block; only within a block can there be
links. Each document is first compared with one leader, which makes near copies one component. Then every block is dealt to as many
tiles as its size asks for, one for most, and each pair of tiles is compared on its own, except those that hold
only the largest component, so every two documents that aren't known to be connected meet exactly once. A task compares a document with the candidates
that aren't yet in its component and answers with at most one link for each document, which is enough for the components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.session import materialize

from .blocks import batched, counts_of, one_of_each, repeated_keys
from .components import components
from .kernels import mix, release, shingle_sets, spread, text_buffers

SETS = "doc_id long, n long, same binary, set1 array<long>, all array<long>, set3 array<long>"
COPIES = 4096  # equal sets that are linked with their smallest at once, about
FOLLOWERS = 1024  # documents that are compared with one copy of their leader, about
TILE_ELEMENTS = 1 << 19  # of sets that one side of a task holds, about


def prefix_length(n: int, percent: int) -> int:
    """Elements of a set of n that must hold one of any set with Jaccard similarity of percent or more."""
    return n - -(-percent * n // 100) + 1


def _prefixes(docs: DataFrame, n: int, percent: int, total: int) -> DataFrame:
    answers, bits = repeated_keys(docs, lambda t: shingle_sets(t, n), total // 6)

    def prefix(key, table, back):
        release()
        table = one_of_each(table)
        sets = shingle_sets(text_buffers(table.column("text")), n)
        df, _ = counts_of(np.concatenate(sets) if sets else np.zeros(0, np.uint64), back, bits)
        cols: dict[str, list] = {"same": [], "set1": [], "all": [], "set3": []}
        at = 0
        for s in sets:
            c = df[at : at + len(s)]
            at += len(s)
            p = prefix_length(len(s), percent) if len(s) else 0
            if not p or np.count_nonzero(c == 1) >= p:
                for v in cols.values():
                    v.append(None)
                continue
            cols["same"].append(hashlib.md5(s.tobytes()).digest())
            rare = np.lexsort((s, c))[:p]
            rare = rare[c[rare] > 1]
            two, three = mix(s, 2), mix(s, 3)
            cols["set1"].append(s[rare].view(np.int64))
            cols["all"].append(s[np.argsort(two, kind="stable")].view(np.int64))
            cols["set3"].append(s[np.argpartition(three, p - 1)[:p]].view(np.int64))
        lists = {k: pa.array(v, pa.binary() if k == "same" else pa.list_(pa.int64())) for k, v in cols.items()}
        return pa.table({"doc_id": table.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), **lists})

    # without any answer a batch still has its documents: a cogroup keeps groups of either side
    return docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(prefix, SETS)


class _Lists:
    """Lists of numbers one after the other."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.flat = whole.flatten().to_numpy()
        self.size = whole.value_lengths().to_numpy().astype(np.int64)
        self.at = np.cumsum(self.size) - self.size

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.at[k] : self.at[k] + self.size[k]]

    def common(self, mine: np.ndarray, others: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """How many of each other list's (first) numbers are among ``mine``."""
        size = self.size[others] if first is None else np.minimum(first[others], self.size[others])
        values = self.flat[spread(self.at[others], size)]
        sorted_ = np.sort(mine)
        k = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
        hit = np.concatenate([[0], np.cumsum(sorted_[k] == values)])
        edge = np.concatenate([[0], np.cumsum(size)])
        return hit[edge[1:]] - hit[edge[:-1]]


def _linked(rows: np.ndarray, left: np.ndarray, one: _Lists, all_: _Lists, three: _Lists, n: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among ``rows`` (places in the lists) of one block that span its components.

    label: components that are known already; left: which of them are the left side of two tiles; all if there is one tile. Pairs within a component needn't be compared.
    """
    m = len(rows)
    tokens = one.flat[spread(one.at[rows], one.size[rows])]
    owner = np.repeat(np.arange(m), one.size[rows])
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    p = np.array([prefix_length(int(x), percent) for x in n], np.int64)
    comp = np.unique(label[rows], return_inverse=True)[1]
    across = not left.all()
    size = n[rows]
    links = []
    for a in np.flatnonzero(left).tolist():
        if not np.any(comp != comp[a]):
            break
        r = rows[a]
        mine = one.of(r)
        lo, hi = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        c = np.unique(owner[spread(lo, hi - lo)])
        c = c[(~left[c] if across else c > a) & (comp[c] != comp[a])]
        c = c[np.minimum(size[c], size[a]) * 100 >= np.maximum(size[c], size[a]) * percent]
        if len(c):  # the second order
            c = c[all_.common(all_.of(r)[: p[r]], rows[c], p) > 0]
        if len(c):  # the third order
            c = c[three.common(three.of(r), rows[c]) > 0]
        if len(c):
            both = all_.common(all_.of(r), rows[c])
            for x in c[both * 100 >= percent * (size[c] + size[a] - both)].tolist():
                if comp[x] != comp[a]:
                    links.append((a, x))
                    comp[comp == comp[x]] = comp[a]
    return links


def _links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b) from rows (key, block, left, two, doc_id, n, label, set1, all, set3); each key is compared on its own."""

    def compare(key, table):
        release()
        table = table.sort_by([("block", "ascending"), ("doc_id", "ascending")])
        ids, block, n, label = (table.column(c).to_numpy() for c in ("doc_id", "block", "n", "label"))
        left, two = table.column("left").to_numpy(), table.column("two").to_numpy()
        lists = [_Lists(table.column(c)) for c in ("set1", "all", "set3")]
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        found = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            rows = np.arange(a, b)
            side = left[a:b] if two[a] else np.ones(b - a, bool)
            found += [(a + x, a + y) for x, y in _linked(rows, side, *lists, n, label, percent)]
        got = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[got[:, 0]], pa.int64()), "b": pa.array(ids[got[:, 1]], pa.int64())})

    return blocks.groupBy("key").applyInArrow(compare, "a long, b long")


def _leader_links(single: DataFrame, entries: DataFrame, least: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between each document of ``entries`` and one candidate: the smallest holder of most of its tokens.

    A row for each document, so a group of near copies becomes one component without being compared in pairs. A
    leader with many followers is repeated for shares of them.
    """
    pick = entries.join(least, "tok").where("a <> b").groupBy("b", "a").agg(F.count("*").alias("c"), F.max("k").alias("k"))
    pick = pick.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("low"), "k")).alias("x"))
    pick = materialize(pick.select("b", (-F.col("x.low")).alias("a"), F.ceil(F.col("x.k") / FOLLOWERS).cast("int").alias("shares")), "leaders")
    mine = single.join(pick, single.doc_id == pick.b).select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "n", "all")
    lead = pick.groupBy("a").agg(F.max("shares").alias("shares")).join(single, F.col("a") == F.col("doc_id"))
    lead = lead.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("n").alias("lead_n"), F.col("all").alias("lead_all"))
    both = F.size(F.array_intersect("all", "lead_all"))
    found = mine.join(lead, ["a", "share"]).where(both * 100 >= percent * (F.col("n") + F.col("lead_n") - both))
    return materialize(found.select("a", "b"), "leads")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, tile: int = TILE_ELEMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of the links Jaccard >= percent/100.

    component_id is the smallest doc_id reachable, itself included. A null or wordless text has the empty
    set and no link; of repeated doc_ids the smallest text counts (null first); rows without doc_id are
    left out; other columns aren't read. ``tile``: elements of sets that one side of a task holds.
    """
    part, _, total = batched(docs)
    sets = materialize(_prefixes(part, n, percent, total), "sets")
    shared = sets.where("set1 is not null")
    # equal sets are linked with the smallest of their part, and the parts' smallest with the group's; how many parts follows the largest group
    most = shared.groupBy("same").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    dealt = shared.select("same", F.col("doc_id").alias("b"), F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-most // COPIES)))).alias("part"))
    firsts = materialize(dealt.groupBy("same", "part").agg(F.min("b").alias("m")), "firsts")
    heads = materialize(firsts.groupBy("same").agg(F.min("m").alias("a")), "heads")
    copies = dealt.join(firsts, ["same", "part"]).where("b <> m").select(F.col("m").alias("a"), "b")
    copies = materialize(copies.unionByName(firsts.join(heads, "same").where("m <> a").select("a", F.col("m").alias("b"))), "copies")
    single = shared.join(heads.select(F.col("a").alias("doc_id")), "doc_id", "left_semi")
    entries = materialize(single.select(F.col("doc_id").alias("b"), F.explode("set1").alias("tok")), "entries")
    least = entries.groupBy("tok").agg(F.min("b").alias("a"), F.count("*").alias("k")).where("k > 1")
    near = components(entries.join(least, "tok").where("a <> b").select("a", "b").distinct())
    placed = near.join(single.select("doc_id", "n"), near.v == F.col("doc_id"))
    leads = _leader_links(single, entries, least, percent)
    links = copies.unionByName(leads)
    known = components(leads).select(F.col("v").alias("known_id"), F.col("comp").alias("known"))
    placed = placed.join(known, F.col("doc_id") == F.col("known_id"), "left")
    placed = materialize(placed.select("doc_id", "n", F.col("comp").alias("block"), F.coalesce("known", "doc_id").alias("label")), "placed")
    shares = placed.groupBy("block", "label").agg(F.sum("n").alias("e")).groupBy("block").agg(F.sum("e").alias("elements"), F.max(F.struct("e", "label")).alias("most"))
    # tiles of the largest known component needn't meet each other: ``mains`` of them, then those of the rest; a block of one component needs none
    more = lambda c: F.ceil(c / tile).cast("int")
    shares = shares.where("elements > most.e").select("block", F.col("most.label").alias("main"), F.when(F.col("elements") <= tile, 0).otherwise(more(F.col("most.e"))).alias("mains"), F.when(F.col("elements") <= tile, 1).otherwise(more(F.col("elements") - F.col("most.e"))).alias("rest"))
    cells = max(1, (placed.agg(F.sum("n")).first()[0] or 0) // tile)
    rows = single.join(placed.join(shares, "block").drop("n"), "doc_id")
    is_main, dealt = (F.col("label") == F.col("main")) & (F.col("mains") > 0), F.xxhash64("doc_id")
    rows = rows.withColumn("tile", F.when(is_main, F.pmod(dealt, F.col("mains"))).otherwise(F.col("mains") + F.pmod(dealt, F.col("rest"))).cast("int"))
    last = F.col("mains") + F.col("rest") - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(0), last)))
    pair = F.xxhash64("block", F.least("tile", "other"), F.greatest("tile", "other"))
    # pairs of tiles are dealt to tasks; those of small blocks share a key
    rows = rows.select(
        F.when(last == 0, F.pmod(F.xxhash64("block"), F.lit(cells))).otherwise(pair).alias("key"), "block", (F.col("tile") < F.col("other")).alias("left"), (F.col("tile") != F.col("other")).alias("two"),
        "doc_id", "n", "label", "set1", "all", "set3",
    )
    labels = components(_links(rows, percent).unionByName(links))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(labels, out.doc_id == labels.v, "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest doc_id of each component; rows without doc_id stay."""
    kept = ngram_components(docs, n, percent).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs.doc_id == kept.kept_id, "left_semi").unionByName(docs.where("doc_id is null"))

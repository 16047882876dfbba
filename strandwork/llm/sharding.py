"""Sharding by balanced label propagation.

DataFrame and SQL functions only. Documents with equal texts are linked. Every document starts in a shard given by a
hash. Groups of over 1 / LARGE of a shard, a bounded number, are placed by their counts, largest first: whole where they
fit, else they fill the emptiest shards in turn, so that they spread over as few as the quotas allow. In each round the part of
a smaller group that is in one shard asks to move to the shard that holds most of the group, and requests are granted by
hash up to what leaves the linked documents of that shard within its quota, once those that go are gone; unlinked
ones always give way. A group whose shard is full gathers in its next best. At last the shards are made exactly even:
documents beyond a shard's quota, unlinked ones first, go to the free places of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandwork.session import materialize

SHARDS = 8
ROUNDS = 4
LARGE = 64  # a group of over 1 / LARGE of a shard is placed by its count; at most SHARDS * LARGE groups are


def _even(total: int, shards: int, counts: list[int]) -> list[int]:
    """Quotas at most one apart; the larger ones go to the fullest shards."""
    fullest = sorted(range(shards), key=lambda s: (-counts[s], s))[: total % shards]
    return [total // shards + (s in fullest) for s in range(shards)]


def place_large(sizes: list[tuple[bytes, int]], quota: int, shards: int) -> list[tuple[bytes, int, int, int]]:
    """(group, shard, first rank, rank after the last): groups in as few shards as there is room for, largest first."""
    free, out = [quota] * shards, []
    for g, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = 0
        while at < size:
            fits = [s for s in range(shards) if free[s] >= size - at]
            # the tightest of those that hold the rest, else the emptiest; what no quota holds (under ``shards`` rows) is evened later
            s = min(fits, key=lambda s: (free[s], s)) if fits else max(range(shards), key=lambda s: (free[s], -s))
            n = min(size - at, free[s]) or size - at
            out.append((g, s, at, at + n))
            free[s], at = max(0, free[s] - n), at + n
    return out


def shares(load: list[int], limit: list[int], want: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """The share of each (from, to) of ``want`` that may move, so that no load grows beyond its limit."""
    x = {k: 1.0 for k in want}
    for _ in range(1000):  # shares only fall, and those of 0 are always allowed
        done = True
        for s in range(len(load)):
            come = sum(n * x[k] for k, n in want.items() if k[1] == s)
            go = sum(n * x[k] for k, n in want.items() if k[0] == s)
            room = max(0, limit[s] - load[s] + go)
            if come > room + 0.5:
                done = False
                for k in want:
                    if k[1] == s:
                        x[k] *= room / come
        if done:
            return x
    return {k: 0.0 for k in want}


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows (.., g: group, s0: first shard) with ``shard`` after the rounds and ``linked`` (2: of a large group, 1, 0)."""
    spark = rows.sparkSession
    total = rows.count()
    quota = total // shards
    per_group = rows.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    large = [(bytes(g), n) for g, n in per_group.where(F.col("size") * LARGE > quota).collect()]  # at most about SHARDS * LARGE
    plan = place_large(large, quota, shards)
    # as literals, for no Python rows go to the workers
    lits = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(s).alias("to"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for g, s, a, b in plan])
    plans = (spark.range(1).select(F.explode(lits).alias("p")) if plan else spark.range(0).select(F.struct(F.lit(b"").alias("g"), F.lit(0).alias("to"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("p"))).select("p.*")
    firm = ranked(rows.join(plans.select("g").distinct(), "g", "left_semi"), "g", ["doc_id"]).join(plans, "g").where("rank >= a and rank < b")
    firm = firm.select(*rows.columns, F.col("to").alias("shard"), F.lit(2).alias("linked"))
    limit = [quota - sum(b - a for _, to, a, b in plan if to == s) for s in range(shards)]
    small = per_group.where(F.col("size") * LARGE <= quota).select("g")
    cells = rows.groupBy("g", "s0").agg(F.count("*").alias("n")).join(small, "g", "left_semi")
    cells = materialize(cells.withColumn("cur", F.col("s0")), "cells")
    # shards that large groups leave little of gather no others, if the rest hold them all
    loose = cells.agg(F.sum("n")).first()[0] or 0
    usable = [s for s in range(shards) if limit[s] > 0 and limit[s] * shards >= loose]
    if sum(limit[s] for s in usable) < loose:
        usable = [s for s in range(shards) if limit[s] > 0]
    usable = usable or list(range(shards))
    open_ = set(usable)
    tie = F.pmod(F.xxhash64("g", "cur"), F.lit(1 << 30)).alias("tie")
    most = lambda among: F.max(F.when(F.col("cur").isin(sorted(among)), F.struct("held", F.col("cur").isin(sorted(open_)), tie, F.col("cur").alias("to"))))["to"]
    for k in range(rounds):
        held = cells.groupBy("g", "cur").agg(F.sum("n").alias("held"))
        best = held.groupBy("g").agg(most(usable).alias("first"), most(open_).alias("next"))
        # a group that is wholly in shards without room goes to any that is open
        home = F.coalesce("first", F.get(F.array(*[F.lit(s) for s in sorted(open_)]), F.pmod(F.xxhash64("g"), F.lit(len(open_))).cast("int")))
        to = F.when(home.isin(sorted(open_)) | (F.col("cur") == home), home).otherwise(F.coalesce("next", "cur"))
        asked = materialize(cells.join(best, "g").select("g", "s0", "n", "cur", to.alias("to")), "asked")
        flows = {(a, b): n for a, b, n in asked.groupBy("cur", "to").agg(F.sum("n")).collect()}  # a row for each two shards
        load = [sum(n for (a, _), n in flows.items() if a == s) for s in range(shards)]
        want = {k: n for k, n in flows.items() if k[0] != k[1]}
        share = shares(load, limit, want)
        if not any(share.values()):
            break
        dice = F.pmod(F.xxhash64("g", F.lit(k)), F.lit(1 << 20)) / (1 << 20)
        x = F.get(F.array(*[F.lit(share.get((a, b), 0.0)) for a in range(shards) for b in range(shards)]), F.col("cur") * shards + F.col("to"))
        cells = materialize(asked.select("g", "s0", "n", F.when(dice < x, F.col("to")).otherwise(F.col("cur")).alias("cur")), "cells")
        open_ = {s for s in usable if all(share[k] == 1.0 for k in want if k[1] == s)}
        if not open_:
            open_ = set(usable)
    rest = rows.join(plans.select("g").distinct(), "g", "left_anti").join(cells.select("g", "s0", "cur"), ["g", "s0"], "left")
    rest = rest.select(*rows.columns, F.coalesce("cur", "s0").alias("shard"), F.col("cur").isNotNull().cast("int").alias("linked"))
    return firm.unionByName(rest)


def ranked(rows: DataFrame, by: str, order: list) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within ``by``: ranges are ranked on their own and get the counts of those before."""
    parts = materialize(rows.repartitionByRange(by, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(by, "part").agg(F.count("*").alias("n"))  # a row for each range and shard
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(by, "part", before.alias("before"))
    own = parts.withColumn("own", F.row_number().over(Window.partitionBy(by, "part").orderBy(*order)))
    return own.join(sizes, [by, "part"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("before", "own", "part")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of ``docs``; law ``rows``.

    A null text counts as empty (size 1, crc 0) and is in the group of the empty texts; rows of repeated or null
    doc_ids are placed each on their own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g"))
    rows = materialize(rows.withColumn("s0", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")), "rows")
    placed = materialize(propagate(rows, shards).withColumn("key", F.xxhash64("g")), "placed")
    counts = {s: n for s, n in placed.groupBy("shard").count().collect()}  # a row for each shard
    have = [counts.get(s, 0) for s in range(shards)]
    quota = _even(sum(have), shards, have)
    over = [max(0, h - q) for h, q in zip(have, quota)]
    free = [max(0, q - h) for h, q in zip(have, quota)]
    lits = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    pick = lambda xs: F.get(lits(xs), F.col("shard"))
    # linked rows rank first, those of large groups before the others, so those beyond the quota are unlinked as far as there are any
    r = ranked(placed, "shard", [F.desc("linked"), "key", "doc_id"])
    moved = F.col("rank") - pick(quota) + pick([sum(over[:s]) for s in range(shards)])  # its number among all that move
    r = r.withColumn("move", F.when(F.col("rank") >= pick(quota), moved))
    target, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        mine = (F.col("move") >= sum(free[:s])) & (F.col("move") < sum(free[: s + 1]))
        target = F.when(mine, F.lit(s)).otherwise(target)
        slot = F.when(mine, F.col("move") - sum(free[:s]) + have[s]).otherwise(slot)
    return r.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.coalesce(target, "shard").alias("shard"), F.coalesce(slot, "rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

"""Simple paths and elementary cycles by path-carrying joins over a pruned edge set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from strandwork.graph import Graph, order_column
from strandwork.operators.traverse import distances, eligible
from strandwork.session import materialize

PATHS, PATH_DEPTH = 20, 8
AT_ONCE = 50_000  # walks extended in one round


def collapsed(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): its id is that of the last parallel one, ``first`` the place of the first."""
    at = order_column(edges)
    return edges.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.max_by("id", at).alias("edge_id"), F.min(at).alias("first"))


def find_paths(graph: Graph, source: str, target: str, max_depth: int = PATH_DEPTH, edge_types: list[str] | None = None, node_types: list[str] | None = None, keep: int = PATHS, at_once: int = AT_ONCE) -> DataFrame:
    """(path_id, node_ids, edge_ids, hop_count) of the first ``keep`` simple paths, in depth-first order of the edges.

    node_types limits the inner nodes. Only edges on some walk of at most ``max_depth`` edges from source to target are
    followed: the distances from both ends bound what a path can still need. Equal ends give no path.

    The first ``at_once`` open walks in that order are extended in a round, so a round's size doesn't grow with the number of
    walks; what comes after the ``keep``-th path found so far is dropped, since extending a walk only moves it back.
    """
    spark = graph.spark
    empty = spark.createDataFrame([], "path_id int, node_ids array<string>, edge_ids array<string>, hop_count int")
    if source == target or max_depth < 1:
        return empty
    edges = materialize(collapsed(eligible(graph.edges, edge_types=edge_types)), "pairs")
    if node_types:
        inner = graph.nodes.where(F.col("type").isin([t.upper() for t in node_types])).select("id").unionByName(spark.createDataFrame([(source,), (target,)], "id string")).distinct()
        edges = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")
    root = lambda x: spark.createDataFrame([(x, x)], "root string, id string")
    fwd = distances(edges.select(F.col("src").alias("near"), F.col("dst").alias("far")), root(source), max_depth)
    bwd = distances(edges.select(F.col("dst").alias("near"), F.col("src").alias("far")), root(target), max_depth)
    on = edges.join(fwd.select(F.col("id").alias("src"), F.col("depth").alias("f")), "src").join(bwd.select(F.col("id").alias("dst"), F.col("depth").alias("b")), "dst")
    on = materialize(on.where((F.col("f") + 1 + F.col("b") <= max_depth) & (F.col("dst") != source)).select("src", "dst", "edge_id", "first", "b"), "walkable")
    ranks = f"array<{dict(on.dtypes)['first']}>"
    walks = spark.createDataFrame([(source, [source])], "at string, node_ids array<string>").select("at", "node_ids", F.array().cast("array<string>").alias("edge_ids"), F.array().cast(ranks).alias("rank"))
    waiting, best = [], []
    while True:
        step = walks.join(on, walks.at == on.src).where(~F.array_contains("node_ids", F.col("dst")) & (F.size("edge_ids") + 1 + F.col("b") <= max_depth))
        step = step.select(F.col("dst").alias("at"), F.concat("node_ids", F.array("dst")).alias("node_ids"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), F.concat("rank", F.array("first")).alias("rank"))
        waiting.append(materialize(step, "walks"))
        ends = waiting[-1].where(F.col("at") == target).orderBy("rank").limit(keep)
        best = sorted(best + [(r.rank, r.node_ids, r.edge_ids) for r in ends.collect()])[:keep]  # at most ``keep`` paths
        open_walks = reduce(DataFrame.unionByName, waiting).where(F.col("at") != target)
        if len(best) == keep:  # a walk's completions all come after it
            open_walks = open_walks.where(F.col("rank") < F.lit(best[-1][0]).cast(ranks))
        first = materialize(open_walks.orderBy("rank").limit(at_once), "walks")
        n, last = first.agg(F.count("*"), F.max("rank")).first()
        if not n:
            break
        waiting = [materialize(open_walks.where(F.col("rank") > F.lit(last).cast(ranks)), "waiting")] if n == at_once else []
        walks = first
    return spark.createDataFrame([(k, nodes, edges, len(edges)) for k, (_, nodes, edges) in enumerate(best, 1)], empty.schema)


def detail(graph: Graph, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the paths with all their columns, path_id and place k on the path; a vertex that isn't a node has only its id."""
    on = lambda c, df: paths.select("path_id", F.posexplode(c).alias("k", "id")).join(df, "id", "left")
    return on("node_ids", graph.nodes), on("edge_ids", graph.edges)


def trimmed(pairs: DataFrame) -> DataFrame:
    """Pairs left when vertices without a way in or out are dropped again and again: all cycles are among them."""
    n = pairs.count()
    while n:
        kept = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = materialize(kept, "core")
        m = kept.count()
        if m == n:
            break
        pairs, n = kept, m
    return pairs


def find_cycles(graph: Graph, edge_types: list[str] | None = None, max_length: int | None = None) -> DataFrame:
    """(length, node_ids) of every elementary cycle of at most ``max_length`` vertices (None: no bound), self-loops too.

    Each cycle is found once, from its smallest vertex, by extending to larger ones only. Default types: imports.
    """
    pairs = eligible(graph.edges, edge_types=edge_types or ["IMPORTS", "IMPORTS_FROM"]).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    pairs = trimmed(materialize(pairs, "pairs"))
    walks = pairs.where("src <= dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst")).alias("node_ids"))
    loops = walks.where("start = at").select(F.lit(1).alias("length"), "node_ids")
    found, walks = [loops], materialize(walks.where("start <> at"), "walks")
    d = 2
    while (max_length is None or d <= max_length) and not walks.isEmpty():
        step = walks.join(pairs, walks.at == pairs.src)
        found.append(step.where("dst = start").select(F.lit(d).alias("length"), "node_ids"))
        walks = materialize(step.where((F.col("dst") > F.col("start")) & ~F.array_contains("node_ids", F.col("dst"))).select("start", F.col("dst").alias("at"), F.concat("node_ids", F.array("dst")).alias("node_ids")), "walks")
        d += 1
    return reduce(DataFrame.unionByName, found)

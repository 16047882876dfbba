"""Bounded breadth-first traversal as a loop of joins.

A hop joins the newest vertices with the eligible edges and drops those already visited; each hop's new rows are
written to the shared folder, so plans stay small and a lost executor loses nothing. The loop's state has
three narrow columns; wide ones are joined once at the end. Frontiers are broadcast only where their measured size lets
adaptive execution do so.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, Window, functions as F

from strandwork.functions.globs import file_filter
from strandwork.graph import Graph
from strandwork.schema import INFERRED
from strandwork.session import materialize

DEPTH = 6


@dataclass
class Reach:
    """nodes: node columns with root and depth; edges: eligible edges out of vertices nearer than the limit, with root."""

    nodes: DataFrame
    edges: DataFrame


def eligible(edges: DataFrame, include_ambiguous: bool = True, edge_types: list[str] | None = None) -> DataFrame:
    if not include_ambiguous:
        edges = edges.where(F.col("certainty") >= INFERRED)
    if edge_types:
        edges = edges.where(F.col("type").isin([t.upper() for t in edge_types]))
    return edges


def distances(steps: DataFrame, roots: DataFrame, max_depth: int | None, nearest: int | None = None) -> DataFrame:
    """(root, id, depth) of every vertex within ``max_depth`` steps (near, far) of a root, None: any number; roots have depth 0.

    nearest: keep only so many of the nearest roots of each vertex. What is nearest to a vertex is among the nearest
    of the one before it on the way, so those that are kept are right.
    """
    seen = frontier = materialize(roots.select("root", "id").distinct().withColumn("depth", F.lit(0)), "frontier")
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        far = frontier.join(steps, frontier.id == steps.near).select("root", F.col("far").alias("id")).distinct()
        if nearest is None:
            new = far.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        else:  # one exchange by id: what was there goes first, then the smallest roots until there are ``nearest``
            both = seen.select("root", "id", F.lit(0).alias("late")).unionByName(far.select("root", "id", F.lit(1).alias("late")))
            both = both.groupBy("id", "root").agg(F.min("late").alias("late"))
            place = F.row_number().over(Window.partitionBy("id").orderBy("late", "root"))
            new = both.withColumn("place", place).where((F.col("late") == 1) & (F.col("place") <= nearest)).select("root", "id")
        new = materialize(new.withColumn("depth", F.lit(d)), "frontier")
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
        if d % 32 == 0:
            seen = materialize(seen, "seen")  # so that the plan of a long walk stays small
    return seen


def reach(
    graph: Graph, roots: DataFrame, direction: str = "downstream", max_depth: int = DEPTH, include_ambiguous: bool = True,
    edge_types: list[str] | None = None, node_types: list[str] | None = None, file_pattern: str | None = None, nearest: int | None = None,
) -> Reach:
    """Impact from each id of ``roots`` (root, id). Types, certainty prune the walk; node_types and file_pattern only filter
    the nodes that come back (a node without a file passes). "downstream" follows edges from source to target. A vertex that
    isn't in the node table is never expanded and never returned, but the edge to it is."""
    if direction not in ("downstream", "upstream"):
        raise ValueError(f"direction {direction!r}")
    near, far = ("source_id", "target_id") if direction == "downstream" else ("target_id", "source_id")
    edges = eligible(graph.edges, include_ambiguous, edge_types)
    known = graph.nodes.select(F.col("id").alias(near))
    steps = materialize(edges.join(known, near, "left_semi").select(F.col(near).alias("near"), F.col(far).alias("far")).distinct(), "steps")
    seen = distances(steps, roots, max_depth, nearest)
    nodes = graph.nodes.join(seen.where("depth > 0 and root <> id").select("root", "id", "depth"), "id")
    if node_types:
        nodes = nodes.where(F.col("type").isin([t.upper() for t in node_types]))
    if file_pattern:
        nodes = nodes.where(file_filter(F.col("file_path"), file_pattern, missing=True))
    inner = seen.where(F.col("depth") < max_depth).select("root", F.col("id").alias(near))
    inner = inner.join(known, near, "left_semi")
    return Reach(nodes, edges.join(inner, near))


def impact(graph: Graph, focus: str, **options) -> Reach:
    """``reach`` from one node id."""
    return reach(graph, graph.nodes.where(F.col("id") == focus).select(F.col("id").alias("root"), "id"), **options)


def batch_impact(graph: Graph, focus: DataFrame, **options) -> Reach:
    """Union of the impacts of several ids (column id), each node and edge once; a focus counts where another one reaches it.

    Two nearest roots of each vertex are enough for that: of a focus one is itself, so the other tells. The walk's size
    doesn't grow with the number of roots.
    """
    r = reach(graph, focus.select(F.col("id").alias("root"), "id"), nearest=2, **options)
    nodes = r.nodes.groupBy("id").agg(F.min("depth").alias("depth"))
    return Reach(graph.nodes.join(nodes, "id"), r.edges.drop("root").dropDuplicates(["id"]))


def dependents(graph: Graph, file_path: str) -> DataFrame:
    """Nodes that depend on anything in the file: upstream of each of its nodes, each once."""
    own = graph.nodes.where(F.col("file_path") == file_path).select("id")
    return batch_impact(graph, own, direction="upstream").nodes

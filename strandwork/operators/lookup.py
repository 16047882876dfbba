"""Lookups, filters, ranked search and reports over a graph."""

from __future__ import annotations

from functools import reduce

import re

from pyspark.sql import DataFrame, functions as F

from strandwork.functions.globs import file_filter, glob
from strandwork.graph import Graph, order_column
from strandwork.schema import AMBIGUOUS, EXACT

UNUSED_TYPES = ["FUNCTION", "METHOD", "CLASS"]
IMPORT_TYPES = ["IMPORTS", "IMPORTS_FROM"]


def resolve(graph: Graph, name: str) -> DataFrame:
    """The node meant by an id or name (0 or 1 row): id, then display name, then part of the qualified, then of the display name;
    case counts for ids only; within a tier the first in document order."""
    low, n = name.lower(), graph.nodes
    dn, qn = F.lower("display_name"), F.lower("qualified_name")
    tier = F.when(F.col("id") == name, 1).when(dn == low, 2).when(F.contains(qn, F.lit(low)), 3).when(F.contains(dn, F.lit(low)), 4)
    return n.withColumn("tier", tier).where("tier is not null").orderBy("tier", order_column(n)).limit(1)


def search(graph: Graph, query: str, node_types: list[str] | None = None, file_pattern: str | None = None, limit: int = 10) -> DataFrame:
    """Nodes by score: 4 a whole name, 3 its beginning, 2 inside the qualified name, 1 inside the display name, 0 the query as a regular
    expression. With file_pattern nodes without a file are left out. Ties by qualified name, then document order."""
    low, n = query.lower(), graph.nodes
    dn, qn = F.lower("display_name"), F.lower("qualified_name")
    score = F.when((qn == low) | (dn == low), 4).when(F.startswith(qn, F.lit(low)) | F.startswith(dn, F.lit(low)), 3).when(F.contains(qn, F.lit(low)), 2).when(F.contains(dn, F.lit(low)), 1)
    try:
        re.compile(query)
        score = score.when(F.col("qualified_name").rlike("(?i)" + query) | F.col("display_name").rlike("(?i)" + query), 0)
    except re.error:
        pass  # not a regular expression: that tier is empty
    if node_types:
        n = n.where(F.col("type").isin([t.upper() for t in node_types]))
    if file_pattern:
        n = n.where(file_filter(F.col("file_path"), file_pattern, missing=False))
    return n.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "qualified_name", order_column(n)).limit(limit)


def focus_search(graph: Graph, text: str) -> DataFrame:
    """Nodes that hold the text in the display name, the qualified name or the path of their file; case doesn't count."""
    low = F.lit(text.lower())
    return graph.nodes.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), low) for c in ("display_name", "qualified_name", "file_path"))))


def extent(nodes: DataFrame) -> DataFrame:
    """One row of how many nodes and how many different files; nodes without a file count as nodes only."""
    return nodes.agg(F.countDistinct("id").alias("node_count"), F.countDistinct(F.nullif("file_path", F.lit(""))).alias("file_count"))


def nodes_of(graph: Graph, types: list[str] | None = None) -> DataFrame:
    return graph.nodes.where(F.col("type").isin(types)) if types else graph.nodes


def edges_of(graph: Graph, types: list[str] | None = None) -> DataFrame:
    return graph.edges.where(F.col("type").isin(types)) if types else graph.edges


def services(graph: Graph) -> DataFrame:
    return nodes_of(graph, ["SERVICE", "COMPONENT"])


def visible(graph: Graph, types: list[str], only_exact: bool = False) -> Graph:
    """What a view shows: nodes of the types, and edges of which both ends are shown."""
    n = nodes_of(graph, types)
    e = graph.edges.where(F.col("certainty") == EXACT) if only_exact else graph.edges
    ids = n.select("id")
    e = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return Graph(n, e)


def neighbours(graph: Graph, focus: str) -> DataFrame:
    """Nodes one edge away in either direction."""
    e = graph.edges
    ids = e.where(F.col("source_id") == focus).select(F.col("target_id").alias("id")).unionByName(e.where(F.col("target_id") == focus).select(F.col("source_id").alias("id")))
    return graph.nodes.join(ids, "id", "left_semi")


def service_members(graph: Graph) -> DataFrame:
    """(id, members): for each service or component the nodes that belong to it."""
    e = edges_of(graph, ["BELONGS_TO_SERVICE"]).groupBy(F.col("target_id").alias("id")).agg(F.sort_array(F.collect_set("source_id")).alias("members"))
    return services(graph).select("id").join(e, "id", "left")


def audit(graph: Graph) -> DataFrame:
    """Edges of the two lowest certainties with the names of both ends (the id where the end isn't a node)."""
    n = graph.nodes
    side = lambda s: n.select(F.col("id").alias(f"{s}_id"), F.col("display_name").alias(f"{s}_found"))
    e = graph.edges.where(F.col("certainty") <= AMBIGUOUS).join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    return e.select("id", "type", "display_name", "certainty", "source_id", "target_id", F.coalesce("source_found", "source_id").alias("source_name"), F.coalesce("target_found", "target_id").alias("target_name")).orderBy("certainty", "type", "display_name")


def unused(graph: Graph, node_types: list[str] | None = None, exclude: list[str] | None = None, entry_points: list[str] | None = None, ignore_edge_types: list[str] | None = None) -> DataFrame:
    """Nodes that no edge points to (containment counts as pointing unless ignored), without excluded files and entry points."""
    edges = graph.edges.where(~F.col("type").isin(ignore_edge_types)) if ignore_edge_types else graph.edges
    n = nodes_of(graph, [t.upper() for t in node_types] if node_types else UNUSED_TYPES)
    n = n.join(edges.select(F.col("target_id").alias("id")), "id", "left_anti")
    for p in exclude or []:
        n = n.where(F.col("file_path").isNull() | ~glob(F.col("file_path"), p))
    for p in entry_points or []:
        n = n.where(~glob(F.col("qualified_name"), p) & ~glob(F.col("display_name"), p))
    return n.orderBy(F.coalesce("file_path", F.lit("")), F.coalesce("line_number", F.lit(0)), "id")


def by_file(nodes: DataFrame) -> DataFrame:
    """(file_path, n, names): nodes by file, those without one under <unknown>."""
    return nodes.groupBy(F.coalesce("file_path", F.lit("<unknown>")).alias("file_path")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("qualified_name")).alias("names"))


def file_context(graph: Graph, file_path: str) -> DataFrame:
    """One row for each node of the file with what it extends and calls, and the file's imports and importers on every row."""
    own = graph.nodes.where(F.col("file_path") == file_path)
    ids = own.select("id")
    out = graph.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    target = graph.nodes.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target_qn"))
    named = out.join(target, "target_id", "left").withColumn("to", F.coalesce("target_qn", "display_name"))
    uses = named.groupBy(F.col("source_id").alias("id")).agg(
        F.sort_array(F.collect_set(F.when(F.col("type") == "INHERITS", F.col("to")))).alias("bases"), F.sort_array(F.collect_set(F.when(F.col("type") == "CALLS", F.col("to")))).alias("calls")
    )
    return own.join(uses, "id", "left").orderBy(F.coalesce("line_number", F.lit(0)), "id")


def file_imports(graph: Graph, file_path: str) -> DataFrame:
    """(kind, name): modules that the file imports, and other files that import its nodes."""
    ids = graph.nodes.where(F.col("file_path") == file_path).select("id")
    e = edges_of(graph, IMPORT_TYPES)
    out = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(graph.nodes.select(F.col("id").alias("target_id"), "qualified_name"), "target_id", "left")
    into = e.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    into = into.join(graph.nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("from_file")), "source_id")
    return out.select(F.lit("imports").alias("kind"), F.coalesce("qualified_name", "display_name").alias("name")).unionByName(into.where(F.col("from_file").isNotNull() & (F.col("from_file") != file_path)).select(F.lit("imported_by").alias("kind"), F.col("from_file").alias("name"))).distinct()


def statistics(graph: Graph) -> DataFrame:
    """(kind, type, n): nodes and edges by type."""
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(graph.nodes, "node").unionByName(count(graph.edges, "edge"))


def totals(graph: Graph) -> DataFrame:
    """One row of counts: nodes, edges, warnings, files that were read and that couldn't be, services, boundaries crossed."""
    read = graph.nodes.where("type in ('MODULE', 'JS_MODULE') and file_path is not null")
    failed = graph.warnings.where(F.col("code").isin("SYNTAX_ERROR", "DECODE_ERROR", "IO_ERROR", "PARSE_ERROR", "JS_PARSE_ERROR")) if graph.warnings is not None else None
    rows = [
        (graph.nodes, F.count("*"), "total_nodes"), (graph.edges, F.count("*"), "total_edges"), (read, F.countDistinct("file_path"), "parsed_files"),
        (graph.nodes.where("type = 'SERVICE'"), F.count("*"), "service_count"), (graph.edges.where("type = 'CROSSES_COMPONENT_BOUNDARY'"), F.count("*"), "cross_component_edge_count"),
        *([(graph.warnings, F.count("*"), "warning_count"), (failed, F.countDistinct("path"), "failed_files")] if failed is not None else []),
    ]
    counts = [df.agg(n.alias(name)) for df, n, name in rows]  # of one row each
    return reduce(lambda a, b: a.join(b), counts)


def summary(graph: Graph, top: int = 5) -> str:
    """A sentence for each of totals with the largest node and edge types, services, warnings where they are known, and doubtful edges."""
    rows = statistics(graph).collect()  # a row for each type
    low = graph.edges.where(F.col("certainty") <= AMBIGUOUS).count()
    parts = []
    for kind in ("node", "edge"):
        of = sorted(((r["n"], r["type"]) for r in rows if r["kind"] == kind), key=lambda x: (-x[0], x[1]))
        parts.append(f"{sum(n for n, _ in of)} {kind}s: " + ", ".join(f"{n} {t}" for n, t in of[:top]))
    t = totals(graph).first().asDict()
    parts.append(f"{t['service_count']} services, {t['cross_component_edge_count']} edges across components")
    if "warning_count" in t:
        parts.append(f"{t['warning_count']} warnings, {t['failed_files']} files that couldn't be read")
    return ". ".join([*parts, f"{low} unresolved or ambiguous edges"]) + "."

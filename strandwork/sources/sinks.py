"""Outputs: Parquet, JSON documents, bulk-import CSV, and the compact and file-list formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.functions.paths import label
from strandwork.graph import Graph
from strandwork.schema import EDGES, NODES, certainty_name

WARNINGS = "code:string, message:string, path:string, certainty:int"
FORMATS = ("full", "compact", "files")


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r}: one of {', '.join(FORMATS)}")
    return fmt


def compact_nodes(nodes: DataFrame) -> DataFrame:
    at = F.when(F.col("line_number").isNull(), F.col("file_path")).otherwise(F.concat_ws(":", "file_path", F.col("line_number").cast("string")))
    return nodes.select("qualified_name", "type", F.when(F.col("file_path").isNotNull(), at).alias("location"))


def compact_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("display_name").alias("display"), "type", certainty_name(F.col("certainty")).alias("certainty"))


def file_list(nodes: DataFrame) -> DataFrame:
    return nodes.where("file_path <> ''").select("file_path").distinct().orderBy("file_path")


def format_nodes(nodes: DataFrame, fmt: str) -> DataFrame:
    return {"full": lambda: nodes, "compact": lambda: compact_nodes(nodes), "files": lambda: file_list(nodes)}[check_format(fmt)]()


def csv_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias(":ID"), F.col("name").alias("name:string"), F.col("qualified_name").alias("qualified_name:string"), F.col("type").alias("type:string"), label(F.col("type")).alias(":LABEL"))


def csv_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias(":START_ID"), F.col("target_id").alias(":END_ID"), F.col("type").alias(":TYPE"), F.col("display_name").alias("display_name:string"), certainty_name(F.col("certainty")).alias("certainty:string"))


def write_csv(graph: Graph, folder: str) -> None:
    """Bulk-import tables nodes and edges; quotes are doubled as csv readers expect."""
    for name, df in (("nodes", csv_nodes(graph.nodes)), ("edges", csv_edges(graph.edges))):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def write_parquet(graph: Graph, folder: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    if graph.warnings is not None:
        graph.warnings.write.mode("overwrite").parquet(f"{folder}/warnings")


def read_parquet(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def document(graph: Graph, pretty: bool = True) -> str:
    """The graph as one JSON document with sorted keys. For small graphs: its rows are gathered on the driver."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.orderBy("id").collect()]
    counts = lambda df: {r["type"]: r["count"] for r in df.groupBy("type").count().collect()}
    n, e = rows(graph.nodes.drop("pos")), rows(graph.edges.drop("pos"))
    w = [r.asDict() for r in graph.warnings.collect()] if graph.warnings is not None else []
    stats = {"total_nodes": len(n), "total_edges": len(e), "node_types": counts(graph.nodes), "edge_types": counts(graph.edges), "warning_count": len(w)}
    return json.dumps({"nodes": n, "edges": e, "warnings": w, "unresolved": [], "scan_metadata": graph.metadata, "statistics": stats}, sort_keys=True, indent=2 if pretty else None, default=str)


def read_document(spark: SparkSession, path: str, about: bool = False) -> Graph:
    """A JSON document's nodes and edges as tables; ``pos`` keeps the document's order. about: its warnings and scan metadata too."""
    schema = f"nodes array<struct<{_ddl(NODES)}>>, edges array<struct<{_ddl(EDGES)}>>, warnings array<struct<{WARNINGS}>>, scan_metadata string"
    d = spark.read.schema(schema).json(path, multiLine=True)
    part = lambda c: d.select(F.posexplode(c).alias("pos", "x")).select("x.*", F.col("pos").cast("long").alias("pos"))
    g = Graph(part("nodes"), part("edges"))
    if about:
        g.warnings = d.select(F.explode("warnings").alias("x")).select("x.*")
        told = d.select("scan_metadata").first()  # one small object
        g.metadata = json.loads(told[0]) if told and told[0] else {}
    return g


def _ddl(schema) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in schema.fields)

"""Changed regions: reading unified diffs, merging regions, and their impact."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandwork.graph import Graph
from strandwork.operators.traverse import distances
from strandwork.session import materialize

WHOLE = (1, 99999)
REGIONS = "file_path string, line_start int, line_end int"
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple[str, int, int]]:
    """(file, first, last line) of the new side of each hunk; a deleted file is changed whole."""
    out, old, new = [], None, None
    for line in text.splitlines():
        if line.startswith("--- "):
            old = line[4:].split("\t")[0].removeprefix("a/")
        elif line.startswith("+++ "):
            new = line[4:].split("\t")[0].removeprefix("b/")
            if new == "/dev/null":
                new = None
                if old and old != "/dev/null":
                    out.append((old, *WHOLE))
        elif new and (m := _HUNK.match(line)):
            start, n = int(m[1]), int(m[2] or 1)
            out.append((new, start, start + max(n - 1, 0)))
    return out


def regions(spark: SparkSession, changes: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(changes, REGIONS)


def merge_regions(r: DataFrame) -> DataFrame:
    """Regions of a file that overlap or touch become one: islands between gaps."""
    w = Window.partitionBy("file_path").orderBy("line_start", "line_end")
    high = F.max("line_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("new", F.when(F.col("line_start") <= high + 1, 0).otherwise(1))
    r = r.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("file_path", "island").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")).drop("island")


@dataclass
class DiffImpact:
    changed: DataFrame
    immediate: DataFrame
    transitive: DataFrame


def _stored_paths(graph: Graph, r: DataFrame) -> DataFrame:
    """Regions under the path that the graph stores: an equal one, else the first that ends with it or that it ends with."""
    stored = graph.nodes.where("file_path is not null").select(F.col("file_path").alias("stored")).distinct()
    exact = r.join(stored, r.file_path == stored.stored, "left_semi")
    rest = r.join(stored, r.file_path == stored.stored, "left_anti")
    # an ending is compared where the last parts agree, so the join has a key
    key = lambda c: F.element_at(F.split(c, "/"), -1)
    close = rest.withColumn("k", key(F.col("file_path"))).join(stored.withColumn("k", key(F.col("stored"))), "k").where(F.endswith("stored", "file_path") | F.endswith("file_path", "stored"))
    return exact.unionByName(close.groupBy("file_path", "line_start", "line_end").agg(F.min("stored").alias("stored")).select(F.col("stored").alias("file_path"), "line_start", "line_end"))


def diff_impact(graph: Graph, r: DataFrame, max_depth: int | None = None, compat: bool = False) -> DiffImpact:
    """changed: nodes of the regions' files that have no line or one inside; immediate: one edge away in either direction;
    transitive: what is further downstream of those, within ``max_depth`` steps of them if it is given (with ``compat`` always empty)."""
    changed = materialize(graph.nodes.join(_stored_paths(graph, r), "file_path").where("line_number is null or line_number between line_start and line_end").select("id").distinct(), "changed")
    e = graph.edges.select("source_id", "target_id")
    near = e.join(changed.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id")).unionByName(e.join(changed.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id")))
    immediate = materialize(near.distinct().join(changed, "id", "left_anti"), "immediate")
    known = graph.nodes.select(F.col("id").alias("source_id"))
    steps = materialize(e.join(known, "source_id", "left_semi").select(F.col("source_id").alias("near"), F.col("target_id").alias("far")).distinct(), "steps")
    far = distances(steps, immediate.select(F.lit("").alias("root"), "id"), 0 if compat else max_depth).where("depth > 0").select("id").join(changed, "id", "left_anti")
    rows = lambda ids: graph.nodes.join(ids, "id", "left_semi")
    return DiffImpact(rows(changed), rows(immediate), rows(far))

"""Joins across modules: longest directory, endpoint stitching, service boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwork.functions.paths import ancestors, normal_url


def longest_directory(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """files (path, ..) with the service of the longest of ``dirs`` (dir, service) above each; files under none are left out.

    Each path is joined under its own ancestors, so the join has an equal key.
    """
    up = files.withColumn("dir", F.explode(ancestors(F.col("path")))).join(dirs, "dir")
    best = up.groupBy("path").agg(F.max_by("service", F.length("dir")).alias("service"))
    return files.join(best, "path")


def stitch(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls (.., url) with the endpoints (.., path) of the same normalised form; the method doesn't count."""
    key = lambda c: normal_url(F.col(c))
    return calls.withColumn("k", key("url")).join(endpoints.withColumn("k", key("path")), "k").drop("k")


def crossings(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Edges whose ends belong to different services; member: (id, service)."""
    side = lambda s: member.select(F.col("id").alias(f"{s}_id"), F.col("service").alias(f"{s}_service"))
    return edges.join(side("source"), "source_id").join(side("target"), "target_id").where("source_service <> target_service")

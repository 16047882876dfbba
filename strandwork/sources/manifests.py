"""Manifests of files (path, sha256, mtime): comparison and staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select("path", F.col("sha256").alias("old_sha"), F.lit(True).alias("was"))
    n = new.select("path", F.col("sha256").alias("new_sha"), "mtime", F.lit(True).alias("is"))
    return o.join(n, "path", "full_outer")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, removed, unchanged or changed by content hash."""
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("changed")
    return _both(old, new).select("path", status.alias("status"))


def staleness(stored: DataFrame, found: DataFrame, built_at: float) -> DataFrame:
    """One row: files newer than the graph (added ones too), added, removed, and whether any is."""
    b = _both(stored, found)
    newer = F.col("is").isNotNull() & (F.col("mtime") > built_at)
    gone = F.col("is").isNull()
    return b.agg(F.count_if(newer).alias("changed"), F.count_if(newer & F.col("was").isNull()).alias("added"), F.count_if(gone).alias("removed"), (F.count_if(newer | gone) > 0).alias("is_stale"))

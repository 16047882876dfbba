"""The ordered fold that merges emissions of the same id into one node or edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandwork.schema import id_column


def folded_metadata(metadata: str = "metadata", seq: str = "seq") -> Column:
    """Maps merged in order of seq: a key that comes with another value keeps both, joined by a bar.

    Only emissions that carry metadata are collected: unresolved names are emitted with none, and from every file.
    """
    carried = F.when(F.size(metadata) > 0, F.struct(F.col(seq).alias("s"), F.map_entries(metadata).alias("m")))
    maps = F.transform(F.array_sort(F.collect_list(carried)), lambda x: F.map_from_entries(x["m"]))
    both = lambda k, a, b: F.when(b.isNull(), a).when(a.isNull() | (a == b), b).otherwise(F.concat(a, F.lit(" | "), b))
    return F.aggregate(maps, F.create_map().cast("map<string,string>"), lambda acc, m: F.map_zip_with(acc, F.coalesce(m, F.create_map().cast("map<string,string>")), both))


def _last(c: str, seq: str = "seq", also: Column | None = None) -> Column:
    some = F.col(c).isNotNull() if also is None else F.col(c).isNotNull() & also
    return F.max_by(F.when(some, F.col(c)), F.when(some, F.col(seq))).alias(c)


def merge_nodes(emitted: DataFrame) -> DataFrame:
    """emitted: node columns and a unique seq. The first emission fixes type and names, certainty is the largest, file and
    line are the last given, metadata is folded."""
    name = F.min_by("name", "seq")
    first = lambda c: F.min_by(F.coalesce(F.nullif(F.col(c), F.lit("")), "name"), "seq").alias(c)
    return emitted.groupBy("id").agg(
        F.min_by("type", "seq").alias("type"), name.alias("name"), first("qualified_name"), first("display_name"), _last("file_path", also=F.col("file_path") != ""),
        _last("line_number"), _last("column"), F.max("certainty").alias("certainty"), folded_metadata().alias("metadata"),
    )


def merge_edges(emitted: DataFrame) -> DataFrame:
    """emitted: source_id, target_id, type, .., seq. One edge for each (source, target, type)."""
    shown = F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.concat_ws(" -> ", "source_id", "target_id"))
    e = emitted.withColumn("id", id_column("edge", "source_id", "target_id", "type"))
    return e.groupBy("id").agg(
        F.min_by("source_id", "seq").alias("source_id"), F.min_by("target_id", "seq").alias("target_id"), F.min_by("type", "seq").alias("type"), F.min_by(shown, "seq").alias("display_name"),
        _last("file_path", also=F.col("file_path") != ""), _last("line_number"), F.max("certainty").alias("certainty"), folded_metadata().alias("metadata"),
    )

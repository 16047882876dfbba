"""Graphs over the driver's tables: the same SELECTs run on Spark and in the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.graph import Graph
from strandwork.session import materialize

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

#: Vertices of the foreign-key graph. {t} stands for table t.
NODE_SQL = """
SELECT 'region:' || r_regionkey AS id, 'MODULE' AS type, r_name AS name, 'region.' || r_name AS qualified_name, r_name AS display_name, CAST(NULL AS string) AS file_path, CAST(NULL AS int) AS line_number, 3 AS certainty FROM {region}
UNION ALL SELECT 'nation:' || n_nationkey, 'SERVICE', n_name, 'nation.' || n_name, n_name, 'nation/all.py', CAST(n_nationkey AS int), 3 FROM {nation}
UNION ALL SELECT 'customer:' || c_custkey, 'CLASS', c_name, 'customer.' || c_mktsegment || '.' || c_name, c_name, 'customer/' || (c_custkey % 50) || '.py', CAST(c_custkey % 1000 AS int), 3 FROM {customer}
UNION ALL SELECT 'order:' || o_orderkey, 'FUNCTION', 'order' || o_orderkey, 'order.' || o_orderstatus || '.' || o_orderkey, 'order' || o_orderkey, 'order/' || (o_orderkey % 200) || '.py', CAST(o_orderkey % 1000 AS int), CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END FROM {orders}
UNION ALL SELECT 'part:' || p_partkey, 'METHOD', p_name, 'part.' || p_brand || '.' || p_name, p_name || ' ' || p_partkey, 'part/' || (p_partkey % 40) || '.py', CAST(p_partkey % 1000 AS int), 3 FROM {part}
UNION ALL SELECT 'supplier:' || s_suppkey, 'ENDPOINT', s_name, 'supplier.' || s_name, s_name, 'supplier/all.py', CAST(s_suppkey % 1000 AS int), 3 FROM {supplier}
"""

#: Edges, at most one for each (source, target, type).
EDGE_SQL = """
SELECT source_id || '>' || target_id || '#' || type AS id, source_id, target_id, type, source_id || ' -> ' || target_id AS display_name, CAST(max(certainty) AS int) AS certainty FROM (
  SELECT 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id, 'CONTAINS' AS type, 3 AS certainty FROM {nation}
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS', 3 FROM {customer}
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CALLS', CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END FROM {orders}
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'IMPORTS', CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 2 ELSE 3 END FROM {lineitem}
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'FOREIGN_KEY', CASE l_linestatus WHEN 'F' THEN 3 ELSE 2 END FROM {lineitem}
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BELONGS_TO_SERVICE', 3 FROM {supplier}
) AS e GROUP BY source_id, target_id, type
"""

#: What each user did next.
STEP_SQL = """
SELECT DISTINCT event_type AS source_id, next AS target_id FROM (
  SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM {events}) AS s WHERE next IS NOT NULL
"""


def on_spark(sql: str, sf_dir: str) -> str:
    return sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES})


def for_oracle(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def fk_graph(spark: SparkSession, sf_dir: str, stored: bool = False) -> Graph:
    """The foreign-key graph: nations' regions, customers, orders, parts, suppliers.

    stored: its edges are written first, as a scan leaves them, for plans that read them several times.
    """
    nodes = spark.sql(on_spark(NODE_SQL, sf_dir)).withColumn("column", F.lit(None).cast("int")).withColumn("metadata", F.create_map().cast("map<string,string>"))
    edges = spark.sql(on_spark(EDGE_SQL, sf_dir)).withColumn("file_path", F.lit(None).cast("string")).withColumn("line_number", F.lit(None).cast("int")).withColumn("metadata", F.create_map().cast("map<string,string>"))
    return Graph(nodes, materialize(edges, "edges") if stored else edges)


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types and which follows which."""
    steps = spark.sql(on_spark(STEP_SQL, sf_dir))
    edges = steps.select(F.concat_ws(">", "source_id", "target_id").alias("id"), "source_id", "target_id", F.lit("IMPORTS").alias("type"), F.concat_ws(" -> ", "source_id", "target_id").alias("display_name"), F.lit(3).alias("certainty"))
    ids = steps.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    nodes = ids.select("id", F.lit("MODULE").alias("type"), F.col("id").alias("name"), F.col("id").alias("qualified_name"), F.col("id").alias("display_name"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.lit(3).alias("certainty"))
    return Graph(nodes, edges)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""The engine's own queries over the driver's tables, with the SQL that an independent engine runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.functions.paths import ancestors, label, normal_url
from strandwork.operators import diff, lookup, merge, simple_paths, traverse
from strandwork.plans.tables import EDGE_SQL, NODE_SQL, STEP_SQL, event_graph, fk_graph, for_oracle, table
from strandwork.schema import certainty_name, id_column
from strandwork.sources import manifests
from strandwork.sources.sinks import csv_edges, csv_nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WITH_GRAPH = f"nodes AS ({for_oracle(NODE_SQL)}), edges AS ({for_oracle(EDGE_SQL)})"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.replace("{graph}", WITH_GRAPH)
        return f

    return add


def _walk_sql(start: str, depth: int, near: str, far: str, where: str = "true") -> str:
    """CTEs w(root, id, d): distances from the ids that ``start`` selects."""
    return f"""WITH RECURSIVE {{graph}}, e AS (SELECT * FROM edges WHERE {where}),
walk AS (SELECT id AS root, id, 0 AS d FROM ({start}) AS s UNION SELECT w.root, e.{far}, w.d + 1 FROM walk w JOIN e ON e.{near} = w.id WHERE w.d < {depth}),
w AS (SELECT root, id, min(d) AS d FROM walk GROUP BY root, id)"""


# ---- building

@query("WITH {graph} SELECT * FROM nodes")
def graph_nodes(spark, sf_dir):
    return fk_graph(spark, sf_dir).nodes.drop("column", "metadata")


@query("WITH {graph} SELECT * FROM edges")
def graph_edges(spark, sf_dir):
    return fk_graph(spark, sf_dir).edges.select("id", "source_id", "target_id", "type", "display_name", "certainty")


@query("WITH {graph} SELECT id AS node, 'mod:' || substr(sha256(id || '|' || type), 1, 16) AS hashed FROM nodes")
def identity(spark, sf_dir):
    return fk_graph(spark, sf_dir).nodes.select(F.col("id").alias("node"), id_column("mod", "id", "type").alias("hashed"))


@query("""
WITH m AS (SELECT user_id, event_id AS seq, event_type, ts, value, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE 'f' || (event_id % 3) END AS file_path, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS int) END AS line FROM events WHERE user_id IS NOT NULL),
f AS (SELECT user_id, arg_min(event_type, seq) AS type, arg_max(file_path, seq) FILTER (WHERE file_path IS NOT NULL) AS file_path, arg_max(line, seq) FILTER (WHERE line IS NOT NULL) AS line_number,
  CAST(max(seq % 4) AS int) AS certainty, list(event_type ORDER BY seq) AS kinds FROM m GROUP BY user_id)
SELECT 'user:' || user_id AS id, type, file_path, line_number, certainty, list_reduce(kinds, lambda a, b: CASE WHEN a = b THEN a ELSE a || ' | ' || b END) AS kind FROM f
""")
def merge_fold(spark, sf_dir):
    """Events as emissions of their user's node, merged in order of event_id."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    e = e.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("type"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.lit("").alias("display_name"),
        F.when(~F.col("event_type").isin("click", "view"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"))).alias("file_path"), F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 100).cast("int")).alias("line_number"),
        F.lit(None).cast("int").alias("column"), (F.col("event_id") % 4).cast("int").alias("certainty"), F.create_map(F.lit("kind"), "event_type").alias("metadata"), F.col("event_id").alias("seq"),
    )
    return merge.merge_nodes(e).select("id", "type", "file_path", "line_number", "certainty", F.element_at("metadata", "kind").alias("kind"))


# ---- traversal

@query(_walk_sql("SELECT 'region:0' AS id", 6, "source_id", "target_id") + " SELECT n.id, n.type, w.d AS depth FROM w JOIN nodes n ON n.id = w.id WHERE w.d > 0")
def impact_downstream(spark, sf_dir):
    return traverse.impact(fk_graph(spark, sf_dir, stored=True), "region:0").nodes.select("id", "type", "depth")


@query(_walk_sql("SELECT 'region:0' AS id", 4, "source_id", "target_id") + " SELECT e.id, e.type FROM e JOIN w ON w.id = e.source_id WHERE w.d < 4")
def impact_edges(spark, sf_dir):
    return traverse.impact(fk_graph(spark, sf_dir, stored=True), "region:0", max_depth=4).edges.select("id", "type")


@query(_walk_sql("SELECT 'region:0' AS id", 6, "source_id", "target_id") + " SELECT count(*) AS node_count, count(DISTINCT nullif(n.file_path, '')) AS file_count FROM w JOIN nodes n ON n.id = w.id WHERE w.d > 0")
def impact_extent(spark, sf_dir):
    return lookup.extent(traverse.impact(fk_graph(spark, sf_dir, stored=True), "region:0").nodes)


@query(_walk_sql("SELECT 'supplier:1' AS id", 6, "target_id", "source_id") + " SELECT n.id, n.type, w.d AS depth FROM w JOIN nodes n ON n.id = w.id WHERE w.d > 0")
def impact_upstream(spark, sf_dir):
    return traverse.impact(fk_graph(spark, sf_dir, stored=True), "supplier:1", direction="upstream").nodes.select("id", "type", "depth")


@query(_walk_sql("SELECT 'nation:3' AS id", 5, "source_id", "target_id", "certainty >= 2 AND type IN ('CONTAINS', 'CALLS', 'IMPORTS')") + " SELECT n.id, n.file_path, w.d AS depth FROM w JOIN nodes n ON n.id = w.id WHERE w.d > 0 AND n.type IN ('FUNCTION', 'METHOD') AND (n.file_path IS NULL OR n.file_path GLOB '*/[1-4]*.py')")
def impact_filtered(spark, sf_dir):
    r = traverse.impact(fk_graph(spark, sf_dir, stored=True), "nation:3", max_depth=5, include_ambiguous=False, edge_types=["contains", "calls", "IMPORTS"], node_types=["function", "METHOD"], file_pattern="*/[1-4]*.py")
    return r.nodes.select("id", "file_path", "depth")


@query(_walk_sql("SELECT id FROM nodes WHERE id IN ('customer:1', 'customer:2', 'nation:3')", 6, "source_id", "target_id") + " SELECT n.id, min(w.d) AS depth FROM w JOIN nodes n ON n.id = w.id WHERE w.d > 0 GROUP BY n.id")
def batch_impact(spark, sf_dir):
    g = fk_graph(spark, sf_dir, stored=True)
    return traverse.batch_impact(g, g.nodes.where(F.col("id").isin("customer:1", "customer:2", "nation:3")).select("id")).nodes.select("id", "depth")


@query(_walk_sql("SELECT id FROM nodes WHERE file_path = 'part/7.py'", 6, "target_id", "source_id") + " SELECT DISTINCT n.id, n.type FROM w JOIN nodes n ON n.id = w.id WHERE w.d > 0")
def dependents(spark, sf_dir):
    return traverse.dependents(fk_graph(spark, sf_dir, stored=True), "part/7.py").select("id", "type")


_PATHS = """WITH RECURSIVE {graph}, pair AS (SELECT source_id, target_id, max(id) AS edge_id, min(id) AS first FROM edges GROUP BY 1, 2),
p AS (SELECT 'customer:1' AS v, ['customer:1'] AS ids, CAST([] AS varchar[]) AS es, CAST([] AS varchar[]) AS rank
  UNION ALL SELECT e.target_id, list_append(ids, e.target_id), list_append(es, e.edge_id), list_append(rank, e.first) FROM p JOIN pair e ON e.source_id = p.v
  WHERE len(es) < 4 AND p.v <> 'supplier:1' AND NOT list_contains(ids, e.target_id)),
r AS (SELECT CAST(row_number() OVER (ORDER BY rank) AS int) AS path_id, array_to_string(ids, '>') AS node_ids, array_to_string(es, ' ') AS edge_ids, CAST(len(es) AS int) AS hop_count FROM p WHERE v = 'supplier:1')
SELECT * FROM r WHERE path_id <= 20"""


@query(_PATHS)
def find_paths(spark, sf_dir):
    p = simple_paths.find_paths(fk_graph(spark, sf_dir), "customer:1", "supplier:1", max_depth=4)
    return p.select("path_id", F.array_join("node_ids", ">").alias("node_ids"), F.array_join("edge_ids", " ").alias("edge_ids"), "hop_count")


@query("""WITH RECURSIVE {graph}, pair AS (SELECT source_id, target_id, max(id) AS edge_id, min(id) AS first FROM edges GROUP BY 1, 2),
back AS (SELECT 'supplier:1' AS id, 0 AS d UNION SELECT pair.source_id, back.d + 1 FROM back JOIN pair ON pair.target_id = back.id WHERE back.d < 8),
need AS (SELECT id, min(d) AS d FROM back GROUP BY id),
p AS (SELECT 'customer:1' AS v, ['customer:1'] AS ids, CAST([] AS varchar[]) AS es, CAST([] AS varchar[]) AS rank
  UNION ALL SELECT e.target_id, list_append(ids, e.target_id), list_append(es, e.edge_id), list_append(rank, e.first) FROM p JOIN pair e ON e.source_id = p.v JOIN need ON need.id = e.target_id
  WHERE len(es) + 1 + need.d <= 8 AND p.v <> 'supplier:1' AND NOT list_contains(ids, e.target_id)),
r AS (SELECT CAST(row_number() OVER (ORDER BY rank) AS int) AS path_id, array_to_string(ids, '>') AS node_ids, array_to_string(es, ' ') AS edge_ids, CAST(len(es) AS int) AS hop_count FROM p WHERE v = 'supplier:1')
SELECT * FROM r WHERE path_id <= 20""")
def find_paths_deep(spark, sf_dir):
    """At the default depth of 8."""
    p = simple_paths.find_paths(fk_graph(spark, sf_dir, stored=True), "customer:1", "supplier:1")
    return p.select("path_id", F.array_join("node_ids", ">").alias("node_ids"), F.array_join("edge_ids", " ").alias("edge_ids"), "hop_count")


def _four_hops(spark, sf_dir):
    g = fk_graph(spark, sf_dir, stored=True)
    return simple_paths.detail(g, simple_paths.find_paths(g, "customer:1", "supplier:1", max_depth=4))


_PLACES = _PATHS.replace("SELECT * FROM r WHERE path_id <= 20", "") + ", x AS (SELECT path_id, {ids} AS ids FROM r WHERE path_id <= 20), y AS (SELECT path_id, unnest(range(len(ids))) AS i, ids FROM x) SELECT path_id, CAST(i AS int) AS k, t.id, t.type, t.{name} FROM y JOIN {table} t ON t.id = ids[i + 1]"


@query(_PLACES.replace("{ids}", "string_split(node_ids, '>')").replace("{table}", "nodes").replace("{name}", "file_path"))
def path_nodes(spark, sf_dir):
    return _four_hops(spark, sf_dir)[0].select("path_id", "k", "id", "type", "file_path")


@query(_PLACES.replace("{ids}", "string_split(edge_ids, ' ')").replace("{table}", "edges").replace("{name}", "certainty"))
def path_edges(spark, sf_dir):
    return _four_hops(spark, sf_dir)[1].select("path_id", "k", "id", "type", "certainty")


@query(f"""WITH RECURSIVE s AS ({for_oracle(STEP_SQL)}),
p AS (SELECT source_id AS start, target_id AS v, CASE WHEN source_id = target_id THEN [source_id] ELSE [source_id, target_id] END AS ids, source_id = target_id AS closed FROM s WHERE source_id <= target_id
  UNION ALL SELECT p.start, s.target_id, CASE WHEN s.target_id = p.start THEN ids ELSE list_append(ids, s.target_id) END, s.target_id = p.start FROM p JOIN s ON s.source_id = p.v
  WHERE NOT closed AND (s.target_id = p.start OR s.target_id > p.start AND NOT list_contains(ids, s.target_id)))
SELECT CAST(len(ids) AS int) AS length, array_to_string(ids, '>') AS node_ids FROM p WHERE closed""")
def find_cycles(spark, sf_dir):
    return simple_paths.find_cycles(event_graph(spark, sf_dir)).select("length", F.array_join("node_ids", ">").alias("node_ids"))


# ---- lookups and reports

@query("""WITH {graph} SELECT id, tier FROM (SELECT id, CASE WHEN id = 'eur' THEN 1 WHEN lower(display_name) = 'eur' THEN 2 WHEN contains(lower(qualified_name), 'eur') THEN 3 WHEN contains(lower(display_name), 'eur') THEN 4 END AS tier FROM nodes) AS t WHERE tier IS NOT NULL ORDER BY tier, id LIMIT 1""")
def resolve_node(spark, sf_dir):
    return lookup.resolve(fk_graph(spark, sf_dir), "EuR").select("id", "tier")


@query("""WITH {graph} SELECT id, qualified_name, score FROM (SELECT *, CASE WHEN lower(qualified_name) = 'part.brand#1' OR lower(display_name) = 'part.brand#1' THEN 4 WHEN starts_with(lower(qualified_name), 'part.brand#1') OR starts_with(lower(display_name), 'part.brand#1') THEN 3
  WHEN contains(lower(qualified_name), 'part.brand#1') THEN 2 WHEN contains(lower(display_name), 'part.brand#1') THEN 1 WHEN regexp_matches(qualified_name, '(?i)part.brand#1') OR regexp_matches(display_name, '(?i)part.brand#1') THEN 0 END AS score FROM nodes) AS t
WHERE score IS NOT NULL AND type = 'METHOD' AND file_path GLOB 'part/?.py' ORDER BY score DESC, qualified_name, id LIMIT 10""")
def search(spark, sf_dir):
    return lookup.search(fk_graph(spark, sf_dir), "Part.Brand#1", node_types=["method"], file_pattern="part/?.py").select("id", "qualified_name", "score")


@query("WITH {graph} SELECT id FROM nodes WHERE contains(lower(display_name), 't/1') OR contains(lower(qualified_name), 't/1') OR contains(lower(file_path), 't/1')")
def focus_search(spark, sf_dir):
    return lookup.focus_search(fk_graph(spark, sf_dir), "T/1").select("id")


@query("WITH {graph} SELECT id, type FROM nodes WHERE type IN ('CLASS', 'ENDPOINT')")
def nodes_by_type(spark, sf_dir):
    return lookup.nodes_of(fk_graph(spark, sf_dir), ["CLASS", "ENDPOINT"]).select("id", "type")


@query("WITH {graph} SELECT id, type FROM edges WHERE type = 'FOREIGN_KEY'")
def edges_by_type(spark, sf_dir):
    return lookup.edges_of(fk_graph(spark, sf_dir), ["FOREIGN_KEY"]).select("id", "type")


@query("WITH {graph} SELECT id, name FROM nodes WHERE type IN ('SERVICE', 'COMPONENT')")
def services(spark, sf_dir):
    return lookup.services(fk_graph(spark, sf_dir)).select("id", "name")


@query("WITH {graph}, m AS (SELECT target_id, array_to_string(list(source_id ORDER BY source_id), ',') AS members FROM edges WHERE type = 'BELONGS_TO_SERVICE' GROUP BY 1) SELECT n.id, m.members FROM nodes n LEFT JOIN m ON m.target_id = n.id WHERE n.type IN ('SERVICE', 'COMPONENT')")
def service_members(spark, sf_dir):
    return lookup.service_members(fk_graph(spark, sf_dir)).select("id", F.array_join("members", ",").alias("members"))


@query("WITH {graph}, v AS (SELECT id FROM nodes WHERE type IN ('CLASS', 'FUNCTION', 'SERVICE')) SELECT id FROM edges WHERE certainty = 3 AND source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)")
def visible_edges(spark, sf_dir):
    return lookup.visible(fk_graph(spark, sf_dir), ["CLASS", "FUNCTION", "SERVICE"], only_exact=True).edges.select("id")


@query("WITH {graph} SELECT DISTINCT n.id FROM nodes n JOIN edges e ON (e.source_id = 'supplier:2' AND e.target_id = n.id) OR (e.target_id = 'supplier:2' AND e.source_id = n.id)")
def neighbours(spark, sf_dir):
    return lookup.neighbours(fk_graph(spark, sf_dir), "supplier:2").select("id")


@query("WITH {graph} SELECT id, type, certainty FROM edges WHERE certainty <= 1")
def ambiguity_audit(spark, sf_dir):
    return lookup.audit(fk_graph(spark, sf_dir)).select("id", "type", "certainty")


@query("WITH {graph} SELECT e.id, coalesce(s.display_name, e.source_id) AS source_name, coalesce(t.display_name, e.target_id) AS target_name FROM edges e LEFT JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes t ON t.id = e.target_id WHERE e.certainty <= 1")
def audit_enriched(spark, sf_dir):
    return lookup.audit(fk_graph(spark, sf_dir)).select("id", "source_name", "target_name")


_UNUSED = "WITH {graph}, used AS (SELECT DISTINCT target_id FROM edges WHERE type NOT IN ('CONTAINS', 'CALLS')), u AS (SELECT * FROM nodes WHERE type IN ('FUNCTION', 'METHOD', 'CLASS') AND id NOT IN (SELECT target_id FROM used) AND NOT (file_path GLOB 'customer/1*') AND NOT (qualified_name GLOB 'order.F.*' OR display_name GLOB 'order.F.*'))"


def _unused(spark, sf_dir):
    return lookup.unused(fk_graph(spark, sf_dir), exclude=["customer/1*"], entry_points=["order.F.*"], ignore_edge_types=["CONTAINS", "CALLS"])


@query(_UNUSED + " SELECT id, file_path, line_number FROM u")
def unused(spark, sf_dir):
    return _unused(spark, sf_dir).select("id", "file_path", "line_number")


@query(_UNUSED + " SELECT coalesce(file_path, '<unknown>') AS file_path, count(*) AS n, array_to_string(list(qualified_name ORDER BY qualified_name), ',') AS names FROM u GROUP BY 1")
def unused_by_file(spark, sf_dir):
    return lookup.by_file(_unused(spark, sf_dir)).select("file_path", "n", F.array_join("names", ",").alias("names"))


@query("""WITH {graph}, o AS (SELECT * FROM nodes WHERE file_path = 'customer/3.py'), c AS (SELECT e.source_id, array_to_string(list(DISTINCT n.qualified_name ORDER BY n.qualified_name), ',') AS calls FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.type = 'CALLS' GROUP BY 1)
SELECT o.id, o.line_number, coalesce(c.calls, '') AS calls FROM o LEFT JOIN c ON c.source_id = o.id""")
def file_context(spark, sf_dir):
    return lookup.file_context(fk_graph(spark, sf_dir, stored=True), "customer/3.py").select("id", "line_number", F.coalesce(F.array_join("calls", ","), F.lit("")).alias("calls"))


@query("""WITH {graph}, o AS (SELECT id FROM nodes WHERE file_path = 'part/5.py') SELECT DISTINCT 'imported_by' AS kind, n.file_path AS name FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.type IN ('IMPORTS', 'IMPORTS_FROM') AND e.target_id IN (SELECT id FROM o) AND n.file_path <> 'part/5.py'""")
def file_imports(spark, sf_dir):
    return lookup.file_imports(fk_graph(spark, sf_dir), "part/5.py")


@query("WITH {graph} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def graph_statistics(spark, sf_dir):
    return lookup.statistics(fk_graph(spark, sf_dir))


@query("WITH {graph} SELECT qualified_name, type, CASE WHEN file_path IS NULL THEN NULL WHEN line_number IS NULL THEN file_path ELSE file_path || ':' || line_number END AS location FROM nodes")
def format_compact_nodes(spark, sf_dir):
    from strandwork.sources.sinks import compact_nodes

    return compact_nodes(fk_graph(spark, sf_dir).nodes)


@query("WITH {graph} SELECT display_name AS display, type, CASE certainty WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'INFERRED' ELSE 'EXACT' END AS certainty FROM edges")
def format_compact_edges(spark, sf_dir):
    return fk_graph(spark, sf_dir).edges.select(F.col("display_name").alias("display"), "type", certainty_name(F.col("certainty")).alias("certainty"))


@query("WITH {graph} SELECT DISTINCT file_path FROM nodes WHERE file_path <> ''")
def format_files(spark, sf_dir):
    from strandwork.sources.sinks import file_list

    return file_list(fk_graph(spark, sf_dir).nodes)


@query("""WITH {graph} SELECT id AS ":ID", name AS "name:string", qualified_name AS "qualified_name:string", type AS "type:string", upper(substr(replace(type, '_', ''), 1, 1)) || lower(substr(replace(type, '_', ''), 2)) AS ":LABEL" FROM nodes""")
def csv_node_rows(spark, sf_dir):
    return csv_nodes(fk_graph(spark, sf_dir).nodes)


@query("""WITH {graph} SELECT source_id AS ":START_ID", target_id AS ":END_ID", type AS ":TYPE", display_name AS "display_name:string", CASE certainty WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'INFERRED' ELSE 'EXACT' END AS "certainty:string" FROM edges""")
def csv_edge_rows(spark, sf_dir):
    return csv_edges(fk_graph(spark, sf_dir).edges)


# ---- changes

_CHANGES = [("part/7.py", 5, 60), ("src/order/9.py", 100, 400), ("all.py", 1, 2), ("none/here.py", 1, 99999), ("customer/3.py", 1, 20), ("customer/3.py", 21, 40), ("customer/3.py", 60, 70), ("customer/3.py", 62, 65)]
_REGION_VALUES = ", ".join(f"('{f}', {a}, {b})" for f, a, b in _CHANGES)
_DIFF = f"""WITH RECURSIVE {{graph}}, r(f, a, b) AS (VALUES {_REGION_VALUES}), stored AS (SELECT DISTINCT file_path AS p FROM nodes WHERE file_path IS NOT NULL),
m AS (SELECT f, a, b, CASE WHEN f IN (SELECT p FROM stored) THEN f ELSE (SELECT min(p) FROM stored WHERE ends_with(p, f) OR ends_with(f, p)) END AS p FROM r),
changed AS (SELECT DISTINCT n.id FROM nodes n JOIN m ON m.p = n.file_path WHERE n.line_number IS NULL OR n.line_number BETWEEN m.a AND m.b),
near AS (SELECT DISTINCT id FROM (SELECT target_id AS id FROM edges WHERE source_id IN (SELECT id FROM changed) UNION ALL SELECT source_id FROM edges WHERE target_id IN (SELECT id FROM changed)) AS x WHERE id NOT IN (SELECT id FROM changed)),
far AS (SELECT id FROM near UNION SELECT e.target_id FROM far JOIN edges e ON e.source_id = far.id)
SELECT id, 'changed' AS tier FROM changed UNION ALL SELECT id, 'immediate' FROM near UNION ALL SELECT id, 'transitive' FROM far WHERE id NOT IN (SELECT id FROM near) AND id NOT IN (SELECT id FROM changed)"""


@query(_DIFF)
def diff_impact(spark, sf_dir):
    d = diff.diff_impact(fk_graph(spark, sf_dir, stored=True), diff.regions(spark, _CHANGES))
    tier = lambda df, name: df.select("id", F.lit(name).alias("tier"))
    return tier(d.changed, "changed").unionByName(tier(d.immediate, "immediate")).unionByName(tier(d.transitive, "transitive"))


@query("""WITH r AS (SELECT 'p' || (l_partkey % 50) AS f, CAST(l_orderkey AS int) AS a, CAST(l_orderkey + l_linenumber AS int) AS b FROM lineitem),
g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY f ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY f ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT f AS file_path, min(a) AS line_start, max(b) AS line_end FROM i GROUP BY f, k""")
def merge_regions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("file_path"), F.col("l_orderkey").cast("int").alias("line_start"), (F.col("l_orderkey") + F.col("l_linenumber")).cast("int").alias("line_end"))
    return diff.merge_regions(line)


_MANIFESTS = """old AS (SELECT 'o' || o_orderkey AS path, sha256(o_orderstatus) AS sha256, CAST(o_orderkey AS double) AS mtime FROM orders UNION ALL SELECT 'c' || c_custkey, sha256(c_name), CAST(c_custkey AS double) FROM customer),
new AS (SELECT 'o' || o_orderkey AS path, sha256(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority ELSE o_orderstatus END) AS sha256, CAST(o_orderkey % 1000 AS double) AS mtime FROM orders UNION ALL SELECT 's' || s_suppkey, sha256(s_name), CAST(s_suppkey AS double) FROM supplier)"""


def _two_manifests(spark, sf_dir):
    """Orders are files of both, with other contents where they are urgent; customers are gone and suppliers have come."""

    def rows(name, letter, key, text, time):
        return table(spark, sf_dir, name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("path"), F.sha2(text.cast("binary"), 256).alias("sha256"), time.cast("double").alias("mtime"))

    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    old = rows("orders", "o", "o_orderkey", status, key).unionByName(rows("customer", "c", "c_custkey", F.col("c_name"), F.col("c_custkey")))
    new = rows("orders", "o", "o_orderkey", F.when(priority == "1-URGENT", priority).otherwise(status), key % 1000).unionByName(rows("supplier", "s", "s_suppkey", F.col("s_name"), F.col("s_suppkey")))
    return old, new


@query(f"WITH {_MANIFESTS} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON n.path = o.path")
def manifest_diff(spark, sf_dir):
    return manifests.diff(*_two_manifests(spark, sf_dir))


@query(f"WITH {_MANIFESTS} SELECT count(*) FILTER (WHERE n.mtime > 500) AS changed, count(*) FILTER (WHERE o.path IS NULL AND n.mtime > 500) AS added, count(*) FILTER (WHERE n.path IS NULL) AS removed, count(*) FILTER (WHERE n.mtime > 500 OR n.path IS NULL) > 0 AS is_stale FROM old o FULL JOIN new n ON n.path = o.path")
def staleness(spark, sf_dir):
    return manifests.staleness(*_two_manifests(spark, sf_dir), built_at=500.0)


# ---- resolution

@query(r"SELECT page_id, rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') AS url FROM pages")
def url_normal_form(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normal_url(F.col("url")).alias("url"))


@query(r"""WITH c AS (SELECT page_id, url, rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') AS u FROM pages), s AS (SELECT page_id, url || '/' AS path FROM pages UNION ALL SELECT page_id, url || '?q=1#top' FROM pages)
SELECT c.page_id AS caller, s.page_id AS endpoint FROM c JOIN s ON rtrim(split_part(split_part(s.path, '?', 1), '#', 1), '/') = c.u""")
def stitch(spark, sf_dir):
    """Calls to the endpoints whose normalised path is theirs."""
    from strandwork.operators.resolution import stitch as join

    p = table(spark, sf_dir, "pages")
    end = p.select("page_id", F.concat("url", F.lit("/")).alias("path")).unionByName(p.select("page_id", F.concat("url", F.lit("?q=1#top")).alias("path")))
    return join(p.select(F.col("page_id").alias("caller"), "url"), end.select(F.col("page_id").alias("endpoint"), "path")).select("caller", "endpoint")


@query(r"""WITH f AS (SELECT 'a' || (p_partkey % 5) || '/b' || (p_partkey % 7) || '/c' || (p_partkey % 3) || '/' || p_partkey || '.py' AS path FROM part),
d(dir, service) AS (VALUES ('a1', 's1'), ('a1/b2', 's12'), ('a1/b2/c0', 's120'), ('a2/b', 'no'), ('a3/b3', 's33')),
m AS (SELECT path, service, row_number() OVER (PARTITION BY path ORDER BY length(dir) DESC) AS k FROM f JOIN d ON starts_with(path, dir || '/')) SELECT path, service FROM m WHERE k = 1""")
def longest_prefix(spark, sf_dir):
    """The service whose directory is the longest that holds each file."""
    from strandwork.operators.resolution import longest_directory

    k = lambda n: (F.col("p_partkey") % n).cast("string")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), k(5), F.lit("/b"), k(7), F.lit("/c"), k(3), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    dirs = spark.createDataFrame([("a1", "s1"), ("a1/b2", "s12"), ("a1/b2/c0", "s120"), ("a2/b", "no"), ("a3/b3", "s33")], "dir string, service string")
    return longest_directory(files, dirs).select("path", "service")


@query("WITH {graph} SELECT DISTINCT type, upper(substr(replace(type, '_', ''), 1, 1)) || lower(substr(replace(type, '_', ''), 2)) AS label FROM nodes")
def node_labels(spark, sf_dir):
    return fk_graph(spark, sf_dir).nodes.select("type", label(F.col("type")).alias("label")).distinct()

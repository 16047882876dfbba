"""The engine's tools by name: plain arguments in, JSON-ready answers out. Only answers are gathered on the driver.

The command line and the HTTP routes are thin layers over ``call``.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.graph import Graph
from strandwork.operators import diff, lookup, simple_paths, traverse
from strandwork.plans.build import build, sources_table
from strandwork.schema import AMBIGUOUS
from strandwork.sources import manifests, sinks
from strandwork.sources.listing import ScanOptions
from strandwork.streaming.refresh import Store, refresh


class NodeNotFound(LookupError):
    pass


def load(spark: SparkSession, path: str) -> Graph:
    """A graph folder of Parquet tables, or a JSON document."""
    return sinks.read_document(spark, path, about=True) if path.endswith(".json") else sinks.read_parquet(spark, path)


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _node(g: Graph, name: str):
    n = lookup.resolve(g, name).first()
    if n is None:
        raise NodeNotFound(name)
    return n


def _options(a: dict) -> dict:
    keys = ("direction", "max_depth", "include_ambiguous", "edge_types", "node_types", "file_pattern")
    return {k: a[k] for k in keys if a.get(k) is not None}


def _subgraph(focus, r: traverse.Reach, fmt: str) -> dict | list:
    sinks.check_format(fmt)
    if fmt == "files":
        return [x["file_path"] for x in rows(sinks.file_list(r.nodes))]
    nodes = r.nodes.drop("root").orderBy("depth", "id")
    extent = rows(lookup.extent(nodes))[0]
    if fmt == "compact":
        return {"focus": focus, **extent, "nodes": rows(sinks.compact_nodes(nodes)), "edges": rows(sinks.compact_edges(r.edges))}
    return {"focus": focus, **extent, "nodes": rows(nodes), "edges": rows(r.edges.drop("root"))}


def impact(g: Graph, a: dict):
    n = _node(g, a["node"])
    return _subgraph(n["qualified_name"], traverse.impact(g, n["id"], **_options(a)), a.get("format", "full"))


def paths(g: Graph, a: dict):
    s, t = _node(g, a["from_node"]), _node(g, a["to_node"])
    fmt = sinks.check_format(a.get("format", "full"))
    p = simple_paths.find_paths(g, s["id"], t["id"], a.get("max_depth", simple_paths.PATH_DEPTH), a.get("edge_types"), a.get("node_types"))
    at, over = simple_paths.detail(g, p)
    if fmt == "files":
        return [x["file_path"] for x in rows(sinks.file_list(at))]
    out = [{"path_id": x["path_id"], "hop_count": x["hop_count"], "nodes": [], "edges": []} for x in rows(p.orderBy("path_id"))]
    by = {x["path_id"]: x for x in out}
    for part, df in (("nodes", at), ("edges", over)):  # at most PATHS paths of max_depth edges
        for x in rows(df.orderBy("path_id", "k")):
            by[x.pop("path_id")][part].append({c: v for c, v in x.items() if c != "k"})
    if fmt == "compact":
        for x in out:
            x["nodes"] = [n["qualified_name"] or n["id"] for n in x["nodes"]]
            x["edge_types"] = [e["type"] for e in x.pop("edges")]
        return {"from": s["qualified_name"], "to": t["qualified_name"], "path_count": len(out), "paths": out}
    return {"from": s.asDict(recursive=True), "to": t.asDict(recursive=True), "path_count": len(out), "paths": out}


def audit(g: Graph, a: dict):
    e = rows(lookup.audit(g))
    low, mid = [x for x in e if x["certainty"] < AMBIGUOUS], [x for x in e if x["certainty"] == AMBIGUOUS]
    return {"unresolved_count": len(low), "ambiguous_count": len(mid), "unresolved_edges": low, "ambiguous_edges": mid}


def dependents(g: Graph, a: dict):
    d = traverse.dependents(g, a["file_path"])
    return {"file_path": a["file_path"], "dependent_count": d.count(), "dependents": rows(sinks.format_nodes(d, a.get("format", "full")))}


def summary(g: Graph, a: dict):
    return {"summary": lookup.summary(g), "statistics": rows(lookup.statistics(g)), "metadata": g.metadata}


def search(g: Graph, a: dict):
    found = lookup.search(g, a["query"], a.get("node_types"), a.get("file_pattern"), a.get("limit", 10))
    return rows(found.select("qualified_name", "display_name", "type", "file_path", "line_number", "id"))


def file_context(g: Graph, a: dict):
    nodes, links = rows(lookup.file_context(g, a["file_path"])), rows(lookup.file_imports(g, a["file_path"]))
    of = lambda *types: [n for n in nodes if n["type"] in types]
    named = ("MODULE", "CLASS", "FUNCTION", "METHOD", "ENDPOINT", "SQLALCHEMY_MODEL", "TABLE")
    return {
        "file_path": a["file_path"], "node_count": len(nodes), "modules_imported": sorted(x["name"] for x in links if x["kind"] == "imports"), "imported_by": sorted(x["name"] for x in links if x["kind"] == "imported_by"),
        "classes": of("CLASS"), "functions": of("FUNCTION"), "methods": of("METHOD"), "endpoints": of("ENDPOINT"), "models": of("SQLALCHEMY_MODEL", "TABLE"), "other": [n for n in nodes if n["type"] not in named],
    }


def diff_impact(g: Graph, a: dict):
    changes = diff.parse_diff(a["diff"]) if a.get("diff") else [(c["file_path"], c.get("line_start", diff.WHOLE[0]), c.get("line_end", diff.WHOLE[1])) for c in a.get("changes", [])]
    d, fmt = diff.diff_impact(g, diff.regions(g.spark, changes), compat=a.get("compat", False)), a.get("format", "compact")
    tiers = {"directly_changed": d.changed, "immediate_dependents": d.immediate, "transitive_dependents": d.transitive}
    out = {k: rows(sinks.format_nodes(v, fmt)) for k, v in tiers.items()}
    return out | {f"{k}_count": len(v) for k, v in out.items()}


def unused(g: Graph, a: dict):
    u = lookup.unused(g, a.get("node_types"), a.get("exclude_patterns"), a.get("entry_points"), a.get("ignore_edge_types"))
    files = rows(lookup.by_file(u).orderBy("file_path"))
    return {"unused_count": sum(x["n"] for x in files), "by_file": {x["file_path"]: x["names"] for x in files}}


def batch_impact(g: Graph, a: dict):
    found, names = [], []
    for name in a["nodes"]:
        n = lookup.resolve(g, name).first()
        names.append(n["qualified_name"] if n else f"<not found: {name}>")
        found += [(n["id"],)] if n else []
    r = traverse.batch_impact(g, g.spark.createDataFrame(found, "id string"), **{k: v for k, v in _options(a).items() if k in ("direction", "max_depth", "include_ambiguous")})
    out = _subgraph(names, r, a.get("format", "compact"))
    return out if isinstance(out, list) else {"input_nodes": names, "node_count": len(out["nodes"]), "edge_count": len(out["edges"])} | out


def cycles(g: Graph, a: dict):
    c = simple_paths.find_cycles(g, a.get("edge_types"), a.get("max_length"))
    out = [x | {"node_ids": x["node_ids"]} for x in rows(c.orderBy("length", "node_ids"))]
    return {"cycle_count": len(out), "cycles": out}


def scan(spark: SparkSession, a: dict):
    options = ScanOptions(a["project_path"], exclude_patterns=a.get("exclude_patterns") or [], include_js=a.get("include_js", False))
    start = time.time()
    g = refresh(spark, options, Store(spark, a["store"])) if a.get("store") else build(spark, options)
    if a.get("output_path"):
        sinks.write_parquet(g, a["output_path"])
    return summary(g, a) | {"warning_count": g.warnings.count(), "graph_written_to": a.get("output_path"), "elapsed": round(time.time() - start, 3)}


def check_staleness(spark: SparkSession, a: dict, shown: int = 20):
    store = Store(spark, a["store"]).read()
    now, _ = sources_table(spark, ScanOptions(a["project_path"], exclude_patterns=a.get("exclude_patterns") or [], include_js=a.get("include_js", False)))
    now = now.select("path", F.sha2("content", 256).alias("sha256"), "mtime")
    if store is None:
        return {"is_stale": True, "recommendation": "no graph yet: scan"}
    by = {s: sorted(x["path"] for x in rows(manifests.diff(store[1], now).where(F.col("status") == s).select("path"))) for s in ("changed", "added", "removed")}
    stale = any(by.values())
    return {"is_stale": stale, **{f"{s}_count": len(v) for s, v in by.items()}, **{s: v[:shown] for s, v in by.items()}, "recommendation": "rescan" if stale else "up to date"}


ON_GRAPH = {f.__name__: f for f in (impact, paths, audit, dependents, summary, search, file_context, diff_impact, unused, batch_impact, cycles)}
ON_TREE = {"scan": scan, "rescan_graph": scan, "check_staleness": check_staleness}


def call(spark: SparkSession, tool: str, a: dict, graph: Graph | None = None):
    """Run a tool by name. Graph tools take ``graph`` or read the one at a["graph_path"]."""
    if tool in ON_TREE:
        return ON_TREE[tool](spark, a)
    if tool not in ON_GRAPH:
        raise ValueError(f"no tool {tool!r}")
    path = a.get("graph_path", "")
    return ON_GRAPH[tool](graph or load(spark, f"{path}/graph.json" if os.path.isfile(f"{path}/graph.json") else path), a)

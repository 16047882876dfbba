"""Command line: ``python -m strandwork.cli VERB ..``; answers are JSON. Exit codes: 0 done, 1 no such node, 2 bad argument."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from strandwork.plans import api
from strandwork.sources import sinks
from strandwork.sources.listing import ScanOptions
from strandwork.streaming.refresh import Store, watch_tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandwork")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name, *positional, graph=True, **options):
        v = sub.add_parser(name)
        for x in positional:
            v.add_argument(x)
        if graph:
            v.add_argument("--graph", required=True)
        for o, kind in options.items():
            flag = "--" + o.replace("_", "-")
            v.add_argument(flag, action="append") if kind is list else v.add_argument(flag, action="store_true") if kind is bool else v.add_argument(flag, type=kind)

    verb("scan", "path", graph=False, output=str, exclude=list, include_js=bool, store=str)
    verb("staleness", "path", graph=False, exclude=list, include_js=bool, store=str)
    verb("summary")
    verb("audit")
    verb("impact", "node", direction=str, depth=int, no_ambiguous=bool, format=str, edge_type=list, node_type=list, file_pattern=str)
    verb("batch-impact", "nodes", direction=str, depth=int, format=str)
    verb("dependents", "file", format=str)
    verb("paths", "source", "target", depth=int, format=str, edge_type=list, node_type=list)
    verb("search", "query", node_type=list, file_pattern=str, limit=int)
    verb("context", "file")
    verb("diff-impact", diff_file=str, format=str)
    verb("unused", node_type=list, exclude=list, entry_point=list)
    verb("cycles", edge_type=list, max_length=int)
    verb("export", "kind", "output")
    verb("serve", port=int, host=str)
    verb("watch", "path", graph=False, output=str, exclude=list, include_js=bool, store=str, debounce_ms=int, rounds=int)
    verb("mcp", graph=False, graph_path=str)
    return p


def _watch(spark: SparkSession, a: argparse.Namespace) -> None:
    if not a.output or not a.store:
        raise ValueError("watch needs --output and --store")

    def done(g, n: int) -> None:
        sinks.write_parquet(g, a.output)
        print(json.dumps({"round": n, "nodes": g.nodes.count(), "edges": g.edges.count()}), flush=True)

    options = ScanOptions(a.path, exclude_patterns=a.exclude or [], include_js=a.include_js)
    watch_tree(spark, options, Store(spark, a.store), done, (1500 if a.debounce_ms is None else a.debounce_ms) / 1000, rounds=a.rounds)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("strandwork").getOrCreate()
    o = vars(a)
    get = o.get
    args = {
        "graph_path": get("graph"), "format": get("format") or ("compact" if a.verb in ("diff-impact", "batch-impact") else "full"), "node": get("node"), "nodes": (get("nodes") or "").split(","), "direction": get("direction"), "max_depth": get("depth"), "include_ambiguous": not get("no_ambiguous"),
        "edge_types": get("edge_type"), "node_types": get("node_type"), "file_pattern": get("file_pattern"), "from_node": get("source"), "to_node": get("target"), "query": get("query"), "limit": get("limit"), "file_path": get("file"), "exclude_patterns": get("exclude"),
        "entry_points": get("entry_point"), "max_length": get("max_length"), "project_path": get("path"), "output_path": get("output"), "include_js": get("include_js"), "store": get("store"),
    }
    args = {k: v for k, v in args.items() if v is not None}
    tool = {"context": "file_context", "staleness": "check_staleness"}.get(a.verb, a.verb.replace("-", "_"))
    try:
        if a.verb == "diff-impact":
            text = open(a.diff_file, encoding="utf-8").read() if a.diff_file else sys.stdin.read()
            args["diff"] = text
            if not text.strip():
                return 0
        if a.verb == "export":
            g = api.load(spark, a.graph)
            if a.kind == "csv":
                sinks.write_csv(g, a.output)
            elif a.kind == "json":
                with open(a.output, "w", encoding="utf-8") as f:
                    f.write(sinks.document(g))
            else:
                raise ValueError(f"export {a.kind!r}: csv or json")
            return 0
        if a.verb == "serve":
            from strandwork.plans.server import serve

            serve(api.load(spark, a.graph), a.port or 8080, a.host or "127.0.0.1").serve_forever()
            return 0
        if a.verb == "mcp":
            from strandwork.plans.mcp import Server

            Server(spark, a.graph_path).run(sys.stdin, sys.stdout)
            return 0
        if a.verb == "watch":
            _watch(spark, a)
            return 0
        print(json.dumps(api.call(spark, tool, args), indent=2, default=str))
        return 0
    except api.NodeNotFound as e:
        print(f"no node {e}", file=sys.stderr)
        return 1
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

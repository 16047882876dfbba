"""The engine's tools over the Model Context Protocol: JSON-RPC 2.0, one message a line, on standard input and output."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import SparkSession

from strandwork.graph import Graph
from strandwork.plans import api

# fixed values of the public protocol
PROTOCOL = "2024-11-05"
BAD_JSON, BAD_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602

_S, _B, _I = {"type": "string"}, {"type": "boolean"}, {"type": "integer", "minimum": 0}
_L = {"type": "array", "items": _S}
_FORMAT = {"type": "string", "enum": ["full", "compact", "files"]}
_DIRECTION = {"type": "string", "enum": ["downstream", "upstream"]}
_CHANGES = {"type": "array", "items": {"type": "object", "properties": {"file_path": _S, "line_start": _I, "line_end": _I}, "required": ["file_path"]}}
_WALK = {"direction": _DIRECTION, "max_depth": _I, "include_ambiguous": _B, "format": _FORMAT}
_TYPES = {"edge_types": _L, "node_types": _L}
_TREE = {"project_path": _S, "exclude_patterns": _L, "include_js": _B, "store": _S}

#: name: (what it does, arguments, those that must be given)
TOOLS = {
    "scan": ("Scan a source tree into a graph.", _TREE | {"output_path": _S}, ["project_path"]),
    "rescan_graph": ("Bring a graph up to date; with a store only changed files are parsed.", _TREE | {"output_path": _S}, ["project_path"]),
    "check_staleness": ("Files that changed, came or went since the stored graph.", _TREE, ["project_path", "store"]),
    "impact": ("What a node reaches, or what reaches it.", {"node": _S} | _WALK | _TYPES | {"file_pattern": _S}, ["node"]),
    "batch_impact": ("Impact of several nodes at once.", {"nodes": _L} | _WALK, ["nodes"]),
    "paths": ("Simple paths between two nodes.", {"from_node": _S, "to_node": _S, "max_depth": _I, "format": _FORMAT} | _TYPES, ["from_node", "to_node"]),
    "dependents": ("Nodes that depend on a file.", {"file_path": _S, "format": _FORMAT}, ["file_path"]),
    "file_context": ("What a file holds, imports and is imported by.", {"file_path": _S}, ["file_path"]),
    "diff_impact": ("Impact of a unified diff or of a list of changed regions.", {"diff": _S, "changes": _CHANGES, "format": _FORMAT}, []),
    "search": ("Nodes by name.", {"query": _S, "node_types": _L, "file_pattern": _S, "limit": _I}, ["query"]),
    "unused": ("Nodes that nothing points to.", {"node_types": _L, "exclude_patterns": _L, "entry_points": _L}, []),
    "cycles": ("Import cycles.", {"edge_types": _L, "max_length": _I}, []),
    "audit": ("Unresolved and ambiguous edges.", {}, []),
    "summary": ("Counts by type and a sentence about them.", {}, []),
}


def listing() -> list[dict]:
    """The tools with their argument schemas. Graph tools take ``graph_path`` as well."""
    out = []
    for name, (text, args, needed) in TOOLS.items():
        more = {"graph_path": _S} if name in api.ON_GRAPH else {}
        out.append({"name": name, "description": text, "inputSchema": {"type": "object", "properties": args | more, "required": needed}})
    return out


class Server:
    """Answers messages; a graph stays open until a scan or rescan writes anew."""

    def __init__(self, spark: SparkSession, graph_path: str | None = None) -> None:
        self.spark, self.graph_path = spark, graph_path
        self.open: dict[str, Graph] = {}

    def _call(self, name: str, a: dict) -> str:
        missing = [x for x in TOOLS[name][2] if a.get(x) is None]
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        graph = None
        if name in api.ON_GRAPH:
            path = a.get("graph_path") or self.graph_path
            if not path:
                raise ValueError("no graph: give graph_path, or scan first")
            if path not in self.open:
                self.open[path] = api.load(self.spark, path)
            graph = self.open[path]
        out = api.call(self.spark, name, a, graph)
        if name in ("scan", "rescan_graph"):
            self.open.clear()
            self.graph_path = a.get("output_path") or self.graph_path
        return json.dumps(out, indent=2, default=str)

    def answer(self, message: dict) -> dict | None:
        """The reply to a message; None to a notification. What a tool raises becomes a text that begins with ERROR."""
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return _failed(message.get("id") if isinstance(message, dict) else None, BAD_REQUEST, "not a request")
        if "id" not in message:
            return None
        i, method, p = message["id"], message["method"], message.get("params") or {}
        if method == "initialize":
            return _done(i, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "strandwork", "version": "1"}})
        if method == "ping":
            return _done(i, {})
        if method == "tools/list":
            return _done(i, {"tools": listing()})
        if method != "tools/call":
            return _failed(i, NO_METHOD, f"no method {method!r}")
        if p.get("name") not in TOOLS:
            return _failed(i, BAD_PARAMS, f"no tool {p.get('name')!r}")
        try:
            text, bad = self._call(p["name"], p.get("arguments") or {}), False
        except Exception as e:  # a tool's failure is its answer; the server goes on
            text, bad = f"ERROR: {type(e).__name__}: {e}", True
        return _done(i, {"content": [{"type": "text", "text": text}], "isError": bad})

    def run(self, lines: TextIO, out: TextIO) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except json.JSONDecodeError as e:
                reply = _failed(None, BAD_JSON, str(e))
            if reply is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()


def _done(i, result: dict) -> dict:
    return {"jsonrpc": "2.0", "id": i, "result": result}


def _failed(i, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": message}}

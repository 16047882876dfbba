"""The HTTP routes over one graph, on the standard library's server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from strandwork.graph import Graph
from strandwork.operators import lookup
from strandwork.plans import api

MOST_DEPTH = 20


def answer(g: Graph, url: str) -> tuple[int, object]:
    """(status, body) of a GET."""
    u = urlparse(url)
    q = parse_qs(u.query)
    one = lambda k, default=None: q.get(k, [default])[0]
    try:
        depth = int(one("depth", "6"))
        if not 1 <= depth <= MOST_DEPTH:
            return 400, {"error": f"depth is 1 to {MOST_DEPTH}"}
        if u.path == "/api/summary":
            return 200, api.summary(g, {})
        if u.path == "/api/nodes":
            return 200, api.rows(lookup.nodes_of(g, q.get("type")))
        if u.path == "/api/edges":
            return 200, api.rows(lookup.edges_of(g, q.get("type")))
        if u.path == "/api/services":
            return 200, api.rows(lookup.services(g))
        if u.path == "/api/audit":
            return 200, api.audit(g, {})
        if u.path == "/api/impact":
            return 200, api.impact(g, {"node": one("node", ""), "direction": one("direction", "downstream"), "max_depth": depth})
        if u.path == "/api/paths":
            return 200, api.paths(g, {"from_node": one("from", ""), "to_node": one("to", ""), "max_depth": depth})
    except api.NodeNotFound as e:
        return 404, {"error": f"no node {e}"}
    except ValueError as e:
        return 400, {"error": str(e)}
    return 404, {"error": "no such route"}


def serve(g: Graph, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            status, body = answer(g, self.path)
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)

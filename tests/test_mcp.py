import io
import json
import threading

from strandwork import cli
from strandwork.plans import api, mcp
from strandwork.plans.build import build
from strandwork.sources.listing import ScanOptions
from strandwork.streaming.refresh import Store, watch_tree


def tree(path):
    path.mkdir()
    (path / "a.py").write_text("from b import g\n\n\ndef f():\n    g()\n")
    (path / "b.py").write_text("def g():\n    pass\n")
    return str(path)


def test_every_tool_has_a_schema():
    assert set(mcp.TOOLS) == set(api.ON_GRAPH) | set(api.ON_TREE) and len(mcp.listing()) == 14


def test_session(spark, tmp_path):
    r, out = tree(tmp_path / "t"), str(tmp_path / "g")
    asked = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "audit"}},
        {"id": 4, "method": "tools/call", "params": {"name": "scan", "arguments": {"project_path": r, "output_path": out}}},
        {"id": 5, "method": "tools/call", "params": {"name": "impact", "arguments": {"node": "g", "direction": "upstream", "format": "files"}}},
        {"id": 6, "method": "tools/call", "params": {"name": "impact", "arguments": {"node": "nothing like it"}}},
        {"id": 7, "method": "tools/call", "params": {"name": "nope"}}, {"id": 8, "method": "nope"},
    ]
    sink = io.StringIO()
    mcp.Server(spark).run(io.StringIO("".join(json.dumps(x) + "\n" for x in asked) + "\n{\n[]\n"), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, 6, 7, 8, None, None]
    text = lambda k: got[k]["result"]["content"][0]["text"]
    assert got[2]["result"]["isError"] and text(2).startswith("ERROR: ")
    assert json.loads(text(3))["graph_written_to"] == out and json.loads(text(4)) == ["a.py", "b.py"]
    assert got[5]["result"]["isError"] and [x["error"]["code"] for x in got[6:]] == [mcp.BAD_PARAMS, mcp.NO_METHOD, mcp.BAD_JSON, mcp.BAD_REQUEST]


def test_watch_tree(spark, tmp_path):
    r, got = tree(tmp_path / "t"), []

    def done(g, n):
        got.append(g.nodes.where("type = 'FUNCTION' and file_path is not null").count())
        if n == 0:
            threading.Timer(0.3, lambda: (tmp_path / "t/c.py").write_text("def h():\n    pass\n")).start()

    watch_tree(spark, ScanOptions(r), Store(spark, str(tmp_path / "s")), done, debounce=0.2, poll=0.1, rounds=2)
    assert got == [2, 3]
    assert cli.main(["watch", r, "--output", str(tmp_path / "g"), "--store", str(tmp_path / "s2"), "--rounds", "1"], spark) == 0
    assert cli.main(["watch", r], spark) == 2
    assert api.load(spark, str(tmp_path / "g")).nodes.where("name = 'h'").count() == 1


def test_added_extractor(spark, tmp_path):
    def todo(file):
        file.node("todo", "FUNCTION", f"{file.module}::todo", 1)
        file.edge(("mod", file.module), "CONTAINS", ("todo", f"{file.module}::todo"), 1)

    g = build(spark, ScanOptions(tree(tmp_path / "t")), [todo])
    assert sorted(x.qualified_name for x in g.nodes.where("name = 'todo'").collect()) == ["a::todo", "b::todo"]
    assert g.edges.join(g.nodes.where("name = 'todo'").select(g.nodes.id.alias("target_id")), "target_id").count() == 2

import fnmatch
import json

import pytest
from pyspark.sql import functions as F

from strandwork.cli import main
from strandwork.functions.globs import glob
from strandwork.graph import Graph
from strandwork.operators import diff, lookup, merge, simple_paths, traverse
from strandwork.plans import api
from strandwork.plans.server import answer
from strandwork.schema import EDGE_TYPES, NODE_TYPES, id_column, make_id
from strandwork.sources import sinks

NODES = [("m:a", "MODULE", "p.main", "p/main.py", None), ("m:b", "MODULE", "p.util", "p/util.py", None), ("m:c", "MODULE", "p.model", "p/model.py", None), ("f:a", "FUNCTION", "p.main::run", "p/main.py", 5), ("f:b", "FUNCTION", "p.util::greet", "p/util.py", 10), ("f:c", "FUNCTION", "p.model::help", "p/model.py", 20), ("m:x", "EXTERNAL_MODULE", "outside", None, None), ("f:lone", "FUNCTION", "p.util::Lone", "p/util.py", 30), ("f:self", "FUNCTION", "p.util::me", "p/util.py", 40)]
EDGES = [("m:a", "m:b", "IMPORTS", 3), ("m:b", "m:c", "IMPORTS", 3), ("f:a", "f:b", "CALLS", 1), ("f:b", "f:c", "CALLS", 3), ("m:a", "f:a", "CONTAINS", 3), ("m:b", "f:b", "CONTAINS", 3), ("m:c", "f:c", "CONTAINS", 3), ("m:a", "m:x", "IMPORTS", 0), ("f:self", "f:self", "CALLS", 3), ("f:c", "gone", "CALLS", 3)]


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame([(i, t, q, q, q, f, line, None, 3, {}) for i, t, q, f, line in NODES], "id string, type string, name string, qualified_name string, display_name string, file_path string, line_number int, column int, certainty int, metadata map<string,string>")
    e = spark.createDataFrame([(f"{a}{b}{t}", a, b, t, f"{a}->{b}", None, None, c, {}) for a, b, t, c in EDGES], "id string, source_id string, target_id string, type string, display_name string, file_path string, line_number int, certainty int, metadata map<string,string>")
    return Graph(n.cache(), e.cache())


def ids(df):
    return sorted(r.id for r in df.collect())


def test_impact(g):
    r = traverse.impact(g, "m:a")
    assert ids(r.nodes) == ["f:a", "f:b", "f:c", "m:b", "m:c", "m:x"] and "f:cgoneCALLS" in ids(r.edges)
    assert ids(traverse.impact(g, "m:a", max_depth=0).nodes) == [] and ids(traverse.impact(g, "m:a", max_depth=0).edges) == []
    assert "f:b" not in ids(traverse.impact(g, "f:a", include_ambiguous=False).nodes)
    assert ids(traverse.impact(g, "f:self").nodes) == [] and ids(traverse.impact(g, "f:self").edges) == ["f:selff:selfCALLS"]
    assert ids(traverse.impact(g, "m:a", file_pattern="p/u*").nodes) == ["f:b", "m:b", "m:x"]
    assert ids(traverse.impact(g, "m:a", file_pattern="!p/u*").nodes) == ["f:a", "f:c", "m:c", "m:x"]
    assert ids(traverse.impact(g, "f:c", direction="upstream").nodes) == ["f:a", "f:b", "m:a", "m:b", "m:c"]
    with pytest.raises(ValueError):
        traverse.impact(g, "f:c", direction="sideways")


def test_batch_and_dependents(g, spark):
    b = traverse.batch_impact(g, spark.createDataFrame([("f:a",), ("f:b",)], "id string"))
    assert ids(b.nodes) == ["f:b", "f:c"]
    assert ids(traverse.dependents(g, "p/model.py")) == ["f:a", "f:b", "m:a", "m:b", "m:c"]


def test_paths(g):
    p = simple_paths.find_paths(g, "m:a", "f:c").collect()
    assert [r.node_ids for r in p] == [["m:a", "f:a", "f:b", "f:c"], ["m:a", "m:b", "f:b", "f:c"], ["m:a", "m:b", "m:c", "f:c"]]
    assert simple_paths.find_paths(g, "f:c", "m:a").count() == 0 and simple_paths.find_paths(g, "m:a", "m:a").count() == 0
    assert [r.node_ids[1] for r in simple_paths.find_paths(g, "m:a", "f:c", node_types=["FUNCTION"]).collect()] == ["f:a"]
    assert simple_paths.find_paths(g, "m:a", "f:c", keep=2).count() == 2


def test_paths_in_small_rounds_are_all_paths_in_depth_first_order(spark):
    """A dense graph at the default depth, walks extended two and seven at a time, against plain recursion."""
    import random

    dice = random.Random(5)
    pairs = sorted({(f"v{dice.randrange(9)}", f"v{dice.randrange(9)}") for _ in range(45)})
    edges = spark.createDataFrame([(f"{dice.random()}", a, b, "CALLS", 3) for a, b in pairs], "id string, source_id string, target_id string, type string, certainty int").cache()
    graph = Graph(edges.select(F.col("source_id").alias("id")).distinct(), edges)
    out = {}
    for r in sorted(edges.collect(), key=lambda r: r.id):
        out.setdefault(r.source_id, []).append(r.target_id)

    def walk(path):
        if path[-1] == "v1":
            yield path
        elif len(path) <= simple_paths.PATH_DEPTH:
            for v in out.get(path[-1], []):
                if v not in path:
                    yield from walk([*path, v])

    want = list(walk(["v0"]))
    assert len(want) > 20
    for keep, at_once in ((20, 40), (len(want) + 1, 300)):
        got = simple_paths.find_paths(graph, "v0", "v1", keep=keep, at_once=at_once).orderBy("path_id").collect()
        assert [r.node_ids for r in got] == want[:keep] and all(r.hop_count == len(r.edge_ids) == len(r.node_ids) - 1 for r in got)


def test_path_answers_and_document_round_trip(g, spark, tmp_path):
    full = api.paths(g, {"from_node": "m:a", "to_node": "f:c"})
    assert full["path_count"] == 3 and full["from"]["id"] == "m:a" and [n["id"] for n in full["paths"][1]["nodes"]] == ["m:a", "m:b", "f:b", "f:c"]
    assert [e["type"] for e in full["paths"][2]["edges"]] == ["IMPORTS", "IMPORTS", "CONTAINS"]
    short = api.paths(g, {"from_node": "m:a", "to_node": "f:c", "format": "compact"})
    assert short["paths"][0]["nodes"] == ["p.main", "p.main::run", "p.util::greet", "p.model::help"] and short["paths"][0]["edge_types"] == ["CONTAINS", "CALLS", "CALLS"]
    assert api.paths(g, {"from_node": "m:a", "to_node": "f:c", "format": "files"}) == ["p/main.py", "p/model.py", "p/util.py"]
    warned = Graph(g.nodes, g.edges, spark.createDataFrame([("IO_ERROR", "gone", "p/x.py", 0)], "code string, message string, path string, certainty int"), {"stages": ["scan"]})
    (tmp_path / "graph.json").write_text(sinks.document(warned))
    back = api.load(spark, str(tmp_path / "graph.json"))
    assert back.metadata == {"stages": ["scan"]} and [tuple(r) for r in back.warnings.collect()] == [("IO_ERROR", "gone", "p/x.py", 0)]
    assert "1 warnings, 1 files" in lookup.summary(back)
    assert ids(lookup.focus_search(g, "P/MODEL")) == ["f:c", "m:c"] and tuple(lookup.extent(g.nodes).first()) == (9, 3)


def test_cycles(spark):
    e = [("a", "b", "IMPORTS"), ("a", "b", "IMPORTS_FROM"), ("b", "c", "IMPORTS"), ("c", "a", "IMPORTS"), ("d", "d", "IMPORTS"), ("c", "x", "IMPORTS"), ("b", "a", "CALLS")]
    edges = spark.createDataFrame([(f"{a}{b}{t}", a, b, t, 3) for a, b, t in e], "id string, source_id string, target_id string, type string, certainty int")
    graph = Graph(edges.select(F.col("source_id").alias("id")), edges)
    assert sorted((r.length, tuple(r.node_ids)) for r in simple_paths.find_cycles(graph).collect()) == [(1, ("d",)), (3, ("a", "b", "c"))]
    assert simple_paths.find_cycles(graph, max_length=2).count() == 1


def test_lookups(g):
    first = lambda q: lookup.resolve(g, q).first()
    assert first("f:b").id == "f:b" and first("P.UTIL::GREET").id == "f:b" and first("greet").id == "f:b" and first("nothing at all") is None
    assert [r.id for r in lookup.search(g, "p.util").collect()] == ["m:b", "f:lone", "f:b", "f:self"]
    assert ids(lookup.search(g, "p.*(run|help)$")) == ["f:a", "f:c"] and lookup.search(g, "p(", limit=3).count() == 0
    assert "m:x" not in ids(lookup.search(g, "o", file_pattern="*"))
    assert ids(lookup.unused(g)) == ["f:lone"] and ids(lookup.unused(g, ignore_edge_types=["CONTAINS"])) == ["f:a", "f:lone"] and ids(lookup.unused(g, entry_points=["*Lone"])) == []
    assert ids(lookup.unused(g, exclude=["p/*"])) == []
    assert [(r.certainty, r.target_name) for r in lookup.audit(g).collect()] == [(0, "outside"), (1, "p.util::greet")]
    assert ids(lookup.neighbours(g, "f:b")) == ["f:a", "f:c", "m:b"]
    assert {(r.kind, r.name) for r in lookup.file_imports(g, "p/util.py").collect()} == {("imports", "p.model"), ("imported_by", "p/main.py")}
    assert ids(lookup.visible(g, ["FUNCTION"]).edges) == ["f:af:bCALLS", "f:bf:cCALLS", "f:selff:selfCALLS"]


def test_diff(g, spark):
    text = "--- a/p/util.py\n+++ b/p/util.py\n@@ -8,2 +8,5 @@\n x\n@@ -50 +50 @@\n--- a/p/old.py\n+++ /dev/null\n@@ -1,3 +0,0 @@\n"
    assert diff.parse_diff(text) == [("p/util.py", 8, 12), ("p/util.py", 50, 50), ("p/old.py", 1, 99999)]
    d = diff.diff_impact(g, diff.regions(spark, [("src/p/util.py", 8, 12)]))
    assert ids(d.changed) == ["f:b", "m:b"] and ids(d.immediate) == ["f:a", "f:c", "m:a", "m:c"] and ids(d.transitive) == ["m:x"]
    assert ids(diff.diff_impact(g, diff.regions(spark, [("p/util.py", 8, 12)]), compat=True).transitive) == []
    r = diff.regions(spark, [("a", 1, 3), ("a", 4, 6), ("b", 1, 3), ("b", 5, 6), ("c", 1, 10), ("c", 2, 3)])
    assert sorted(map(tuple, diff.merge_regions(r).collect())) == [("a", 1, 6), ("b", 1, 3), ("b", 5, 6), ("c", 1, 10)]


def test_merge_fold(spark):
    e = spark.createDataFrame(
        [("i", "CLASS", "n", "", None, None, 1, None, 1, {"k": "a", "x": "1"}, 1), ("i", "FUNCTION", "other", "q", "d", "f", None, 4, 3, {"k": "b"}, 2), ("i", "FUNCTION", "o", "q", "d", "", 7, None, 2, {"k": "b"}, 3)],
        "id string, type string, name string, qualified_name string, display_name string, file_path string, line_number int, column int, certainty int, metadata map<string,string>, seq long",
    )
    r = merge.merge_nodes(e).first()
    assert (r.type, r.name, r.qualified_name, r.display_name, r.file_path, r.line_number, r.column, r.certainty) == ("CLASS", "n", "n", "n", "f", 7, 4, 3)
    assert r.metadata == {"k": "a | b | b", "x": "1"}


def test_ids_globs_and_sets(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert df.select(id_column("edge", "x", "y")).first()[0] == make_id("edge", "a", "b")
    paths = ["a.py", "a/b.py", "a/[x].py", "t1.py", "A.PY", "x\ny", "a.pyc", ""]
    table = spark.createDataFrame([(p,) for p in paths], "p string")
    for pattern in ["*.py", "a/*", "t[0-9].py", "t[!0-9].py", "?.py", "a/[[]x].py", "*", "x*", "a.p(y|c)", "tests/*"]:
        assert [r.p for r in table.where(glob(F.col("p"), pattern)).collect()] == [p for p in paths if fnmatch.fnmatchcase(p, pattern)], pattern
    assert len(NODE_TYPES) == len(EDGE_TYPES) == 18


def test_tools_routes_and_command_line(g, spark, tmp_path, capsys):
    folder = str(tmp_path / "g")
    sinks.write_parquet(g, folder)
    for tool, a in {"impact": {"node": "p.main"}, "paths": {"from_node": "p.main", "to_node": "p.model::help", "format": "compact"}, "audit": {}, "dependents": {"file_path": "p/model.py"}, "summary": {}, "search": {"query": "run"}, "file_context": {"file_path": "p/util.py"}, "diff_impact": {"changes": [{"file_path": "p/util.py"}]}, "unused": {}, "batch_impact": {"nodes": ["p.main", "no such"]}, "cycles": {"edge_types": ["CALLS"]}}.items():
        json.dumps(api.call(spark, tool, a, g), default=str)
    assert api.call(spark, "cycles", {"edge_types": ["CALLS"]}, g)["cycle_count"] == 1
    assert api.call(spark, "batch_impact", {"nodes": ["no such"]}, g)["input_nodes"] == ["<not found: no such>"]
    assert api.call(spark, "impact", {"node": "p.main", "format": "files"}, g) == ["p/main.py", "p/model.py", "p/util.py"]
    assert answer(g, "/api/impact?node=p.main&depth=1")[0] == 200 and answer(g, "/api/impact?node=zzz")[0] == 404 and answer(g, "/api/impact?node=p.main&depth=99")[0] == 400 and answer(g, "/nowhere")[0] == 404
    assert len(answer(g, "/api/nodes?type=FUNCTION")[1]) == 5
    assert main(["search", "run", "--graph", folder], spark) == 0 and "p.main::run" in capsys.readouterr().out
    assert main(["impact", "no such node", "--graph", folder], spark) == 1 and main(["impact", "p.main", "--graph", folder, "--direction", "up"], spark) == 2 and main(["nonsense"], spark) == 2
    assert main(["export", "csv", str(tmp_path / "c"), "--graph", folder], spark) == 0


def test_diff_impact_follows_chains_to_their_ends(spark):
    n = 72
    nodes = spark.createDataFrame([(f"n{k}", f"f{k}", 1) for k in range(n)], "id string, file_path string, line_number int").cache()
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(n - 1)], "source_id string, target_id string").cache()
    r = diff.regions(spark, [("f0", 1, 1)])
    assert ids(diff.diff_impact(Graph(nodes, edges), r).transitive) == sorted(f"n{k}" for k in range(2, n))
    assert ids(diff.diff_impact(Graph(nodes, edges), r, max_depth=3).transitive) == ["n2", "n3", "n4"]

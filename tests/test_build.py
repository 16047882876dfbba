import os

import pytest

from strandwork.plans.build import build
from strandwork.operators import lookup, traverse
from strandwork.schema import make_id
from strandwork.sources import configs, sinks
from strandwork.sources.js_facts import resolve_specifier
from strandwork.sources.listing import ScanOptions, scan
from strandwork.sources.python_facts import annotation_names, module_name, relative_target
from strandwork.streaming.refresh import Store, refresh, watch

TREE = {
    "api/app/__init__.py": "",
    "api/app/main.py": "import os\nimport importlib\nfrom fastapi import FastAPI, Depends\nfrom .models import User\nfrom . import tools as t\nimport app.tools\n\napp = FastAPI()\n\n\ndef get_db():\n    return 1\n\n\n@app.get('/users/{id}')\ndef read(id: int, u: User, db=Depends(get_db), s=Depends(User)):\n    helper()\n    t.go()\n    os.getcwd()\n    return User()\n\n\ndef helper():\n    importlib.import_module('x')\n",
    "api/app/models.py": "from sqlalchemy import Column, ForeignKey\nfrom sqlalchemy.orm import declarative_base, relationship\nfrom abc import ABC\n\nThing = declarative_base()\n\n\nclass User(Thing):\n    __tablename__ = 'users'\n    team_id = Column(ForeignKey('teams.id'))\n    team = relationship('Team')\n\n    def name(self) -> 'User':\n        return self.other()\n\n\nclass Plain(ABC):\n    pass\n",
    "api/app/tools.py": "import requests\nfrom functools import wraps\n\n\ndef go():\n    requests.post('http://x/y')\n    requests.get(url())\n\n\n@wraps(go)\nasync def later():\n    def inner():\n        go()\n",
    "api/app/urls.py": "from django.urls import path\nfrom app import views\n\nurlpatterns = [path('p/', views.index), include([path('r/', views.Other.as_view())])]\n",
    "api/flasky.py": "@bp.route('/items', methods=['GET', 'POST'])\ndef items():\n    pass\n",
    "web/src/client.tsx": "import { a, b as c } from './util';\nimport React from 'react';\nconst x = require('../other');\nexport async function load() {\n  // fetch('/no')\n  const r = await fetch('/items/');\n  return axios.post(`/users/${r}`);\n}\nconst Page = () => { load(); return useSWR('/items?x=1', load); };\nclass Box { open(n) { fetch('/box'); } }\n",
    "web/src/util.ts": "export const a = 1;\n",
    "api/pyproject.toml": "[project]\nname = 'api-pkg'\n",
    "lib/pyproject.toml": "[project]\nname = 'shared'\n",
    "lib/shared.py": "class Shared:\n    pass\n",
    "docker-compose.yml": "services:\n  api:\n    build: ./api\n    ports:\n      - '80:80'\n",
    "api/Dockerfile": "FROM x\nCMD run\nCMD [\"serve\"]\n",
    "bad.py": "def (:\n",
    "setup.py": "import nothing\n",
    "build/skip.py": "x = 1\n",
}


def write(root, tree):
    for p, text in tree.items():
        os.makedirs(os.path.dirname(os.path.join(root, p)) or root, exist_ok=True)
        with open(os.path.join(root, p), "w") as f:
            f.write(text)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = str(tmp_path_factory.mktemp("tree"))
    write(r, TREE)
    return r


@pytest.fixture(scope="module")
def graph(spark, root):
    g = build(spark, ScanOptions(root, include_js=True))
    g.nodes, g.edges = g.nodes.cache(), g.edges.cache()
    return g


@pytest.fixture(scope="module")
def edges(graph):
    names = {r.id: r.qualified_name for r in graph.nodes.collect()}
    return {(names.get(e.source_id), e.type, names.get(e.target_id)): e for e in graph.edges.collect()}


def test_listing(root):
    files, _ = scan(ScanOptions(root))
    assert ("setup.py", "config") in files and ("api/app/__init__.py", "python") in files and not any("skip" in p for p, _ in files)


def test_names():
    assert module_name("src/a/__init__.py") == "a" and module_name("a/b.py") == "a.b" and module_name("__init__.py") == ""
    assert relative_target("x", 1, "p.m") == "p.x" and relative_target(None, 2, "a.b.c") == "a" and relative_target("x", 3, "p.m") == "x" and relative_target(None, 3, "p.m") is None
    assert resolve_specifier("../x/y.ts", "a.b.c") == ("a.x.y", True) and resolve_specifier("react", "a") == ("react", False)
    import ast

    assert annotation_names(ast.parse("Optional[List['User'] | x.Y]", mode="eval").body) == ["User", "Y"]


def test_every_name_is_a_node(graph):
    ids = {r.id for r in graph.nodes.collect()}
    assert all(e.source_id in ids and e.target_id in ids for e in graph.edges.collect())
    assert graph.nodes.count() == len(ids)


@pytest.mark.parametrize(
    "source, kind, target, certainty",
    [
        ("api.app.main", "IMPORTS", "os", 3), ("api.app.main", "IMPORTS_FROM", "fastapi", 2), ("api.app.main", "IMPORTS_FROM", "api.app.models", 3), ("api.app.main", "IMPORTS_FROM", "api.app", 3), ("api.app.main", "IMPORTS", "app.tools", 2),
        ("api.app.main", "IMPORTS", "<dynamic>::<unknown>", 0), ("api.app.models", "CONTAINS", "api.app.models::User", 3), ("api.app.models::User", "CONTAINS", "api.app.models::User::name", 3), ("api.app.models::User", "INHERITS", "<builtins>::Thing", 1),
        ("api.app.models::Plain", "IMPLEMENTS", "abc::ABC", 2), ("api.app.main::read", "CALLS", "api.app.main::helper", 3), ("api.app.main::read", "CALLS", "os::getcwd", 1), ("api.app.models::User::name", "CALLS", "api.app.models::User::other", 2),
        ("api.app.main::read", "EXPOSES_ENDPOINT", "GET /users/{id}", 3), ("api.app.main::read", "INJECTS_DEPENDENCY", "<unresolved>::get_db", 1), ("api.app.main::read", "INJECTS_DEPENDENCY", "api.app.models::User", 3),
        ("api.app.main::read", "TYPE_ANNOTATED", "api.app.models::User", 3), ("functools::wraps", "DECORATES", "api.app.tools::later", 2), ("api.app.tools::go", "CALLS_HTTP", "POST http://x/y", 3), ("api.app.tools::go", "CALLS_HTTP", "GET <dynamic>", 1),
        ("api.flasky::items", "EXPOSES_ENDPOINT", "POST /items", 3), ("api.app.urls::views.index", "EXPOSES_ENDPOINT", "DJANGO p/ -> views.index", 2), ("api.app.urls::views.Other.as_view", "EXPOSES_ENDPOINT", "DJANGO r/ -> views.Other.as_view", 2),
        ("api.app.models::User", "DEFINES_MODEL", "users", 3), ("api.app.models::User", "FOREIGN_KEY", "teams", 3), ("web.src.client", "IMPORTS_FROM", "web.src.util", 3), ("web.src.client", "IMPORTS", "react", 2), ("web.src.client", "IMPORTS", "web.other", 3),
        ("web.src.client::load", "CALLS_HTTP", "GET /items/", 3), ("web.src.client::load", "CALLS_HTTP", "POST <dynamic>", 1), ("web.src.client::load", "CALLS_HTTP", "GET /items", 2), ("web.src.client::Page", "CALLS_HTTP", "GET /items", 2), ("web.src.client::Box::open", "CALLS_HTTP", "GET /box", 3),
        ("web.src.client", "CALLS", "web.src.client::load", 2), ("api.app.main", "BELONGS_TO_SERVICE", "api", 3),
    ],
)
def test_edges(edges, source, kind, target, certainty):
    assert edges[source, kind, target].certainty == certainty


def test_nodes_and_warnings(graph):
    n = {(r.type, r.qualified_name): r for r in graph.nodes.collect()}
    assert n["MODULE", "api.app.main"].id == make_id("mod", "api.app.main") and ("JS_COMPONENT", "web.src.client::Page") in n
    assert n["FUNCTION", "api.app.main::helper"].display_name == "api.app.main::helper" and n["FUNCTION", "api.app.main::helper"].name == "helper"
    assert n["SERVICE", "api"].metadata["package_name"] == "api-pkg" and n["SERVICE", "api"].metadata["entrypoint"] == '["serve"]' and "GET /items" in n["SERVICE", "api"].metadata["endpoints"]
    assert ("COMPONENT", "shared") in n
    assert {w.code for w in graph.warnings.collect()} >= {"SYNTAX_ERROR", "DYNAMIC_IMPORT"}


def test_round_trips(spark, graph, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(sinks.document(graph))
    back = sinks.read_document(spark, str(path))
    assert sinks.document(back) == sinks.document(type(graph)(graph.nodes, graph.edges))
    sinks.write_parquet(graph, str(tmp_path / "p"))
    assert sinks.read_parquet(spark, str(tmp_path / "p")).edges.count() == graph.edges.count()
    sinks.write_csv(graph, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c/nodes")).columns[0] == ":ID"
    assert "nodes" in lookup.summary(graph)


def test_queries_over_a_real_graph(graph):
    helper = lookup.resolve(graph, "HELPER").first()
    up = {r.qualified_name for r in traverse.impact(graph, helper.id, direction="upstream").nodes.collect()}
    assert "api.app.main::read" in up
    assert {r.id for r in traverse.impact(graph, helper.id, max_depth=0).nodes.collect()} == set()


def test_block_yaml():
    assert configs.block_yaml("services:\n  a:\n    build:\n      context: ./a\n    ports: ['1:1']\n  b:\n    image: x # y\n") == {"services": {"a": {"build": {"context": "./a"}, "ports": ["1:1"]}, "b": {"image": "x"}}}


def rows(g):
    return sorted(map(repr, g.nodes.select("id", "type", "certainty", "file_path", "line_number", "metadata").collect())), sorted(map(repr, g.edges.select("id", "type", "certainty", "line_number", "metadata").collect()))


def test_refresh_equals_full_build(spark, tmp_path):
    r = str(tmp_path / "t")
    write(r, TREE)
    store, options = Store(spark, str(tmp_path / "s")), ScanOptions(r, include_js=True)
    refresh(spark, options, store)
    write(r, {"api/app/aaa.py": "from .main import read\n\n\ndef f():\n    read()\n", "api/app/tools.py": "def go():\n    pass\n"})
    os.remove(f"{r}/api/flasky.py")
    assert rows(refresh(spark, options, store)) == rows(build(spark, options))


def test_configuration_changes_are_seen(spark, tmp_path):
    from strandwork.streaming.refresh import configs_changed

    r = str(tmp_path / "t")
    write(r, {"a.py": "x = 1\n", "Procfile": "web: run\n"})
    store, options = Store(spark, str(tmp_path / "s")), ScanOptions(r)
    assert configs_changed(spark, options, store)
    refresh(spark, options, store)
    write(r, {"a.py": "x = 2\n"})
    assert not configs_changed(spark, options, store)
    write(r, {"Procfile": "web: run --fast\n"})
    assert configs_changed(spark, options, store)


def test_unreadable_files_are_warnings(spark, tmp_path):
    r = str(tmp_path / "t")
    write(r, {"a.py": "def f():\n    pass\n", "docker-compose.yml": "services: [\n"})
    with open(f"{r}/b.py", "wb") as f:
        f.write(b"\xff\xfe")
    with open(f"{r}/.strandworkignore", "wb") as f:
        f.write(b"caf\xe9*\nskip/\n")
    os.makedirs(f"{r}/skip")
    write(r, {"skip/no.py": "x = 1\n"})
    os.mkfifo(f"{r}/pipe.txt")
    os.symlink(f"{r}/nothing", f"{r}/c.py")
    g = build(spark, ScanOptions(r))
    assert sorted((w.code, os.path.basename(w.path)) for w in g.warnings.collect()) == [("BROKEN_SYMLINK", "c.py"), ("DECODE_ERROR", "b.py")]
    assert {n.qualified_name for n in g.nodes.where("file_path is not null").collect()} == {"a", "a::f"}


def test_scratch_is_cleared(spark):
    from strandwork.session import clear_scratch, materialize, scratch

    df = materialize(spark.range(5), "some")
    assert df.count() == 5 and spark.sparkContext.applicationId in scratch(spark, "x")
    clear_scratch(spark)
    with pytest.raises(Exception):
        df.count()


def test_watch(spark, tmp_path):
    r = str(tmp_path / "t")
    write(r, {"a.py": "def f():\n    pass\n"})
    feed = tmp_path / "feed"
    spark.createDataFrame([("a.py",)], "path string").write.json(str(feed))
    got = []
    q = watch(spark.readStream.schema("path string").json(str(feed)), ScanOptions(r), Store(spark, str(tmp_path / "s")), lambda g, n: got.append(g.nodes.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert got == [2]


def test_long_arguments_of_http_calls():
    from strandwork.sources.js_facts import file_facts

    headers = ", ".join(f"'x-header-{k}': 'value {k}'" for k in range(60))
    source = f"axios({{ headers: {{ {headers} }}, data: {{ url: '/inner', f: (a) => [a] }}, url: '/far', method: 'put' }});\naxios({{ data: {{ url: '/inner' }}, url: where }});\naxios({{ url: '/near' }});\nfetch('/plain');\n"
    assert len(headers) > 800
    got = [(f["name"], f["certainty"]) for f in file_facts("a.js", 0, source.encode()) if f["type"] == "EXTERNAL_ENDPOINT"]
    assert got == [("PUT /far", 3), ("GET <dynamic>", 1), ("GET /near", 3), ("GET /plain", 3)]

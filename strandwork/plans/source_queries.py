"""Queries of the readers and extractors over literal sources, each with the rows that it must give as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.graph import Graph
from strandwork.operators import lookup
from strandwork.operators.diff import parse_diff
from strandwork.plans.build import assemble, extract
from strandwork.plans.queries import ORACLE, QUERIES
from strandwork.session import materialize
from strandwork.sources import configs
from strandwork.sources.listing import ScanOptions, excluded, ignore_patterns, kind_of

EDGE_ROW = "source, type, target, certainty, line"
NODE_ROW = "type, name, qualified_name, display_name, file_path, line, certainty"


def graph_of(spark: SparkSession, files: dict[str, str | bytes | None]) -> Graph:
    """The graph of sources by path; None stands for a file that can't be read."""
    listed = [(p, kind_of(p, js=True), t) for p, t in sorted(files.items())]
    rows = [(p, k, i, bytearray(t.encode() if isinstance(t, str) else t) if t is not None else None) for i, (p, k, t) in enumerate(listed)]
    sources = spark.createDataFrame(rows, "path string, kind string, rank int, content binary")
    tree = configs.Texts({p: t for p, t in files.items() if isinstance(t, str)})
    return assemble(materialize(extract(sources), "facts"), configs.topology(tree, [p for p, k, _ in listed if k == "config"]))


def edge_rows(g: Graph, *types: str) -> DataFrame:
    name = lambda side: g.nodes.select(F.col("id").alias(f"{side}_id"), F.col("qualified_name").alias(side))
    e = g.edges.where(F.col("type").isin(*types)).join(name("source"), "source_id").join(name("target"), "target_id")
    return e.select("source", "type", "target", "certainty", F.col("line_number").alias("line"))


def node_rows(g: Graph, *types: str) -> DataFrame:
    return g.nodes.where(F.col("type").isin(*types)).select("type", "name", "qualified_name", "display_name", "file_path", F.col("line_number").alias("line"), "certainty")


def meta_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, entry, value) of the metadata."""
    return rows.select(key, F.explode("metadata").alias("entry", "value"))


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows; whole numbers are 32-bit."""
    names = columns.split(", ")
    number = lambda k: any(isinstance(r[k], int) for r in rows)
    cast = lambda k, c: f"CAST({c} AS {'boolean' if isinstance(rows[0][k], bool) else 'int' if number(k) else 'varchar'}) AS {c}"
    return f"SELECT {', '.join(cast(k, c) for k, c in enumerate(names))} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns})"


def expects(columns: str, rows: list[tuple]):
    """Register a function of the session as a query over literal sources that gives these rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        ORACLE[f.__name__] = values(columns, rows)
        return f

    return add


# ---- Python

IMPORTS = {
    "src/app/__init__.py": "",
    "src/app/core.py": "import os.path\nimport app.util as u, numpy.linalg\nfrom .util import a, b as c\nfrom . import util\nfrom .. import far\nfrom ...other import x\nfrom collections import *\nimport appendix\n\n\ndef f():\n    from app import util\n",
    "src/app/util.py": "from typing import TYPE_CHECKING\n\nif TYPE_CHECKING:\n    from .core import f\n\na = b = 1\n",
    "src/app/deep/leaf.py": "from ..util import a\nfrom .none import b\n",
    "top.py": "from .... import nothing\n",
}


@expects(EDGE_ROW, [
    ("app.core", "IMPORTS", "os.path", 3, 1), ("app.core", "IMPORTS", "app.util", 3, 2), ("app.core", "IMPORTS", "numpy.linalg", 2, 2), ("app.core", "IMPORTS_FROM", "app.util", 3, 3), ("app.core", "IMPORTS_FROM", "app", 3, 12),
    ("app.core", "IMPORTS_FROM", "other", 2, 6), ("app.core", "IMPORTS_FROM", "collections", 3, 7), ("app.core", "IMPORTS", "appendix", 2, 8), ("app.util", "IMPORTS_FROM", "typing", 3, 1), ("app.util", "IMPORTS_FROM", "app.core", 3, 4),
    ("app.deep.leaf", "IMPORTS_FROM", "app.util", 3, 1), ("app.deep.leaf", "IMPORTS_FROM", "app.deep.none", 2, 2),
])
def source_imports(spark):
    return edge_rows(graph_of(spark, IMPORTS), "IMPORTS", "IMPORTS_FROM")


@expects(NODE_ROW, [
    ("MODULE", "app", "app", "app", "src/app/__init__.py", None, 3), ("MODULE", "app.core", "app.core", "app.core", "src/app/core.py", None, 3), ("MODULE", "app.util", "app.util", "app.util", "src/app/util.py", None, 3),
    ("MODULE", "app.deep.leaf", "app.deep.leaf", "app.deep.leaf", "src/app/deep/leaf.py", None, 3), ("MODULE", "top", "top", "top", "top.py", None, 3), ("MODULE", "other", "other", "other", None, None, 2),
    ("MODULE", "app.deep.none", "app.deep.none", "app.deep.none", None, None, 2), ("EXTERNAL_MODULE", "os.path", "os.path", "os.path", None, None, 3), ("EXTERNAL_MODULE", "numpy.linalg", "numpy.linalg", "numpy.linalg", None, None, 2),
    ("EXTERNAL_MODULE", "collections", "collections", "collections", None, None, 3), ("EXTERNAL_MODULE", "appendix", "appendix", "appendix", None, None, 2), ("EXTERNAL_MODULE", "typing", "typing", "typing", None, None, 3),
])
def source_modules(spark):
    return node_rows(graph_of(spark, IMPORTS), "MODULE", "EXTERNAL_MODULE")


@expects("source, names", [("app.core -> app.util", "a, b"), ("app.core -> app", "util"), ("app.core -> other", "x"), ("app.core -> collections", "*"), ("app.util -> typing", "TYPE_CHECKING"), ("app.util -> app.core", "f"), ("app.deep.leaf -> app.util", "a"), ("app.deep.leaf -> app.deep.none", "b")])
def source_import_names(spark):
    g = graph_of(spark, IMPORTS)
    ends = edge_rows(g, "IMPORTS_FROM").select("source", "target").distinct()
    ids = g.nodes.select(F.col("id").alias("i"), F.col("qualified_name").alias("q"))
    e = g.edges.where("type = 'IMPORTS_FROM'").join(ids, F.col("source_id") == F.col("i")).select(F.col("q").alias("source"), "target_id", "metadata").join(ids, F.col("target_id") == F.col("i")).withColumnRenamed("q", "target")
    return e.join(ends, ["source", "target"]).select(F.concat("source", F.lit(" -> "), "target").alias("source"), F.element_at("metadata", "names").alias("names"))


DYNAMIC = {"m.py": "import importlib\nimport importlib as il\n\n\ndef f(n):\n    importlib.import_module(n); __import__(n)\n    il.import_module('x')\n    other.import_module('y')\n\n\n__import__('z')\n", "n.py": "from importlib import import_module\nimport_module('q')\n"}


@expects(EDGE_ROW, [("m", "IMPORTS", "importlib", 3, 2), ("m", "IMPORTS", "<dynamic>::<unknown>", 0, 7), ("n", "IMPORTS_FROM", "importlib", 3, 1)])
def source_dynamic_imports(spark):
    return edge_rows(graph_of(spark, DYNAMIC), "IMPORTS", "IMPORTS_FROM")


@expects("code, path, n", [("DYNAMIC_IMPORT", "m.py", 3), ("SYNTAX_ERROR", "bad.py", 1), ("DECODE_ERROR", "latin.py", 1), ("IO_ERROR", "gone.py", 1), ("UNRESOLVABLE_RELATIVE_IMPORT", "up.py", 2), ("JS_PARSE_ERROR", "latin.js", 1), ("IO_ERROR", "gone.ts", 1)])
def source_warnings(spark):
    files = DYNAMIC | {"bad.py": "def (:\n", "latin.py": b"# caf\xe9\n", "gone.py": None, "up.py": "from . import x\nfrom ... import y\n", "latin.js": b"// caf\xe9", "gone.ts": None, "plain.py": "'''only a text'''\n", "empty.py": "", "marked.py": "# -*- coding: utf-8 -*-\nx = '\u00e9'\n"}
    return graph_of(spark, files).warnings.groupBy("code", "path").agg(F.count("*").cast("int").alias("n"))


CLASSES = {
    "shapes.py": "import abc, base\nimport lib.kit as kit\nfrom abc import ABC\nfrom typing import Protocol\nfrom . import Near\nfrom base import Root as R\n\n\nclass Shape(ABC):\n    def area(self):\n        class Hidden:\n            pass\n\n    class Part(R):\n        async def size(self):\n            pass\n\n\nclass Square(Shape, base.Mix, kit.Tool, kit.sub.Tool, lost.One):\n    pass\n\n\nclass Drawn(Protocol, abc.ABC, Part, dict, Near, Generic[T], make()):\n    x = 1\n\n\ndef f():\n    class Inner:\n        pass\n",
}


@expects(EDGE_ROW, [
    ("shapes::Shape", "IMPLEMENTS", "abc::ABC", 2, 9), ("shapes::Shape::Part", "INHERITS", "base::Root", 2, 14), ("shapes::Square", "INHERITS", "shapes::Shape", 3, 19), ("shapes::Square", "INHERITS", "base::Mix", 2, 19),
    ("shapes::Square", "INHERITS", "lib.kit::Tool", 2, 19), ("shapes::Square", "INHERITS", "<unknown>::Tool", 1, 19), ("shapes::Square", "INHERITS", "<unknown>::One", 1, 19), ("shapes::Drawn", "IMPLEMENTS", "typing::Protocol", 2, 23),
    ("shapes::Drawn", "IMPLEMENTS", "abc::ABC", 2, 23), ("shapes::Drawn", "INHERITS", "shapes::Part", 3, 23), ("shapes::Drawn", "INHERITS", "<builtins>::dict", 1, 23), ("shapes::Drawn", "INHERITS", "Near", 2, 23), ("shapes::Drawn", "INHERITS", "<complex_base>", 1, 23),
])
def source_bases(spark):
    return edge_rows(graph_of(spark, CLASSES), "INHERITS", "IMPLEMENTS")


@expects(NODE_ROW, [
    ("CLASS", "Shape", "shapes::Shape", "shapes::Shape", "shapes.py", 9, 3), ("METHOD", "area", "shapes::Shape::area", "shapes::Shape::area", "shapes.py", 10, 3), ("CLASS", "Part", "shapes::Shape::Part", "shapes::Shape::Part", "shapes.py", 14, 3),
    ("METHOD", "size", "shapes::Shape::Part::size", "shapes::Shape::Part::size", "shapes.py", 15, 3), ("CLASS", "Square", "shapes::Square", "shapes::Square", "shapes.py", 19, 3), ("CLASS", "Drawn", "shapes::Drawn", "shapes::Drawn", "shapes.py", 23, 3),
    ("FUNCTION", "f", "shapes::f", "shapes::f", "shapes.py", 27, 3), ("CLASS", "ABC", "abc::ABC", "abc::ABC", None, None, 2), ("CLASS", "Root", "base::Root", "base::Root", None, None, 2), ("CLASS", "Mix", "base::Mix", "base::Mix", None, None, 2),
    ("CLASS", "Tool", "lib.kit::Tool", "lib.kit::Tool", None, None, 2), ("CLASS", "Tool", "<unknown>::Tool", "<unknown>::Tool", None, None, 1), ("CLASS", "One", "<unknown>::One", "<unknown>::One", None, None, 1), ("CLASS", "Protocol", "typing::Protocol", "typing::Protocol", None, None, 2),
    ("CLASS", "Part", "shapes::Part", "shapes::Part", None, None, 3), ("CLASS", "dict", "<builtins>::dict", "<builtins>::dict", None, None, 1), ("CLASS", "Near", "Near", "Near", None, None, 2), ("CLASS", "<complex_base>", "<complex_base>", "<complex_base>", None, None, 1),
])
def source_classes(spark):
    return node_rows(graph_of(spark, CLASSES), "CLASS", "METHOD", "FUNCTION")


CALLS = {
    "pack/__init__.py": "",
    "pack/tools.py": "def go():\n    pass\n",
    "main.py": "import os.path\nimport pack.tools as t\nimport pack\nfrom pack.tools import go, run as r\nfrom . import near\n\n\ndef top():\n    def inner():\n        go()\n        self.lost()\n\n    inner()\n    t.go()\n    pack.any()\n    os.getcwd()\n    r()\n    r.more()\n    near()\n    near.far()\n    print(len([]))\n    obj.method()\n    a.b.c()\n    [x() for x in y]\n\n\nclass Box:\n    def open(self):\n        self.shut()\n\n        def helper():\n            self.shut()\n\n    def shut(self):\n        top()\n        Box()\n\n\ngo()\n",
}


@expects(EDGE_ROW, [
    ("main::top", "CALLS", "pack.tools::go", 2, 10), ("main::top", "CALLS", "<self>::lost", 1, 11), ("main::top", "CALLS", "main::inner", 3, 13), ("main::top", "CALLS", "pack::any", 2, 15), ("main::top", "CALLS", "os.path::getcwd", 1, 16),
    ("main::top", "CALLS", "pack.tools::run", 2, 17), ("main::top", "CALLS", "pack.tools::run::more", 1, 18), ("main::top", "CALLS", "<unresolved>::near", 1, 19), ("main::top", "CALLS", "::near::far", 1, 20), ("main::top", "CALLS", "<unresolved>::print", 1, 21),
    ("main::top", "CALLS", "<unresolved>::len", 1, 21), ("main::top", "CALLS", "<unresolved>::x", 1, 24), ("main::top::inner", "CALLS", "pack.tools::go", 2, 10), ("main::top::inner", "CALLS", "<self>::lost", 1, 11),
    ("main::Box::open", "CALLS", "main::Box::shut", 2, 32), ("main::Box::open::helper", "CALLS", "main::Box::shut", 2, 32), ("main::Box::shut", "CALLS", "main::top", 3, 35), ("main::Box::shut", "CALLS", "main::Box", 3, 36),
])
def source_calls(spark):
    return edge_rows(graph_of(spark, CALLS), "CALLS")


@expects(EDGE_ROW, [
    ("main", "CONTAINS", "main::top", 3, 8), ("main::top", "CONTAINS", "main::top::inner", 3, 9), ("main", "CONTAINS", "main::Box", 3, 27), ("main::Box", "CONTAINS", "main::Box::open", 3, 28), ("main::Box::open", "CONTAINS", "main::Box::open::helper", 3, 31),
    ("main::Box", "CONTAINS", "main::Box::shut", 3, 34), ("pack.tools", "CONTAINS", "pack.tools::go", 3, 1),
])
def source_contains(spark):
    return edge_rows(graph_of(spark, CALLS), "CONTAINS")


DECORATORS = {
    "deco.py": "import functools, app as web\nfrom functools import wraps, cache\nfrom . import mark\n\n\ndef own(f):\n    @wraps(f)\n    def inner():\n        pass\n    return inner\n\n\n@own\n@cache\n@functools.lru_cache(maxsize=1)\n@web.route.deep('/x')\n@thing.on.click\ndef f():\n    pass\n\n\n@mark\n@lost(1)\n@table['a']\nclass C:\n    @property\n    def p(self):\n        pass\n\n    @f().x\n    def q(self):\n        pass\n",
}


@expects(EDGE_ROW, [
    ("functools::wraps", "DECORATES", "deco::own::inner", 2, 8), ("deco::own", "DECORATES", "deco::f", 3, 18), ("functools::cache", "DECORATES", "deco::f", 2, 18), ("functools::lru_cache", "DECORATES", "deco::f", 2, 18),
    ("app::route::deep", "DECORATES", "deco::f", 2, 18), ("thing::on::click", "DECORATES", "deco::f", 1, 18), ("<unresolved>::mark", "DECORATES", "deco::C", 1, 25), ("<unresolved>::lost", "DECORATES", "deco::C", 1, 25),
    ("<dynamic>", "DECORATES", "deco::C", 1, 25), ("<unresolved>::property", "DECORATES", "deco::C::p", 1, 27), ("x", "DECORATES", "deco::C::q", 1, 31),
])
def source_decorators(spark):
    return edge_rows(graph_of(spark, DECORATORS), "DECORATES")


@expects("decorator, entry, value", [
    ("functools::wraps", "is_factory", "true"), ("functools::wraps", "preserves_identity", "true"), ("functools::lru_cache", "is_factory", "true"), ("app::route::deep", "is_factory", "true"), ("<unresolved>::lost", "is_factory", "true"),
])
def source_decorator_metadata(spark):
    g = graph_of(spark, DECORATORS)
    e = g.edges.where("type = 'DECORATES'").join(g.nodes.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("decorator")), "source_id")
    return meta_rows(e, "decorator")


FASTAPI = {
    "models.py": "class User:\n    pass\n\n\nclass Db:\n    pass\n",
    "routes.py": "from models import User, Db\n\n\n@router.get('/users/{id}')\n@router.post(path='/users')\nasync def users(id: int, u: Optional[User], *, db=Depends(get_db), m: Db = Depends(Db), k=x.Depends(no)) -> list[User]:\n    pass\n\n\n@app.delete(PATH)\ndef gone(s=Depends(auth.user), q: 'User' = None, *rest: Db):\n    pass\n\n\n@mock.patch('a.b')\ndef test():\n    pass\n\n\nclass View:\n    @router.get('/no')\n    def m(self):\n        pass\n\n\n@get('/no')\ndef no(u: User):\n    pass\n",
}


@expects(EDGE_ROW, [
    ("routes::users", "EXPOSES_ENDPOINT", "GET /users/{id}", 3, 6), ("routes::users", "EXPOSES_ENDPOINT", "POST /users", 3, 6), ("routes::gone", "EXPOSES_ENDPOINT", "DELETE <dynamic>", 3, 11), ("routes::test", "EXPOSES_ENDPOINT", "PATCH a.b", 3, 16),
    ("routes::users", "INJECTS_DEPENDENCY", "<unresolved>::get_db", 1, 6), ("routes::users", "INJECTS_DEPENDENCY", "models::Db", 3, 6), ("routes::gone", "INJECTS_DEPENDENCY", "<unresolved>::auth.user", 1, 11),
    ("routes::users", "TYPE_ANNOTATED", "models::User", 3, 6), ("routes::users", "TYPE_ANNOTATED", "models::Db", 3, 6), ("routes::gone", "TYPE_ANNOTATED", "models::User", 3, 11), ("routes::gone", "TYPE_ANNOTATED", "models::Db", 3, 11), ("routes::no", "TYPE_ANNOTATED", "models::User", 3, 27),
])
def source_fastapi(spark):
    return edge_rows(graph_of(spark, FASTAPI), "EXPOSES_ENDPOINT", "INJECTS_DEPENDENCY", "TYPE_ANNOTATED")


@expects(NODE_ROW, [
    ("ENDPOINT", "GET /users/{id}", "GET /users/{id}", "GET /users/{id}", "routes.py", 6, 3), ("ENDPOINT", "POST /users", "POST /users", "POST /users", "routes.py", 6, 3), ("ENDPOINT", "DELETE <dynamic>", "DELETE <dynamic>", "DELETE <dynamic>", "routes.py", 11, 3),
    ("ENDPOINT", "PATCH a.b", "PATCH a.b", "PATCH a.b", "routes.py", 16, 3),
])
def source_endpoints(spark):
    return node_rows(graph_of(spark, FASTAPI), "ENDPOINT")


FLASK = {"views.py": "@app.route('/items', methods=['GET', 'post'])\n@bp.route(RULE)\ndef items():\n    pass\n\n\n@bp.route('/one/<int:id>', methods=('PUT',))\ndef one(id):\n    pass\n\n\n@app.route()\ndef none():\n    pass\n"}


@expects(EDGE_ROW, [
    ("views::items", "EXPOSES_ENDPOINT", "GET /items", 3, 3), ("views::items", "EXPOSES_ENDPOINT", "POST /items", 3, 3), ("views::items", "EXPOSES_ENDPOINT", "GET <dynamic>", 3, 3), ("views::one", "EXPOSES_ENDPOINT", "GET /one/<int:id>", 3, 8), ("views::none", "EXPOSES_ENDPOINT", "GET <dynamic>", 3, 13),
])
def source_flask(spark):
    return edge_rows(graph_of(spark, FLASK), "EXPOSES_ENDPOINT")


DJANGO = {
    "shop/urls.py": "from django.urls import include, path, re_path\nfrom . import views\n\nurlpatterns = [\n    path('items/', views.items),\n    re_path(r'^old$', views.Old.as_view()),\n    path(PREFIX, home),\n    include([path('in/', views.inner)]),\n    path('no-view/'),\n]\nother = [path('x/', views.x)]\n",
    "shop/models.py": "from django.db import models\nfrom django.db.models import Model\n\n\nclass Item(models.Model):\n    owner = models.ForeignKey('auth.User', on_delete=models.CASCADE)\n    tags = models.ManyToManyField(Tag)\n    self_ = models.OneToOneField(to=Tag)\n    name = models.CharField('x')\n\n\nclass Tag(Model):\n    pass\n\n\nclass Form(forms.Model):\n    x = ForeignKey('No')\n",
    "shop/views.py": "urlpatterns = [path('y/', y)]\n",
}


@expects(EDGE_ROW, [
    ("shop.urls::views.items", "EXPOSES_ENDPOINT", "DJANGO items/ -> views.items", 2, 5), ("shop.urls::views.Old.as_view", "EXPOSES_ENDPOINT", "DJANGO ^old$ -> views.Old.as_view", 2, 6), ("shop.urls::home", "EXPOSES_ENDPOINT", "DJANGO <dynamic> -> home", 2, 7),
    ("shop.urls::views.inner", "EXPOSES_ENDPOINT", "DJANGO in/ -> views.inner", 2, 8), ("shop.urls::<unknown>", "EXPOSES_ENDPOINT", "DJANGO no-view/ -> <unknown>", 2, 9),
    ("shop.models::Item", "FOREIGN_KEY", "<unresolved>::User", 2, 6), ("shop.models::Item", "FOREIGN_KEY", "<unresolved>::Tag", 2, 7),
])
def source_django(spark):
    return edge_rows(graph_of(spark, DJANGO), "EXPOSES_ENDPOINT", "FOREIGN_KEY")


SQLALCHEMY = {
    "db.py": "from sqlalchemy.orm import declarative_base\n\nThing = declarative_base()\n\n\nclass Root(DeclarativeBase):\n    pass\n",
    "tables.py": "from db import Thing, Root\n\n\nclass User(Thing):\n    __tablename__ = 'users'\n    team_id = Column(Integer, ForeignKey('teams.id'))\n    boss: Mapped[int] = mapped_column(type_=wrap(ForeignKey('main.users.id')))\n    team = relationship('Team', back_populates='users')\n    posts = relationship(Post)\n    plain = Column(String)\n\n\nclass Team(Root):\n    __tablename__ = NAME\n    far = ForeignKey('far.id')\n\n\nclass Grand(User):\n    __tablename__ = 'grand'\n\n\ndef f():\n    class Hidden(Thing):\n        __tablename__ = 'hidden'\n",
}


@expects(EDGE_ROW, [
    ("tables::User", "DEFINES_MODEL", "users", 3, 4), ("tables::User", "FOREIGN_KEY", "teams", 3, 6), ("tables::User", "FOREIGN_KEY", "main", 3, 7), ("tables::User", "CALLS", "<unresolved>::Team", 2, 8), ("tables::User", "CALLS", "<unresolved>::Post", 2, 9), ("tables::Team", "FOREIGN_KEY", "far", 3, 15),
])
def source_sqlalchemy(spark):
    g = graph_of(spark, SQLALCHEMY)
    models = g.nodes.where("type = 'SQLALCHEMY_MODEL'").select(F.col("id").alias("source_id"))
    return edge_rows(Graph(g.nodes, g.edges.join(models, "source_id", "left_semi")), "DEFINES_MODEL", "FOREIGN_KEY", "CALLS")


@expects(NODE_ROW, [
    ("SQLALCHEMY_MODEL", "Root", "db::Root", "db::Root", "db.py", 6, 3), ("SQLALCHEMY_MODEL", "User", "tables::User", "tables::User", "tables.py", 4, 3), ("SQLALCHEMY_MODEL", "Team", "tables::Team", "tables::Team", "tables.py", 13, 3),
    ("SQLALCHEMY_MODEL", "Team", "<unresolved>::Team", "<unresolved>::Team", None, None, 1), ("SQLALCHEMY_MODEL", "Post", "<unresolved>::Post", "<unresolved>::Post", None, None, 1),
    ("TABLE", "users", "users", "users", "tables.py", 4, 3), ("TABLE", "teams", "teams", "teams", None, None, 2), ("TABLE", "main", "main", "main", None, None, 2), ("TABLE", "far", "far", "far", None, None, 2),
])
def source_models(spark):
    return node_rows(graph_of(spark, SQLALCHEMY), "SQLALCHEMY_MODEL", "TABLE")


HTTP = {"client.py": "import requests, httpx as hx\n\n\ndef a():\n    requests.get('http://x/y', timeout=1)\n    requests.post(url='http://no')\n\n    def b():\n        httpx.AsyncClient(timeout=1).delete(f'/{a}')\n    hx.get('/alias')\n    session.get('/no')\n\n\nclass C:\n    def m(self):\n        requests.Session().put('http://x/z')\n        requests.trace('/no')\n\n\nrequests.head('http://top')\n"}


@expects(EDGE_ROW, [
    ("client::a", "CALLS_HTTP", "GET http://x/y", 3, 5), ("client::a", "CALLS_HTTP", "POST <dynamic>", 1, 6), ("client::a::b", "CALLS_HTTP", "DELETE <dynamic>", 1, 9), ("client::C::m", "CALLS_HTTP", "PUT http://x/z", 3, 16), ("client::<module>", "CALLS_HTTP", "HEAD http://top", 3, 20),
])
def source_http_clients(spark):
    return edge_rows(graph_of(spark, HTTP), "CALLS_HTTP")


ANNOTATIONS = {
    "a.py": "class A:\n    pass\n\n\nclass B:\n    pass\n",
    "b.py": "class B:\n    own: A = None\n",
    "use.py": "import a\nfrom typing import List\n\nx: 'A' = 1\n\n\ndef f(self: A, p: List[a.A], /, *args: B, k: A | None = None, **kw: Dict[str, B]) -> 'List[A]':\n    y: Box[A, Lost] = 2\n\n    def g(q: Callable[[A], B]):\n        pass\n\n\nasync def h() -> a.B:\n    pass\n",
}


@expects(EDGE_ROW, [
    ("use", "TYPE_ANNOTATED", "a::A", 3, 4), ("use::f", "TYPE_ANNOTATED", "b::B", 3, 7), ("use::f", "TYPE_ANNOTATED", "a::A", 3, 8), ("use::f::g", "TYPE_ANNOTATED", "b::B", 3, 10), ("use::h", "TYPE_ANNOTATED", "b::B", 3, 14), ("b", "TYPE_ANNOTATED", "a::A", 3, 2),
])
def source_annotations(spark):
    return edge_rows(graph_of(spark, ANNOTATIONS), "TYPE_ANNOTATED")


# ---- services

SERVICES = {
    "docker-compose.yml": "version: '3'\nservices:\n  api:\n    build:\n      context: ./api\n      dockerfile: Own.Dockerfile\n    ports:\n      - '80:80'\n      - 81\n  worker:\n    build: jobs/run\n    command: python main.py\n  cache:\n    image: redis\n",
    "api/Own.Dockerfile": "FROM python\nENTRYPOINT [\"first\"]\nRUN x\ncmd serve --all\n",
    "jobs/run/Dockerfile": "FROM python\n",
    "api/main.py": "from lib.shared import thing\nimport jobs.run.work\n\n\n@app.get('/a')\ndef a():\n    thing()\n\n\n@app.post('/b')\ndef b():\n    pass\n",
    "api/pyproject.toml": "[project]\nname = 'api-package'\n",
    "lib/shared.py": "def thing():\n    pass\n",
    "lib/pyproject.toml": "broken",
    "jobs/run/work.py": "import lib.shared\n",
    "jobs/Procfile": "# processes\nweb: gunicorn server/app.py\n\nclock: python -m tick\n",
    "jobs/server/app.py": "x = 1\n",
}


@expects(NODE_ROW, [
    ("SERVICE", "api", "api", "api", "docker-compose.yml", None, 3), ("SERVICE", "worker", "worker", "worker", "docker-compose.yml", None, 3), ("SERVICE", "cache", "cache", "cache", "docker-compose.yml", None, 3),
    ("SERVICE", "web", "web", "web", "jobs/Procfile", None, 2), ("SERVICE", "clock", "clock", "clock", "jobs/Procfile", None, 2), ("COMPONENT", "lib", "lib", "lib", "lib/pyproject.toml", None, 3),
])
def source_services(spark):
    return node_rows(graph_of(spark, SERVICES), "SERVICE", "COMPONENT")


@expects("name, entry, value", [
    ("api", "source", "docker-compose.yml"), ("api", "ports", "80:80, 81"), ("api", "dockerfile", "Own.Dockerfile"), ("api", "build_context", "./api"), ("api", "entrypoint", "serve --all"), ("api", "package_name", "api-package"), ("api", "endpoints", '["GET /a","POST /b"]'),
    ("worker", "source", "docker-compose.yml"), ("worker", "command", "python main.py"), ("worker", "build_context", "jobs/run"), ("cache", "source", "docker-compose.yml"), ("web", "source", "jobs/Procfile"), ("web", "command", "gunicorn server/app.py"),
    ("clock", "source", "jobs/Procfile"), ("clock", "command", "python -m tick"), ("lib", "source", "lib/pyproject.toml"),
])
def source_service_metadata(spark):
    return meta_rows(graph_of(spark, SERVICES).nodes.where("type in ('SERVICE', 'COMPONENT')"), "name")


@expects(EDGE_ROW, [
    ("api.main", "BELONGS_TO_SERVICE", "api", 3, None), ("lib.shared", "BELONGS_TO_SERVICE", "lib", 3, None), ("jobs.run.work", "BELONGS_TO_SERVICE", "worker", 3, None), ("jobs.server.app", "BELONGS_TO_SERVICE", "web", 3, None),
    ("api.main", "CROSSES_COMPONENT_BOUNDARY", "lib.shared", 3, 1), ("api.main", "CROSSES_COMPONENT_BOUNDARY", "jobs.run.work", 3, 2), ("api.main::a", "CROSSES_COMPONENT_BOUNDARY", "lib.shared::thing", 2, 7), ("jobs.run.work", "CROSSES_COMPONENT_BOUNDARY", "lib.shared", 3, 1),
])
def source_boundaries(spark):
    return edge_rows(graph_of(spark, SERVICES), "BELONGS_TO_SERVICE", "CROSSES_COMPONENT_BOUNDARY")


@expects("shown", [
    ("api.main -> lib.shared [cross-boundary: api -> lib]",), ("api.main -> jobs.run.work [cross-boundary: api -> worker]",), ("api.main::a -> lib.shared::thing [cross-boundary: api -> lib]",), ("jobs.run.work -> lib.shared [cross-boundary: worker -> lib]",),
    ("api.main belongs to api",), ("lib.shared belongs to lib",), ("jobs.run.work belongs to worker",), ("jobs.server.app belongs to web",),
])
def source_edge_names(spark):
    return graph_of(spark, SERVICES).edges.where("type in ('BELONGS_TO_SERVICE', 'CROSSES_COMPONENT_BOUNDARY')").select(F.col("display_name").alias("shown"))


@expects("total_nodes, total_edges, parsed_files, failed_files, warning_count, service_count, cross_component_edge_count", [(17, 19, 4, 1, 1, 5, 4)])
def source_totals(spark):
    t = lookup.totals(graph_of(spark, SERVICES | {"api/bad.py": "def (:"}))
    return t.select(*[F.col(c).cast("int").alias(c) for c in t.columns])


@expects("path, kind, excluded", [
    ("a.py", "python", False), ("b.js", "js", False), ("c.tsx", "js", False), ("d.txt", None, False), ("setup.py", "config", False), ("deep/Dockerfile", "config", False), ("pyproject.toml", "config", False), ("node_modules", None, True), ("x/__pycache__", None, True),
    ("pkg.egg-info", None, True), ("build", None, True), ("src/gen/out.py", "python", True), ("src/gen", None, True), ("gen/out.py", "python", False), ("docs/a.py", "python", True), ("test_a.py", "python", True), ("deep/test_b.py", "python", True), ("attest_a.py", "python", False),
])
def source_listing(spark):
    patterns = ignore_patterns(ScanOptions("/nowhere", exclude_patterns=["src/gen*", "docs/*", "test_*.py"]))
    paths = ("a.py", "b.js", "c.tsx", "d.txt", "setup.py", "deep/Dockerfile", "pyproject.toml", "node_modules", "x/__pycache__", "pkg.egg-info", "build", "src/gen/out.py", "src/gen", "gen/out.py", "docs/a.py", "test_a.py", "deep/test_b.py", "attest_a.py")
    return spark.createDataFrame([(p, kind_of(p, js=True), excluded(p, patterns)) for p in paths], "path string, kind string, excluded boolean")


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py\t2024
@@ -1,3 +1,4 @@ def f():
 a
+b
@@ -10 +12,0 @@
-c
@@ -20,2 +21 @@
--- a/gone.py
+++ /dev/null
@@ -1,9 +0,0 @@
--- /dev/null
+++ b/new/file.py
@@ -0,0 +1,7 @@
"""


@expects("file_path, line_start, line_end", [("x.py", 1, 4), ("x.py", 12, 12), ("x.py", 21, 21), ("gone.py", 1, 99999), ("new/file.py", 1, 7)])
def source_unified_diff(spark):
    return spark.createDataFrame(parse_diff(DIFF), "file_path string, line_start int, line_end int")


# ---- JavaScript

JS = {
    "web/src/app.tsx": "import React from 'react';\nimport { a, b as c } from './util';\nimport * as all from '../lib/all.ts';\nimport './style';\n// import no from 'no';\nconst p = require('./deep/../p.js');\n\nexport default function App() {\n  load();\n  return a();\n}\nasync function load() {\n  await fetch('/items/');\n  axios.post(`/users/${id}`, {});\n}\nconst save = async (x) => {\n  axios({ method: 'put', url: '/items?x=1' });\n  load();\n};\nconst Page = () => useSWR('/users', load);\nclass Box {\n  open() { fetch(url); }\n}\nuseQuery(['k', '/top#a'], f);\naxios.request('/raw');\nconst text = \"fetch('/no')\";\n",
    "web/src/util.ts": "export const a = 1;\n",
    "back.py": "@app.get('/items')\ndef items():\n    pass\n\n\n@app.post('/items/')\ndef add():\n    pass\n\n\n@app.get('/top')\ndef top():\n    pass\n",
}


@expects(EDGE_ROW, [
    ("web.src.app", "IMPORTS", "react", 2, 1), ("web.src.app", "IMPORTS_FROM", "web.src.util", 3, 2), ("web.src.app", "IMPORTS_FROM", "web.lib.all", 3, 3), ("web.src.app", "IMPORTS", "web.src.style", 3, 4), ("web.src.app", "IMPORTS", "web.src.p", 3, 6),
])
def source_js_imports(spark):
    return edge_rows(graph_of(spark, JS), "IMPORTS", "IMPORTS_FROM")


@expects(NODE_ROW, [
    ("JS_MODULE", "app", "web.src.app", "web.src.app", "web/src/app.tsx", None, 3), ("JS_MODULE", "util", "web.src.util", "web.src.util", "web/src/util.ts", None, 3), ("JS_MODULE", "react", "react", "react", None, None, 2), ("JS_MODULE", "all", "web.lib.all", "web.lib.all", None, None, 3),
    ("JS_MODULE", "style", "web.src.style", "web.src.style", None, None, 3), ("JS_MODULE", "p", "web.src.p", "web.src.p", None, None, 3), ("JS_COMPONENT", "App", "web.src.app::App", "web.src.app::App", "web/src/app.tsx", 8, 3),
    ("JS_FUNCTION", "load", "web.src.app::load", "web.src.app::load", "web/src/app.tsx", 12, 3), ("JS_FUNCTION", "save", "web.src.app::save", "web.src.app::save", "web/src/app.tsx", 16, 3), ("JS_COMPONENT", "Page", "web.src.app::Page", "web.src.app::Page", "web/src/app.tsx", 20, 3),
    ("JS_COMPONENT", "Box", "web.src.app::Box", "web.src.app::Box", "web/src/app.tsx", 21, 3), ("JS_FUNCTION", "open", "web.src.app::Box::open", "web.src.app::Box::open", "web/src/app.tsx", 22, 3), ("JS_FUNCTION", "<module>", "web.src.app::<module>", "web.src.app::<module>", "web/src/app.tsx", None, 3),
])
def source_js_functions(spark):
    return node_rows(graph_of(spark, JS), "JS_MODULE", "JS_FUNCTION", "JS_COMPONENT")


@expects(EDGE_ROW, [("web.src.app", "CALLS", "web.src.app::load", 2, 18)])
def source_js_calls(spark):
    return edge_rows(graph_of(spark, JS), "CALLS")


@expects(EDGE_ROW, [
    ("web.src.app::load", "CALLS_HTTP", "GET /items/", 3, 13), ("web.src.app::load", "CALLS_HTTP", "POST <dynamic>", 1, 14), ("web.src.app::save", "CALLS_HTTP", "PUT /items?x=1", 3, 17), ("web.src.app::Page", "CALLS_HTTP", "GET /users", 3, 20), ("web.src.app::Box::open", "CALLS_HTTP", "GET <dynamic>", 1, 22),
    ("web.src.app::<module>", "CALLS_HTTP", "GET /top#a", 3, 24), ("web.src.app::<module>", "CALLS_HTTP", "GET /raw", 3, 25),
    ("web.src.app::load", "CALLS_HTTP", "GET /items", 2, 13), ("web.src.app::load", "CALLS_HTTP", "POST /items/", 2, 13), ("web.src.app::save", "CALLS_HTTP", "GET /items", 2, 17), ("web.src.app::save", "CALLS_HTTP", "POST /items/", 2, 17), ("web.src.app::<module>", "CALLS_HTTP", "GET /top", 2, 24),
])
def source_js_http(spark):
    """Calls and, where a path is an endpoint's, the call stitched to it whatever its method."""
    return edge_rows(graph_of(spark, JS), "CALLS_HTTP")

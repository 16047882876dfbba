"""Facts of one Python file. The tree is parsed once and every extractor walks it in the same worker.

A fact is a node or an edge with references that other files may have to settle: ``ref`` says how (see resolve.py):
``module`` (is that module scanned?), ``alias`` (the same, for a call), ``class`` (which class has that bare name),
``base`` (is one of these bases a model base?). Facts carry their place in the emission order.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator

# fixed values
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "trace")
TYPE_WRAPPERS = (
    "Optional", "Union", "List", "list", "Set", "set", "Dict", "dict", "Tuple", "tuple", "Sequence", "Iterable", "Iterator", "Generator", "Awaitable", "Annotated", "ClassVar", "Final", "Mapped",
)
MODEL_BASES = ("Base", "DeclarativeBase", "DeclarativeBaseNoMeta", "MappedAsDataclass")
INTERFACES = ("ABC", "ABCMeta", "Protocol")
RELATIONS = ("ForeignKey", "OneToOneField", "ManyToManyField")
CLIENTS, SESSIONS = ("requests", "httpx"), ("Session", "Client", "AsyncClient")
EXTRACTORS = ("imports", "classes", "calls", "fastapi", "flask", "django", "sqlalchemy", "http", "annotations")
UNKNOWN = "<dynamic>"
SOURCE_ID, TARGET_ID = "\x01", "\x02"  # in an edge's display name: stand for its ends' ids
ADDED_STAGE = 64  # of the first extractor that a caller adds

FACTS = "kind string, stage int, file int, n int, prefix string, type string, name string, qualified_name string, display_name string, source_prefix string, source string, file_path string, line_number int, certainty int, meta map<string,string>, ref string, keys array<string>"


def module_name(path: str) -> str:
    p = path.removeprefix("src/").removesuffix(".py")
    parts = p.split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def relative_target(module: str | None, level: int, importer: str) -> str | None:
    """What a relative import means: the importer's name without its last ``level`` parts (or as many as it has), then the module."""
    parts = importer.split(".")
    return ".".join([*parts[: max(0, len(parts) - level)], *([module] if module else [])]) or None


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def dotted(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else None
    return None


def last_name(node: ast.AST | None) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


class Scope:
    """Names that a module binds anywhere in it: what it defines, the modules it imports and the names it imports from them."""

    def __init__(self, tree: ast.Module, module: str) -> None:
        self.local: dict[str, str] = {}
        self.classes: dict[str, str] = {}
        self.alias: dict[str, str] = {}
        self.imported: dict[str, tuple[str, str]] = {}
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                self.alias |= {a.asname or a.name.split(".")[0]: a.name for a in n.names}
            elif isinstance(n, ast.ImportFrom):
                self.imported |= {a.asname or a.name: (n.module or "", a.name) for a in n.names}
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.local[n.name] = f"{module}::{n.name}"
                if isinstance(n, ast.ClassDef):
                    self.classes[n.name] = self.local[n.name]

    def from_module(self, name: str) -> str | None:
        """module::name of a name that is imported from a module that is named."""
        module, own = self.imported.get(name, ("", ""))
        return f"{module}::{own}" if module else None


class File:
    """The facts of one file; ``facts`` yields them in order."""

    def __init__(self, path: str, rank: int, source: bytes) -> None:
        self.path, self.rank, self.module = path, rank, module_name(path)
        self.tree = ast.parse(source.decode("utf-8"), filename=path)
        self.scope = Scope(self.tree, self.module)
        self.out: list[dict] = []
        self.stage = 0

    def facts(self, added=()) -> Iterator[dict]:
        """``added``: functions of this file that emit more facts with ``node``, ``edge`` and ``warn``, after the built-in ones."""
        for self.stage, name in enumerate(EXTRACTORS):
            getattr(self, name)()
        for self.stage, extractor in enumerate(added, ADDED_STAGE):
            extractor(self)
        for n, f in enumerate(self.out):
            yield f | {"n": n}

    # -- emission

    def _add(self, **f) -> None:
        base = dict.fromkeys("kind prefix type name qualified_name display_name source_prefix source line_number ref keys".split())
        self.out.append(base | {"stage": self.stage, "file": self.rank, "file_path": self.path, "certainty": 3, "meta": {}} | f)

    def node(self, prefix, type_, qualified, line=None, certainty=3, own_file=True, name=None, shown=None, **meta) -> None:
        name = name or qualified.split("::")[-1]
        self._add(kind="node", prefix=prefix, type=type_, name=name, qualified_name=qualified, display_name=shown or qualified, line_number=line, certainty=certainty, file_path=self.path if own_file else None, meta=meta)

    def edge(self, source, type_, target, line=None, certainty=3, shown=None, ref=None, keys=None, **meta) -> None:
        """source and target: (prefix, qualified name)."""
        self._add(kind="edge", source_prefix=source[0], source=source[1], type=type_, prefix=target[0], qualified_name=target[1], display_name=shown, line_number=line, certainty=certainty, ref=ref, keys=keys, meta=meta)

    def warn(self, code: str, message: str, line: int) -> None:
        self._add(kind="warning", type=code, name=message, line_number=line, certainty=0)

    # -- imports

    def imports(self) -> None:
        me = ("mod", self.module)
        self.node("mod", "MODULE", self.module, name=self.module)
        for n in ast.walk(self.tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.edge(me, "IMPORTS", ("?", a.name), n.lineno, shown=f"{SOURCE_ID} imports {a.name}", ref="module", keys=[a.name])
            elif isinstance(n, ast.ImportFrom):
                target = relative_target(n.module, n.level, self.module) if n.level else n.module
                if target is None:
                    self.warn("UNRESOLVABLE_RELATIVE_IMPORT", f"level {n.level} in {self.module}", n.lineno)
                    continue
                names = ", ".join(a.name for a in n.names)
                self.edge(me, "IMPORTS_FROM", ("mod" if n.level else "?", target), n.lineno, shown=f"{SOURCE_ID} imports from {target}", ref="relative" if n.level else "module", keys=[target], names=names)
        loaders = {f"{a}.import_module" for a, m in self.scope.alias.items() if m == "importlib"}
        hidden, lines = f"{UNKNOWN}::<unknown>", set()
        for n in ast.walk(self.tree):
            if not isinstance(n, ast.Call) or n.lineno in lines:
                continue
            f = dotted(n.func)
            how = f if f == "__import__" else "importlib.import_module" if f in loaders else None
            if how:
                lines.add(n.lineno)
                self.node("extmod", "EXTERNAL_MODULE", hidden, certainty=0, own_file=False, shown="<dynamic import>")
                self.edge(me, "IMPORTS", ("extmod", hidden), n.lineno, 0, shown=f"{SOURCE_ID} dynamically imports unknown module", dynamic="true", pattern=how)
                self.warn("DYNAMIC_IMPORT", f"{how} in {self.module}", n.lineno)

    # -- classes

    def classes(self) -> None:
        self._class_body(self.tree.body, ("mod", self.module), self.module)

    def _base(self, b: ast.AST) -> tuple[str, int]:
        if isinstance(b, ast.Name):
            if b.id in self.scope.classes:
                return self.scope.classes[b.id], 3
            if b.id in self.scope.imported:
                return self.scope.from_module(b.id) or self.scope.imported[b.id][1], 2
            return f"<builtins>::{b.id}", 1
        if isinstance(b, ast.Attribute):
            module = self.scope.alias.get(b.value.id) if isinstance(b.value, ast.Name) else None
            return (f"{module}::{b.attr}", 2) if module else (f"<unknown>::{b.attr}", 1)
        return "<complex_base>", 1

    def _class_body(self, body, parent, prefix) -> None:
        for s in body:
            if not isinstance(s, ast.ClassDef):
                continue
            q = f"{prefix}::{s.name}"
            self.node("func", "CLASS", q, s.lineno)
            self.edge(parent, "CONTAINS", ("func", q), s.lineno, shown=f"{SOURCE_ID} contains {q}")
            for b in s.bases:
                target, certainty = self._base(b)
                kind = "IMPLEMENTS" if target.split("::")[-1] in INTERFACES else "INHERITS"
                self.node("func", "CLASS", target, certainty=certainty, own_file=False)
                self.edge(("func", q), kind, ("func", target), s.lineno, certainty, shown=f"{q} {kind.lower()} {target}")
            for m in s.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    self.node("func", "METHOD", f"{q}::{m.name}", m.lineno)
                    self.edge(("func", q), "CONTAINS", ("func", f"{q}::{m.name}"), m.lineno, shown=f"{q} contains {q}::{m.name}")
            self._class_body(s.body, ("func", q), q)

    # -- calls and decorators

    def calls(self) -> None:
        self._call_body(self.tree.body, ("mod", self.module), self.module, None)

    def _call_body(self, body, parent, prefix, owner) -> None:
        """owner: the bare name of the class that ``body`` is in, also through functions."""
        for s in body:
            if not isinstance(s, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            q, is_class = f"{prefix}::{s.name}", isinstance(s, ast.ClassDef)
            self.node("func", "CLASS" if is_class else "METHOD" if owner else "FUNCTION", q, s.lineno)
            self.edge(parent, "CONTAINS", ("func", q), s.lineno, shown=f"{SOURCE_ID} contains {q}")
            self._decorators(s, q)
            if is_class:
                self._call_body(s.body, ("func", q), q, s.name)
                continue
            for n in ast.walk(s):
                if isinstance(n, ast.Call):
                    self._call(n, q, owner)
            self._call_body([x for x in s.body if not isinstance(x, ast.ClassDef)], ("func", q), q, owner)

    def _call(self, n: ast.Call, caller: str, owner: str | None) -> None:
        f, scope, ref, keys = n.func, self.scope, None, None
        if isinstance(f, ast.Name):
            if f.id in scope.local:
                target, certainty = scope.local[f.id], 3
            else:
                found = scope.from_module(f.id)
                target, certainty = (found, 2) if found else (f"<unresolved>::{f.id}", 1)
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            left = f.value.id
            if left == "self":
                target, certainty = (f"{self.module}::{owner}::{f.attr}", 2) if owner else (f"<self>::{f.attr}", 1)
            elif left in scope.alias:
                target, certainty, ref, keys = f"{scope.alias[left]}::{f.attr}", 1, "alias", [scope.alias[left]]
            elif left in scope.imported:
                target, certainty = "::".join([*scope.imported[left], f.attr]), 1
            else:
                return
        else:
            return
        self._add(kind="node", prefix="func", type="FUNCTION", name=target.split("::")[-1], qualified_name=target, display_name=target, certainty=certainty, file_path=None, ref=ref, keys=keys)
        self.edge(("func", caller), "CALLS", ("func", target), n.lineno, certainty, shown=f"{SOURCE_ID} calls {target}", ref=ref, keys=keys)

    def _decorator(self, f: ast.AST) -> tuple[str, int]:
        if isinstance(f, ast.Name):
            found = self.scope.from_module(f.id)
            return (found, 2) if found else (self.scope.local[f.id], 3) if f.id in self.scope.local else (f"<unresolved>::{f.id}", 1)
        parts = []
        while isinstance(f, ast.Attribute):
            parts.insert(0, f.attr)
            f = f.value
        if not parts:
            return UNKNOWN, 1
        head = f.id if isinstance(f, ast.Name) else parts.pop(0)
        module = self.scope.alias.get(head)
        return "::".join([module or head, *parts]), 2 if module else 1

    def _decorators(self, s, q: str) -> None:
        for d in s.decorator_list:
            factory = isinstance(d, ast.Call)
            target, certainty = self._decorator(d.func if factory else d)
            meta = ({"is_factory": "true"} if factory else {}) | ({"preserves_identity": "true"} if target in ("functools::wraps", "<unresolved>::wraps") else {})
            self.node("deco", "DECORATOR", target, certainty=certainty, own_file=False)
            self.edge(("deco", target), "DECORATES", ("func", q), s.lineno, certainty, shown=f"{target} decorates {TARGET_ID}", **meta)

    # -- web frameworks

    def _functions(self) -> list:
        return [s for s in self.tree.body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef))]

    def _endpoint(self, parts: list[str], shown: str, handler: tuple[str, str, int], line: int, **meta) -> None:
        """An endpoint of the identity ``parts`` and who serves it: (its name, qualified name, certainty)."""
        name, q, certainty = handler
        self.node("func", "FUNCTION", q, line, certainty, name=name)
        self._add(kind="node", prefix="endpoint", type="ENDPOINT", name=shown, qualified_name="|".join(parts), display_name=shown, line_number=line, meta=meta)
        self.edge(("func", q), "EXPOSES_ENDPOINT", ("endpoint", "|".join(parts)), line, certainty, shown=f"{name} exposes {shown}")

    def fastapi(self) -> None:
        for s in self._functions():
            q, routed = f"{self.module}::{s.name}", False
            for d in s.decorator_list:
                if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr.lower() in HTTP_VERBS):
                    continue
                given = d.args[0] if d.args else next((k.value for k in d.keywords if k.arg in ("path", None)), None)
                path, method, routed = text_of(given) or UNKNOWN, d.func.attr.upper(), True
                self._endpoint([method, path], f"{method} {path}", (s.name, q, 3), s.lineno, http_method=method, path=path)
            if not routed:
                continue
            for v in [*s.args.defaults, *filter(None, s.args.kw_defaults)]:
                if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "Depends" and v.args and isinstance(v.args[0], (ast.Name, ast.Attribute)):
                    name = ast.unparse(v.args[0])
                    self.edge(("func", q), "INJECTS_DEPENDENCY", ("func", f"<unresolved>::{name}"), s.lineno, 1, shown=f"{s.name} depends on {name}", ref="class", keys=[name])
            for a in self._arguments(s):
                if name := handled_name(a.annotation):
                    self.edge(("func", q), "TYPE_ANNOTATED", ("func", name), s.lineno, shown=f"{s.name} param annotated with {name}", ref="known class", keys=[name])
            if name := handled_name(s.returns):
                self.edge(("func", q), "TYPE_ANNOTATED", ("func", name), s.lineno, shown=f"{s.name} returns {name}", ref="known class", keys=[name])

    def flask(self) -> None:
        for s in self._functions():
            for d in s.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr == "route":
                    path = text_of(d.args[0]) if d.args else None
                    path = path or UNKNOWN
                    listed = next((k.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List)), None)
                    for m in [m.upper() for e in getattr(listed, "elts", []) if (m := text_of(e))] or ["GET"]:
                        self._endpoint([m, path], f"{m} {path}", (s.name, f"{self.module}::{s.name}", 3), s.lineno, http_method=m, path=path)

    def django(self) -> None:
        for s in self.tree.body:
            if isinstance(s, ast.Assign) and self.path.rsplit("/", 1)[-1] == "urls.py" and any(isinstance(t, ast.Name) and t.id == "urlpatterns" for t in s.targets):
                self._urls(s.value)
            if isinstance(s, ast.ClassDef) and any(isinstance(b, (ast.Name, ast.Attribute)) and ast.unparse(b) in ("Model", "models.Model") for b in s.bases):
                self._django_model(s)

    def _urls(self, value: ast.AST) -> None:
        for e in value.elts if isinstance(value, (ast.List, ast.Tuple)) else ():
            if not isinstance(e, ast.Call):
                continue
            if last_name(e.func) not in ("path", "re_path", "url"):
                for a in e.args:  # include and the like
                    self._urls(a)
            elif e.args:
                given = e.args[1] if len(e.args) > 1 else None
                given = given.func if isinstance(given, ast.Call) else given if isinstance(given, (ast.Name, ast.Attribute)) else None
                path, view = text_of(e.args[0]) or UNKNOWN, ast.unparse(given) if given is not None else "<unknown>"
                self._endpoint(["DJANGO", path, view], f"DJANGO {path} -> {view}", (view, f"{self.module}::{view}", 2), e.lineno, http_method="ANY", path=path, view=view)

    def _django_model(self, c: ast.ClassDef) -> None:
        q = f"{self.module}::{c.name}"
        self.node("model", "SQLALCHEMY_MODEL", q, c.lineno, framework="django")
        for s in c.body:
            if not (isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and last_name(s.value.func) in RELATIONS and s.value.args):
                continue
            given = s.value.args[0]
            name = (text_of(given) or last_name(given) or "").split(".")[-1]
            if name:
                self._related(q, name, "FOREIGN_KEY", s.lineno, f"{c.name} -> {name} ({last_name(s.value.func)})")

    def _related(self, model: str, name: str, kind: str, line: int, shown: str, **keyed) -> None:
        target = f"<unresolved>::{name}"
        self._add(kind="node", prefix="func", type="SQLALCHEMY_MODEL", name=name, qualified_name=target, display_name=target, certainty=1, file_path=None, **keyed)
        self.edge(("model", model), kind, ("func", target), line, 2, shown=shown, **keyed)

    # -- models

    def sqlalchemy(self) -> None:
        for s in ast.walk(self.tree):
            if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and last_name(s.value.func) in ("declarative_base", "as_declarative"):
                for t in s.targets:
                    if isinstance(t, ast.Name):
                        self._add(kind="base", name=t.id)
            elif isinstance(s, ast.ClassDef) and any(last_name(b) in MODEL_BASES for b in s.bases):
                self._add(kind="base", name=s.name)
        for c in self.tree.body:
            if isinstance(c, ast.ClassDef) and (bases := [b for b in map(last_name, c.bases) if b]):
                self._model(c, {"ref": "base", "keys": bases})

    def _model(self, c: ast.ClassDef, keyed: dict) -> None:
        q = f"{self.module}::{c.name}"
        self._add(kind="node", prefix="model", type="SQLALCHEMY_MODEL", name=c.name, qualified_name=q, display_name=q, line_number=c.lineno, meta={"framework": "sqlalchemy"}, **keyed)
        named = next((s for s in c.body if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in s.targets)), None)
        if table := text_of(getattr(named, "value", None)):
            self._add(kind="node", prefix="table", type="TABLE", name=table, qualified_name=table, display_name=table, line_number=c.lineno, **keyed)
            self.edge(("model", q), "DEFINES_MODEL", ("table", table), c.lineno, shown=f"{c.name} defines table {table}", **keyed)
        for s in c.body:
            value = s.value if isinstance(s, (ast.Assign, ast.AnnAssign)) else None
            how = last_name(value.func) if isinstance(value, ast.Call) else None
            if how in ("Column", "mapped_column"):
                for a in [*value.args, *(k.value for k in value.keywords)]:
                    self._foreign_keys(a, c, s.lineno, keyed)
            elif how == "ForeignKey":
                self._foreign_keys(value, c, s.lineno, keyed)
            elif how == "relationship" and value.args:
                given = value.args[0]
                if name := text_of(given) or (given.id if isinstance(given, ast.Name) else None):
                    self._related(q, name, "CALLS", s.lineno, f"{c.name} relationship -> {name}", **keyed)

    def _foreign_keys(self, value: ast.AST, c: ast.ClassDef, line: int, keyed: dict) -> None:
        """Of a call, or of the calls among its arguments."""
        if not isinstance(value, ast.Call):
            return
        if last_name(value.func) != "ForeignKey":
            for a in value.args:
                self._foreign_keys(a, c, line, keyed)
        elif value.args and (ref := text_of(value.args[0])):
            table = ref.split(".")[0]
            self._add(kind="node", prefix="table", type="TABLE", name=table, qualified_name=table, display_name=table, certainty=2, file_path=None, **keyed)
            self.edge(("model", f"{self.module}::{c.name}"), "FOREIGN_KEY", ("table", table), line, shown=f"{c.name} FK -> {table}", **keyed)

    # -- HTTP clients

    def http(self) -> None:
        where: dict[int, str] = {}

        def visit(body, prefix):
            for s in body:
                if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    q = f"{prefix}::{s.name}"
                    if not isinstance(s, ast.ClassDef):
                        where.update({id(n): q for n in ast.walk(s)})
                    visit(s.body, q)

        visit(self.tree.body, self.module)
        for n in ast.walk(self.tree):
            if not (isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr.lower() in HTTP_VERBS[:-1]):
                continue
            left = n.func.value
            session = isinstance(left, ast.Call) and isinstance(left.func, ast.Attribute) and left.func.attr in SESSIONS
            client = left.func.value if session else left
            if not (isinstance(client, ast.Name) and client.id in CLIENTS):
                continue
            url, method = text_of(n.args[0]) if n.args else None, n.func.attr.upper()
            url = url or UNKNOWN
            certainty, shown, q = 1 if url == UNKNOWN else 3, f"{method} {url}", where.get(id(n), f"{self.module}::<module>")
            self._add(kind="node", prefix="ext_endpoint", type="EXTERNAL_ENDPOINT", name=shown, qualified_name=f"{method}|{url}", display_name=shown, line_number=n.lineno, certainty=certainty, meta={"http_method": method, "url": url})
            self.node("func", "FUNCTION", q)
            self.edge(("func", q), "CALLS_HTTP", ("ext_endpoint", f"{method}|{url}"), n.lineno, certainty, shown=f"{q} calls {shown}")

    # -- type annotations

    def _arguments(self, s) -> list[ast.arg]:
        return [a for a in [*s.args.args, *s.args.kwonlyargs, s.args.vararg, s.args.kwarg] if a is not None and a.arg != "self"]

    def annotations(self) -> None:
        self._annotated(self.tree.body, self.module, None)

    def _annotated(self, body, prefix, inside) -> None:
        for s in body:
            if isinstance(s, ast.ClassDef):
                self._annotated(s.body, f"{prefix}::{s.name}", None)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                q = f"{prefix}::{s.name}"
                self.node("func", "FUNCTION", q, s.lineno)
                for a, context in [*((a.annotation, f"param {a.arg}") for a in self._arguments(s)), (s.returns, "return")]:
                    self._types(a, ("func", q), context, s.lineno)
                self._annotated(s.body, q, q)
            elif isinstance(s, ast.AnnAssign):
                self._types(s.annotation, ("func", inside) if inside else ("mod", self.module), "annotated assignment", s.lineno)

    def _types(self, annotation, source, context: str, line: int) -> None:
        for name in dict.fromkeys(annotation_names(annotation)):
            self.edge(source, "TYPE_ANNOTATED", ("func", name), line, shown=f"{source[1]} [{context}] -> {name}", ref="known class", keys=[name])


def handled_name(node: ast.AST | None) -> str | None:
    """The one name that a handler's annotation stands for: the innermost of subscripts, the first of several."""
    while isinstance(node, ast.Subscript):
        node = node.slice
    if isinstance(node, ast.Tuple):
        return next(filter(None, map(handled_name, node.elts)), None)
    return last_name(node)


def annotation_names(node: ast.AST | None) -> list[str]:
    """Names in an annotation without wrappers: unions and subscripts are opened, a quoted name counts as it stands."""
    if text := text_of(node):
        return [text]
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return annotation_names(node.left) + annotation_names(node.right)
    if isinstance(node, ast.Subscript):
        return annotation_names(node.value) + annotation_names(node.slice)
    if isinstance(node, ast.Tuple):
        return [x for e in node.elts for x in annotation_names(e)]
    name = last_name(node)
    return [name] if name and not (isinstance(node, ast.Name) and name in TYPE_WRAPPERS) else []


def file_facts(path: str, rank: int, source: bytes | None, added=()) -> list[dict]:
    """Facts of a file, or one warning where it can't be read (``source`` is None) or isn't Python."""
    try:
        if source is None:
            raise OSError(f"cannot read {path}")
        return list(File(path, rank, source).facts(added))
    except OSError as e:
        code, message = "IO_ERROR", str(e)
    except UnicodeDecodeError as e:
        code, message = "DECODE_ERROR", str(e)
    except (SyntaxError, ValueError) as e:
        code, message = "SYNTAX_ERROR", str(e)
    except RecursionError as e:
        code, message = "PARSE_ERROR", str(e)
    base = dict.fromkeys(x.split()[0] for x in FACTS.split(", "))
    return [base | {"kind": "warning", "stage": 0, "file": rank, "n": 0, "type": code, "name": message, "file_path": path, "certainty": 0, "meta": {}}]


def is_standard(module: str) -> bool:
    return module.split(".")[0] in sys.stdlib_module_names

"""Facts of one JavaScript or TypeScript file by a small scanner: comments and strings are read properly, the rest by patterns.

Covered: import and require, function and class declarations, functions bound to names, calls of names of the same module, and
HTTP calls by fetch, axios, useQuery, useSWR and useMutation. Anything else in a file is passed over.
"""

from __future__ import annotations

import re

UNKNOWN = "<dynamic>"
AXIOS_VERBS = ("get", "post", "put", "delete", "patch", "head", "options", "request")
STAGES = {"imports": 10, "functions": 11, "http": 12}

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_IMPORT = re.compile(r"\bimport\s+(?:(type\s+)?([\w$*{}\s,]+?)\s+from\s+)?(§\d+§)|\brequire\s*\(\s*(§\d+§)\s*\)")
_FUNCTION = re.compile(r"\b(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\(|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)|\bclass\s+([A-Za-z_$][\w$]*)")
_METHOD = re.compile(r"(?:^|[;{}\n])\s*(?:public |private |protected |static |async |get |set )*([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::\s*[\w<>\[\]| ]+)?\{")
_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\(")
_HTTP = re.compile(r"(?<![\w$.])(fetch|useQuery|useSWR|useMutation|axios(?:\s*\.\s*(\w+))?)\s*(?:<[^>()]*>)?\(\s*")
_FIRST, _SECOND, _LISTED = re.compile(r"(§\d+§)"), re.compile(r"\[\s*§\d+§\s*,\s*(§\d+§)"), re.compile(r"\[\s*(§\d+§)")
_BRACKET = re.compile(r"[()\[\]{}]")
_KEYWORDS = frozenset("if for while switch catch function return typeof await super import require constructor".split())


def module_name(path: str) -> str:
    return re.sub(r"\.(js|ts|jsx|tsx)$", "", path).replace("/", ".")


def resolve_specifier(spec: str, module: str) -> tuple[str, bool]:
    """(dotted name, whether it is a file of the project)."""
    if not spec.startswith("."):
        return spec, False
    parts = module.split(".")[:-1]
    for p in re.sub(r"\.(js|ts|jsx|tsx)$", "", spec).split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in (".", ""):
            parts.append(p)
    return ".".join(parts), True


class File:
    def __init__(self, path: str, rank: int, source: bytes) -> None:
        self.path, self.rank, self.module = path, rank, module_name(path)
        self.strings: list[str] = []
        text = source.decode("utf-8")

        def keep(m: re.Match) -> str:
            t = m[0]
            if t.startswith("/"):
                return re.sub(r"[^\n]", " ", t)
            self.strings.append(UNKNOWN if t[0] == "`" and "${" in t else t[1:-1])
            return f"§{len(self.strings) - 1}§" + "\n" * t.count("\n")

        self.text = _TOKEN.sub(keep, text)
        self.out: list[dict] = []

    def facts(self) -> list[dict]:
        for name, self.stage in STAGES.items():
            getattr(self, name)()
        return [f | {"n": n} for n, f in enumerate(self.out)]

    def _line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def _string(self, token: str) -> str:
        return self.strings[int(token.strip("§"))]

    def _add(self, **f) -> None:
        base = dict.fromkeys("kind prefix type name qualified_name display_name source_prefix source line_number ref keys".split())
        self.out.append(base | {"stage": self.stage, "file": self.rank, "file_path": self.path, "certainty": 3, "meta": {}} | f)

    def _node(self, prefix, type_, q, line=None, **more) -> None:
        name = q.split("::" if "::" in q else ".")[-1]
        self._add(**{"kind": "node", "prefix": prefix, "type": type_, "name": name, "qualified_name": q, "display_name": q, "line_number": line} | more)

    def _edge(self, source, type_, target, line, shown, **more) -> None:
        self._add(**{"kind": "edge", "source_prefix": source[0], "source": source[1], "type": type_, "prefix": target[0], "qualified_name": target[1], "display_name": shown, "line_number": line} | more)

    def imports(self) -> None:
        self._node("jsmod", "JS_MODULE", self.module)
        for m in _IMPORT.finditer(self.text):
            target, own = resolve_specifier(self._string(m[3] or m[4]), self.module)
            certainty = 3 if own else 2
            named = "{" in (m[2] or "") or "*" in (m[2] or "")
            self._node("jsmod", "JS_MODULE", target, certainty=certainty, file_path=None)
            shown = f"{self.module} -> {target}" if m[3] else f"{self.module} requires {target}"
            self._edge(("jsmod", self.module), "IMPORTS_FROM" if named else "IMPORTS", ("jsmod", target), self._line(m.start()), shown, certainty=certainty)

    def _body(self, at: int) -> tuple[int, int]:
        """The braces that follow, or the rest of the line."""
        line, open_ = self.text.find("\n", at), self.text.find("{", at)
        if open_ < 0:
            return at, line if line >= 0 else len(self.text)
        depth = 0
        for k in range(open_, len(self.text)):
            depth += {"{": 1, "}": -1}.get(self.text[k], 0)
            if depth == 0:
                return at, k + 1
        return at, len(self.text)

    def _own(self, at: int) -> str:
        """What stands in the object that begins here, up to its closing brace, without what is in brackets inside."""
        depth, out, start = 0, [], at
        for m in _BRACKET.finditer(self.text, at):
            if m[0] in "([{":
                if depth == 1:
                    out.append(self.text[start : m.start()])
                depth += 1
            else:
                depth -= 1
                if depth == 0:
                    return " ".join([*out, self.text[start : m.start()]])
            if depth == 1:
                start = m.end()
        return " ".join(out)

    def functions(self) -> None:
        self.spans: list[tuple[int, int, str]] = []
        me, names = ("jsmod", self.module), {}
        for m in _FUNCTION.finditer(self.text):
            name = m[1] or m[2] or m[3]
            q = f"{self.module}::{name}"
            names[name] = q
            line = self._line(m.start())
            self._node("jsfunc", "JS_COMPONENT" if name[0].isupper() else "JS_FUNCTION", q, line)
            self._edge(me, "CONTAINS", ("jsfunc", q), line, f"{self.module} contains {name}")
            # a parameter list may hold braces: the body begins after it
            a, b = self._body(m.end() if m[3] or not m[1] else self.text.find(")", m.end()))
            if m[3]:
                for x in _METHOD.finditer(self.text, a, b):
                    if x[1] not in _KEYWORDS:
                        mq = f"{q}::{x[1]}"
                        self._node("jsfunc", "JS_FUNCTION", mq, self._line(x.start(1)))
                        self._edge(("jsfunc", q), "CONTAINS", ("jsfunc", mq), self._line(x.start(1)), f"{q} contains {x[1]}")
                        self.spans.append((x.start(1), self._body(x.end() - 1)[1], mq))
            else:
                self.spans.append((m.start(), b, q))
        for m in _CALL.finditer(self.text):
            before = self.text[max(0, m.start() - 12) : m.start()].rstrip()
            if m[1] in names and not before.endswith("function"):
                self._edge(me, "CALLS", ("jsfunc", names[m[1]]), self._line(m.start()), f"{self.module} calls {names[m[1]]}", certainty=2)

    def http(self) -> None:
        for m in _HTTP.finditer(self.text):
            verb = m[2]
            at = m.end()
            method = "GET"
            if m[1].startswith("axios"):
                if verb and verb not in AXIOS_VERBS:
                    continue
                method = "GET" if verb in (None, "request") else verb.upper()
                if not verb and not self.text.startswith("{", at):
                    continue
            s = _FIRST.match(self.text, at) or _SECOND.match(self.text, at)
            if not s and self.text.startswith("{", at):
                rest = self._own(at)
                s = re.search(r"\burl\s*:\s*(§\d+§)", rest)
                given = re.search(r"\bmethod\s*:\s*(§\d+§)", rest)
                method = self._string(given[1]).upper() if given else method
            elif not s and self.text.startswith("[", at):
                s = _LISTED.match(self.text, at)
            url = self._string(s[1]) if s else UNKNOWN
            inner = [x for x in self.spans if x[0] <= m.start() < x[1]]
            caller = max(inner)[2] if inner else f"{self.module}::<module>"
            certainty, line, name = 3 if url != UNKNOWN else 1, self._line(m.start()), f"{method} {url}"
            self._add(kind="node", prefix="js_ext_endpoint", type="EXTERNAL_ENDPOINT", name=name, qualified_name=f"{method}|{url}", display_name=name, line_number=line, certainty=certainty, file_path=None, meta={"http_method": method, "url": url, "source": "js"})
            self._node("jsfunc", "JS_FUNCTION", caller)
            self._edge(("jsfunc", caller), "CALLS_HTTP", ("js_ext_endpoint", f"{method}|{url}"), line, f"{caller} calls {name}", certainty=certainty, meta={"url": url, "http_method": method})


def file_facts(path: str, rank: int, source: bytes | None) -> list[dict]:
    """Facts of a file, or one warning where it can't be read (``source`` is None) or decoded."""
    try:
        if source is None:
            raise OSError(f"cannot read {path}")
        return File(path, rank, source).facts()
    except (OSError, ValueError) as e:
        base = dict.fromkeys("kind prefix type name qualified_name display_name source_prefix source line_number ref keys".split())
        return [base | {"kind": "warning", "stage": 10, "file": rank, "n": 0, "type": "IO_ERROR" if isinstance(e, OSError) else "JS_PARSE_ERROR", "name": str(e), "file_path": path, "certainty": 0, "meta": {}}]

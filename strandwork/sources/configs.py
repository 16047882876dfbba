"""Readers of the small configuration files that describe services; they run on the driver and take texts."""

from __future__ import annotations

import os
import re
import tomllib


def compose(text: str) -> dict[str, dict[str, str]]:
    """{service: {ports, command, dockerfile, build_context}} of a compose file; {} if it can't be read.

    With a YAML library it is used; without one the block style that such files are written in is read.
    """
    try:
        import yaml

        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError:
            return {}
    except ImportError:
        data = block_yaml(text)
    services = data.get("services") if isinstance(data, dict) else None
    out = {}
    for name, body in services.items() if isinstance(services, dict) else ():
        if not isinstance(body, dict):
            continue
        build, ports, command = body.get("build"), body.get("ports"), body.get("command")
        build = build if isinstance(build, dict) else {"context": build if isinstance(build, str) else None}
        info = {"ports": ", ".join(map(str, ports)) if isinstance(ports, list) else None, "command": command, "dockerfile": build.get("dockerfile"), "build_context": build.get("context")}
        out[str(name)] = {k: str(v) for k, v in info.items() if v}
    return out


def block_yaml(text: str):
    """Mappings, lists and plain scalars in block style, nothing more."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", r).rstrip() for r in text.splitlines()) if x.strip() and x.strip() != "---"]

    def scalar(v: str):
        v = v.strip()
        if v[:1] == "[" and v[-1:] == "]":
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v

    def block(k: int, depth: int):
        if k < len(rows) and rows[k][1].startswith("- "):
            out: list | dict = []
            while k < len(rows) and rows[k][0] == depth and rows[k][1].startswith("- "):
                out.append(scalar(rows[k][1][2:]))
                k += 1
            return out, k
        out = {}
        while k < len(rows) and rows[k][0] == depth:
            key, colon, value = rows[k][1].partition(":")
            if not colon:
                return out, k + 1
            k += 1
            if value.strip():
                out[scalar(key)] = scalar(value)
            elif k < len(rows) and (rows[k][0] > depth or rows[k][0] == depth and rows[k][1].startswith("- ")):
                out[scalar(key)], k = block(k, rows[k][0])
            else:
                out[scalar(key)] = None
        return out, k

    return block(0, rows[0][0])[0] if rows else {}


def entrypoint(text: str) -> str | None:
    """What the last CMD or ENTRYPOINT of a Dockerfile says."""
    found = [m[1].strip() for line in text.splitlines() if (m := re.match(r"(?:CMD|ENTRYPOINT)(.*)", line.strip(), re.I))]
    return found[-1] if found and found[-1] else None


def procfile(text: str) -> dict[str, str]:
    """{process: command}"""
    pairs = [line.strip().partition(":") for line in text.splitlines() if not line.strip().startswith("#")]
    return {name.strip(): command.strip() for name, colon, command in pairs if colon}


def project_name(text: str, directory: str) -> str:
    """The name in a pyproject file, else its directory's."""
    try:
        name = tomllib.loads(text).get("project", {}).get("name")
    except tomllib.TOMLDecodeError:
        name = None
    return name or directory


class Folder:
    """Files below a folder."""

    def __init__(self, root: str) -> None:
        self.root, self.name = root, os.path.basename(root)

    def read(self, path: str) -> str | None:
        try:
            with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            return None

    def is_dir(self, path: str) -> bool:
        return os.path.isdir(os.path.join(self.root, path))


class Texts:
    """The same over texts by path."""

    def __init__(self, files: dict[str, str], name: str = "root") -> None:
        self.files, self.name, self.read = files, name, files.get

    def is_dir(self, path: str) -> bool:
        return path == "" or any(f.startswith(path + "/") for f in self.files)


def _below(top: str, path: str) -> str:
    """A path that is given relative to the folder ``top``; the root itself is empty."""
    where = os.path.normpath(os.path.join(top, path)).replace(os.sep, "/")
    return "" if where == "." else where


def topology(tree: Folder | Texts, paths: list[str]) -> list[dict]:
    """Services and components: [{dir, kind, name, path, certainty, meta}] from the configuration files at ``paths``.

    Of those that claim one directory the last has it; the others' ``dir`` is None.
    """
    out: list[dict] = []
    owner: dict[str, dict] = {}
    top = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    of = lambda *names: [p for p in paths if p.rsplit("/", 1)[-1] in names]

    def add(where, **service):
        out.append(service | {"dir": None})
        owner[where] = out[-1]

    for p in of("docker-compose.yml", "docker-compose.yaml"):
        for name, info in compose(tree.read(p) or "").items():
            where = _below(top(p), info.get("build_context", ""))
            start = entrypoint(tree.read(_below(where, info.get("dockerfile", "Dockerfile"))) or "")
            add(where, kind="SERVICE", name=name, path=p, certainty=3, meta={"source": p} | info | ({"entrypoint": start} if start else {}))
    for p in of("Procfile"):
        for name, command in procfile(tree.read(p) or "").items():
            named = [d for x in command.split() for d in ([x, top(x)] if "/" in x else [x])]  # directories, or those of files
            where = next((d for d in (_below(top(p), x) for x in named) if tree.is_dir(d)), top(p))
            add(where, kind="SERVICE", name=name, path=p, certainty=2, meta={"source": p, "command": command})
    projects = of("pyproject.toml")
    for p in projects if len(projects) > 1 else ():  # one alone is no boundary
        name = project_name(tree.read(p) or "", top(p).rsplit("/", 1)[-1] or tree.name)
        if top(p) in owner:
            owner[top(p)]["meta"]["package_name"] = name
        else:
            add(top(p), kind="COMPONENT", name=name, path=p, certainty=3, meta={"source": p})
    for where, x in owner.items():
        x["dir"] = where
    return out

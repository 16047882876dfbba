"""Directory listing on the driver: which files are sources, which are configuration.

Spark's own file sources leave out names that begin with an underscore, such as __init__.py, so the tree is walked here and
only the list of paths becomes a table.
"""

from __future__ import annotations

import fnmatch
import os
import tomllib
from dataclasses import dataclass, field

# fixed values
CONFIG_NAMES = ("docker-compose.yml", "docker-compose.yaml", "Dockerfile", "Procfile", "pyproject.toml", "setup.py", "setup.cfg")
JS_SUFFIXES = (".js", ".ts", ".jsx", ".tsx")
IGNORED = ("__pycache__", ".git", ".venv", "venv", "env", ".env", "node_modules", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "*.egg-info", "dist", "build")


@dataclass
class ScanOptions:
    root: str
    max_depth: int = 64
    exclude_patterns: list[str] = field(default_factory=list)
    exclude_files: list[str] = field(default_factory=list)
    include_js: bool = False
    ignore_file: str = ".strandworkignore"
    config_section: str = "strandwork"


def _pattern_lines(path: str) -> list[str]:
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as f:
        return [x.strip() for x in f if x.strip() and not x.strip().startswith("#")]


def ignore_patterns(o: ScanOptions) -> list[str]:
    """Built-in patterns, then the project's, the ignore file's, extra files' and extra ones; they only add up."""
    out = list(IGNORED)
    project = os.path.join(o.root, "pyproject.toml")
    if os.path.isfile(project):
        try:
            with open(project, "rb") as f:
                out += tomllib.load(f).get("tool", {}).get(o.config_section, {}).get("exclude", [])
        except (tomllib.TOMLDecodeError, UnicodeDecodeError):
            pass  # a broken project file excludes nothing
    for p in (os.path.join(o.root, o.ignore_file), *o.exclude_files):
        out += _pattern_lines(p)
    return out + o.exclude_patterns


def excluded(relative: str, patterns: list[str]) -> bool:
    """A pattern without a slash is held against the last part; one with a slash against the relative path."""
    name = relative.rsplit("/", 1)[-1]
    for p in patterns:
        if "/" not in p:
            if fnmatch.fnmatch(name, p):
                return True
        elif fnmatch.fnmatch(relative, p) or p.endswith("/") and (fnmatch.fnmatch(name, p.rstrip("/")) or fnmatch.fnmatch(relative, p.rstrip("/"))):
            return True
    return False


def kind_of(path: str, js: bool) -> str | None:
    """python, js, config or None, by the name alone."""
    name = path.rsplit("/", 1)[-1]
    return "config" if name in CONFIG_NAMES else "python" if name.endswith(".py") else "js" if js and name.endswith(JS_SUFFIXES) else None


def scan(o: ScanOptions) -> tuple[list[tuple[str, str]], list[tuple[str, str, str, int]]]:
    """([(relative path, kind)], [(code, message, path, certainty)]), sorted; kind: python, js or config."""
    patterns, files, warnings, seen = ignore_patterns(o), [], [], set()
    root = os.path.realpath(o.root)
    for top, dirs, names in os.walk(root, followlinks=True):
        real = os.path.realpath(top)
        if real in seen:
            warnings.append(("SYMLINK_LOOP", f"directory already visited: {top}", top, 0))
            dirs[:] = []
            continue
        seen.add(real)
        rel = os.path.relpath(top, root).replace(os.sep, "/")
        depth = 0 if rel == "." else rel.count("/") + 1
        join = lambda n: n if rel == "." else f"{rel}/{n}"  # noqa: E731, B023
        dirs[:] = sorted(d for d in dirs if depth < o.max_depth and not excluded(join(d), patterns))
        for n in names:
            path = os.path.join(top, n)
            if os.path.islink(path) and not os.path.exists(path):
                warnings.append(("BROKEN_SYMLINK", f"link to nothing: {path}", path, 0))
            elif not excluded(join(n), patterns):
                if kind := kind_of(n, o.include_js):
                    files.append((join(n), kind))
    return sorted(files), warnings

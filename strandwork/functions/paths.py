"""Expressions over URLs, paths and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normal_url(c: Column) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.rtrim(F.split(F.split(c, r"\?")[0], "#")[0], F.lit("/"))


def python_module(path: Column) -> Column:
    """Dotted module name of a path relative to the root: a leading src/ goes, __init__ is its package."""
    p = F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.py$", "")
    return F.replace(F.regexp_replace(p, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def js_module(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.(js|ts|jsx|tsx)$", ""), F.lit("/"), F.lit("."))


def ancestors(path: Column) -> Column:
    """Every directory above a path, the nearest last: a/b/c.py gives [a, a/b]."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def label(node_type: Column) -> Column:
    """The bulk-import label of a node type."""
    return F.initcap(F.lower(F.replace(node_type, F.lit("_"), F.lit(""))))

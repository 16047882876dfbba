"""Shell globs as Spark predicates."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, functions as F


def glob_regex(pattern: str) -> str:
    """A Java regular expression that matches whole strings as ``fnmatch`` does; ``*`` crosses slashes."""
    body = fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "")
    return f"^{body}\\z"


def glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def file_filter(c: Column, pattern: str, missing: bool) -> Column:
    """Paths that match; a leading ``!`` excludes instead. ``missing``: what a null path gives."""
    test = ~glob(c, pattern[1:]) if pattern.startswith("!") else glob(c, pattern)
    return F.when(c.isNull(), F.lit(missing)).otherwise(test)

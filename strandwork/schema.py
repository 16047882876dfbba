"""Table schemas, fixed value sets and identifiers of the dependency graph."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F, types as T

# fixed values
NODE_TYPES = (
    "MODULE", "PACKAGE", "CLASS", "FUNCTION", "METHOD", "ENDPOINT", "VARIABLE", "DECORATOR", "SQLALCHEMY_MODEL", "TABLE", "EXTERNAL_MODULE", "EXTERNAL_SERVICE", "EXTERNAL_ENDPOINT", "SERVICE", "COMPONENT",
    "JS_MODULE", "JS_FUNCTION", "JS_COMPONENT",
)
EDGE_TYPES = (
    "IMPORTS", "IMPORTS_FROM", "CALLS", "RETURNS", "INHERITS", "IMPLEMENTS", "CONTAINS", "DECORATES", "EXPOSES_ENDPOINT", "INJECTS_DEPENDENCY", "CALLS_HTTP", "DEFINES_MODEL", "HAS_COLUMN", "FOREIGN_KEY",
    "TYPE_ANNOTATED", "CROSSES_COMPONENT_BOUNDARY", "BELONGS_TO_SERVICE", "AMBIGUOUS",
)
UNRESOLVED, AMBIGUOUS, INFERRED, EXACT = range(4)
CERTAINTY_NAMES = ("UNRESOLVED", "AMBIGUOUS", "INFERRED", "EXACT")

_META = T.MapType(T.StringType(), T.StringType())
NODES = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("type", T.StringType(), False), T.StructField("name", T.StringType(), False),
    T.StructField("qualified_name", T.StringType(), False), T.StructField("display_name", T.StringType(), False), T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("certainty", T.IntegerType(), False), T.StructField("metadata", _META, False),
])
EDGES = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("source_id", T.StringType(), False), T.StructField("target_id", T.StringType(), False), T.StructField("type", T.StringType(), False),
    T.StructField("display_name", T.StringType(), False), T.StructField("file_path", T.StringType()), T.StructField("line_number", T.IntegerType()), T.StructField("certainty", T.IntegerType(), False), T.StructField("metadata", _META, False),
])
WARNINGS = T.StructType([T.StructField("code", T.StringType(), False), T.StructField("message", T.StringType(), False), T.StructField("path", T.StringType()), T.StructField("certainty", T.IntegerType(), False)])


def make_id(prefix: str, *parts: str) -> str:
    """prefix:first 16 hex digits of the SHA-256 of the parts joined by bars."""
    return f"{prefix}:{hashlib.sha256('|'.join(parts).encode()).hexdigest()[:16]}"


def id_column(prefix: str, *parts: str | Column) -> Column:
    """``make_id`` as an expression; null parts count as empty."""
    cols = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16))


def certainty_name(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CERTAINTY_NAMES]), c + 1)

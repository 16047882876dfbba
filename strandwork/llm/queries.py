"""The subpackage's queries over the driver's tables, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat import CLOSE, CONTROLS, NEW_LINE, OPEN, conversation_digests
from .decision_list import quality_report
from .decontaminate import contamination
from .license_scan import scan
from .ngram_join import ngram_components
from .packing import pack
from .quality_crf import KEEP_FROM, fit, fold, score
from .repeats import repeat_report
from .sharding import shard
from .token_io import tokens_round_trip

ADDED_CONVERSATION = (-7, "</s>[INST] ok [/INST]")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    conv, text = ADDED_CONVERSATION
    added = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversation_digests(own.unionByName(added))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_token_output, op3_ngram_join, op4_quality_rules, op5_license_scan,
        op6_sharding, op7_packing, op8_quality_classifier, op9_chat_formatting, op10_suffix_dedup,
    )
}


def _sql_escape(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for x in CONTROLS:
        c = f"replace({c}, '{x}', '{x[0]}\\{x[1:]}')"
    return c


_CONV, _TEXT = ADDED_CONVERSATION

ORACLE: dict[str, str] = {
    # sets of shingles, links from counts of common shingles, components by the closure of the links
    "op3_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(u) FROM r WHERE v = n.doc_id) AS component_id FROM n
""",
    # every 100-byte window, those that equal an earlier one, their runs, and what lies between the runs
    "op10_suffix_dedup": r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(b[i:i + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM b)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS first FROM l),
s AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM s GROUP BY doc_id, span),
k AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z NULLS LAST), 1) AS p
  FROM (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, n + 1, NULL FROM b)),
o AS (
  SELECT k.doc_id, cast(sum(coalesce(z - a, 0)) AS bigint) AS n_removed, count(z) AS n_spans, string_agg(hex(b[p:a - 1]), '' ORDER BY a, z NULLS LAST) AS kept
  FROM k JOIN b ON b.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT b.doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM b JOIN o ON o.doc_id = b.doc_id
""",
    "op9_chat_formatting": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({_CONV}, 0, 'user', '{_TEXT}'), ({_CONV}, 1, 'assistant', '{_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  cast(sum({len(OPEN) + len(CLOSE) + 2} + length(replace({_sql_escape('role')}, chr(10), '{NEW_LINE}')) + length({_sql_escape('text')})) AS bigint) AS formatted_chars
FROM c GROUP BY conv_id
""",
}

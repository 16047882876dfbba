"""Quality rules: decision lists learned by sequential covering, applied as ordered conditional expressions.

DataFrame and SQL functions only. Statistics of every text are computed in its row. Rules that reject are grown
one threshold condition at a time on two thirds of the labelled rows and pruned on the others; rows that a
rule covers leave both sets. Only counts by feature, bucket and label reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from strandwork.session import materialize

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # percent of the words

#: Features of the rules, as SQL over the statistics.
FEATURES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "stutter": "n_adjacent / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "word_chars": "word_chars / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
}
CUTS = 32
MAX_RULES, MAX_CONDITIONS = 8, 3
LEAST_PRECISION, LEAST_COVER = 0.9, 5


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with its statistics (see FEATURES). A null text has no words."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("_t", text).withColumn("_w", F.filter(F.split("_t", WORD_BREAK), lambda x: x != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", lines).withColumn("n_words", F.size("_w").cast("long"))
    hashes = F.transform("_w", lambda x: F.xxhash64(x))
    d = d.withColumn("_h", hashes)
    d = d.withColumn("_g", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int")), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    # only texts with a repeated window need their places
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = F.zip_with("_s", F.expr("slice(_s, 2, size(_s))"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), places))
    gaps = F.expr(f"aggregate(zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> least({WINDOW}, b - a)), 0L, (s, x) -> s + coalesce(x, {WINDOW}))")
    adjacent = F.size(F.filter(F.zip_with("_h", F.expr("slice(_h, 2, size(_h))"), lambda a, b: a == b), lambda x: x))
    return d.select(
        *[f"`{c}`" for c in docs.columns if c != "text"], "n_words", F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_p").isNotNull(), gaps).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"), F.when(F.col("n_words") > 1, adjacent).otherwise(0).cast("long").alias("n_adjacent"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"), F.regexp_count("_t", F.lit("!!")).cast("long").alias("n_shouts"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.at_least else '<'} {self.cut!r}D"


Rule = tuple[Condition, ...]


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules that reject, in order. Uses every labelled row that the base rules pass; labels that repeat count as their smallest.

    Without labels of both kinds there is no rule.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(known, F.col("doc_id") == F.col("id"))
    names = list(FEATURES)
    rows = rows.select((F.col("quality") > 0).alias("good"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *[F.expr(FEATURES[n]).cast("double").alias(n) for n in names])
    rows = materialize(rows, "labelled")
    shares = [k / CUTS for k in range(1, CUTS)] + [0.005, 0.01, 0.99, 0.995]
    first = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), *[F.percentile_approx(n, sorted(shares), 10000).alias(n) for n in names], *[F.percentile_approx(F.when(~F.col("good"), F.col(n)), sorted(shares), 10000).alias(f"bad_{n}") for n in names]).first()
    if not first["good"] or not first["bad"]:
        return []
    cuts = {n: sorted({*first[n], *first[f"bad_{n}"]}) for n in names}
    bucket = lambda n: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[n]]), lambda c: F.col(n) >= c)).alias(n)
    left = materialize(rows.select("good", "grow", *[bucket(n) for n in names]), "buckets")
    in_rule = lambda r: F.expr(" and ".join(f"{c.feature} {'>=' if c.at_least else '<'} {cuts[c.feature].index(c.cut) + 1}" for c in r) or "true")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            step = _best(_counts(left.where("grow").where(in_rule(rule)), names), cuts)
            if step is None:
                break
            rule = (*rule, step[0])
            if step[1] == 0:  # covers bad rows only
                break
        rule = _pruned(rule, left.where("not grow"), in_rule)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~in_rule(rule))
    return rules


def _counts(rows: DataFrame, names: list[str]) -> dict[str, dict[int, list[int]]]:
    """For each feature and bucket: bad and good rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names]))
    got = rows.select("good", pairs.alias("x")).groupBy("x.f", "x.b").agg(F.count_if(~F.col("good")), F.count_if("good")).collect()  # at most features x cuts rows
    out: dict[str, dict[int, list[int]]] = {n: {} for n in names}
    for f, b, bad, good in got:
        out[f][b] = [bad, good]
    return out


def _best(counts: dict[str, dict[int, list[int]]], cuts: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition of the largest information gain on bad rows, with the good rows that it still covers."""
    from math import log2

    bad, good = (sum(x[k] for x in next(iter(counts.values())).values()) for k in (0, 1))
    if not bad or not good:
        return None
    best, most = None, 0.0
    for n, by in sorted(counts.items()):
        above = [0, 0]
        for b in range(len(cuts[n]), 0, -1):
            x = by.get(b, [0, 0])
            above = [above[0] + x[0], above[1] + x[1]]
            for at_least, p, q in ((True, *above), (False, bad - above[0], good - above[1])):
                if p >= LEAST_COVER and (gain := p * (log2(p / (p + q)) - log2(bad / (bad + good)))) > most:
                    best, most = (Condition(n, at_least, cuts[n][b - 1]), q), gain
    return best


def _pruned(rule: Rule, rows: DataFrame, in_rule) -> Rule:
    """The shortest beginning of the rule that does best on the rows kept for pruning; () if none is precise enough."""
    if not rule:
        return ()
    some = [c for k in range(1, len(rule) + 1) for c in (F.count_if(in_rule(rule[:k]) & ~F.col("good")), F.count_if(in_rule(rule[:k]) & F.col("good")))]
    got = rows.agg(*some).first()
    best, most = (), 0.0
    for k in range(1, len(rule) + 1):
        p, q = got[2 * k - 2], got[2 * k - 1]
        if p and p / (p + q) >= LEAST_PRECISION and (p - q) > most:
            best, most = rule[:k], p - q
    return best


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditions: the first rule that holds rejects, else the text is kept."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(F.expr(" and ".join(f"({c.sql()})" for c in r)), F.lit(False)).otherwise(out)
    return out


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row of ``docs``.

    A null, empty or wordless text has zeros and fails the base rules; texts of any length are counted whole; repeated rows and
    rows without doc_id are reported each on their own, but rows without doc_id teach nothing; an empty table gives no row; without labels
    what passes the base rules is kept; other columns aren't read, whatever their names. A list has at most MAX_RULES rules
    of at most MAX_CONDITIONS conditions, so that it can be read.
    """
    stats = materialize(statistics(docs.select("doc_id", "text")), "statistics")
    rules = learn(stats, labels)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))

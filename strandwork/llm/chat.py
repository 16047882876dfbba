"""Chat formatting over reply trees.

Messages point to the message that they reply to. Ancestors at distances of powers of two are found by
iterative self-joins, and every leaf collects its root-to-leaf path from them in as many steps, so a thread
of n turns takes log2(n) joins. Paths are ranked by the score of their messages and each chosen one becomes a conversation.

Template: ``<|im_start|>role, line break, text<|im_end|>, line break`` for each turn. In texts and roles a backslash is doubled and
every control string gets a backslash after its first character, so none can be forged and ``unescape``
(drop each backslash that stands before a character) gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwork.session import materialize

CONTROLS = ["<|im_start|>", "<|im_end|>", "<|nl|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, CLOSE, NEW_LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROLS:
        c = F.replace(c, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def climbs(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jumps, totals). jumps[k]: (conv_id, msg_id, above), the message 2**k replies further up; totals: (conv_id, msg_id, s, n),
    the sum of the scores (null: 0) and the number of the messages from each one up to its root.

    messages: conv_id, msg_id (unique in its conversation), parent_id (null or unknown: a root), score. Both double their reach
    each round. A message whose way up runs into a ring has no root and no total.
    """
    real = messages.select("conv_id", F.col("msg_id").alias("above"))
    up = messages.select("conv_id", "msg_id", F.col("parent_id").alias("above"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"), F.lit(1).cast("long").alias("n"))
    known = up.join(real.withColumn("real", F.lit(True)), ["conv_id", "above"], "left").withColumn("above", F.when(F.col("real"), F.col("above")))
    state, jumps, n = materialize(known.select("conv_id", "msg_id", "above", "s", "n"), "climb"), [], messages.count()
    while 1 << len(jumps) <= n:
        jump = state.where("above is not null").select("conv_id", "msg_id", "above")
        if jump.isEmpty():
            break
        jumps.append(jump)
        then = state.select("conv_id", F.col("msg_id").alias("above"), F.col("above").alias("further"), F.col("s").alias("s2"), F.col("n").alias("n2"))
        # those that are at their root are done
        more = state.where("above is not null").join(then, ["conv_id", "above"]).select("conv_id", "msg_id", F.col("further").alias("above"), (F.col("s") + F.col("s2")).alias("s"), (F.col("n") + F.col("n2")).alias("n"))
        state = materialize(state.where("above is null").select("conv_id", "msg_id", "above", "s", "n").unionByName(more), "climb")
    return jumps, state.where("above is null").select("conv_id", "msg_id", "s", "n")


def best_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, rank, msg_id, role, text, depth) of the ``keep`` best branches of each conversation.

    A branch ends at a message without replies. Its score is the mean of its messages' scores (null counts as 0); of equal ones the
    longer, then the smaller leaf. Branches are ranked by their totals; only those that are kept are spelled out.
    """
    jumps, totals = climbs(messages)
    parents = messages.select("conv_id", F.col("parent_id").alias("msg_id")).where("msg_id is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.col("s") / F.col("n")), F.desc("n"), "msg_id"))
    kept = totals.join(parents, ["conv_id", "msg_id"], "left_anti").withColumn("rank", rank).where(F.col("rank") <= keep)
    found = materialize(kept.select("conv_id", "rank", "msg_id", (F.col("n") - 1).alias("depth")), "paths")
    for k in range(len(jumps) - 1, -1, -1):
        more = found.join(jumps[k], ["conv_id", "msg_id"]).select("conv_id", "rank", F.col("above").alias("msg_id"), (F.col("depth") - (1 << k)).alias("depth"))
        found = materialize(found.unionByName(more), "paths")
    return found.join(messages.select("conv_id", "msg_id", "role", "text"), ["conv_id", "msg_id"]).select("conv_id", "rank", "msg_id", "role", "text", "depth")


def format_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, rank, formatted, loss): loss holds (start, length) in characters of what each assistant turn says."""
    e = turns.select("conv_id", "rank", "depth", F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(NEW_LINE)).alias("r"), escape(F.coalesce("text", F.lit(""))).alias("t"), (F.coalesce("role", F.lit("")) == "assistant").alias("learn"))
    e = e.withColumn("piece", F.concat(F.lit(OPEN), "r", F.lit("\n"), "t", F.lit(CLOSE + "\n")))
    g = e.groupBy("conv_id", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "piece", F.length("t").alias("n"), F.length("piece").alias("all"), "learn"))).alias("x"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + x["all"]).alias("at"),
        F.when(x["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["all"] - x["n"] - len(CLOSE) - 1).alias("start"), x["n"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    return g.select("conv_id", "rank", F.array_join(F.transform("x", lambda v: v["piece"]), "").alias("formatted"), F.aggregate("x", start, step, lambda a: a["spans"]).alias("loss"))


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` best paths of each conversation, formatted.

    Rows without conv_id or msg_id are left out; of rows that repeat a msg_id of their conversation the smallest
    counts (by parent, role, text and score, null first); messages that reply into a ring are on no path; null
    roles and texts are empty; texts are formatted whole; an empty table gives no row; other columns aren't read.
    """
    m = messages.where("conv_id is not null and msg_id is not null")
    first = F.min(F.struct(*[F.struct(F.col(c).isNotNull().alias("given"), F.col(c).alias("it")).alias(c) for c in ("parent_id", "role", "text", "score")])).alias("x")
    m = m.groupBy("conv_id", "msg_id").agg(first)
    return format_paths(best_paths(m.select("conv_id", "msg_id", *[F.col(f"x.{c}.it").alias(c) for c in ("parent_id", "role", "text", "score")]), keep))


def parsed(formatted: DataFrame) -> DataFrame:
    """(.., turns array<struct<role, text>>, learnt): what the formatted text and its loss mask say, unescaped."""
    parts = F.split("formatted", r"\Q" + CLOSE + "\n" + r"\E")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    turn = lambda p: F.struct(
        unescape(F.replace(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1), F.lit(NEW_LINE), F.lit("\n"))).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
    )
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("learnt", learnt)


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Messages of threads without branches: each row replies to the row before it, by turn, then role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = conversations.where("conv_id is not null").select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("msg_id"))
    return m.withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)).withColumn("score", F.lit(0.0))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the written output. A null text or role is empty."""
    messages = materialize(linear_messages(conversations), "messages")
    out = parsed(materialize(format_trees(messages), "formatted"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )

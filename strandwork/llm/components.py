"""Connected components of a link table by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwork.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex reachable from each vertex of ``links`` (a, b).

    Each round every vertex takes the smallest label among its neighbours' and its own, and labels
    follow their own label once (pointer jumping), so star-shaped links need two rounds. Each
    round's labels are written to the shared folder; nothing is collected but a count.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("comp").alias("near"))
        own = labels.join(near, labels.v == near.a, "left").select("v", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("v").alias("u"), F.col("comp").alias("top"))
        new = own.join(up, own.low == up.u, "left").select("v", F.col("comp").alias("was"), F.least("low", F.coalesce("top", "low")).alias("comp"))
        new = materialize(new, "labels")
        changed = new.where("comp <> was").limit(1).count()
        labels = new.select("v", "comp")
        if not changed:
            return labels

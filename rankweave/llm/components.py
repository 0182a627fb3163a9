"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.session import checkpointed


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b) -> (id, label): label is the smallest id reachable; only ids that have a link are listed.

    Each round gives every id the smallest label among its neighbours and then the label of that label, so paths shorten
    by half a round and stars end in two. Links stay in tables; only the number of changes comes to the driver.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ends = labels.select(F.col("id").alias("label"), F.col("label").alias("end"))
        after = checkpointed(lower.join(ends, "label").select("id", "old", F.least("label", "end").alias("label")))
        labels = after.select("id", "label")
        if after.where("label < old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

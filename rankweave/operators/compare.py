"""Where two tables of texts differ, by a tree of hash sums over ranges of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.session import stored

#: Bits of an id's hash that each level of the tree looks at, and levels before the rows themselves.
BITS, LEVELS = 10, 2


def _sums(rows: DataFrame, level: int) -> DataFrame:
    """Number and order-free hash sum of the rows of each range of the first ``level`` times BITS bits."""
    return rows.groupBy(_range(level).alias("at")).agg(F.count("*").alias("n"), F.sum(F.col("h1").cast("decimal(20,0)")).alias("s1"), F.sum(F.col("h2").cast("decimal(20,0)")).alias("s2"))


def _range(level: int) -> Column:
    return F.shiftrightunsigned("slot", 64 - BITS * level)


def _hashed(corpus: DataFrame) -> DataFrame:
    key, text = F.struct("id"), F.sha2("text", 256)
    return corpus.select("id", F.xxhash64(key, F.lit(0)).alias("slot"), F.xxhash64(key, text, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), text, key).alias("h2"))


def differences(frozen: DataFrame, actual: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, change): ids of tables (id, text) that were ``added``, ``lost`` or ``changed`` from ``frozen`` to ``actual``; none where they are equal.

    Rows become two hashes where they are read. Each level sums them up by ranges of the ids' hashes on both sides, and only
    rows of ranges whose sums differ go on to the next; what is left is compared by id. An id that comes again counts by all of
    its rows, so one that lost a copy is changed; a null id is an id and a null text differs from an empty one.
    """
    left, right = _hashed(frozen), _hashed(actual)
    for level in range(1, levels + 1):
        a, b = _sums(left, level).alias("a"), _sums(right, level).alias("b")
        unlike = ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.s1").eqNullSafe(F.col("b.s1")) & F.col("a.s2").eqNullSafe(F.col("b.s2")))
        differing = stored(a.join(b, F.col("a.at") == F.col("b.at"), "full").where(unlike).select(F.coalesce("a.at", "b.at").alias("at")), "ranges")
        left, right = (side.withColumn("at", _range(level)).join(differing, "at", "left_semi").drop("at") for side in (left, right))
    total = lambda side: side.groupBy(F.struct("id").alias("key")).agg(F.count("*").alias("n"), F.sum(F.col("h1").cast("decimal(20,0)")).alias("s1"), F.sum(F.col("h2").cast("decimal(20,0)")).alias("s2"))
    both = total(left).alias("a").join(total(right).alias("b"), F.col("a.key") == F.col("b.key"), "full")
    change = F.when(F.col("a.n").isNull(), "added").when(F.col("b.n").isNull(), "lost").when((F.col("a.n") != F.col("b.n")) | (F.col("a.s1") != F.col("b.s1")) | (F.col("a.s2") != F.col("b.s2")), "changed")
    return both.select(F.coalesce("a.key", "b.key").getField("id").alias("id"), change.alias("change")).where("change is not null")

"""Summaries of experiment runs: latest rows, percentiles, null-aware totals, paired runs, resumable task lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.session import drop_stored, stored


def latest(rows: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The last row of each key by ``seq``: a maximum per key, combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*seq)).alias("row"))
    return best.select(*keys, "row.*").select(*rows.columns)


def nearest_rank(value: str, share: float = 0.95) -> Column:
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def interpolated_median(value: str) -> Column:
    return F.median(value)


def total_if_all_known(value: str) -> Column:
    """The sum; null if any value is unknown or there is none."""
    return F.when((F.count_if(F.col(value).isNull()) == 0) & (F.count("*") > 0), F.sum(value))


def total_of_known(value: str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def share_passed(passed: str) -> Column:
    """Passed over graded; null when none is graded."""
    return F.avg(F.col(passed).cast("double"))


def strict_accuracy(correct: str, whole: int) -> Column:
    """Correct over ``whole`` only when all are graded."""
    return F.when(F.count(correct) == whole, F.count_if(F.col(correct)) / F.lit(float(whole)))


def ranked_values(rows: DataFrame, by: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """``by``, n (known values of the group) and for each name the value at its place (from 0, by ``n``) in rising order.

    Equal values are counted first; the counts are added up by ranges of groups and values, so no task or row holds a
    group. Null keys are a group; unknown values are left out.
    """
    keyed = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("times"))
    # range numbers are kept with the rows, so they are the same each time
    counts = stored(keyed.repartitionByRange("key", "value").withColumn("range", F.spark_partition_id()), "counts")
    totals = counts.groupBy("key", "range").agg(F.sum("times").alias("times"))
    of_key, earlier = Window.partitionBy("key"), Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("key", "range", F.sum("times").over(of_key).alias("n"), F.coalesce(F.sum("times").over(earlier), F.lit(0)).alias("of_ranges"))
    own = Window.partitionBy("key", "range").orderBy("value")
    placed = counts.withColumn("upto", F.sum("times").over(own)).alias("c").join(totals.alias("t"), F.col("c.key").eqNullSafe(F.col("t.key")) & (F.col("c.range") == F.col("t.range")))
    placed = placed.select("c.key", "c.value", "c.times", "t.n", (F.col("upto") + F.col("of_ranges")).alias("upto"))
    at = lambda place: F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("times")), F.col("value")))
    found = stored(placed.groupBy("key").agg(F.max("n").alias("n"), *[at(place).alias(name) for name, place in places.items()]), "ranked")
    drop_stored(counts)
    return found.select("key.*", "n", *places)


def _middle(n: str) -> Column:
    return F.floor(F.expr(n) / 2)


def latency_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by``, n, median (between the middle two), upper_median and p95 (nearest rank) of the known values."""
    found = ranked_values(rows, by, value, {"lower": _middle("n - 1"), "upper_median": _middle("n"), "p95": F.ceil(F.col("n") * 0.95) - 1})
    return found.select(*by, "n", ((F.col("lower") + F.col("upper_median")) / 2).alias("median"), "upper_median", "p95")


def complete_everywhere(rows: DataFrame, key: str, profile: str, complete: Column) -> DataFrame:
    """Keys with a complete row in every profile that occurs."""
    done = rows.where(complete).select(key, profile).distinct().groupBy(key).agg(F.count("*").alias("done"))
    profiles = rows.agg(F.countDistinct(profile).alias("profiles"))
    return done.join(F.broadcast(profiles), F.col("done") == F.col("profiles")).select(key)


def paired_summary(rows: DataFrame, key: str, profile: str, complete: Column, seconds: str) -> DataFrame:
    """Per profile over the keys complete in all of them: n, median and P95 seconds."""
    both = complete_everywhere(rows, key, profile, complete)
    kept = rows.where(complete).join(both, key, "left_semi")
    return _with_latencies(kept.groupBy(profile).agg(F.count("*").alias("n")), kept, profile, seconds)


def _with_latencies(counted: DataFrame, rows: DataFrame, by: str, value: str) -> DataFrame:
    """Adds p50 (between the middle two) and p95 (nearest rank) of the known values."""
    times = latency_summary(rows, (by,), value).select(F.col(by).alias("of"), F.col("median").alias("p50"), "p95")
    return counted.join(times, F.col(by).eqNullSafe(F.col("of")), "left").drop("of")


def variant_summary(rows: DataFrame, by: str = "variant") -> DataFrame:
    """Per variant of rows (qid, status, grade, attempts, tokens, seconds): completeness, grades, attempts, tokens and clean latency."""
    clean = F.when((F.col("status") == "complete") & (F.col("attempts") == 1), F.col("seconds"))
    shown = rows.withColumn("clean_seconds", clean)
    counted = shown.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("grade") == "correct").alias("correct"), F.count("grade").alias("graded"),
        F.sum("attempts").alias("attempts"), total_of_known("tokens").alias("known_tokens"), total_if_all_known("tokens").alias("all_tokens"),
    )
    return _with_latencies(counted, shown, by, "clean_seconds")


def red_team_summary(rows: DataFrame) -> DataFrame:
    """By risk, of rows (risk, passed, n_citations, bad_pages, bad_paths, error, seconds)."""
    counted = rows.groupBy("risk").agg(
        F.count("*").alias("n"), F.count_if(F.col("passed")).alias("passed"), share_passed("passed").alias("pass_rate"), F.sum("n_citations").alias("citations"), F.sum("bad_pages").alias("bad_pages"),
        F.sum("bad_paths").alias("bad_paths"), F.count("error").alias("errors"),
    )
    medians = ranked_values(rows, ["risk"], "seconds", {"median_seconds": _middle("n")}).select(F.col("risk").alias("of"), "median_seconds")
    return counted.join(medians, F.col("risk").eqNullSafe(F.col("of")), "left").drop("of")


def tasks(cases: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Every case with every variant; even cases in the given order, odd ones reversed."""
    listed = F.array(*map(F.lit, variants))
    return cases.select("*", F.posexplode(F.when(F.col("pos") % 2 == 0, listed).otherwise(F.reverse(listed))).alias("turn", "variant"))


def remaining(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned tasks whose key is not done."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def reviewed_answers(notes: DataFrame, answers: DataFrame) -> DataFrame:
    """notes (key, grade, reason, answer_sha256) with answers (key, answer); ``current`` says whether the answer is the one reviewed."""
    digest = F.sha2("answer", 256)
    return notes.join(answers, "key", "left").withColumn("current", F.coalesce(digest == F.col("answer_sha256"), F.lit(False)))

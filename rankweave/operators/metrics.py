"""Ranking metrics of batches of queries, by k, mode and slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS, CUTOFF = (1, 3, 5, 8, 20), 20


def judged(hits: DataFrame, gold: DataFrame, by: Sequence[str] = ("qid",)) -> DataFrame:
    """One row for each list of hits: *by, ranks (of the relevant hits, rising) and n_gold; queries of ``gold`` (qid, id) without hits too.

    ``hits`` has *by (qid among them), id and rank. Only relevant hits are kept, so a row stays small.
    """
    extra = [c for c in by if c != "qid"]
    gold = gold.select("qid", "id").distinct()
    sizes = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    lists = hits.select(*extra).distinct().crossJoin(sizes) if extra else sizes
    found = hits.join(gold, ["qid", "id"]).groupBy(*by).agg(F.array_sort(F.collect_set(F.col("rank").cast("int"))).alias("ranks"))
    return lists.join(found, list(by), "left").select(*by, F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), "n_gold")


def _upto(k: int) -> Column:
    return F.filter("ranks", lambda r: r <= k)


def hit_at(k: int) -> Column:
    return (F.size(_upto(k)) > 0).cast("double")


def recall_at(k: int) -> Column:
    """Null without relevant ids."""
    return F.when(F.col("n_gold") > 0, F.size(_upto(k)) / F.col("n_gold"))


def precision_at(k: int) -> Column:
    """Divided by k even where fewer came back; 0 for k of 0 or less."""
    return F.size(_upto(k)) / F.lit(float(k)) if k > 0 else F.lit(0.0)


def ndcg_at(k: int) -> Column:
    """Binary gain against the best order of min(n_gold, k) relevant ids; 0 without any."""
    gain = lambda r: F.lit(1.0) / F.log2(r + 1)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, r: s + gain(r))
    best = total(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")))
    return F.when((F.col("n_gold") > 0) & F.lit(k > 0), total(_upto(k)) / best).otherwise(0.0)


def reciprocal_rank(cutoff: int = CUTOFF) -> Column:
    first = F.get(_upto(cutoff), 0)
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def per_query(judgements: DataFrame, ks: Sequence[int] = KS, cutoff: int = CUTOFF) -> DataFrame:
    """A row for each list and k: k, hit, recall, precision, ndcg, rr."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), hit_at(k).alias("hit"), recall_at(k).alias("recall"), precision_at(k).alias("precision"), ndcg_at(k).alias("ndcg"), reciprocal_rank(cutoff).alias("rr")) for k in ks])
    kept = [c for c in judgements.columns if c not in ("ranks", "n_gold")]
    return judgements.select(*kept, F.explode(cells).alias("m")).select(*kept, "m.*")


def summary(per: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Means over the queries of each k and of the columns ``by``, with n; means of nothing are null."""
    means = [F.round(F.avg(c), digits).alias(name) for c, name in (("hit", "hit"), ("recall", "recall"), ("precision", "precision"), ("ndcg", "ndcg"), ("rr", "mrr"))]
    return per.groupBy(*by, "k").agg(F.count("*").alias("n"), *means)


def failures(judgements: DataFrame, k: int = 5, cutoff: int = CUTOFF) -> DataFrame:
    """Lists without a relevant hit in the first ``k``, with the rank of their first one, null where there is none."""
    kept = [c for c in judgements.columns if c not in ("ranks", "n_gold")]
    return judgements.where((F.size(_upto(k)) == 0) & (F.col("n_gold") > 0)).select(*kept, F.get(_upto(cutoff), 0).alias("first_rank"))


def first_hits(hits: DataFrame) -> DataFrame:
    return hits.where("rank = 1")


def coverage(found: Column, gold: Column) -> Column:
    """Whether all of ``gold`` was found; null where it is empty or null."""
    return F.when(F.size(gold) > 0, F.size(F.array_except(gold, F.coalesce(found, F.array().cast("array<string>")))) == 0)


def coverage_counts(hits: DataFrame, gold: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per list kind: queries with any gold id in the first 3, in the first 8, and with all in the first 8."""
    own = judged(hits, gold, (*by, "qid"))
    return own.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.size(_upto(3)) > 0).alias("any_3"), F.count_if(F.size(_upto(8)) > 0).alias("any_8"), F.count_if(F.size(_upto(8)) == F.col("n_gold")).alias("full_8")
    )


def mean_without_errors(rows: DataFrame, by: Sequence[str], value: str, error: str, digits: int = 4) -> DataFrame:
    ok = F.when(F.col(error).isNull(), F.col(value))
    return rows.groupBy(*by).agg(F.count(ok).alias("n"), F.round(F.avg(ok), digits).alias("mean"), F.count_if(F.col(error).isNotNull()).alias("errors"))


def worst_drops(scores: DataFrame, base: str = "orig") -> DataFrame:
    """``scores`` (mode, variant, value) -> (variant, worst, drop): the lowest value of a variant over the modes, and its greatest fall under that mode's own base."""
    bases = scores.where(F.col("variant") == base).select("mode", F.col("value").alias("base"))
    return scores.where(F.col("variant") != base).join(bases, "mode").groupBy("variant").agg(F.min("value").alias("worst"), F.round(F.min(F.col("value") - F.col("base")), 6).alias("drop"))

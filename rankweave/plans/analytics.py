"""Queries that summarise runs: latest rows, percentiles, totals, pairs, remaining tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators import experiment
from rankweave.operators.retrieve import valid_requests
from rankweave.plans.registry import register
from rankweave.sources.tables import spread, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@register("latest_wins", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = experiment.latest(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts", "value"), ("user_id", "event_type"), ("ts", "event_id"))
    return found.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@register(
    "latency_percentiles",
    "SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(list_sort(list(value))[count(value) // 2 + 1], 6) AS upper_median, round(quantile_disc(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = experiment.latency_summary(_events(spark, sf_dir), ("event_type",), "value")
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "upper_median", "p95")])


_COMPLETE = "value > 5 AND event_type <> 'error'"


@register(
    "paired_complete",
    f"""WITH done AS (SELECT * FROM events WHERE {_COMPLETE}), paired AS (SELECT user_id FROM done GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events WHERE event_type <> 'error'))
SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM done SEMI JOIN paired USING (user_id) GROUP BY event_type""",
)
def paired_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types over the users who have a large enough value in each of them."""
    rows = _events(spark, sf_dir).where("event_type <> 'error'")
    found = experiment.paired_summary(rows, "user_id", "event_type", F.expr(_COMPLETE), "value")
    return found.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


_KNOWN = "CASE WHEN event_type <> 'purchase' OR user_id % 7 <> 0 THEN CAST(round(value) AS BIGINT) END"


@register(
    "null_aware_totals",
    f"SELECT user_id, CASE WHEN count(*) = count(tokens) THEN CAST(sum(tokens) AS BIGINT) END AS all_known, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS known, count(*) AS n FROM (SELECT user_id, {_KNOWN} AS tokens FROM events) GROUP BY user_id",
)
def null_aware_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.expr(_KNOWN).alias("tokens"))
    return rows.groupBy("user_id").agg(experiment.total_if_all_known("tokens").alias("all_known"), experiment.total_of_known("tokens").alias("known"), F.count("*").alias("n"))


@register("resume_antijoin", "SELECT doc_id, variant FROM (SELECT doc_id, unnest(['a', 'b']) AS variant FROM documents) t WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = t.doc_id AND (t.variant = 'a' OR l.quality = 1))")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tasks for each document; labelled documents have done the first, good ones both."""
    planned = experiment.tasks(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos")), ("a", "b")).select("doc_id", "variant")
    labels = table(spark, sf_dir, "labels")
    done = labels.select("doc_id", F.lit("a").alias("variant")).unionByName(labels.where("quality = 1").select("doc_id", F.lit("b").alias("variant")))
    return experiment.remaining(planned, done, ("doc_id", "variant"))


@register("cell_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def cell_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "purchase"]
    return _events(spark, sf_dir).groupBy("user_id").pivot("event_type", kinds).count().select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


@register("json_tolerant", "SELECT event_id, json_extract_string(CASE WHEN event_id % 3 = 0 AND NOT json_valid('note: ' || props || ' end') THEN props ELSE props END, '$.k') AS k, json_valid(props) AS valid FROM events")
def json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third object is wrapped in words first; the tolerant parser finds it all the same."""
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note: "), "props", F.lit(" end"))).otherwise(F.col("props"))
    parsed = T.tolerant_json(wrapped)
    return _events(spark, sf_dir).select("event_id", F.try_variant_get(parsed, "$.k", "string").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@register(
    "stage_report",
    """WITH runs AS (SELECT user_id AS qid, event_type AS variant, event_id % 3 + 1 AS attempts, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'wrong' ELSE 'correct' END AS grade, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN event_id % 13 <> 0 THEN event_id % 1000 END AS tokens, value AS seconds FROM events)
SELECT variant, count(*) AS n, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (grade = 'correct') AS correct, count(grade) AS graded, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS known_tokens,
  CASE WHEN count(*) = count(tokens) THEN CAST(sum(tokens) AS BIGINT) END AS all_tokens, round(median(seconds) FILTER (status = 'complete' AND attempts = 1), 6) AS p50, round(quantile_disc(seconds, 0.95) FILTER (status = 'complete' AND attempts = 1), 6) AS p95 FROM runs GROUP BY variant""",
)
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as runs of an experiment, summarised by variant."""
    e = F.col("event_id")
    runs = _events(spark, sf_dir).select(
        F.col("user_id").alias("qid"), F.col("event_type").alias("variant"), (e % 3 + 1).alias("attempts"), F.when(e % 11 == 0, None).when(e % 4 == 0, "wrong").otherwise("correct").alias("grade"),
        F.when(e % 10 == 0, "failed").otherwise("complete").alias("status"), F.when(e % 13 != 0, e % 1000).alias("tokens"), F.col("value").alias("seconds"),
    )
    found = experiment.variant_summary(runs)
    return found.select(*[F.round(c, 6).alias(c) if c in ("p50", "p95") else c for c in found.columns])


@register("request_validation", "SELECT conv_id, turn, length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) BETWEEN 1 AND 500 AND role IN ('user', 'assistant') AS valid FROM conversations")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("profile"))
    return valid_requests(requests, ("user", "assistant")).select("conv_id", "turn", "valid")


@register(
    "order_status_rates",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, round(avg(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderstatus = 'F' AS INTEGER) END), 6) AS rate, round(median(o_totalprice), 4) AS median_price FROM orders GROUP BY o_orderpriority""",
)
def order_status_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as graded cases: pending ones are not graded."""
    graded = spread(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")).withColumn("passed", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))
    return graded.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.round(experiment.share_passed("passed"), 6).alias("rate"), F.round(experiment.interpolated_median("o_totalprice"), 4).alias("median_price"))

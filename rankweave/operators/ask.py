"""Answering a batch of requests: route by profile, retrieve, pack, generate, judge; and the bounds of a tool loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.operators import context, fusion
from rankweave.operators.generate import PROFILES, USAGE, Client, generate, public_answer, total_tokens
from rankweave.operators.retrieve import Ranker, retrieve, valid_requests
from rankweave.session import checkpointed

#: Limits of a tool loop for one question, and the argument each tool takes.
LIMITS = {"search": 3, "read": 2}
MODEL_CALLS, MOST_CHARS, SECONDS = 8, 500, 120
ARGUMENT = {"search": "query", "read": "chunk_id"}


def packed(hits: DataFrame, prompt: str, budget: int = context.BUDGET) -> DataFrame:
    """(qid, context, source_map) by the prompt's way of packing; labels of the baseline are page labels."""
    if prompt == "evidence":
        return context.evidence_context(hits, budget).select("qid", "context", "source_map")
    kept = context.prefix_within_budget(hits, budget=budget)
    entry = F.struct("rank", context.page_label(F.col("page"), F.col("path")).alias("label"), F.col("id").cast("string").alias("id"))
    labels = kept.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    # pages share labels, so the first hit of a label stands for it
    first = F.filter("e", lambda x, i: ~F.exists(F.slice("e", F.lit(1), i), lambda y: y["label"] == x["label"]))
    maps = labels.select("qid", F.map_from_arrays(F.transform(first, lambda x: x["label"]), F.transform(first, lambda x: x["id"])).alias("source_map"))
    return context.baseline_context(hits, budget).join(maps, "qid")


def answer(
    requests: DataFrame, corpus: DataFrame, dense: Ranker | None = None, lexical: Ranker | None = None, make_client: Callable[[], Client] | None = None,
    mode: str = "rrf", k: int = fusion.FINAL_K, retrieval_only: bool = False, profiles: Sequence[str] = tuple(PROFILES),
) -> DataFrame:
    """Requests (qid, question, profile) -> qid, question, profile, answer, status, sources, usage, total_tokens.

    ``corpus`` has id, page, path and text. Invalid requests are status ``invalid``; without hits it is ``no_evidence``,
    without a client ``not_configured``, and an evidence answer that cites an unknown label is withheld as
    ``citation_failed``. Only ``profiles`` are planned for. Sources stay whatever becomes of the answer; contexts and errors are not returned.
    """
    checked = valid_requests(requests, profiles)
    none = F.lit(None).cast("string")
    result = checked.where(~F.col("valid")).select("qid", "question", "profile", none.alias("answer"), F.lit("invalid").alias("status"), F.array().cast("array<struct<rank:int,id:string,in_context:boolean>>").alias("sources"), F.array().cast(USAGE).alias("usage"))
    for profile in profiles:
        strategy, prompt, _ = PROFILES[profile]
        own = checked.where(F.col("valid") & (F.col("profile") == profile)).select("qid", "question", "profile")
        hits = checkpointed(retrieve(own.select("qid", F.col("question").alias("text")), corpus, dense, lexical, mode, strategy, k))
        texts = packed(hits, prompt)
        known = hits.join(texts.select("qid", "source_map"), "qid", "left").withColumn("in_context", F.array_contains(F.map_values("source_map"), F.col("id").cast("string")))
        source = F.struct(F.col("rank").cast("int").alias("rank"), F.col("id").cast("string").alias("id"), F.coalesce("in_context", F.lit(False)).alias("in_context"))
        sources = known.groupBy("qid").agg(F.array_sort(F.collect_list(source)).alias("sources"))
        asked = own.join(texts, "qid", "left").join(sources, "qid", "left")
        found = asked.where("sources is not null")
        if retrieval_only or make_client is None:
            status = "retrieval_only" if retrieval_only else "not_configured"
            replied = found.select("*", none.alias("answer"), F.lit(status).alias("status"), F.array().cast(USAGE).alias("usage"))
        else:
            replied = generate(found, make_client, prompt == "evidence")
            if prompt == "evidence":
                replied = replied.withColumn("status", F.when((F.col("status") == "complete") & ~context.citations_known(F.col("answer"), F.col("source_map")), "citation_failed").otherwise(F.col("status")))
        nothing = asked.where("sources is null").select("*", none.alias("answer"), F.lit("no_evidence").alias("status"), F.array().cast(USAGE).alias("usage"))
        rows = replied.unionByName(nothing).withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<rank:int,id:string,in_context:boolean>>")))
        result = result.unionByName(rows.select(*result.columns))
    return public_answer(result.withColumn("total_tokens", total_tokens(F.col("usage"))))


def call_fault(tool: Column, arguments: Column, retrieved: Column) -> Column:
    """Why a tool call is not valid, else null: an unknown tool, not exactly its one argument, a blank or long one, or a read of what was not retrieved."""
    value = F.lit(None).cast("string")
    for name, key in ARGUMENT.items():
        value = F.when(tool == name, F.try_element_at(arguments, F.lit(key))).otherwise(value)
    return (
        F.when(~F.coalesce(tool, F.lit("")).isin(*ARGUMENT), "unknown_tool").when(value.isNull() | (F.size(arguments) != 1), "bad_arguments")
        .when(~F.length(F.trim(value)).between(1, MOST_CHARS), "bad_value").when((tool == "read") & ~F.array_contains(retrieved, value), "unknown_source")
    )


def admitted(calls: DataFrame) -> DataFrame:
    """Tool calls (qid, model_call, seq, tool) with ``admitted``: within the tool's limit and the limit of model calls, one by one even inside a batch."""
    so_far = F.row_number().over(Window.partitionBy("qid", "tool").orderBy("model_call", "seq"))
    most = F.lit(0)
    for tool, n in LIMITS.items():
        most = F.when(F.col("tool") == tool, n).otherwise(most)
    return calls.withColumn("admitted", (so_far <= most) & (F.col("model_call") <= MODEL_CALLS))


def loop_outcomes(calls: DataFrame) -> DataFrame:
    """(qid, status, stopped_at) of tool calls (qid, model_call, seq, tool, fault, seconds): what ended the loop first, and at which model call.

    Before each call: beyond SECONDS since the start it is ``timeout``, a call with a fault (:func:`call_fault`) is
    ``agent_failed``, one beyond a limit (:func:`admitted`) is ``limited``; a loop that meets none of these is ``complete``.
    """
    reason = F.when(F.col("seconds") > SECONDS, "timeout").when(F.col("fault").isNotNull(), "agent_failed").when(~F.col("admitted"), "limited")
    at = F.when(reason.isNotNull(), F.struct("model_call", "seq"))
    ended = admitted(calls).withColumns({"reason": reason, "at": at}).groupBy("qid").agg(F.min_by("reason", "at").alias("reason"), F.min("at").alias("at"))
    return ended.select("qid", F.coalesce("reason", F.lit("complete")).alias("status"), F.col("at.model_call").alias("stopped_at"))


def gathered(chunks: DataFrame) -> DataFrame:
    """Chunks (qid, seq, id, ...) as they came in, each id once, where it came first."""
    first = F.row_number().over(Window.partitionBy("qid", "id").orderBy("seq"))
    return chunks.withColumn("r", first).where("r = 1").drop("r")

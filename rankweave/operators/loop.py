"""A bounded tool loop for a table of questions at once: rounds over those still open, and the answers from what they gathered."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.operators import context
from rankweave.operators.ask import ARGUMENT, LIMITS, MODEL_CALLS, SECONDS, call_fault
from rankweave.operators.generate import Client, generate
from rankweave.operators.retrieve import Ranker
from rankweave.session import stored

#: Neighbours on each side that a read brings along.
REACH = 1


@dataclass(frozen=True)
class Move:
    """What a model wants next: tool calls (tool, arguments), or none when it has enough."""

    calls: list[tuple[str, dict[str, str]]] = field(default_factory=list)
    finish_reason: str | None = None
    seconds: float | None = None  # measured where it is not given


Mover = Callable[[str, list[str]], Move]

_CALLS = "array<struct<tool:string,arguments:map<string,string>>>"
_STATE = {
    "history": "array<string>", "ids": "array<string>", "pending": _CALLS, "model_calls": "int", **{f"{tool}s": "int" for tool in LIMITS}, "seconds": "double", "status": "string", "stop_reason": "string",
}


def _moved(make_mover: Callable[[], Mover]):
    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mover = make_mover()
        for batch in batches:
            rows = []
            for question, history in zip(batch["question"], batch["history"], strict=True):
                began = time.perf_counter()
                try:
                    own = mover(question or "", list(history))
                    calls, reason = [(tool, {str(k): str(v) for k, v in arguments.items()}) for tool, arguments in own.calls], own.finish_reason
                    seconds = own.seconds
                except Exception:  # whatever the injected model raises ends this question alone
                    calls, reason, seconds = [], "failed", None
                rows.append((calls, reason, time.perf_counter() - began if seconds is None else seconds))
            yield pd.DataFrame({"qid": batch["qid"], "calls": [r[0] for r in rows], "reason": [r[1] for r in rows], "took": [r[2] for r in rows]})

    return move


def _asked(state: DataFrame, make_mover: Callable[[], Mover]) -> DataFrame:
    """One model call for every open question without pending calls; what ends a question here is decided in order."""
    due = state.where("status is null and size(pending) = 0")
    kind = dict(state.dtypes)["qid"]
    # a question has one call at most at each number, so spent ones ask no more
    moves = due.where(F.col("model_calls") < MODEL_CALLS).select("qid", "question", "history").mapInPandas(_moved(make_mover), f"qid {kind}, calls {_CALLS}, reason string, took double")
    joined = state.join(moves, "qid", "left")
    here = F.col("status").isNull() & (F.size("pending") == 0)
    seconds = F.col("seconds") + F.coalesce("took", F.lit(0.0))
    ended = (
        F.when(F.col("calls").isNull(), F.lit("limited/model_call_budget")).when(seconds > SECONDS, "timeout/orchestration_timeout").when(F.col("reason") == "failed", "agent_failed/model_request_failed")
        .when(F.col("reason") == "length", "limited/model_output_limit").when((F.size("calls") == 0) & (F.size("ids") == 0), "no_evidence/no_sources").when(F.size("calls") == 0, "complete/evidence_ready")
    )
    values = {
        "pending": F.when(here & ended.isNull(), F.col("calls")).otherwise(F.col("pending")), "model_calls": F.col("model_calls") + F.col("calls").isNotNull().cast("int"), "seconds": seconds,
        "status": F.when(here, F.get(F.split(ended, "/"), F.lit(0))).otherwise(F.col("status")), "stop_reason": F.when(here, F.get(F.split(ended, "/"), F.lit(1))).otherwise(F.col("stop_reason")),
    }
    return joined.withColumns(values).select(*state.columns)


def _called(state: DataFrame, search: Ranker, corpus: DataFrame) -> DataFrame:
    """The first pending call of every open question: judged before it runs, searches of all questions as one batch."""
    first = F.get("pending", F.lit(0))
    due = F.col("status").isNull() & (F.size("pending") > 0)
    fault = call_fault(first["tool"], first["arguments"], F.col("ids"))
    spent = F.lit(False)
    for tool, most in LIMITS.items():
        spent = F.when(first["tool"] == tool, F.col(f"{tool}s") >= most).otherwise(spent)
    ended = F.when(fault.isNotNull(), "agent_failed/invalid_tool_call").when(spent, "limited/tool_budget")
    judged = state.withColumns({"ended": F.when(due, ended), "tool": F.when(due & ended.isNull(), first["tool"])})
    for tool, key in ARGUMENT.items():
        judged = judged.withColumn(key, F.when(F.col("tool") == tool, F.try_element_at(first["arguments"], F.lit(key))))
    judged = stored(judged, "judged")
    rows = corpus.select(F.col("id").cast("string").alias("id"), "pos", "page", "path", "text")
    wanted = judged.where("tool = 'search'").select("qid", F.col("query").alias("text"))
    none = rows.limit(0).selectExpr("id qid", "pos rank", "id").select(F.lit(None).cast(dict(state.dtypes)["qid"]).alias("qid"), "rank", "id")
    hits = none if wanted.isEmpty() else search(wanted).select("qid", "rank", F.col("id").cast("string").alias("id"))
    anchors = judged.where("tool = 'read'").select("qid", F.col("chunk_id").alias("id")).join(rows.select("id", "pos"), "id")
    near = anchors.select("qid", F.explode(F.sequence(F.col("pos") - REACH, F.col("pos") + REACH)).alias("pos")).join(rows.select("pos", "id"), "pos").select("qid", F.col("pos").alias("rank"), "id")
    found = hits.select("qid", F.col("rank").cast("long").alias("rank"), "id").unionByName(near.select("qid", F.col("rank").cast("long").alias("rank"), "id"))
    found = found.join(rows, "id")
    listed = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("new_ids"))
    replies = context.evidence_context(found).select("qid", F.to_json(F.struct("context", F.map_values("source_map").alias("ids"), "omitted")).alias("reply"))
    joined = judged.join(listed, "qid", "left").join(replies, "qid", "left")
    ran = F.col("tool").isNotNull()
    values = {
        "ids": F.when(ran, F.array_distinct(F.concat("ids", F.coalesce("new_ids", F.array().cast("array<string>"))))).otherwise(F.col("ids")),
        "history": F.when(ran, F.array_append("history", F.coalesce("reply", F.lit("{}")))).otherwise(F.col("history")),
        "pending": F.when(ran, F.slice("pending", F.lit(2), F.greatest(F.size("pending") - 1, F.lit(0)))).otherwise(F.col("pending")),
        "status": F.coalesce("status", F.get(F.split("ended", "/"), F.lit(0))), "stop_reason": F.coalesce("stop_reason", F.get(F.split("ended", "/"), F.lit(1))),
        **{f"{tool}s": F.col(f"{tool}s") + F.coalesce(F.col("tool") == tool, F.lit(False)).cast("int") for tool in LIMITS},
    }
    return joined.withColumns(values).select(*state.columns)


def tool_loop(questions: DataFrame, search: Ranker, corpus: DataFrame, make_mover: Callable[[], Mover]) -> DataFrame:
    """Questions (qid, question) -> qid, question, status, stop_reason, model_calls, searchs, reads, seconds, ids, history.

    Each round gives every open question without pending calls one model call, and every one with pending calls its next tool
    call: at most MODEL_CALLS and the LIMITS of the tools, so the rounds are bounded whatever the number of questions. A call is
    judged before it runs, also inside one batch: a fault, a spent limit or a time beyond SECONDS ends its question and no
    other. Searches of a round are one batch for ``search`` (qid, text) -> (qid, rank, id). A read brings the rows at most REACH
    ``pos`` away; ``corpus`` has id, pos (whole numbers without gaps), page, path and text. ``ids`` are gathered in order, each
    once. ``history`` holds the replies as JSON: the packed context, its ids and those left out for its budget. qid is unique and not null.
    """
    state = questions.select("qid", "question", *[(F.array() if t.startswith("array") else F.lit(0) if n in ("model_calls", "searchs", "reads", "seconds") else F.lit(None)).cast(t).alias(n) for n, t in _STATE.items()])
    state = stored(state, "open")
    done = None
    for _ in range(MODEL_CALLS + sum(LIMITS.values()) + 1):
        after = stored(_called(stored(_asked(state, make_mover), "asked"), search, corpus), "open")
        closed = after.where("status is not null")
        done = closed if done is None else done.unionByName(closed)
        state = after.where("status is null")
        if state.isEmpty():
            break
    return done.unionByName(state.withColumns({"status": F.lit("limited"), "stop_reason": F.lit("rounds")})).drop("pending")


def synthesized(loops: DataFrame, corpus: DataFrame, make_client: Callable[[], Client], budget: int = context.BUDGET) -> DataFrame:
    """Answers from what :func:`tool_loop` gathered: qid, status, answer, usage, gathered, in_context.

    The chunks are packed in the order they came in. Questions that gathered something and ended complete or limited are
    answered; a reply that cites an unknown label is withheld as ``citation_failed``; the others keep the status of their loop.
    """
    rows = corpus.select(F.col("id").cast("string").alias("id"), "page", "path", "text")
    able = loops.where(F.col("status").isin("complete", "limited") & (F.size("ids") > 0))
    hits = able.select("qid", F.posexplode("ids").alias("rank", "id")).join(rows, "id")
    packed = able.select("qid", "question", F.col("ids").alias("gathered")).join(context.evidence_context(hits, budget), "qid")
    replied = generate(packed, make_client)
    status = F.when((F.col("status") == "complete") & ~context.citations_known(F.col("answer"), F.col("source_map")), "citation_failed").otherwise(F.col("status"))
    shown = replied.withColumn("status", status)
    shown = shown.select("qid", "status", F.when(F.col("status") == "complete", F.col("answer")).alias("answer"), "usage", "gathered", F.map_values("source_map").alias("in_context"))
    others = loops.join(able.select("qid"), "qid", "left_anti")
    kept = others.select("qid", "status", F.lit(None).cast("string").alias("answer"), F.array().cast(dict(shown.dtypes)["usage"]).alias("usage"), F.col("ids").alias("gathered"), F.array().cast("array<string>").alias("in_context"))
    return shown.unionByName(kept)

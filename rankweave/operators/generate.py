"""Answer generation behind an injected client: attempts, usage, statuses. No model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.session import stored

FIRST_TOKENS, MOST_TOKENS, ATTEMPTS = 2048, 8192, 3
#: HTTP statuses after which no further attempt is made.
FATAL = (400, 401, 402, 403, 404, 429)
#: Strategy, prompt and thinking of each profile.
PROFILES: dict[str, tuple[str, str, str]] = {
    "baseline": ("baseline", "baseline", "default"),
    "quality": ("guarded", "evidence", "low"),
    "fast": ("guarded", "evidence", "disabled"),
    "agent": ("guarded", "evidence", "low"),
}


class Client(Protocol):
    def __call__(self, context: str, question: str, max_tokens: int) -> Reply: ...


@dataclass(frozen=True)
class Reply:
    text: str | None
    finish_reason: str | None = None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    status_code: int | None = None
    error: str | None = None


USAGE = "array<struct<attempt:int,max_tokens:int,prompt_tokens:bigint,completion_tokens:bigint,finish_reason:string,error:string,status_code:int>>"


def attempt(client: Client, context: str, question: str, evidence: bool = True) -> tuple[str | None, str, list[tuple]]:
    """(answer, status, usage) after up to ATTEMPTS replies with doubled budgets.

    An empty or cut reply is tried again, and so is a client that raises: its error and its status code, if it has one,
    are kept in the usage. The last cut reply counts only outside evidence mode. Unknown usage stays null.
    """
    usage, best = [], None
    for n in range(ATTEMPTS):
        budget = min(FIRST_TOKENS << n, MOST_TOKENS)
        try:
            reply = client(context, question, budget)
        except Exception as fault:  # whatever the injected client raises is an attempt that failed
            code = getattr(fault, "status_code", None)
            reply = Reply(None, error=f"{type(fault).__name__}: {fault}"[:500], status_code=code if isinstance(code, int) else None)
        usage.append((n + 1, budget, reply.prompt_tokens, reply.completion_tokens, reply.finish_reason, reply.error, reply.status_code))
        if reply.status_code in FATAL:
            return None, "generation_failed", usage
        text = (reply.text or "").strip()
        if text and reply.finish_reason != "length":
            return text, "complete", usage
        best = text or best
    if best and not evidence:
        return best, "truncated", usage
    return None, "truncated" if best else "generation_failed", usage


def generate(asked: DataFrame, make_client: Callable[[], Client], evidence: bool = True) -> DataFrame:
    """Adds answer, status and usage to rows with question and context; a client is made once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            found = [attempt(client, c or "", q or "", evidence) for c, q in zip(batch["context"], batch["question"], strict=True)]
            yield batch.assign(answer=[f[0] for f in found], status=[f[1] for f in found], usage=[f[2] for f in found])

    fields = ", ".join(f"`{n}` {t}" for n, t in asked.dtypes)
    return asked.mapInPandas(run, f"{fields}, answer string, status string, usage {USAGE}")


#: Rounds for items whose reply is not valid, and the sampling temperature of each.
TEMPERATURES = (0.0, 0.3, 0.7, 1.0)


def residual_rounds(items: DataFrame, make_asker: Callable[[], Callable[[str, float], str | None]], valid: Callable[[Column, Column], Column], temperatures: Sequence[float] = TEMPERATURES) -> DataFrame:
    """Items (qid, prompt) -> qid, status, round, reply: each is asked until its reply is valid, in as many rounds as there are ``temperatures``.

    A round asks all open items as one table; ``valid`` (prompt, reply) decides which replies are accepted, a null counting as
    no, and accepted items are never asked again. What is left is ``exhausted``, with its last reply. An asker (prompt,
    temperature) that raises gives no reply. qid is unique.
    """
    open_items, done = items.select("qid", "prompt"), None
    fields = ", ".join(f"`{n}` {t}" for n, t in open_items.dtypes)
    for number, temperature in enumerate(temperatures, 1):

        def ask(batches: Iterator[pd.DataFrame], temperature: float = temperature) -> Iterator[pd.DataFrame]:
            asker = make_asker()
            for batch in batches:
                replies = []
                for prompt in batch["prompt"]:
                    try:
                        replies.append(asker(prompt or "", temperature))
                    except Exception:  # whatever the injected model raises is no reply
                        replies.append(None)
                yield batch.assign(reply=pd.Series(replies, index=batch.index, dtype=object))

        asked = open_items.mapInPandas(ask, f"{fields}, reply string")
        judged = stored(asked.withColumn("accepted", F.coalesce(valid(F.col("prompt"), F.col("reply")), F.lit(False))), "round")
        last = number == len(temperatures)
        closed = judged.where("accepted") if not last else judged
        closed = closed.select("qid", F.when(F.col("accepted"), "accepted").otherwise("exhausted").alias("status"), F.lit(number).alias("round"), "reply")
        done = closed if done is None else done.unionByName(closed)
        open_items = judged.where("not accepted").select("qid", "prompt")
        if not last and open_items.isEmpty():
            break
    return done


def total_tokens(usage: Column) -> Column:
    """Prompt and completion tokens of all attempts; null if any is unknown."""
    each = F.transform(usage, lambda u: u["prompt_tokens"] + u["completion_tokens"])
    return F.when((F.size(each) > 0) & ~F.exists(each, lambda x: x.isNull()), F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x))


def final_status(status: Column, ready: Column, n_sources: Column, labels_ok: Column) -> Column:
    """The status shown: without a key or sources nothing is generated; an unknown citation withholds the answer."""
    return F.when(n_sources == 0, "no_evidence").when(~ready, "retrieval_only").when((status == "complete") & ~labels_ok, "citation_failed").otherwise(status)


def public_answer(rows: DataFrame) -> DataFrame:
    """What a caller may see: no context, source map or error texts, and no answer unless it is complete."""
    hidden = [c for c in ("context", "source_map", "error") if c in rows.columns]
    shown = rows.drop(*hidden).withColumn("answer", F.when(F.col("status").isin("complete", "truncated"), F.col("answer")))
    return shown.withColumn("usage", F.transform("usage", lambda u: u.dropFields("error"))) if "usage" in rows.columns else shown


def profile_of(profile: Column) -> Column:
    """struct(strategy, prompt, thinking) of a profile; null for an unknown one."""
    out = F.lit(None).cast("struct<strategy:string,prompt:string,thinking:string>")
    for name, (strategy, prompt, thinking) in PROFILES.items():
        out = F.when(profile == name, F.struct(F.lit(strategy).alias("strategy"), F.lit(prompt).alias("prompt"), F.lit(thinking).alias("thinking"))).otherwise(out)
    return out


def api_ready(key: str | None, base_url: str | None) -> bool:
    return bool((key or "").strip() and (base_url or "").strip())

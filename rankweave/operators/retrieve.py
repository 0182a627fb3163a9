"""Whole retrieval of a batch of queries: channels, modes, strategies, selection, hits, and row neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.functions.text import strip
from rankweave.operators import fusion
from rankweave.operators.lexical import LexicalIndex, bm25_rank
from rankweave.session import checkpointed

Ranker = Callable[[DataFrame], DataFrame]


def channels(mode: str, dense: Ranker | None, lexical: Ranker | None) -> list[tuple[str, int, Ranker]]:
    """The channels of a mode with their order; a channel that is not asked for is never built."""
    if mode not in fusion.MODES:
        raise ValueError(f"mode must be one of {fusion.MODES}, not {mode!r}")
    wanted = {"rrf": ("dense", "bm25"), "dense": ("dense",), "bm25": ("bm25",)}[mode]
    own = {"dense": (0, dense), "bm25": (1, lexical)}
    return [(name, own[name][0], own[name][1]) for name in wanted if own[name][1] is not None]


def lexical_ranker(index: LexicalIndex, k: int | None = 20) -> Ranker:
    return lambda queries: bm25_rank(index, queries, k).select("qid", "id", "rank")


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    dense: Ranker | None = None,
    lexical: Ranker | None = None,
    mode: str = "rrf",
    strategy: str = "baseline",
    k: int = fusion.FINAL_K,
    rules: Sequence[fusion.Rule] = fusion.RULES,
) -> DataFrame:
    """Hits of every query (qid, text): qid, rank, id, rrf, dense_rank, bm25_rank, queries, candidate_count, mode, strategy and the corpus columns.

    A ranker takes (qid, text) and gives (qid, id, rank). Blank queries have no hits. ``baseline`` and ``expanded`` take the
    fused order; ``coverage`` and ``guarded`` select evidence by facet. The ranks of a channel are those of the query
    itself, null where only an added query found the id.
    """
    asked = queries.select("qid", fusion.query_list(F.col("text"), strategy, rules).alias("queries")).where(F.size("queries") > 0)
    single = asked.select("qid", F.posexplode("queries").alias("query_no", "text"))
    numbered = single.select(F.struct("qid", "query_no").alias("qid"), "text")
    ranks = None
    for name, number, ranker in channels(mode, dense, lexical):
        own = ranker(numbered).select("qid.qid", "qid.query_no", F.lit(name).alias("channel"), (F.col("qid.query_no") * 2 + number).alias("channel_no"), "id", "rank")
        ranks = own if ranks is None else ranks.unionByName(own)
    if ranks is None:
        raise ValueError(f"mode {mode!r} needs a ranker")
    ranks = checkpointed(ranks)  # a few dozen rows for each query, read several times from here on
    fused = fusion.fuse(ranks)
    counted = fused.withColumn("candidate_count", F.count("*").over(Window.partitionBy("qid")))
    if strategy in ("coverage", "guarded"):
        picked = fusion.select_evidence(fused, fusion.facet_orders(ranks, strategy == "guarded"), k)
        top = counted.join(picked, ["qid", "id"]).withColumnRenamed("pick", "place")
    else:
        top = counted.where(F.col("fused_rank") <= max(1, k)).withColumn("place", F.col("fused_rank"))
    own = ranks.where("query_no = 0").groupBy("qid", "id").agg(*[F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank") for c in ("dense", "bm25")])
    found = top.join(own, ["qid", "id"], "left").join(asked, "qid").join(corpus, "id")
    fixed = ["qid", F.col("place").alias("rank"), "id", F.round("rrf", 6).alias("rrf"), "dense_rank", "bm25_rank", "queries", "candidate_count", F.lit(mode).alias("mode"), F.lit(strategy).alias("strategy")]
    return found.select(*fixed, *[c for c in corpus.columns if c != "id"])


def clamp(k: int, n: int) -> int:
    return max(1, min(k, n))


def smoke_check(hits: DataFrame, expected: DataFrame, top: int = 3) -> DataFrame:
    """(qid, passed): any keyword of ``expected`` (qid, keywords) in the text of the first hits."""
    text = hits.where(F.col("rank") <= top).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("seen"))
    return expected.join(text, "qid", "left").select("qid", F.exists("keywords", lambda w: F.contains(F.coalesce("seen", F.lit("")), w)).alias("passed"))


def neighbours(rows: DataFrame, anchors: DataFrame, group: Sequence[str] = (), pos: str = "pos", reach: int = 1) -> DataFrame:
    """For every anchor (*group, pos) the rows at most ``reach`` places away in order, as (*group, anchor, pos, ...).

    Places are numbered 1, 2, ... in a group, so this is an equi-join on the place after each anchor is copied to its
    2 * reach + 1 places; places beyond the ends find nothing.
    """
    order = Window.partitionBy(*group).orderBy(pos)
    placed = rows.withColumn("place", F.row_number().over(order))
    named = anchors.select(*group, F.col(pos).alias("anchor"))
    at = placed.join(named, [*[placed[g] == named[g] for g in group], placed[pos] == named["anchor"]]).select(*[placed[g] for g in group], "anchor", F.explode(F.sequence(F.col("place") - reach, F.col("place") + reach)).alias("place"))
    return at.join(placed, [*group, "place"]).drop("place")


def hit_preview(text, most: int = 150):
    """The first characters on one line, with an ellipsis where there are more."""
    line = F.regexp_replace(F.substring(text, 1, most), "\n", " ")
    return F.when(F.length(text) > most, F.concat(line, F.lit("…"))).otherwise(line)


def valid_requests(requests: DataFrame, profiles: Sequence[str] = ("baseline", "quality", "fast", "agent"), most: int = 500) -> DataFrame:
    """Requests (question, profile) with the question stripped and ``valid``: 1 to ``most`` characters and a known profile."""
    clean = requests.withColumn("question", strip(F.col("question")))
    return clean.withColumn("valid", F.coalesce(F.length("question").between(1, most) & F.col("profile").isin(*profiles), F.lit(False)))

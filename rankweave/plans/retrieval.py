"""Queries that rank, fuse, select, pack and measure."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import ask, cells, context, dense, fusion, generate, loop, metrics, perturb
from rankweave.operators.lexical import LexicalIndex, bm25_rank, build_index
from rankweave.operators.retrieve import lexical_ranker, neighbours, retrieve
from rankweave.operators.substrings import holding
from rankweave.plans.registry import ORACLE_SQL, register
from rankweave.session import stored
from rankweave.sources.tables import spread, table

KS = (1, 3, 5, 8, 20)

# ---------------------------------------------------------------- pieces of SQL


def _bm25_sql(queries: str, k: int = 20) -> str:
    """Ranks of ``queries`` (qid, text) over documents, as ranked(qid, id, score, rank)."""
    cut = lambda c: rf"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"""
  words AS (SELECT doc_id, unnest({cut("text")}) AS term FROM documents),
  lengths AS (SELECT doc_id, len({cut("text")}) AS length FROM documents),
  postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
  raw AS (SELECT term, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM postings GROUP BY term),
  weights AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  queries AS ({queries}),
  asked AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({cut("text")}) AS term FROM queries) GROUP BY ALL),
  scored AS (
    SELECT qid, doc_id AS id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / (SELECT avg(length) FROM lengths)))), 6) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
  ranked AS (SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


_ITEMS = "SELECT item_id AS qid, text FROM benchmark"
_GOLD = "gold AS (SELECT DISTINCT item_id AS qid, doc_id AS id FROM benchmark, documents WHERE contains(documents.text, benchmark.text))"


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
_NEAR = "-list_sum(list_transform(generate_series(1, len(q.embedding)), lambda i: abs(CAST(q.embedding[i] AS DOUBLE) - CAST(v.embedding[i] AS DOUBLE))))"


def _dense_sql(score: str = _DOT) -> str:
    """(qid, id, score) of all vectors with every hundredth."""
    return f"SELECT q.vec_id AS qid, v.vec_id AS id, round({score}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0"


def _top_sql(scores: str, k: int = 20) -> str:
    return f"SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({scores})) WHERE rank <= {k}"


def _fused_sql() -> str:
    return f"""
  one AS ({_top_sql(_dense_sql())}), two AS ({_top_sql(_dense_sql(_NEAR))}),
  ranks AS (SELECT qid, 0 AS channel_no, id, rank FROM one UNION ALL SELECT qid, 1, id, rank FROM two),
  scores AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(channel_no * 1000 + rank) AS first FROM ranks GROUP BY ALL),
  fused AS (SELECT qid, id, rrf, CAST(row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first) AS INTEGER) AS fused_rank FROM scores)"""


# ---------------------------------------------------------------- pieces of plans


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text", "lang")


#: The last index built: by the application and the files it came from.
_BUILT: dict[tuple[str, ...], LexicalIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The index of the documents, built once for all queries of an application over the same files."""
    docs = _documents(spark, sf_dir).select("id", "pos", "text")
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build_index(docs)
    return _BUILT[key]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item whole."""
    items = _items(spark, sf_dir).withColumnsRenamed({"qid": "term_id", "text": "term"})
    return stored(holding(_documents(spark, sf_dir), items).select(F.col("term_id").alias("qid"), "id").distinct(), "gold")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return vectors.select(F.col("vec_id").alias("id"), "embedding"), vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _two_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by the dot product and by the sum of differences."""
    one = dense.dense_rank(*_vectors(spark, sf_dir)).select("qid", F.lit(0).alias("channel_no"), "id", "rank")
    two = dense.dense_rank(*_vectors(spark, sf_dir), score=dense.nearness).select("qid", F.lit(1).alias("channel_no"), "id", "rank")
    return one.unionByName(two)


def _judgements(spark: SparkSession, sf_dir: str, gold: DataFrame) -> DataFrame:
    """Ranks of all items, judged; those that no document holds have nothing to find."""
    return metrics.judged(bm25_rank(_index(spark, sf_dir), _items(spark, sf_dir)), gold)


# ---------------------------------------------------------------- queries


@register("bm25_topk", f"WITH {_bm25_sql('SELECT item_id AS qid, text FROM benchmark')} SELECT qid, id, score, rank FROM ranked")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_rank(_index(spark, sf_dir), _items(spark, sf_dir))


@register("dense_topk", _top_sql(_dense_sql()))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_rank(*_vectors(spark, sf_dir))


@register("cell_topk", _top_sql(_dense_sql()))
def cell_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over cells, of which only those are scored that can hold a rank."""
    vectors, asked = _vectors(spark, sf_dir)
    return cells.cell_rank(cells.build_cells(vectors), asked)[0]


@register("rrf_fusion", f"WITH {_fused_sql()} SELECT qid, id, round(rrf, 6) AS rrf, fused_rank FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse(_two_channels(spark, sf_dir))
    return fused.select("qid", "id", F.round("rrf", 6).alias("rrf"), "fused_rank")


@register(
    "evidence_selection",
    f"""WITH {_fused_sql()},
  s0 AS (SELECT qid, id, rank AS o, 0 AS stage FROM one WHERE rank <= 3),
  s1 AS (SELECT qid, id, o, 1 AS stage FROM (SELECT t.qid, t.id, t.rank AS o, row_number() OVER (PARTITION BY t.qid ORDER BY t.rank) AS r FROM two t ANTI JOIN s0 USING (qid, id)) WHERE r <= 2),
  s2 AS (SELECT f.qid, f.id, f.fused_rank AS o, 2 AS stage FROM fused f ANTI JOIN s0 USING (qid, id) ANTI JOIN s1 USING (qid, id)),
  whole AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)
SELECT qid, id, CAST(pick AS INTEGER) AS pick FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY stage, o) AS pick FROM whole) WHERE pick <= 8""",
)
def evidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = stored(_two_channels(spark, sf_dir), "ranks")  # a few dozen rows for each query, read twice
    facets = ranks.select("qid", F.col("channel_no").alias("query_no"), "id", F.col("rank").alias("facet_rank"))
    return fusion.select_evidence(fusion.fuse(ranks), facets)


_GAIN = "(SELECT sum(1 / log2(i + 1)) FROM generate_series(1, least(n_gold, k)) t(i))"
_METRICS = f"""WITH {_bm25_sql(_ITEMS)}, {_GOLD},
  sizes AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid),
  grid AS (SELECT qid, n_gold, k FROM sizes, (VALUES (1), (3), (5), (8), (20)) t(k)),
  found AS (SELECT qid, rank FROM ranked SEMI JOIN gold USING (qid, id)),
  per AS (
    SELECT g.qid, g.k, n_gold, count(*) FILTER (rank <= k) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k), 0) AS gain, coalesce(1.0 / min(rank), 0) AS rr
    FROM grid g LEFT JOIN found f ON f.qid = g.qid GROUP BY ALL),
  each AS (SELECT qid, k, CAST(hits > 0 AS INTEGER) AS hit, hits / n_gold AS recall, hits / k AS precision, gain / {_GAIN} AS ndcg, rr FROM per)"""
_MEANS = "count(*) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr"


@register("ir_metrics_at_k", f"{_METRICS} SELECT CAST(k AS INTEGER) AS k, {_MEANS} FROM each GROUP BY k")
def ir_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(metrics.per_query(_judgements(spark, sf_dir, _gold(spark, sf_dir)), KS))


@register("ir_metrics_by_slice", f"{_METRICS}, slices AS (SELECT qid, min(lang) AS slice FROM gold JOIN documents ON id = doc_id GROUP BY qid) SELECT slice, CAST(k AS INTEGER) AS k, {_MEANS} FROM each JOIN slices USING (qid) GROUP BY slice, k")
def ir_metrics_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    slices = gold.join(_documents(spark, sf_dir).select("id", "lang"), "id").groupBy("qid").agg(F.min("lang").alias("slice"))
    return metrics.summary(metrics.per_query(_judgements(spark, sf_dir, gold), KS).join(slices, "qid"), ["slice"])


@register("retrieval_failures", f"WITH {_bm25_sql(_ITEMS)}, {_GOLD} SELECT qid, CAST(min(rank) AS INTEGER) AS first_rank FROM (SELECT DISTINCT qid FROM gold) LEFT JOIN (SELECT qid, rank FROM ranked SEMI JOIN gold USING (qid, id)) USING (qid) GROUP BY qid HAVING coalesce(min(rank), 99) > 1")
def retrieval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose documents are not found first."""
    return metrics.failures(_judgements(spark, sf_dir, _gold(spark, sf_dir)), k=1)


_VARIANTS = r"""
  SELECT item_id, 'orig' AS variant, text FROM benchmark UNION ALL
  SELECT item_id, 'punct_strip', regexp_replace(text, '[？?！!，,。.、；;：:（）()]', '', 'g') FROM benchmark UNION ALL
  SELECT item_id, 'spacey', regexp_replace(text, '([0-9])([^0-9\s])', '\1 \2', 'g') FROM benchmark UNION ALL
  SELECT item_id, 'fullwidth_digit', translate(text, '0123456789', '０１２３４５６７８９') FROM benchmark UNION ALL
  SELECT item_id, 'polite', 'please tell me, ' || text FROM benchmark UNION ALL
  SELECT item_id, 'typo_drop', regexp_replace(text, '(?s)^((?:.*?[A-Za-z]){2}.*?)[A-Za-z]', '\1') FROM benchmark WHERE len(regexp_extract_all(text, '[A-Za-z]')) > 4 UNION ALL
  SELECT item_id, 'truncated', substr(text, 1, greatest(4, length(text) // 2)) FROM benchmark"""
_FRAME = {"polite": "please tell me, {q}"}


@register("query_variants", f"SELECT item_id AS qid, variant, text FROM ({_VARIANTS})")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.explode_variants(_items(spark, sf_dir), "[A-Za-z]", _FRAME)


@register(
    "variant_recall",
    f"""WITH {_bm25_sql(f"SELECT item_id || ' ' || variant AS qid, text FROM ({_VARIANTS})", 5)}, {_GOLD},
  judged AS (SELECT v.item_id, variant, id, rank FROM ({_VARIANTS}) v SEMI JOIN (SELECT qid AS item_id FROM gold) USING (item_id) LEFT JOIN ranked ON ranked.qid = v.item_id || ' ' || variant AND EXISTS (FROM gold g WHERE g.qid = v.item_id AND g.id = ranked.id)),
  per AS (SELECT item_id, variant, count(id) AS hits, coalesce(1.0 / min(rank), 0) AS rr FROM judged GROUP BY ALL)
SELECT variant, count(*) AS n, round(avg(hits / n_gold), 6) AS recall, round(avg(rr), 6) AS mrr FROM per JOIN (SELECT qid AS item_id, count(*) AS n_gold FROM gold GROUP BY qid) USING (item_id) GROUP BY variant""",
)
def variant_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = perturb.explode_variants(_items(spark, sf_dir), "[A-Za-z]", _FRAME)
    gold = _gold(spark, sf_dir)
    hits = bm25_rank(_index(spark, sf_dir), asked.select(F.struct("qid", "variant").alias("qid"), "text"), 5)
    wanted = asked.select("qid", "variant").join(gold, "qid").select(F.struct("qid", "variant").alias("qid"), "id")
    per = metrics.per_query(metrics.judged(hits, wanted), (5,), 5)
    return per.groupBy("qid.variant").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))


@register(
    "adjacent_turns",
    """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT a.conv_id, a.turn AS anchor, b.turn, b.role, length(b.text) AS chars FROM placed a JOIN placed b ON a.conv_id = b.conv_id AND b.place BETWEEN a.place - 1 AND a.place + 1 WHERE a.role = 'assistant'""",
)
def adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    near = neighbours(turns, turns.where("role = 'assistant'"), ("conv_id",), "turn")
    return near.select("conv_id", "anchor", "turn", "role", F.length("text").cast("long").alias("chars"))


@register(
    "context_prefix_budget",
    "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 1500",
)
def context_prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return context.prefix_within_budget(turns, ("conv_id",), "turn", budget=1500).select("conv_id", "turn", "used")


@register(
    "context_greedy_budget",
    """WITH RECURSIVE placed AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
  walk AS (
    SELECT conv_id, 0 AS place, 0 AS used, CAST([] AS BIGINT[]) AS kept FROM placed GROUP BY conv_id
    UNION ALL
    SELECT w.conv_id, p.place, CASE WHEN w.used + cost <= 1500 THEN w.used + cost ELSE w.used END, CASE WHEN w.used + cost <= 1500 THEN list_append(w.kept, p.turn) ELSE w.kept END
    FROM walk w JOIN placed p ON p.conv_id = w.conv_id AND p.place = w.place + 1,
      LATERAL (SELECT length('〔source' || (len(w.kept) + 1) || '〕') + 1 + length(p.text) + CASE WHEN len(w.kept) > 0 THEN 2 ELSE 0 END AS cost))
SELECT conv_id, CAST(used AS BIGINT) AS used, array_to_string(kept, ',') AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS r FROM walk) WHERE r = 1""",
)
def context_greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("turn", F.col("turn").cast("string").alias("id"), F.lit("").alias("head"), "text")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    packed = turns.select("conv_id", context.greedy(F.transform("items", lambda x: F.struct(x["id"], x["head"], x["text"])), 1500, "source").alias("c"))
    return packed.select("conv_id", F.col("c.used").cast("long").alias("used"), F.array_join("c.ids", ",").alias("kept"))


# ---------------------------------------------------------------- whole retrieval by strategy

#: Terms of the made-up texts that stand for the topics of questions.
_RULES = (fusion.Rule((("the",), ("ing", "ion")), ("thend andon", "erand thes")), fusion.Rule((("de",),), ("enein una",), prepend=True), fusion.Rule((("er",),), ("lich ein",), unless=("und", ("onat for",))))
_QUESTIONS = """SELECT item_id * 10 + i - 1 AS qid, qs[i] AS text FROM (
    SELECT item_id, list_concat([trim(text)], list_concat(list_concat(CASE WHEN contains(text, 'de') THEN ['enein una'] ELSE [] END, CASE WHEN contains(text, 'the') AND (contains(text, 'ing') OR contains(text, 'ion')) THEN ['thend andon', 'erand thes'] ELSE [] END),
      CASE WHEN NOT contains(text, 'er') THEN [] WHEN contains(text, 'und') THEN ['onat for'] ELSE ['lich ein'] END))[1:3] AS qs FROM benchmark), unnest(generate_series(1, len(qs))) t(i)"""
_RETRIEVED = f"""WITH {_bm25_sql(_QUESTIONS)},
  sums AS (SELECT qid // 10 AS qid, id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min((qid % 10 * 2 + 1) * 1000 + rank) AS first, min(rank) FILTER (qid % 10 = 0) AS bm25_rank, max(qid % 10) AS last_query FROM ranked GROUP BY qid // 10, id),
  fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first) AS fused_rank, count(*) OVER (PARTITION BY qid) AS candidate_count FROM sums)"""
_SHOWN = "id, round(rrf, 6) AS rrf, bm25_rank, candidate_count"


def _retrieved(spark: SparkSession, sf_dir: str, strategy: str, asked: DataFrame | None = None) -> DataFrame:
    corpus = _documents(spark, sf_dir).select("id", "pos", "text")
    lexical = lexical_ranker(_index(spark, sf_dir))
    hits = retrieve(asked if asked is not None else _items(spark, sf_dir), corpus.select("id"), lexical=lexical, mode="bm25", strategy=strategy, rules=_RULES)
    return hits.select("qid", F.col("rank").cast("int").alias("rank"), "id", "rrf", "bm25_rank", "candidate_count")


@register("retrieval_expanded", f"{_RETRIEVED} SELECT qid, CAST(fused_rank AS INTEGER) AS rank, {_SHOWN} FROM fused WHERE fused_rank <= 8")
def retrieval_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the facets of the rules they meet, ranked each and fused."""
    return _retrieved(spark, sf_dir, "expanded")


@register(
    "retrieval_guarded",
    f"""{_RETRIEVED},
  many AS (SELECT qid // 10 AS qid FROM ({_QUESTIONS}) GROUP BY qid // 10 HAVING count(*) > 1),
  s0 AS (SELECT qid // 10 AS qid, id, rank AS o, 0 AS stage FROM ranked WHERE qid % 10 = 0 AND rank <= 3 AND qid // 10 IN (FROM many)),
  s1 AS (SELECT qid, id, o, 1 AS stage FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS r FROM (SELECT qid // 10 AS qid, id, rank AS o FROM ranked WHERE qid % 10 = 1) t ANTI JOIN s0 USING (qid, id)) WHERE r <= 2),
  s2 AS (SELECT qid, id, o, 2 AS stage FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS r FROM (SELECT qid // 10 AS qid, id, rank AS o FROM ranked WHERE qid % 10 = 2) t ANTI JOIN s0 USING (qid, id) ANTI JOIN s1 USING (qid, id)) WHERE r <= 2),
  s3 AS (SELECT qid, id, fused_rank AS o, 3 AS stage FROM fused ANTI JOIN s0 USING (qid, id) ANTI JOIN s1 USING (qid, id) ANTI JOIN s2 USING (qid, id)),
  picked AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY stage, o) AS INTEGER) AS rank FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2 UNION ALL FROM s3))
SELECT qid, rank, {_SHOWN} FROM picked JOIN fused USING (qid, id) WHERE rank <= 8""",
)
def retrieval_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with places kept for the facets."""
    return _retrieved(spark, sf_dir, "guarded")


_GUARDED = ORACLE_SQL["retrieval_guarded"]


@register("retrieval_coverage", _GUARDED)
def retrieval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by facets alone, which is no other order with one channel; and blank questions, which have no hits."""
    blank = _items(spark, sf_dir).select((F.col("qid") + 1_000_000).alias("qid"), F.lit(" \t").alias("text"))
    return _retrieved(spark, sf_dir, "coverage", _items(spark, sf_dir).unionByName(blank))


def _by_mode_sql(dense_channel: bool, lexical_channel: bool) -> str:
    channels = (["SELECT qid, 0 AS channel_no, id, rank FROM near"] if dense_channel else []) + (["SELECT qid, 1, id, rank FROM ranked"] if lexical_channel else [])
    near = _top_sql(_dense_sql().replace("q.vec_id % 100 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)"))
    return f"""WITH {_bm25_sql(_ITEMS)}, near AS ({near}), ranks(qid, channel_no, id, rank) AS ({" UNION ALL ".join(channels)}),
  sums AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(channel_no * 1000 + rank) AS first, min(rank) FILTER (channel_no = 0) AS dense_rank, min(rank) FILTER (channel_no = 1) AS bm25_rank FROM ranks GROUP BY ALL),
  fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first) AS fused_rank, count(*) OVER (PARTITION BY qid) AS candidate_count FROM sums)
SELECT qid, CAST(fused_rank AS INTEGER) AS rank, id, round(rrf, 6) AS rrf, dense_rank, bm25_rank, candidate_count FROM fused WHERE fused_rank <= 8"""


def _by_mode(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Whole retrieval of the items; the vector of an item's number stands for the model's."""
    vectors = spread(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    of = vectors.select(F.col("id").alias("item"), "embedding")

    def near(queries: DataFrame) -> DataFrame:
        return dense.dense_rank(vectors, queries.join(of, F.col("qid.qid") == F.col("item")).select("qid", "embedding")).select("qid", "id", "rank")

    corpus = vectors.select("id").unionByName(_documents(spark, sf_dir).select("id")).distinct()
    hits = retrieve(_items(spark, sf_dir), corpus, near, lexical_ranker(_index(spark, sf_dir)), mode)
    return hits.select("qid", F.col("rank").cast("int").alias("rank"), "id", "rrf", "dense_rank", "bm25_rank", "candidate_count")


@register("retrieval_rrf", _by_mode_sql(True, True))
def retrieval_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_mode(spark, sf_dir, "rrf")


@register("retrieval_dense", _by_mode_sql(True, False))
def retrieval_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_mode(spark, sf_dir, "dense")


@register(
    "boundary_report",
    f"""WITH {_bm25_sql("SELECT name AS qid, text FROM (VALUES " + ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in perturb.BOUNDARY.items()) + ") t(name, text)")},
  hits AS (SELECT qid, count(*) AS n, min(id) FILTER (rank = 1) AS top1 FROM ranked GROUP BY qid)
SELECT name AS "case", 'bm25' AS mode, coalesce(n, 0) AS n_returned, top1 FROM (VALUES {", ".join(f"('{name}')" for name in perturb.BOUNDARY)}) t(name) LEFT JOIN hits ON qid = name""",
)
def boundary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary questions over the documents: none of them fails."""
    suite = perturb.boundary_suite(spark, ["bm25"])
    hits = bm25_rank(_index(spark, sf_dir), suite.select(F.col("case").alias("qid"), "text")).select(F.col("qid").alias("case"), F.lit("bm25").alias("mode"), "id", "rank")
    return perturb.boundary_report(suite, hits)


@register(
    "coverage_counts",
    f"""WITH {_bm25_sql(_ITEMS)}, {_GOLD}, per AS (SELECT g.qid, count(DISTINCT g.id) AS n_gold, count(rank) FILTER (rank <= 3) AS in_3, count(rank) FILTER (rank <= 8) AS in_8 FROM gold g LEFT JOIN ranked r ON r.qid = g.qid AND r.id = g.id GROUP BY g.qid)
SELECT 'bm25' AS mode, count(*) AS n, count(*) FILTER (in_3 > 0) AS any_3, count(*) FILTER (in_8 > 0) AS any_8, count(*) FILTER (in_8 = n_gold) AS full_8 FROM per""",
)
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which some or all documents are among the first."""
    gold = _gold(spark, sf_dir)
    hits = bm25_rank(_index(spark, sf_dir), _items(spark, sf_dir)).withColumn("mode", F.lit("bm25"))
    return metrics.coverage_counts(hits, gold, ["mode"])


@register("first_hits", f"SELECT qid, id, score, rank FROM ({_top_sql(_dense_sql())}) WHERE rank = 1")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_hits(dense.dense_rank(*_vectors(spark, sf_dir)))


@register(
    "facet_orders",
    f"""WITH scores AS (SELECT 0 AS channel, * FROM ({_dense_sql().replace("% 100 = 0", "% 100 <= 1")}) UNION ALL SELECT 1, * FROM ({_dense_sql(_NEAR).replace("% 100 = 0", "% 100 <= 1")})),
  ranks AS (SELECT * FROM (SELECT channel, qid, id, row_number() OVER (PARTITION BY channel, qid ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= 20),
  fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(channel * 1000 + rank) AS first, bool_or(channel = 1 AND rank = 1 AND qid % 100 = 1) AS anchor FROM ranks GROUP BY ALL),
  ordered AS (SELECT qid, id, anchor, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first) AS r FROM fused)
SELECT qid - qid % 100 AS qid, CAST(qid % 100 AS INTEGER) AS query_no, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN anchor THEN 0 ELSE 1 END, r) AS INTEGER) AS facet_rank FROM ordered""",
)
def facet_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector with the one after it as an added query; the first of the second channel goes to its front."""
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    corpus, asked = vectors.select(F.col("vec_id").alias("id"), "embedding"), vectors.where("vec_id % 100 <= 1").select(F.col("vec_id").alias("qid"), "embedding")
    ranks = None
    for number, (name, score) in enumerate((("dense", dense.dot), ("near", dense.nearness))):
        own = dense.dense_rank(corpus, asked, score=score).select((F.col("qid") - F.col("qid") % 100).alias("qid"), (F.col("qid") % 100).cast("int").alias("query_no"), F.lit(name).alias("channel"), F.lit(number).alias("channel_no"), "id", "rank")
        ranks = own if ranks is None else ranks.unionByName(own)
    return fusion.facet_orders(stored(ranks, "ranks"), True, "near")  # read twice


# ---------------------------------------------------------------- tool loops

#: What the scripted model does, by the first digit of a question: the calls of each turn until it has enough.
_SEARCH, _UNKNOWN = ("search", "{text}"), ("read", "nowhere")
_SCRIPTS = {
    0: [[_SEARCH], [("read", "{first}")]], 1: [], 2: [[_SEARCH, _SEARCH, _SEARCH, _SEARCH]], 3: [[_UNKNOWN]],
    4: [[_SEARCH], [_SEARCH]], 5: [[_SEARCH], [("fly", "x")]], 6: [[_SEARCH, _UNKNOWN]], 7: None,
}


def _scripted() -> loop.Mover:
    def move(question: str, history: list[str]) -> loop.Move:
        kind, text = question.split(":", 1)
        script = _SCRIPTS[int(kind)]
        if script is None:
            raise RuntimeError("no model")
        turn = sum(1 for _ in history)
        if turn >= len(script):
            return loop.Move(seconds=1.0)
        first = (json.loads(history[0]).get("ids") or ["none"])[0] if history else "none"
        return loop.Move([(tool, {ask.ARGUMENT.get(tool, "query"): value.format(text=text, first=first)}) for tool, value in script[turn]], seconds=1.0)

    return move


def _answering() -> Callable[[str, str, int], generate.Reply]:
    """A client that cites the first source, or for questions of kind 4 one that does not exist."""
    return lambda packed, question, most: generate.Reply("see 〔来源9〕" if question.startswith("4") else "see 〔来源1〕", "stop", len(packed), 3)


def _loops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir)
    corpus = docs.select("id", "pos", F.lit(1).alias("page"), F.lit("").alias("path"), F.substring("text", 1, 300).alias("text"))
    asked = _items(spark, sf_dir).select("qid", F.concat((F.col("qid") % 8).cast("string"), F.lit(":"), F.substring(F.trim("text"), 1, 400)).alias("question"))
    return loop.tool_loop(asked, lexical_ranker(_index(spark, sf_dir), 3), corpus, _scripted), corpus


_LOOPS = f"""WITH {_bm25_sql("SELECT item_id AS qid, substr(trim(text), 1, 400) AS text FROM benchmark", 3)},
  hits AS (SELECT qid, list(id ORDER BY rank) AS found FROM ranked GROUP BY qid),
  kinds AS (SELECT item_id AS qid, item_id % 8 AS kind, coalesce(found, []) AS found FROM benchmark LEFT JOIN hits ON qid = item_id),
  beside AS (SELECT qid, list(doc_id ORDER BY doc_id) AS more FROM kinds JOIN documents ON doc_id BETWEEN found[1] - 1 AND found[1] + 1 WHERE kind = 0 GROUP BY qid),
  near AS (SELECT kinds.qid, kind, found, CASE WHEN kind IN (0, 2, 4, 5, 6) THEN found ELSE [] END AS first, coalesce(more, []) AS more FROM kinds LEFT JOIN beside USING (qid)),
  ended AS (SELECT qid, kind, list_concat(first, list_filter(more, lambda x: NOT list_contains(first, x))) AS ids,
    CASE WHEN kind = 1 THEN 'no_evidence' WHEN kind = 2 THEN 'limited' WHEN kind IN (3, 5, 6, 7) OR (kind = 0 AND len(found) = 0) THEN 'agent_failed' WHEN len(found) = 0 THEN 'no_evidence' ELSE 'complete' END AS status FROM near)"""


@register(
    "tool_loop",
    f"""{_LOOPS}
SELECT qid, status, CASE WHEN kind = 7 THEN 'model_request_failed' ELSE CASE status WHEN 'complete' THEN 'evidence_ready' WHEN 'no_evidence' THEN 'no_sources' WHEN 'limited' THEN 'tool_budget' ELSE 'invalid_tool_call' END END AS stop_reason,
  CAST(CASE kind WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 1 END AS INTEGER) AS model_calls, CAST(CASE kind WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS INTEGER) AS searches,
  CAST(CASE WHEN kind = 0 AND status = 'complete' THEN 1 ELSE 0 END AS INTEGER) AS reads, array_to_string(ids, ',') AS ids FROM ended""",
)
def tool_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as questions for a scripted model that searches and reads the documents, or goes wrong in each of the ways there are."""
    loops, _ = _loops(spark, sf_dir)
    return loops.select("qid", "status", "stop_reason", "model_calls", F.col("searchs").alias("searches"), "reads", F.array_join("ids", ",").alias("ids"))


@register(
    "synthesized_answers",
    f"""{_LOOPS}
SELECT qid, CASE WHEN status NOT IN ('complete', 'limited') OR len(ids) = 0 THEN status WHEN kind = 4 THEN 'citation_failed' ELSE 'complete' END AS status,
  CASE WHEN status IN ('complete', 'limited') AND len(ids) > 0 AND kind <> 4 THEN 'see 〔来源1〕' END AS answer, len(ids) AS gathered, CASE WHEN status IN ('complete', 'limited') THEN len(ids) ELSE 0 END AS in_context FROM ended""",
)
def synthesized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers from what those loops gathered; a cited source that does not exist withholds an answer."""
    loops, corpus = _loops(spark, sf_dir)
    found = loop.synthesized(loops, corpus, _answering)
    return found.select("qid", "status", "answer", F.size("gathered").cast("long").alias("gathered"), F.size("in_context").cast("long").alias("in_context"))

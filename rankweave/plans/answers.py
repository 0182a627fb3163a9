"""Queries about stored answers: citations, expectations, contexts, statuses, tool calls, and the sets they are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.functions import text as T
from rankweave.operators import ask, checks, context, experiment, fusion, generate, metrics, perturb, retrieve, structure
from rankweave.plans.registry import register
from rankweave.sources.tables import spread, table

NUMBER = "[0-9]+"
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


# ---------------------------------------------------------------- citations and grounding

_PATHS = "SELECT n_nationkey, n_regionkey + 1 AS page, CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE r_name || ' > ' || n_name END AS path, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey"


@register(
    "citation_report",
    f"""WITH paths AS ({_PATHS}),
  cited AS (SELECT conv_id * 1000 + turn AS qid, CAST(conv_id % 6 + 1 AS INTEGER) AS page, CASE turn % 4 WHEN 0 THEN r_name || ' > ' || n_name || ' > more' WHEN 1 THEN r_name WHEN 2 THEN '无章节' ELSE '' END AS claim FROM conversations JOIN paths ON n_nationkey = conv_id % 25),
  led AS (SELECT *, CASE WHEN claim LIKE '% > % > %' THEN split_part(claim, ' > ', 1) || ' > ' || split_part(claim, ' > ', 2) ELSE claim END AS prefix FROM cited)
SELECT qid, page, claim, page IN (SELECT page FROM paths) AS page_ok,
  page IN (SELECT page FROM paths) AND CASE WHEN claim = '' THEN true WHEN claim = '无章节' THEN EXISTS (FROM paths p WHERE p.page = led.page AND p.path = '') ELSE EXISTS (FROM paths p WHERE p.page = led.page AND p.path <> '' AND (p.path = prefix OR starts_with(p.path, prefix || ' > '))) END AS path_ok FROM led""",
)
def citation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that cite a page and a path of the nations' table, right or wrong."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = nations.select("n_nationkey", (F.col("n_regionkey") + 1).alias("page"), F.when(F.col("n_nationkey") % 6 == 5, "").otherwise(T.joined_path(F.col("r_name"), F.col("n_name"))).alias("path"), "r_name", "n_name")
    kind = F.col("turn") % 4
    claim = F.when(kind == 0, T.joined_path(F.col("r_name"), F.col("n_name"), F.lit("more"))).when(kind == 1, F.col("r_name")).when(kind == 2, "无章节").otherwise("")
    said = _turns(spark, sf_dir).join(F.broadcast(paths), F.col("n_nationkey") == F.col("conv_id") % 25)  # 25 nations
    answer = F.concat(F.regexp_replace("text", "[〔〕]", ""), F.lit(" 〔第"), (F.col("conv_id") % 6 + 1).cast("string"), F.lit("页·"), claim, F.lit("〕"))
    answers = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), answer.alias("answer"))
    return checks.citation_report(answers, paths.select(F.array(F.col("page").cast("int")).alias("pages"), "path"))


_KNOWN_LABELS = "CASE WHEN turn % 3 = 2 THEN '〔source9〕' ELSE '〔source2〕' END"


@register("known_labels", f"SELECT conv_id, turn, list_filter(regexp_extract_all('〔source1〕' || text || {_KNOWN_LABELS}, '〔([^〕]+)〕', 1), lambda x: x NOT IN ('source1', 'source2')) = [] AS known FROM conversations")
def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every label in a reply is one of two sources."""
    answer = F.concat(F.lit("〔source1〕"), "text", F.when(F.col("turn") % 3 == 2, "〔source9〕").otherwise("〔source2〕"))
    sources = F.create_map(F.lit("source1"), F.lit("a"), F.lit("source2"), F.lit("b"))
    return _turns(spark, sf_dir).select("conv_id", "turn", context.citations_known(answer, sources).alias("known"))


_QUOTED = r"""SELECT item_id AS qid, b.text AS item, d.text AS source, CASE WHEN item_id % 2 = 0 THEN substr(d.text, 3, 40) ELSE b.text END AS quote, regexp_extract(coalesce(d.text, ''), '[0-9]+') || CASE WHEN item_id % 3 = 0 THEN ' 424242' ELSE '' END AS answer
  FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id"""


@register(
    "quote_checks",
    rf"""SELECT qid, contains(regexp_replace(coalesce(source, ''), '\s+', '', 'g'), regexp_replace(coalesce(quote, ''), '\s+', '', 'g')) AS quote_found,
  array_to_string(list_filter(list_distinct(regexp_extract_all(answer, '[0-9]+')), lambda f: NOT contains(regexp_replace(coalesce(source, ''), '\s+', '', 'g'), f)), ' ') AS ungrounded FROM ({_QUOTED})""",
)
def quote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every other item the quote comes from its document, and every third answer has a number that the document lacks."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    items = _items(spark, sf_dir).join(docs.select(F.col("id").alias("qid"), F.col("text").alias("source")), "qid", "left")
    quote = F.when(F.col("qid") % 2 == 0, F.substring("source", 3, 40)).otherwise(F.col("text"))
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "[0-9]+", 0)
    answer = F.concat(number, F.when(F.col("qid") % 3 == 0, " 424242").otherwise(""))
    cases = items.select("qid", F.col("qid").alias("source_chunk"), F.coalesce(quote, F.lit("")).alias("quote"), answer.alias("answer"))
    found = checks.quote_checks(cases, docs, NUMBER)
    return found.select("qid", "quote_found", F.array_join("ungrounded", " ").alias("ungrounded"))


@register(
    "gold_candidates",
    rf"""WITH folded AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents WHERE length(text) >= 100),
  facts AS (SELECT DISTINCT item_id, unnest([CAST(item_id AS VARCHAR), CAST(item_id + 7 AS VARCHAR), CAST(item_id * 3 AS VARCHAR)]) AS fact FROM benchmark),
  hits AS (SELECT item_id, doc_id FROM facts, folded WHERE contains(t, fact) AND doc_id <> item_id GROUP BY ALL HAVING count(DISTINCT fact) >= 2)
SELECT item_id AS qid, string_agg(doc_id, ',' ORDER BY doc_id) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS r FROM hits) WHERE r <= 3 GROUP BY item_id""",
)
def gold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least two of three numbers of each item."""
    number = F.col("qid")
    answers = _items(spark, sf_dir).select("qid", number.cast("string").alias("source_chunk"), F.concat_ws(" ", number, number + 7, number * 3).alias("answer"))
    chunks = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), "text", F.col("source").alias("path"))
    return checks.gold_candidates(answers, chunks, NUMBER).select("qid", F.array_join("candidates", ",").alias("candidates"))


# ---------------------------------------------------------------- expectations and reviews

_EXPECT = [*checks.NEEDED, "answer_with_citation", "cite_rule", "unheard_of"]
_ADDED = ["未规定", "版本", "当地", "法务", "无法", "具体", "the"]


def _pick(values: list[str], at: str) -> str:
    return "CASE " + " ".join(f"WHEN {at} % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


_SHOWN = " ".join(f"WHEN expect = '{name}' THEN {_any('answer', checks.MARKERS[group])}" + (" AND NOT contains(answer, ' of ')" if name == "refuse" else "") for name, group in checks.NEEDED.items())


@register(
    "expectation_screen",
    f"""SELECT conv_id, turn, CASE {_SHOWN} WHEN expect = 'answer_with_citation' THEN {_any('answer', ['the', '未'])} WHEN expect = 'cite_rule' THEN {_any('answer', ['the', '未'])} AND turn % 2 >= 1 END AS passed
FROM (SELECT conv_id, turn, text || {_pick(_ADDED, 'turn')} AS answer, {_pick(_EXPECT, '(conv_id + turn)')} AS expect FROM conversations)""",
)
def expectation_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with one marker word added, held against expectations in turn."""
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    answer = F.concat("text", at(_ADDED, F.col("turn")))
    must, forbidden = F.array(F.array(F.lit("the"), F.lit("未"))), F.array(F.lit(" of "))
    passed = checks.expectation(answer, at(_EXPECT, F.col("conv_id") + F.col("turn")), must, forbidden, F.col("turn") % 2)
    return _turns(spark, sf_dir).select("conv_id", "turn", passed.alias("passed"))


@register("reviewed_answers", "SELECT l.doc_id, quality, coalesce(CASE WHEN l.doc_id % 2 = 0 THEN sha256(text) ELSE 'stale' END = sha256(text), false) AS current FROM labels l LEFT JOIN documents d USING (doc_id)")
def reviewed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as reviews of texts; of every other document the text has changed since."""
    answers = _documents(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("text").alias("answer"))
    then = answers.select("key", F.when(F.col("key") % 2 == 0, F.sha2("answer", 256)).otherwise("stale").alias("answer_sha256"))
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("grade")).join(then, "key", "left")
    return experiment.reviewed_answers(notes, answers).select(F.col("key").alias("doc_id"), F.col("grade").alias("quality"), "current")


@register(
    "refreshed_candidates",
    "SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN item_id WHEN item_id % 2 = 0 THEN item_id + 1 END AS candidate, item_id % 3 <> 0 AS open FROM benchmark",
)
def refreshed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of reviewed items stay, those of the others are new; and which items are not reviewed."""
    items, qid = _items(spark, sf_dir), F.col("qid")
    old = items.select("qid", (qid % 3 == 0).alias("reviewed"), F.array(qid).alias("candidates"))
    new = items.where("qid % 2 = 0").select("qid", F.array(qid + 1).alias("candidates"))
    pending = checks.unreviewed(old).withColumn("open", F.lit(True))
    return checks.refreshed(old, new).join(pending, "qid", "left").select("qid", F.get("candidates", 0).alias("candidate"), F.coalesce("open", F.lit(False)).alias("open"))


@register(
    "source_chunks",
    """WITH placed AS (SELECT doc_id, source, n_chars % 50 AS score, doc_id % 9 = 0 AS is_table, row_number() OVER (PARTITION BY source ORDER BY n_chars % 50 DESC, doc_id) AS place FROM documents)
SELECT doc_id, source, is_table FROM placed WHERE place <= length(source) OR is_table""",
)
def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each source up to the length of its name, and all that count as tables."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("source").alias("chapter"), (F.col("n_chars") % 50).alias("score"), (F.col("doc_id") % 9 == 0).alias("is_table"))
    quotas = docs.select(F.col("source").alias("chapter"), F.length("source").alias("quota")).distinct()
    return checks.source_chunks(chunks, quotas).select(F.col("id").alias("doc_id"), F.col("chapter").alias("source"), "is_table")


# ---------------------------------------------------------------- summaries


@register(
    "mean_without_errors",
    "SELECT event_type, count(*) FILTER (event_id % 10 <> 0 AND value IS NOT NULL) AS n, round(avg(value) FILTER (event_id % 10 <> 0), 4) AS mean, count(*) FILTER (event_id % 10 = 0) AS errors FROM events GROUP BY event_type",
)
def mean_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("error", F.when(F.col("event_id") % 10 == 0, "failed"))
    return metrics.mean_without_errors(rows, ["event_type"], "value", "error")


@register("strict_accuracy", "SELECT l_orderkey, CASE WHEN count(*) = 4 THEN round(avg(CAST(l_quantity > 25 AS INTEGER)), 6) END AS accuracy FROM lineitem GROUP BY l_orderkey")
def strict_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which all four lines are graded."""
    graded = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") > 25).alias("correct"))
    return graded.groupBy("l_orderkey").agg(F.round(experiment.strict_accuracy("correct", 4), 6).alias("accuracy"))


@register(
    "worst_drops",
    """WITH scores AS (SELECT user_id % 3 AS mode, event_type AS variant, round(avg(value), 6) AS value FROM events GROUP BY ALL)
SELECT s.variant, round(min(s.value), 6) AS worst, round(min(s.value - b.value), 6) AS lost FROM scores s JOIN scores b ON b.mode = s.mode AND b.variant = 'click' WHERE s.variant <> 'click' GROUP BY s.variant""",
)
def worst_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _events(spark, sf_dir).groupBy((F.col("user_id") % 3).alias("mode"), F.col("event_type").alias("variant")).agg(F.round(F.avg("value"), 6).alias("value"))
    return metrics.worst_drops(scores, "click").select("variant", F.round("worst", 6).alias("worst"), F.col("drop").alias("lost"))


@register(
    "red_team_summary",
    """SELECT event_type AS risk, count(*) AS n, count(*) FILTER (event_id % 7 <> 0 AND value > 5) AS passed, round(avg(CASE WHEN event_id % 7 <> 0 THEN CAST(value > 5 AS INTEGER) END), 6) AS pass_rate, CAST(sum(event_id % 4) AS BIGINT) AS citations,
  CAST(sum(event_id % 2) AS BIGINT) AS bad_pages, count(*) FILTER (event_id % 7 = 0) AS errors, round(list_sort(list(value) FILTER (value IS NOT NULL))[count(value) // 2 + 1], 6) AS median_seconds FROM events GROUP BY event_type""",
)
def red_team_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    failed = e % 7 == 0
    rows = _events(spark, sf_dir).select(
        F.col("event_type").alias("risk"), F.when(~failed, F.col("value") > 5).alias("passed"), (e % 4).alias("n_citations"), (e % 2).alias("bad_pages"), F.lit(0).alias("bad_paths"), F.when(failed, "x").alias("error"), F.col("value").alias("seconds")
    )
    found = experiment.red_team_summary(rows)
    return found.select("risk", "n", "passed", F.round("pass_rate", 6).alias("pass_rate"), "citations", "bad_pages", "errors", F.round("median_seconds", 6).alias("median_seconds"))


@register(
    "task_order",
    "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN k ELSE 2 - k END AS INTEGER) AS turn, ['a', 'b', 'c'][k + 1] AS variant FROM documents, (VALUES (0), (1), (2)) t(k)",
)
def task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of every document, odd ones in reverse."""
    cases = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos"))
    return experiment.tasks(cases, ("a", "b", "c")).select("doc_id", "turn", "variant")


# ---------------------------------------------------------------- small text parts

_TOKENS = "string_split(text, ' ')"


@register(
    "small_parts",
    f"""SELECT item_id AS qid, '2048,4096,8192' AS ladder, array_to_string(list_filter({_TOKENS}, lambda x, i: list_position({_TOKENS}, x) = i)[1:5], ' ') AS first_words,
  CASE WHEN item_id % 3 = 0 THEN CAST(item_id AS VARCHAR) ELSE item_id || '+' || (item_id + 1) END AS ids, 'item > ' || item_id AS path FROM benchmark""",
)
def small_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of attempts, the first different words, listed numbers, and a path of what is not empty."""
    qid = F.col("qid")
    listed = F.when(qid % 3 != 0, F.concat_ws(",", qid, qid + 1))
    joined = lambda xs, by: F.array_join(xs.cast("array<string>"), by)
    return _items(spark, sf_dir).select(
        "qid", joined(T.budget_ladder(), ",").alias("ladder"), F.array_join(T.ordered_distinct(F.split("text", " "), 5), " ").alias("first_words"),
        joined(T.csv_ints(listed, qid), "+").alias("ids"), T.joined_path(F.lit("item"), F.lit(""), qid.cast("string")).alias("path"),
    )


@register(
    "markdown_tables",
    rf"""SELECT doc_id, '| key | value |' || chr(10) || '| --- | --- |' || chr(10) || '| source | ' || source || ' |' || chr(10) || '| text | ' || replace(trim(regexp_replace(text || '|end', '[\r\n]', ' ', 'g'), {_WS}), '|', chr(92) || '|') || ' |' || chr(10) || '| short |  |' AS markdown FROM documents""",
)
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a table: an empty row goes, a short one is padded, pipes and line ends in cells are made safe."""
    row = lambda *cells: F.array(*cells)
    rows = F.array(row(F.lit("key"), F.lit("value")), row(F.lit("source"), F.col("source")), row(F.lit(""), F.lit(None).cast("string")), row(F.lit("text"), F.concat("text", F.lit("|end"))), row(F.lit("short")))
    return _documents(spark, sf_dir).select("doc_id", T.markdown_table(rows).alias("markdown"))


_COVERED = "CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source) AND source < 'src3' THEN substr(text, 1, 30) ELSE text END"


@register(
    "page_annotation",
    f"SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY source) AND chars < 60 AS is_cover, CAST(chars AS INTEGER) AS char_len, NOT (doc_id = min(doc_id) OVER (PARTITION BY source) AND chars < 60) AND contains(replace(substr('目 录' || text, 1, 200), ' ', ''), '目录') AND doc_id % 5 = 0 AS is_toc FROM (SELECT *, length(trim(CASE WHEN doc_id % 5 = 0 THEN '目 录' ELSE '' END || text, {_WS})) AS chars FROM (SELECT doc_id, source, {_COVERED} AS text FROM documents))",
)
def page_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of a book for each source, some with a short cover; every fifth begins like a table of contents."""
    first = F.min("doc_id").over(Window.partitionBy("source"))
    text = F.when((F.col("doc_id") == first) & (F.col("source") < "src3"), F.substring("text", 1, 30)).otherwise(F.col("text"))
    pages = _documents(spark, sf_dir).select("source", F.col("doc_id").alias("page"), F.concat(F.when(F.col("doc_id") % 5 == 0, "目 录").otherwise(""), text).alias("text"))
    return structure.annotated(pages, ("source",)).select(F.col("page").alias("doc_id"), "is_cover", "char_len", "is_toc")


_FRAMED = " UNION ALL ".join(f"SELECT item_id AS qid, '{name}' AS variant, '{frame.split('{q}')[0]}' || text || '{frame.split('{q}')[1]}' AS text FROM benchmark" for name, frame in perturb.FRAMES.items())


@register("framed_variants", _FRAMED)
def framed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in the frames of colloquial, verbose, noisy and mixed questions."""
    return perturb.explode_variants(_items(spark, sf_dir)).where(F.col("variant").isin(*perturb.FRAMES))


# ---------------------------------------------------------------- queries and facets

#: Terms of the made-up texts that stand for the topics of questions.
_RULES = (
    fusion.Rule((("the",), ("ing", "ion")), ("first facet", "second facet")),
    fusion.Rule((("de",),), ("front facet",), prepend=True),
    fusion.Rule((("er",),), ("plain facet",), unless=("und", ("other facet",))),
)
_SCOPE = (fusion.Rule((("la",), ("los", "las")), ("only facet",)),)
_FACETS = """list_concat(list_concat(CASE WHEN contains(t, 'de') THEN ['front facet'] ELSE [] END, CASE WHEN contains(t, 'the') AND (contains(t, 'ing') OR contains(t, 'ion')) THEN ['first facet', 'second facet'] ELSE [] END),
    CASE WHEN NOT contains(t, 'er') THEN [] WHEN contains(t, 'und') THEN ['other facet'] ELSE ['plain facet'] END)"""


@register(
    "expanded_queries",
    f"""SELECT item_id AS qid, array_to_string(list_concat([t], {_FACETS})[1:3], ' | ') AS expanded, CASE WHEN contains(t, 'la') AND (contains(t, 'los') OR contains(t, 'las')) THEN t || ' | only facet' ELSE array_to_string(list_concat([t], {_FACETS})[1:3], ' | ') END AS scoped
FROM (SELECT item_id, trim(text, {_WS}) AS t FROM benchmark)""",
)
def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions asked for each item: itself and the facets of the rules it meets, or those of its scope."""
    text, shown = F.col("text"), lambda c: F.array_join(c, " | ")
    return _items(spark, sf_dir).select("qid", shown(fusion.expanded_queries(text, _RULES)).alias("expanded"), shown(fusion.scoped_queries(text, _RULES, _SCOPE)).alias("scoped"))


@register(
    "smoke_check",
    "SELECT source AS qid, coalesce(bool_or(contains(text, 'the') OR contains(text, 'qqq')), false) AS passed FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3 GROUP BY source",
)
def smoke_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose first three documents have a keyword."""
    docs = _documents(spark, sf_dir).select(F.col("source").alias("qid"), "doc_id", "text")
    hits = docs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id")))
    expected = docs.select("qid").distinct().withColumn("keywords", F.array(F.lit("the"), F.lit("qqq")))
    return retrieve.smoke_check(hits, expected)


# ---------------------------------------------------------------- contexts, statuses, tools


@register(
    "baseline_contexts",
    """WITH used AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations)
SELECT conv_id, sha1(string_agg('〔第' || turn || '页·' || CASE WHEN turn % 3 = 0 THEN '无章节' ELSE role END || '〕' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS context_sha1, count(*) AS n FROM used WHERE used <= 6000 GROUP BY conv_id""",
)
def baseline_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as hits, labelled and joined within the budget."""
    hits = _turns(spark, sf_dir).select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.col("turn").alias("page"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("path"), "text")
    counted = context.prefix_within_budget(hits).groupBy("qid").agg(F.count("*").alias("n"))
    return context.baseline_context(hits).join(counted, "qid").select(F.col("qid").alias("conv_id"), F.sha1("context").alias("context_sha1"), "n")


_STATUSES = ["complete", "truncated", "generation_failed"]


@register(
    "final_statuses",
    f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no_evidence' WHEN event_id % 7 = 0 THEN 'retrieval_only' WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'citation_failed' ELSE {_pick(_STATUSES, 'event_id')} END AS status,
  CASE {_pick(list(generate.PROFILES), 'user_id')} WHEN 'baseline' THEN 'baseline' ELSE 'guarded' END AS strategy, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id + 2 * event_id + 10 END AS tokens FROM events""",
)
def final_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers: the status shown, the strategy of the profile, and the tokens of two attempts where both are known."""
    e, u = F.col("event_id"), F.col("user_id")
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    usage = F.array(F.struct(u.alias("prompt_tokens"), e.alias("completion_tokens")), F.struct(F.when(e % 4 != 0, e).alias("prompt_tokens"), F.lit(10).cast("long").alias("completion_tokens")))
    status = generate.final_status(at(_STATUSES, e), e % 7 != 0, e % 5, e % 2 != 0)
    return _events(spark, sf_dir).select("event_id", status.alias("status"), generate.profile_of(at(list(generate.PROFILES), u))["strategy"].alias("strategy"), generate.total_tokens(usage).alias("tokens"))


def _counting_client():
    """A client whose replies follow from the question's length: empty, cut, refused, raised or whole."""

    def reply(context: str, question: str, max_tokens: int) -> generate.Reply:
        n = len(question)
        if n % 7 == 0:
            return generate.Reply(None, status_code=429)
        if n % 5 == 0 and max_tokens < 8192:
            raise TimeoutError("no reply in time")
        if n % 3 == 0:
            return generate.Reply("cut", "length", n, max_tokens)
        return generate.Reply("" if n % 2 == 0 and max_tokens < 4096 else "whole", "stop", n, max_tokens)

    return reply


@register(
    "attempt_ladder",
    """SELECT conv_id, turn, CASE WHEN n % 7 = 0 THEN 'generation_failed' WHEN n % 3 = 0 THEN 'truncated' ELSE 'complete' END AS status,
  CASE WHEN n % 7 = 0 THEN NULL WHEN n % 3 = 0 THEN 'cut' ELSE 'whole' END AS answer, CASE WHEN n % 7 = 0 THEN 1 WHEN n % 5 = 0 OR n % 3 = 0 THEN 3 WHEN n % 2 = 0 THEN 2 ELSE 1 END AS attempts,
  CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN NULL WHEN n % 3 = 0 THEN 3 * n + 14336 WHEN n % 2 = 0 THEN 2 * n + 6144 ELSE n + 2048 END AS tokens FROM (SELECT conv_id, turn, length(text) AS n FROM conversations)""",
)
def attempt_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn asked of a client that fails in each way, with doubled budgets."""
    asked = _turns(spark, sf_dir).select("conv_id", "turn", F.col("text").alias("question"), F.lit("").alias("context"))
    found = generate.generate(asked, _counting_client, evidence=False)
    return found.select("conv_id", "turn", "status", "answer", F.size("usage").alias("attempts"), generate.total_tokens(F.col("usage")).alias("tokens"))


_TOOL = "CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'read' ELSE event_type END"


def _tool(kind: Column) -> Column:
    return F.when(kind == "click", "search").when(kind == "view", "read").otherwise(kind)


@register(
    "admitted_calls",
    f"""WITH calls AS (SELECT user_id, event_id, {_TOOL} AS tool, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS model_call FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id, tool ORDER BY model_call) <= CASE tool WHEN 'search' THEN 3 WHEN 'read' THEN 2 ELSE 0 END AND model_call <= 8 AS admitted FROM calls""",
)
def admitted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as tool calls of one question."""
    calls = _events(spark, sf_dir).select(F.col("user_id").alias("qid"), "event_id", _tool(F.col("event_type")).alias("tool"), F.lit(0).alias("seq"))
    numbered = calls.withColumn("model_call", F.row_number().over(Window.partitionBy("qid").orderBy("event_id")))
    return ask.admitted(numbered).select("event_id", "admitted")


@register(
    "call_faults",
    f"""SELECT event_id, CASE WHEN tool NOT IN ('search', 'read') THEN 'unknown_tool' WHEN event_id % 4 = 1 THEN 'bad_arguments' WHEN event_id % 4 = 2 THEN 'bad_value' WHEN tool = 'read' AND event_id % 8 <> 0 THEN 'unknown_source' END AS fault FROM (SELECT event_id, {_TOOL} AS tool FROM events)""",
)
def call_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls with right, missing, blank and unknown arguments."""
    e, tool = F.col("event_id"), _tool(F.col("event_type"))
    key = F.when(tool == "read", "chunk_id").otherwise("query")
    value = F.when(e % 4 == 2, "  ").otherwise(F.concat(F.lit("c"), (e % 8).cast("string")))
    arguments = F.when(e % 4 == 1, F.create_map(F.lit("other"), F.lit("x"))).otherwise(F.create_map(key, value))
    return _events(spark, sf_dir).select("event_id", ask.call_fault(tool, arguments, F.array(F.lit("c0"))).alias("fault"))


@register(
    "loop_outcomes",
    f"""WITH calls AS (SELECT user_id, event_id, {_TOOL} AS tool, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS model_call FROM events WHERE event_type IN ('click', 'view', 'purchase')),
  judged AS (SELECT *, CASE WHEN model_call * (user_id % 40 + 1) > 120 THEN 'timeout' WHEN tool NOT IN ('search', 'read') AND event_id % 3 = 0 THEN 'agent_failed'
    WHEN row_number() OVER (PARTITION BY user_id, tool ORDER BY model_call) > CASE tool WHEN 'search' THEN 3 WHEN 'read' THEN 2 ELSE 0 END OR model_call > 8 THEN 'limited' END AS reason FROM calls)
SELECT user_id AS qid, coalesce(arg_min(reason, model_call) FILTER (reason IS NOT NULL), 'complete') AS status, min(model_call) FILTER (reason IS NOT NULL) AS stopped_at FROM judged GROUP BY user_id""",
)
def loop_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the tool calls of one question: what ended its loop."""
    e, tool = F.col("event_id"), _tool(F.col("event_type"))
    calls = _events(spark, sf_dir).where(F.col("event_type").isin("click", "view", "purchase")).select(F.col("user_id").alias("qid"), "event_id", tool.alias("tool"), F.lit(0).alias("seq"), F.when(~tool.isin("search", "read") & (e % 3 == 0), "unknown_tool").alias("fault"))
    numbered = calls.withColumn("model_call", F.row_number().over(Window.partitionBy("qid").orderBy("event_id")))
    return ask.loop_outcomes(numbered.withColumn("seconds", F.col("model_call") * (F.col("qid") % 40 + 1)))


@register("gathered_chunks", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def gathered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind of a user, as chunks that came in."""
    chunks = _events(spark, sf_dir).select(F.col("user_id").alias("qid"), F.col("event_id").alias("seq"), F.col("event_type").alias("id"))
    return ask.gathered(chunks).select(F.col("qid").alias("user_id"), F.col("id").alias("event_type"), F.col("seq").alias("event_id"))

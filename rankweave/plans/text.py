"""Queries about lines, headings, chunks, facts and checks of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.functions import text as T
from rankweave.operators import checks, structure
from rankweave.plans.registry import register
from rankweave.sources.tables import spread, table

NUMBER = r"[0-9]+(?:[.][0-9]+)?"


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


_LINES = r"""lines AS (
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, parts[i] AS line, trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, len(parts) AS n
    FROM (SELECT doc_id, CASE WHEN ends THEN parts[1:len(parts) - 1] ELSE parts END AS parts
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, text LIKE '%' || chr(10) OR text = '' AS ends FROM documents)), unnest(generate_series(1, len(parts))) t(i))"""


@register(
    "frame_noise_removed",
    f"""WITH {_LINES}, often AS (SELECT bare FROM lines GROUP BY bare HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, idx, (idx < 3 OR idx >= n - 3) AND bare IN (FROM often) OR (regexp_full_match(bare, '[0-9]+') AND idx >= n - 3) AS noise FROM lines WHERE bare <> ''""",
)
def frame_noise_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of one book: lines that recur near the edges."""
    pages = _documents(spark, sf_dir, "doc_id", "text").withColumn("book", F.lit(0)).withColumnRenamed("doc_id", "page")
    return structure.frame_noise(pages, ("book",), 10).select(F.col("page").alias("doc_id"), "idx", "noise")


@register("line_frequency", f"WITH {_LINES} SELECT sha1(bare) AS line_sha1, count(DISTINCT doc_id) AS documents, count(*) AS n FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT doc_id) >= 2")
def line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(T.split_lines(F.col("text"))).alias("line"))
    per_doc = lines.select("doc_id", T.strip(F.col("line")).alias("bare")).where("bare <> ''").groupBy("bare", "doc_id").agg(F.count("*").alias("n"))
    both = per_doc.groupBy("bare").agg(F.count("*").alias("documents"), F.sum("n").alias("n")).where("documents >= 2")
    return both.select(F.sha1("bare").alias("line_sha1"), "documents", "n")


@register(
    "last_heading_context",
    f"""WITH {_LINES}, marked AS (SELECT *, regexp_full_match(line, '[^ .]+( [^ .]+)?[.]') AS chapter, regexp_full_match(line, '.{{1,30}}') AS short FROM lines),
  up AS (SELECT *, last_value(CASE WHEN chapter THEN line END IGNORE NULLS) OVER w AS c, count(*) FILTER (chapter) OVER w AS part FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, c AS chapter, last_value(CASE WHEN short AND NOT chapter THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY idx) AS section FROM up""",
)
def last_heading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one or two words and a full stop as chapters, other short lines as sections."""
    lines = _documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("idx", "line"))
    chapter, section = F.col("line").rlike(r"^[^ .]+( [^ .]+)?[.]\z"), F.col("line").rlike(r"^.{1,30}\z")
    return structure.last_headings(lines, ("doc_id",), ("idx",), chapter, section).select("doc_id", "idx", "chapter", "section")


def _windows_sql(source: str, key: str, stops: tuple[str, ...]) -> str:
    """cut(key, no, piece): the windows of ``source`` (key, s), stripped; to follow WITH RECURSIVE. Stops are SQL expressions."""

    def end(start: str) -> str:
        high = f"least({start} + 750, length(s))"
        last = f"substr(s, CAST({start} + 501 AS INTEGER), CAST({high} - {start} - 500 AS INTEGER))"
        cases = " ".join(f"WHEN strpos({last}, {stop}) > 0 THEN {start} + 500 + length({last}) - strpos(reverse({last}), reverse({stop})) + 2 - length({stop})" for stop in stops)
        return f"CASE WHEN length(s) <= 750 THEN length(s) WHEN {high} - {start} <= 500 THEN {high} {cases} ELSE {high} END"

    return f"""walked AS (
    SELECT {key}, s, 0 AS turn, CAST(0 AS BIGINT) AS start, CAST({end("0")} AS BIGINT) AS fin FROM {source} WHERE s <> ''
    UNION ALL
    SELECT {key}, s, turn + 1, nxt, CAST({end("nxt")} AS BIGINT) FROM (SELECT *, CASE WHEN fin - 80 > start THEN fin - 80 ELSE fin END AS nxt FROM walked WHERE fin < length(s))),
  cut AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY turn) - 1 AS INTEGER) AS no, piece FROM (SELECT {key}, turn, trim(substr(s, CAST(start + 1 AS INTEGER), CAST(fin - start AS INTEGER)), {_SPACE}) AS piece FROM walked) WHERE piece <> '')"""


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register(
    "chunk_windows",
    f"""WITH RECURSIVE src AS (SELECT doc_id, trim(text, {_SPACE}) AS s FROM documents), {_windows_sql("src", "doc_id", ("'. '", "'.' || chr(10)", "chr(10)", "' '"))}
SELECT doc_id, no, CAST(length(piece) AS INTEGER) AS chars, 'p' || no || '-' || substr(sha1(piece), 1, 10) AS piece_id FROM cut""",
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = structure.ChunkRules(stops=(". ", ".\n", "\n", " "))
    pieces = structure.chunk_windows(_documents(spark, sf_dir, "doc_id", "text"), rules)
    return pieces.select("doc_id", "no", F.length("piece").alias("chars"), T.content_id(F.col("no"), F.col("piece")).alias("piece_id"))


_CLAUSE = r"^(\d{1,2}(?:\.\d{1,2}){1,3})\s*(.*)$"


@register(
    "table_groups",
    f"""WITH {_LINES}, rows AS (SELECT doc_id, idx, '| ' || idx || ' | ' || replace(bare, '|', chr(92) || '|') || ' |' AS line FROM lines WHERE bare <> ''),
  sized AS (SELECT doc_id, idx, line, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS r, greatest(4, 750 // (greatest(max(length(line)) OVER (PARTITION BY doc_id), 15) + 1)) AS g, sum(length(line) + 1) OVER (PARTITION BY doc_id) + 29 AS whole FROM rows),
  pieces AS (SELECT doc_id, CASE WHEN whole <= 750 THEN 0 ELSE r // g END AS no, '| line | text |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY idx) AS piece FROM sized GROUP BY ALL)
SELECT doc_id, CAST(no AS INTEGER) AS no, sha1(piece) AS piece_sha1, CAST(length(piece) AS INTEGER) AS chars FROM pieces""",
)
def table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document as a table with their numbers, in groups of rows under the repeated head."""
    lines = F.transform(T.split_lines(F.col("text")), lambda line, i: F.struct(i.alias("i"), T.strip(line).alias("line")))
    rows = F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.array(x["i"].cast("string"), x["line"]))
    table_of = F.when(F.size(rows) > 0, F.concat(F.array(F.array(F.lit("line"), F.lit("text"))), rows))
    pieces = _documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(structure.table_pieces(table_of)).alias("no", "piece"))
    return pieces.select("doc_id", "no", F.sha1("piece").alias("piece_sha1"), F.length("piece").alias("chars"))


@register(
    "structural_chunks",
    rf"""WITH RECURSIVE {_LINES}, items AS (
    SELECT doc_id, 0 AS kind, idx, bare AS line FROM lines WHERE bare <> '' UNION ALL
    SELECT doc_id, 1, 0, '| lang | source |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || source || ' |' FROM documents),
  typed AS (SELECT *, kind = 0 AND regexp_matches(line, '^([^ .]+)( [^ .]+)?\.$') AS chapter, kind = 0 AND regexp_matches(line, '^.{{1,30}}$') AS short, kind = 0 AND regexp_matches(line, '{_CLAUSE}') AS clause FROM items),
  up AS (SELECT *, last_value(CASE WHEN chapter THEN line END IGNORE NULLS) OVER w AS c, count(*) FILTER (chapter) OVER w AS part, chapter OR short OR kind = 1 OR coalesce(lag(kind) OVER w, 0) = 1 AS hard FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY kind, idx)),
  headed AS (SELECT *, last_value(CASE WHEN short AND NOT chapter THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY kind, idx) AS sec, count(*) FILTER (hard) OVER (PARTITION BY doc_id ORDER BY kind, idx) AS stretch FROM up),
  body AS (SELECT *, CASE WHEN clause THEN regexp_extract(line, '{_CLAUSE}', 1) END AS number, CASE WHEN clause THEN trim(regexp_extract(line, '{_CLAUSE}', 2)) END AS rest FROM headed WHERE NOT chapter AND NOT short),
  shown AS (SELECT *, CASE WHEN NOT clause THEN line WHEN length(rest) >= 30 THEN rest ELSE trim(number || ' ' || rest) END AS put, row_number() OVER (PARTITION BY doc_id ORDER BY kind, idx) AS nn, stretch <> lag(stretch) OVER (PARTITION BY doc_id ORDER BY kind, idx) AS fresh FROM body),
  walk AS (
    SELECT doc_id, nn, CAST(0 AS BIGINT) AS block, CAST(length(put) + 1 AS BIGINT) AS held, 0 AS spill FROM shown WHERE nn = 1
    UNION ALL
    SELECT doc_id, nn, before + spill, CASE WHEN spill = 1 THEN 0 ELSE had END + length(put) + 1, spill FROM (
      SELECT *, CASE WHEN had > 0 AND had + length(put) > 750 THEN 1 ELSE 0 END AS spill FROM (
        SELECT s.doc_id, s.nn, s.put, CASE WHEN fresh OR (clause AND held >= 300) THEN w.block + 1 ELSE w.block END AS before, CASE WHEN fresh OR (clause AND held >= 300) THEN 0 ELSE held END AS had
        FROM walk w JOIN shown s ON s.doc_id = w.doc_id AND s.nn = w.nn + 1))),
  placed AS (SELECT * FROM shown JOIN walk USING (doc_id, nn)),
  notes AS (SELECT doc_id, block - spill AS block, arg_min(number, nn) AS first, arg_max(number, nn) AS last, arg_max(rest, nn) AS title FROM placed WHERE clause GROUP BY ALL),
  blocks AS (SELECT doc_id, block, any_value(c) AS c, any_value(sec) AS sec, string_agg(put, chr(10) ORDER BY nn) AS content FROM placed GROUP BY doc_id, block),
  src AS (SELECT {{'d': doc_id, 'b': block, 'path': concat_ws(' > ', c, sec, CASE WHEN first = last THEN trim(first || ' ' || title) ELSE first || '~' || last END)}} AS k, trim(content, {_SPACE}) AS s FROM blocks LEFT JOIN notes USING (doc_id, block)),
  {_windows_sql("src", "k", ("'. '", "chr(10)"))}
SELECT k.d AS doc_id, CAST(row_number() OVER (PARTITION BY k.d ORDER BY k.b, no) - 1 AS INTEGER) AS pos, 'p1-' || substr(sha1(CASE WHEN k.path = '' THEN piece ELSE '【' || k.path || '】' || chr(10) || piece END), 1, 10) AS id, k.path AS path, CAST(length(piece) AS INTEGER) AS char_len FROM cut""",
)
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books of one page with a table each, with Latin headings and stops."""
    rules = structure.ChunkRules(chapter=r"^([^ .]+)( [^ .]+)?\.$", section=r"^(.{1,30})()$", clause=_CLAUSE, stops=(". ", "\n"))
    tables = F.array(F.array(F.array(F.lit("lang"), F.lit("source")), F.array("lang", "source")))
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    pages = docs.select("doc_id", F.lit(1).alias("page"), "text", tables.alias("tables"), F.lit(False).alias("is_cover"), F.lit(False).alias("is_toc"))
    return structure.build_chunks(pages, rules).select("doc_id", "pos", "id", "path", "char_len")


@register("content_ids", "SELECT doc_id, 'p' || doc_id || '-' || substr(sha1(text), 1, 10) AS content_id, sha256(text) AS digest, length(text) AS chars FROM documents")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", T.content_id(F.col("doc_id"), F.col("text")).alias("content_id"), F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("chars"))


@register("duplicate_content", "SELECT source, count(*) AS n, count(*) - count(DISTINCT text) AS duplicates, round(avg(length(text)), 4) AS mean_chars, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY source")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "source", "text").select("source", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("chars"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("digest")).alias("duplicates"), F.round(F.avg("chars"), 4).alias("mean_chars"), F.min("chars").alias("least"), F.max("chars").alias("most"))


@register("numeric_facts", f"SELECT doc_id, len(regexp_extract_all(text, '{NUMBER}')) AS n_facts, array_to_string(regexp_extract_all(text, '{NUMBER}'), ' ') AS facts, CASE WHEN starts_with(text, '|') THEN 'table' WHEN len(regexp_extract_all(text, '{NUMBER}')) >= 3 THEN 'numeric' ELSE 'fact' END AS kind FROM documents")
def numeric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, text = T.numeric_facts(F.col("text"), NUMBER), F.col("text")
    return _documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.size(facts).cast("long").alias("n_facts"), F.array_join(facts, " ").alias("facts"), T.content_type(text, NUMBER).alias("kind"))


@register(
    "bigram_jaccard_pairs",
    """WITH kept AS (SELECT item_id, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') AS t FROM benchmark),
  sets AS (SELECT item_id, list_distinct(list_transform(generate_series(1, length(t) - 1), lambda i: substr(t, CAST(i AS INTEGER), 2))) AS g FROM kept WHERE length(t) >= 2)
SELECT left_id, right_id, similarity FROM (SELECT a.item_id AS left_id, b.item_id AS right_id, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM sets a JOIN sets b ON a.item_id < b.item_id) WHERE similarity >= 0.5""",
)
def bigram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.similar_pairs(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), 0.5, "[^A-Za-z0-9]")


_FOLDED = r"folded AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents)"


@register(
    "term_absence",
    rf"""WITH {_FOLDED}, hits AS (SELECT item_id, doc_id FROM benchmark, folded WHERE contains(t, regexp_replace(benchmark.text, '\s+', '', 'g')))
SELECT item_id AS term_id, count(doc_id) AS n_violations, coalesce(array_to_string(list_sort(list(doc_id) FILTER (doc_id IS NOT NULL))[1:3], ','), '') AS violators FROM benchmark LEFT JOIN hits USING (item_id) GROUP BY item_id""",
)
def term_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term"))
    found = checks.absence(_documents(spark, sf_dir, F.col("doc_id").alias("id"), "text"), terms)
    return found.select("term_id", "n_violations", F.array_join(F.col("violators").cast("array<string>"), ",").alias("violators"))


@register("quote_containment", rf"WITH {_FOLDED} SELECT item_id AS term_id, doc_id AS id FROM benchmark, folded WHERE contains(t, regexp_replace(benchmark.text, '\s+', '', 'g'))")
def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term"))
    return checks.containing(_documents(spark, sf_dir, F.col("doc_id").alias("id"), "text"), quotes)


_REPLIES = "SELECT conv_id, turn, text || ' ' || conv_id % 7 AS answer, lag(text || ' ' || conv_id % 5) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations QUALIFY role = 'assistant'"


@register(
    "ungrounded_numbers",
    rf"SELECT conv_id, turn, coalesce(array_to_string(list_filter(list_distinct(regexp_extract_all(answer, '{NUMBER}')), lambda f: NOT contains(regexp_replace(coalesce(source, ''), '\s+', '', 'g'), f)), ' '), '') <> '' AS ungrounded FROM ({_REPLIES})",
)
def ungrounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reply, with a number put to it, has numbers that the turn before it, with another, lacks."""
    turns = table(spark, sf_dir, "conversations")
    ended = lambda n: F.concat("text", F.lit(" "), (F.col("conv_id") % n).cast("string"))
    before = F.lag(ended(5)).over(Window.partitionBy("conv_id").orderBy("turn"))
    replies = turns.select("conv_id", "turn", "role", ended(7).alias("answer"), before.alias("source")).where("role = 'assistant'")
    return replies.select("conv_id", "turn", (F.size(checks.ungrounded_numbers(F.col("answer"), F.col("source"), NUMBER)) > 0).alias("ungrounded"))


@register(
    "marker_screen",
    "SELECT conv_id, turn, contains(text, ' not ') OR contains(text, 'Thon') AS negate, contains(text, 'the') AND (contains(text, 'ing') OR contains(text, 'keit')) AS must, CASE WHEN contains(text, ' of ') THEN ' of ' WHEN contains(text, ' de ') THEN ' de ' END AS first_hit FROM conversations",
)
def marker_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, text = table(spark, sf_dir, "conversations"), F.col("text")
    must = F.array(F.array(F.lit("the")), F.array(F.lit("ing"), F.lit("keit")))
    alternatives = F.array(F.lit(" of "), F.lit(" de "))
    return turns.select("conv_id", "turn", T.contains_any(text, [" not ", "Thon"]).alias("negate"), checks.must_hit(text, must).alias("must"), T.first_contained(text, alternatives).alias("first_hit"))


@register(
    "topn_per_group",
    f"""WITH scored AS (SELECT doc_id, source, lang, length(text) AS chars, least(len(regexp_extract_all(text, '{NUMBER}')), 5) + CASE WHEN starts_with(text, '|') THEN 5 ELSE 0 END + CASE WHEN source LIKE 'src1%' THEN 2 ELSE 0 END + CASE WHEN length(text) BETWEEN 200 AND 700 THEN 1 ELSE 0 END AS score FROM documents)
SELECT source, doc_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM scored) WHERE place <= 3""",
)
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most useful documents of each source."""
    score = T.value_score(F.col("text"), F.col("source").like("src1%"), F.length("text"), NUMBER)
    scored = _documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", score.cast("long").alias("score"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("place", place).where("place <= 3").select("source", "doc_id", "score", "place")


@register(
    "html_text_smoke",
    r"SELECT page_id, length(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'), '\s+', '', 'g')) AS chars, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages",
)
def html_text_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    bare = T.without_space(F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " "))
    return pages.select("page_id", F.length(bare).cast("long").alias("chars"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"))


@register("source_preview", "SELECT doc_id, replace(substr(text, 1, 150), chr(10), ' ') || CASE WHEN length(text) > 150 THEN '…' ELSE '' END AS preview FROM documents")
def source_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.operators.retrieve import hit_preview

    return _documents(spark, sf_dir, "doc_id", "text").select("doc_id", hit_preview(F.col("text")).alias("preview"))

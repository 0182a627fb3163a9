"""Queries that compare corpora, and that write through the sinks and read what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import generate, structure
from rankweave.operators.compare import differences
from rankweave.plans.registry import register
from rankweave.session import new_scratch_path
from rankweave.sources import documents as files
from rankweave.sources import reports
from rankweave.sources.tables import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


@register(
    "corpus_changes",
    """WITH actual AS (SELECT doc_id AS id, CASE WHEN doc_id % 89 = 3 THEN text || '.' ELSE text END AS text FROM documents WHERE doc_id % 97 <> 5
  UNION ALL SELECT doc_id + 10000000, text FROM documents WHERE doc_id % 101 = 7)
SELECT coalesce(a.id, d.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'lost' ELSE 'changed' END AS change
FROM documents d FULL JOIN actual a ON a.id = d.doc_id WHERE d.text IS DISTINCT FROM a.text""",
)
def corpus_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against a version of them of which some were lost, changed and added."""
    frozen = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    kept = frozen.where("id % 97 <> 5").select("id", F.when(F.col("id") % 89 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return differences(frozen, kept.unionByName(frozen.where("id % 101 = 7").select((F.col("id") + 10_000_000).alias("id"), "text")))


@register("jsonl_round_trip", "SELECT doc_id, lang, sha256(text) AS digest, length(text) AS chars FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as lines of JSON and read back under a fixed schema."""
    path = new_scratch_path(spark, "jsonl")
    files.write_jsonl(_documents(spark, sf_dir), path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string, source string").select("doc_id", "lang", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("chars"))


@register("json_document_round_trip", "SELECT count(*) AS n, min(doc_id) AS least, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def json_document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of the documents written as one JSON object and read as a whole document."""
    path = new_scratch_path(spark, "stats")
    length = F.length("text").cast("long")
    reports.write_stats(_documents(spark, sf_dir).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max(length).alias("longest"), F.sum(length).alias("chars")), path)
    return files.read_json_document(spark, path, "n long, least long, longest long, chars long")


@register(
    "editable_round_trip",
    r"""SELECT doc_id AS page, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)) AS text, 2 AS n_rows, 'doc ' || doc_id || ' | ' || lang AS cells, doc_id % 10 = 1 AS is_toc FROM documents""",
)
def editable_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of editable Markdown, each with a table whose cells hold pipes, written as text and read back; lines as they are without blank ones."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cell = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" | "), "lang")
    tables = F.array(F.array(F.array(F.lit("a"), F.lit("b")), F.array(cell, F.lit("x"))))
    pages = _documents(spark, sf_dir).select(F.col("doc_id").alias("page"), F.array_join(lines, "\n").alias("text"), tables.alias("tables"), F.lit(False).alias("is_cover"), (F.col("doc_id") % 10 == 1).alias("is_toc"))
    path = new_scratch_path(spark, "editable")
    files.editable_pages(pages).select(F.concat("markdown", F.lit("\n\n")).alias("value")).write.text(path)
    found = files.read_editable(spark, path)
    return found.select(F.col("page").cast("long").alias("page"), "text", F.size(F.get("tables", 0)).alias("n_rows"), F.get(F.get(F.get("tables", 0), 1), 0).alias("cells"), "is_toc")


@register("index_round_trip", "SELECT vec_id AS id, len(embedding) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as index entries: half of them written anew, then all appended by the ids that are new."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = new_scratch_path(spark, "entries")
    files.rebuild_index(vectors.where("id % 2 = 0"), path)
    files.append_index(vectors, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(path).select("id", F.size("embedding").cast("long").alias("dims"), F.round(total, 4).alias("total"))


@register("empty_pages", "SELECT doc_id AS page FROM documents WHERE doc_id % 6 = 0 AND doc_id % 12 <> 0 AND doc_id <> (SELECT min(doc_id) FROM documents d WHERE d.source = documents.source)")
def empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of a book for each source: every sixth is blank, and half of those hold a table."""
    text = F.when(F.col("doc_id") % 6 == 0, " \n ").otherwise(F.concat(F.lit("x"), "text"))
    tables = F.when(F.col("doc_id") % 12 == 0, F.array(F.array(F.array(F.lit("cell")))))
    pages = _documents(spark, sf_dir).select("source", F.col("doc_id").alias("page"), text.alias("text"), tables.alias("tables"))
    return structure.empty_pages(structure.annotated(pages, ("source",)))


@register("smoke_report", "SELECT line_no, value FROM (SELECT 0 AS line_no, CASE WHEN contains(text, 'the') THEN 'PASS ' ELSE 'FAIL ' END || item_id AS value FROM benchmark UNION ALL SELECT 1, count(*) FILTER (contains(text, 'the')) || '/' || count(*) || ' passed' FROM benchmark)")
def smoke_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a smoke report over the items, written as text and read back by their numbers."""
    checks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.contains("text", F.lit("the")).alias("passed"))
    path = new_scratch_path(spark, "smoke")
    reports.smoke_lines(checks).select(F.concat_ws("\t", "line_no", "value").alias("value")).write.text(path)
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).select(parts[0].cast("int").alias("line_no"), parts[1].alias("value"))


_BOXES = "SELECT l_orderkey % 20 AS page, l_orderkey * 10 + l_linenumber AS box, CAST(l_partkey * 7 % 600 AS DOUBLE) AS x0, CAST((l_orderkey * 3 + l_linenumber * 11) % 800 AS DOUBLE) AS top FROM lineitem"
_AREAS = "SELECT s_suppkey % 20 AS page, s_suppkey AS area, CAST(s_suppkey * 37 % 400 AS DOUBLE) AS x0, CAST(s_suppkey * 53 % 500 AS DOUBLE) AS top FROM supplier"


@register(
    "contained_boxes",
    f"""SELECT b.page, area, count(*) AS n, min(box) AS least FROM ({_BOXES}) b JOIN ({_AREAS}) a ON a.page = b.page AND b.x0 >= a.x0 - 1 AND b.top >= a.top - 1 AND b.x0 + 5 <= a.x0 + 121 AND b.top + 8 <= a.top + 201 GROUP BY ALL""",
)
def contained_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as characters of pages, suppliers as tables on them: the characters in each table."""
    l, s = F.col("l_orderkey"), F.col("s_suppkey")
    boxes = table(spark, sf_dir, "lineitem").select((l % 20).alias("page"), (l * 10 + F.col("l_linenumber")).alias("box"), (F.col("l_partkey") * 7 % 600).cast("double").alias("x0"), ((l * 3 + F.col("l_linenumber") * 11) % 800).cast("double").alias("top"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 5, "bottom": F.col("top") + 8})
    areas = table(spark, sf_dir, "supplier").select((s % 20).alias("page"), s.alias("area"), (s * 37 % 400).cast("double").alias("x0"), (s * 53 % 500).cast("double").alias("top"))
    areas = areas.withColumns({"x1": F.col("x0") + 120, "bottom": F.col("top") + 200})
    return files.contained_counts(boxes, areas)


def _asker():
    """A scripted model: a prompt that begins with k gets its text back from the k-th temperature on, before that nothing or a question."""

    def ask(prompt: str, temperature: float) -> str | None:
        kind, text = prompt.split(":", 1)
        turn = generate.TEMPERATURES.index(temperature)
        if kind == "5":
            raise RuntimeError("no model")
        return text[:20] if turn >= int(kind) else ("", "what?")[turn % 2]

    return ask


@register(
    "residual_rounds",
    """SELECT conv_id * 1000 + turn AS qid, CASE WHEN conv_id % 6 <= 3 THEN 'accepted' ELSE 'exhausted' END AS status, CAST(CASE WHEN conv_id % 6 <= 3 THEN conv_id % 6 + 1 ELSE 4 END AS INTEGER) AS round,
  CASE WHEN conv_id % 6 <= 3 THEN substr(text, 1, 20) WHEN conv_id % 6 = 4 THEN 'what?' END AS reply FROM conversations WHERE role = 'user'""",
)
def residual_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as prompts of a scripted model whose replies are valid in the first round, in a later one or in none."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    items = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat((F.col("conv_id") % 6).cast("string"), F.lit(":"), "text").alias("prompt"))
    return generate.residual_rounds(items, lambda: _asker(), lambda prompt, reply: (reply != "") & F.contains(prompt, reply))

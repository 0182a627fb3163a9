"""JSON, Markdown and index tables: readers with fixed schemas, and their sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import markdown_table, strip

PAGE = "page int, text string, tables array<array<array<string>>>, has_image boolean, is_cover boolean, is_toc boolean, char_len int"
CHUNK = "id string, pages array<int>, chapter string, section string, clause_range string, path string, content string, text string, char_len int"
GOLDEN = (
    "qid string, question string, gold_chunk_ids array<string>, gold_candidates array<string>, gold_pages array<bigint>, reference_answer string, evidence_quote string, type string, "
    "source_chunk string, source_path string, reviewed boolean, review_note string, closest_content string, negative_kind string, related_pages array<bigint>, related_chunk_ids array<string>, related_path string"
)
RED_TEAM = "rid string, category string, risk string, question string, expect string, must array<array<string>>, note string, forbid_output array<string>"
CASE = (
    "qid string, question string, kind string, source string, annotation_status string, gold_chunk_ids array<string>, base_qid string, required_points array<string>, review_note string, "
    "related_chunk_ids array<string>, known_evidence string, missing_detail string, expected_behavior string, required_context array<string>"
)
#: The page mark and the table mark of editable text.
PAGE_MARK, TABLE_MARK = r"<!-- page (\d+)( cover| toc)? -->", "|"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record for each line that is not blank."""
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_editable(spark: SparkSession, path: str) -> DataFrame:
    """Pages of Markdown files with page marks: doc, page, text, tables, is_cover, is_toc.

    Blocks of a page between blank lines that start with a pipe are tables; the other blocks are its text.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")
    parts = F.split("value", f"(?={PAGE_MARK})")
    page = whole.select("doc", F.explode(parts).alias("part")).where(F.col("part").rlike(f"^{PAGE_MARK}"))
    body = F.regexp_replace("part", PAGE_MARK, "")
    blocks = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda b: strip(b)), lambda b: b != "")
    cells = lambda line: F.transform(F.split(F.regexp_replace(strip(line), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))
    rows = lambda b: F.transform(F.filter(F.split(b, "\n"), lambda r: ~r.rlike(r"^\|[\s|:-]+\|$")), cells)
    kind = F.regexp_extract("part", PAGE_MARK, 2)
    return page.select(
        "doc", F.regexp_extract("part", PAGE_MARK, 1).cast("int").alias("page"), F.array_join(F.filter(blocks, lambda b: ~b.startswith(TABLE_MARK)), "\n").alias("text"),
        F.transform(F.filter(blocks, lambda b: b.startswith(TABLE_MARK)), rows).alias("tables"), (kind == " cover").alias("is_cover"), (kind == " toc").alias("is_toc"),
    )


def editable_pages(pages: DataFrame) -> DataFrame:
    """(page, markdown): every page with its mark, text and tables."""
    mark = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.when(F.col("is_cover"), " cover").when(F.col("is_toc"), " toc").otherwise(""), F.lit(" -->"))
    parts = F.concat(F.array(strip(F.col("text"))), F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), markdown_table))
    return pages.select("page", F.concat(mark, F.lit("\n"), F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")).alias("markdown"))


def scan_files(spark: SparkSession, path: str, extract, pattern: str = "*.pdf") -> DataFrame:
    """Pages of binary files by an injected ``extract(content) -> [(text, tables)]``; a file that fails gives one empty page with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, n, text, tables, None) for n, (text, tables) in enumerate(extract(bytes(content)), 1)]
                except Exception as error:  # noqa: BLE001  a bad file must not end the scan
                    rows.append((name, 1, "", [], str(error)))
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "tables", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "doc string, page int, text string, tables array<array<array<string>>>, error string")


def inside(box, areas, slack: float = 1.0):
    """Whether a box (x0, top, x1, bottom) lies in any of the areas, give or take ``slack`` on every side."""
    return F.exists(areas, lambda a: (box["x0"] >= a["x0"] - slack) & (box["top"] >= a["top"] - slack) & (box["x1"] <= a["x1"] + slack) & (box["bottom"] <= a["bottom"] + slack))


#: Width and height of the squares that boxes are dealt by.
SQUARE = 64.0


def contained(boxes: DataFrame, areas: DataFrame, slack: float = 1.0, square: float = SQUARE) -> DataFrame:
    """(page, box, area): which boxes (page, box, x0, top, x1, bottom) lie in which areas (page, area, x0, top, x1, bottom), give or take ``slack``.

    An area is listed under every square of its page that it reaches, a box under the square of its first corner alone, so
    both meet at most once, by page and square; the exact test follows. Rows with a null coordinate lie in nothing and hold nothing.
    """
    reach = lambda low, high: F.sequence(F.floor((F.col(low) - slack) / square), F.floor((F.col(high) + slack) / square))
    known = lambda df: df.where(" and ".join(f"{c} is not null" for c in ("x0", "top", "x1", "bottom")))
    held = known(areas).where(f"x1 >= x0 - {2 * slack} and bottom >= top - {2 * slack}").select("page", "area", F.col("x0").alias("a0"), F.col("top").alias("atop"), F.col("x1").alias("a1"), F.col("bottom").alias("abottom"), F.explode(reach("x0", "x1")).alias("across"), reach("top", "bottom").alias("rows"))
    held = held.withColumn("down", F.explode("rows")).drop("rows")
    placed = known(boxes).withColumns({"across": F.floor(F.col("x0") / square), "down": F.floor(F.col("top") / square)})
    met = placed.join(held, ["page", "across", "down"])
    inner = (F.col("x0") >= F.col("a0") - slack) & (F.col("top") >= F.col("atop") - slack) & (F.col("x1") <= F.col("a1") + slack) & (F.col("bottom") <= F.col("abottom") + slack)
    return met.where(inner).select("page", "box", "area")


def contained_counts(boxes: DataFrame, areas: DataFrame, slack: float = 1.0, square: float = SQUARE) -> DataFrame:
    """(page, area, n, least): how many boxes lie in each area that holds any, and the least of them; inputs as for :func:`contained`.

    Boxes of one place and size are counted first and areas of one place and size asked once, so what meets grows with the
    different rectangles and not with the rows.
    """
    shape = ["page", "x0", "top", "x1", "bottom"]
    counted = boxes.groupBy(*shape).agg(F.struct(F.count("*").alias("n"), F.min("box").alias("least")).alias("box"))
    asked = areas.select(*shape).distinct().withColumn("area", F.struct(*shape))
    held = contained(counted, asked, slack, square).groupBy("area").agg(F.sum("box.n").alias("n"), F.min("box.least").alias("least"))
    named = areas.select(*shape, "area").join(held.select("area.*", "n", "least"), shape)
    return named.groupBy("page", "area").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def index_entries(chunks: DataFrame) -> DataFrame:
    """The columns an index keeps of chunks with embeddings."""
    return chunks.select("id", "embedding", F.col("text").alias("document"), F.element_at("pages", 1).alias("page_start"), "pages", "path", F.col("clause_range").alias("clause"), "char_len")


def rebuild_index(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(path)


def append_index(entries: DataFrame, path: str) -> None:
    """Adds the entries whose id is new; of entries that share an id the one whose row is least as JSON."""
    known = entries.sparkSession.read.parquet(path).select("id")
    row = F.struct(*[F.col(f"`{c}`") for c in entries.columns])
    fresh = entries.join(known, "id", "left_anti").select(entries.columns)
    fresh.groupBy("id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*").write.mode("append").parquet(path)

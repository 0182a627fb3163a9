"""Scalar text functions as Column expressions. White space and digits are Unicode ones unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that make a number a fact, the citation form, the source label and kept characters of bigrams.
NUMERIC_FACT = r"\d+(?:\.\d+)?\s*(?:个工作日|个自然日|个自然月|个月|天|日|年|元|%|小时|分钟|次|级|人)"
CITATION = r"〔第\s*(\d+)\s*页[·・]?([^〕]*)〕"
SOURCE_LABEL = r"〔([^〕]+)〕"
BIGRAM_DROPPED = r"[^一-鿿A-Za-z0-9]"
TOC_MARK = "目录"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def split_lines(c: Column) -> Column:
    """Lines of a text with any of the line ends of Unicode; none for an empty text, no empty last one."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def without_space(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def is_digits(c: Column) -> Column:
    return c.rlike(r"(?U)^\d+$")


def starts_like_toc(c: Column, mark: str = TOC_MARK, head: int = 200) -> Column:
    """Whether the first characters hold the mark, blanks (also ideographic ones) aside."""
    return F.contains(F.translate(F.substring(c, 1, head), " 　", ""), F.lit(mark))


def table_cell(c: Column) -> Column:
    """A table cell on one line, pipes escaped; null is empty."""
    return F.replace(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")), F.lit("|"), F.lit("\\|"))


def markdown_row(cells: Column, width: Column | int) -> Column:
    """Cells padded or cut to ``width`` as one table row."""
    width = F.lit(width) if isinstance(width, int) else width
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return F.concat(F.lit("| "), F.array_join(F.transform(padded, lambda x: strip(x)), " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a table: empty rows go, short ones are padded, the first is the head; none is ''."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, table_cell)), lambda r: F.exists(r, lambda x: x != ""))
    width = F.array_max(F.transform(clean, F.size))
    body = F.transform(clean, lambda r: markdown_row(r, width))
    rule = markdown_row(F.array_repeat(F.lit("---"), width), width)
    parts = F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))))
    return F.when(F.size(clean) > 0, F.array_join(parts, "\n")).otherwise("")


def joined_path(*parts: Column, sep: str = " > ") -> Column:
    """The parts that are not empty, joined."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def content_id(page: Column, text: Column) -> Column:
    """``p{page}-`` and ten hex digits of the text's SHA-1."""
    return F.concat(F.lit("p"), page.cast("string"), F.lit("-"), F.substring(F.sha1(text), 1, 10))


def numeric_facts(c: Column, pattern: str = NUMERIC_FACT) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)


def citations(c: Column, pattern: str = CITATION) -> Column:
    """(page, claim) of every citation."""
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), 1).alias("p"), F.regexp_extract_all(c, F.lit(pattern), 2).alias("c")),
        lambda x: F.struct(x["p"].cast("int").alias("page"), strip(x["c"]).alias("claim")),
    )


def source_labels(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(SOURCE_LABEL), 1)


def bigrams(c: Column, dropped: str = BIGRAM_DROPPED) -> Column:
    """Distinct pairs of neighbouring kept characters."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), dropped, "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(kept) - 1), lambda i: F.substring(kept, i, F.lit(2)))
    return F.when(F.length(kept) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union of two sets that both have; null where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t)) if terms else F.lit(False)


def first_contained(c: Column, alternatives: Column) -> Column:
    """The first alternative that the text has, else null."""
    return F.get(F.filter(alternatives, lambda a: F.contains(c, a)), 0)


def tolerant_json(c: Column) -> Column:
    """The text as JSON, else its part from the first to the last brace, else an empty object."""
    part = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(part), F.parse_json(F.lit("{}")))


def csv_ints(c: Column, fallback: Column) -> Column:
    """'21,22' as [21, 22]; the fallback alone where there is nothing."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.transform(F.split(c, ","), lambda x: x.cast("int"))).otherwise(F.array(fallback.cast("int")))


def budget_ladder(first: int = 2048, most: int = 8192, attempts: int = 3) -> Column:
    """Token budgets of the attempts: doubled each time, up to the most."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda i: F.least(F.call_function("shiftleft", F.lit(first), i), F.lit(most)))


def ordered_distinct(items: Column, most: int) -> Column:
    return F.slice(F.array_distinct(items), 1, most)


def value_score(content: Column, has_clause: Column, length: Column, pattern: str = NUMERIC_FACT) -> Column:
    """How much a chunk is worth asking about: 5 for a table, 2 for a clause, up to 5 for facts, 1 for a good length."""
    table = F.when(content.startswith("|"), 5).otherwise(0)
    return table + F.when(has_clause, 2).otherwise(0) + F.least(F.size(numeric_facts(content, pattern)), F.lit(5)) + F.when(length.between(200, 700), 1).otherwise(0)


def content_type(content: Column, pattern: str = NUMERIC_FACT) -> Column:
    return F.when(content.startswith("|"), "table").when(F.size(numeric_facts(content, pattern)) >= 3, "numeric").otherwise("fact")

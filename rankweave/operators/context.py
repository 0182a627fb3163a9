"""Contexts under a budget, with labels and citation checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.functions.text import source_labels

BUDGET, SEPARATOR = 6000, "\n\n"
#: The word before the number of a source, the words of a page label, and the name of a chunk without path.
SOURCE, PAGE, UNNAMED = "来源", "第{page}页·{path}", "无章节"


def prefix_within_budget(hits: DataFrame, by: Sequence[str] = ("qid",), order: str = "rank", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """The first hits of each list, up to the first that passes the budget; only texts count."""
    used = F.sum(F.length(text)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", used).where(F.col("used") <= budget)


def page_label(page: Column, path: Column) -> Column:
    before, rest = PAGE.split("{page}")
    middle, after = rest.split("{path}")
    return F.concat(F.lit(before), page.cast("string"), F.lit(middle), F.coalesce(F.nullif(path, F.lit("")), F.lit(UNNAMED)), F.lit(after))


def baseline_context(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(qid, context) of hits (qid, rank, page, path, text): labelled texts of the prefix within the budget."""
    kept = prefix_within_budget(hits, budget=budget)
    part = F.struct("rank", F.concat(F.lit("〔"), page_label(F.col("page"), F.col("path")), F.lit("〕\n"), F.col("text")).alias("part"))
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), SEPARATOR).alias("context"))


def greedy(items: Column, budget: int = BUDGET, label: str = SOURCE) -> Column:
    """Of an ordered array of (id, head, text), what fits: struct(used, parts, ids). What does not fit is skipped, not the end.

    A part is its label and head on a line and the text; the budget counts parts and the separators between them. Labels number
    the admitted parts.
    """
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<string>").alias("ids"))

    def step(s: Column, x: Column) -> Column:
        part = F.concat(F.lit(f"〔{label}"), (F.size(s["parts"]) + 1).cast("string"), F.lit("〕"), x["head"], F.lit("\n"), F.coalesce(x["text"], F.lit("")))
        cost = F.length(part) + F.when(F.size(s["parts"]) > 0, len(SEPARATOR)).otherwise(0)
        more = F.struct((s["used"] + cost).alias("used"), F.concat(s["parts"], F.array(part)).alias("parts"), F.concat(s["ids"], F.array(x["id"].cast("string"))).alias("ids"))
        return F.when(s["used"] + cost <= budget, more).otherwise(s)

    return F.aggregate(items, start, step)


def evidence_context(hits: DataFrame, budget: int = BUDGET, label: str = SOURCE) -> DataFrame:
    """(qid, context, source_map, omitted) of hits (qid, rank, id, page, path, text): label -> id of what was admitted, and the ids that were not."""
    head = F.concat(F.lit(" "), page_label(F.col("page"), F.col("path"))).alias("head")
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", head, "text"))), lambda x: F.struct(x["id"], x["head"], x["text"]))
    packed = hits.groupBy("qid").agg(items.alias("items")).withColumn("kept", greedy(F.col("items"), budget, label))
    names = F.transform("kept.ids", lambda _, i: F.concat(F.lit(label), (i + 1).cast("string")))
    return packed.select(
        "qid", F.array_join("kept.parts", SEPARATOR).alias("context"), F.map_from_arrays(names, F.col("kept.ids")).alias("source_map"),
        F.array_except(F.transform("items", lambda x: x["id"].cast("string")), F.col("kept.ids")).alias("omitted"),
    )


def citations_known(answer: Column, source_map: Column) -> Column:
    """Whether every label cited is one of the sources."""
    return F.size(F.array_except(source_labels(answer), F.map_keys(source_map))) == 0

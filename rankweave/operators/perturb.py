"""Query variants for robustness runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Punctuation that is dropped, digits and their full-width forms, and sentence frames.
PUNCTUATION = "[？?！!，,。.、；;：:（）()]"
DIGITS, WIDE_DIGITS = "0123456789", "０１２３４５６７８９"
FRAMES: dict[str, str] = {
    "colloquial": "请问一下，{q}",
    "verbose": "我是刚入职不久的新同事，对公司制度还不太熟悉，想请教一个问题：{q}",
    "noise_prefix": "顺便再问个事，{q}，谢谢！",
    "english_mix": "Hi，想问下 {q}",
}
#: Inputs that must neither fail nor be refused.
BOUNDARY: dict[str, str] = {
    "empty": "",
    "whitespace": "   \t\n  ",
    "single_char": "假",
    "single_punct": "？",
    "emoji": "😀😀😀 请假？？？ 🎉",
    "control_chars": "请假\x00\x01\x02申请",
    "html": "<script>alert(1)</script> 事假要提前几天",
    "sql_like": "'; DROP TABLE chunks; -- 事假",
    "very_long": "请假" * 2000,
    "newlines": "事假\n\n\n\n提前几天\n申请",
    "only_digits": "1234567890",
    "mixed_script": "ﾊﾞｲﾄ 事假 ﾔｽﾐ",
}
HAN = r"\p{IsHan}"


def _framed(query: Column, frame: str) -> Column:
    before, after = frame.split("{q}")
    return F.concat(F.lit(before), query, F.lit(after))


def without_third(query: Column, letter: str = HAN, least: int = 4) -> Column:
    """Without the third of its letters of a kind, where it has more than ``least``; else null."""
    return F.when(F.regexp_count(query, F.lit(letter)) > least, F.regexp_replace(query, f"(?s)^((?:.*?{letter}){{2}}.*?){letter}", "$1"))


def variants(query: Column, letter: str = HAN, frames: dict[str, str] = FRAMES) -> Column:
    """An array of (variant, text); a variant that does not apply is left out."""
    made: list[tuple[str, Column]] = [
        ("orig", query),
        ("punct_strip", F.regexp_replace(query, PUNCTUATION, "")),
        ("spacey", F.regexp_replace(query, r"([0-9])([^0-9\s])", "$1 $2")),
        ("fullwidth_digit", F.translate(query, DIGITS, WIDE_DIGITS)),
        *((name, _framed(query, frame)) for name, frame in frames.items()),
        ("typo_drop", without_third(query, letter)),
        ("truncated", F.substring(query, F.lit(1), F.greatest(F.lit(4), F.floor(F.length(query) / 2).cast("int")))),
    ]
    cells = F.array(*[F.struct(F.lit(name).alias("variant"), text.alias("text")) for name, text in made])
    return F.filter(cells, lambda x: x["text"].isNotNull())


def explode_variants(queries: DataFrame, letter: str = HAN, frames: dict[str, str] = FRAMES) -> DataFrame:
    """(qid, variant, text) of queries (qid, text)."""
    return queries.select("qid", F.explode(variants(F.col("text"), letter, frames)).alias("v")).select("qid", "v.variant", "v.text")


def boundary_suite(spark, modes: Sequence[str]) -> DataFrame:
    rows = spark.createDataFrame(list(BOUNDARY.items()), "case string, text string")
    return rows.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))


def boundary_report(suite: DataFrame, hits: DataFrame) -> DataFrame:
    """(case, mode, n_returned, top1) for every case and mode of the suite; ``hits`` has case, mode, id, rank."""
    found = hits.groupBy("case", "mode").agg(F.count("*").alias("n"), F.min(F.when(F.col("rank") == 1, F.col("id"))).alias("top1"))
    return suite.join(found, ["case", "mode"], "left").select("case", "mode", F.coalesce("n", F.lit(0)).alias("n_returned"), "top1")

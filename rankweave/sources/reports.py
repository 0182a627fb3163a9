"""Reports of small result tables: Markdown, plain text and one JSON object."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a report shows at most; result tables of runs are far smaller.
MOST_ROWS = 10_000


def _cell(value: object) -> str:
    return "" if value is None else (f"{value:.4f}" if isinstance(value, float) else str(value)).replace("|", "\\|").replace("\n", " ")


def markdown_of(df: DataFrame, order: Sequence[str] = ()) -> str:
    """A small table as Markdown; a larger one than MOST_ROWS is refused."""
    rows = (df.orderBy(*order) if order else df).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report shows at most {MOST_ROWS} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(map(_cell, r)) + " |" for r in rows])


def report(title: str, sections: Iterable[tuple[str, DataFrame]]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_of(df)}" for name, df in sections)]) + "\n"


def smoke_lines(checks: DataFrame) -> DataFrame:
    """PASS and FAIL lines of checks (qid, passed), then a summary; rows of (line_no, value), for a text sink."""
    lines = checks.select(F.lit(0).alias("line_no"), F.concat(F.when(F.col("passed"), "PASS ").otherwise("FAIL "), F.col("qid").cast("string")).alias("value"))
    total = checks.agg(F.concat(F.count_if("passed").cast("string"), F.lit("/"), F.count("*").cast("string"), F.lit(" passed")).alias("value")).select(F.lit(1).alias("line_no"), "value")
    return lines.unionByName(total)


def write_stats(stats: DataFrame, path: str) -> None:
    """A one-row table as a JSON object."""
    stats.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)

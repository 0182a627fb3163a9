"""What several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: White space of the word rule: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


def small_batches(df: DataFrame, size: int = 16 << 20) -> DataFrame:
    """``df``, after bounding the bytes that go to a Python task at once: a few thousand long texts fill a worker otherwise."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def release() -> None:
    """Give what this Python worker has freed back to the machine: workers live on through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def filtered(df: DataFrame, keep) -> DataFrame:
    """``df`` through a function of Arrow batches that leaves out rows; columns go by place, so names may hold dots or come twice."""
    names = df.columns
    placed = df.toDF(*[f"c{k}" for k in range(len(names))])
    return placed.mapInArrow(keep, placed.schema).toDF(*names)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def same_value(column: str) -> Callable[[str, str], Column]:
    """Null-safe equality of one column under two aliases."""
    return lambda left, right: F.col(f"{left}.{column}").eqNullSafe(F.col(f"{right}.{column}"))

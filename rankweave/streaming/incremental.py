"""Incremental runs over arriving files: new rows are appended once, the latest row of a key is kept. An extension."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.experiment import latest, remaining


def stream_rows(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def append_once(rows: DataFrame, keys: Sequence[str], target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Append rows of keys that the target lacks, batch by batch; a batch that comes again adds nothing. The started query.

    Of rows of a batch that share their keys the one that is least as JSON counts.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
        fresh = transform(batch.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = remaining(fresh, spark.read.parquet(target), keys)
        fresh.write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, log: str, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The latest row of each key of an append log."""
    return latest(spark.read.parquet(log), keys, seq)

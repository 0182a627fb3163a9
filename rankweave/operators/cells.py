"""Vector ranking over cells: an inverted file whose bounds leave out cells without losing a rank."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from rankweave.operators.dense import TOP_K
from rankweave.session import stored

#: Vectors that centres are fitted on (drawn by a hash of the id), most centres, and rounds of fitting.
SAMPLE, CELLS, ROUNDS = 20_000, 1024, 8
#: Vectors of a cell and questions that meet in one task at a time, and cells that every question visits first.
BLOCK, CHUNK, FIRST = 4096, 2048, 4
#: Scores are rounded to six places: a bound must fail by more than this.
MARGIN = 1e-5


@dataclass(frozen=True)
class CellIndex:
    """``vectors`` (cell, block, id, embedding), ``cells`` (cell, radius, blocks, n), and the centres, at most CELLS of them.

    A cell's radius is the distance of its farthest vector from the centre. Large cells lie in blocks.
    """

    vectors: DataFrame
    cells: DataFrame
    centres: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row and the distance to it."""
    squares = (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
    cell = squares.argmin(axis=1)
    return cell, np.linalg.norm(x - centres[cell], axis=1)


def fit_centres(vectors: DataFrame, sample: int = SAMPLE, most: int = CELLS) -> np.ndarray:
    """Centres by k-means over at most about ``sample`` vectors; as many as the square root of their number, ``most`` at most."""
    n = vectors.count()
    if not n:
        return np.empty((0, 0))
    share = min(1.0, sample / n)
    drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("id", "embedding").orderBy("id").limit(2 * sample).toArrow()
    if not drawn.num_rows:
        drawn = vectors.select("id", "embedding").orderBy("id").limit(1).toArrow()
    x = _matrix(drawn["embedding"].combine_chunks())
    k = max(1, min(most, int(len(x) ** 0.5)))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        cell, _distance = _nearest(x, centres)
        counts = np.bincount(cell, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def build_cells(vectors: DataFrame, sample: int = SAMPLE, most: int = CELLS, block: int = BLOCK) -> CellIndex:
    """Every vector (id, embedding) in its cell; rows without embedding are left out. All embeddings have one length."""
    vectors = vectors.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    centres = fit_centres(vectors, sample, most)
    sent = vectors.sparkSession.sparkContext.broadcast(centres)  # at most CELLS rows

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, distance = _nearest(_matrix(batch.column(1)), sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(distance), *batch.columns], ["cell", "distance", "id", "embedding"])

    schema = StructType().add("cell", IntegerType()).add("distance", DoubleType())
    for field in vectors.schema:
        schema = schema.add(field)
    placed = stored(vectors.mapInArrow(assign, schema), "assigned")
    cells = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
    cells = stored(cells.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "cells")
    dealt = placed.join(F.broadcast(cells.select("cell", "blocks")), "cell")  # at most CELLS rows
    dealt = dealt.select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "embedding")
    return CellIndex(stored(dealt.repartition("cell", "block").sortWithinPartitions("cell", "block"), "vectors"), cells, centres)


def _bounds(centres, radius) -> Iterator:
    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.flatnonzero(~np.isnan(radius.value))
        for batch in batches:
            if batch.num_rows and len(own):
                q = _matrix(batch.column(1))
                most = q @ centres.value[own].T + np.linalg.norm(q, axis=1)[:, None] * radius.value[own][None, :]
                place = (-most).argsort(axis=1, kind="stable").argsort(axis=1)
                rows = np.repeat(np.arange(len(q)), len(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.tile(own, len(q)), pa.int32()), pa.array(most.ravel()), pa.array(place.ravel(), pa.int32())], ["qno", "cell", "most", "place"])

    return bounds


def _scores(k: int):
    def scores(key: tuple, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        x, q = (_matrix(t["embedding"].combine_chunks()) if t.num_rows else np.empty((0, 0)) for t in (vectors, asked))
        found = q @ x.T if len(x) and len(q) else np.empty((0, 0))
        if found.shape[1] > k:  # with all that may share the last place after rounding
            rows, columns = np.nonzero(found >= np.partition(found, -k, axis=1)[:, -k][:, None] - MARGIN)
        else:
            rows, columns = np.nonzero(np.ones_like(found, bool))
        return pa.table({"qno": asked["qno"].combine_chunks().take(pa.array(rows)), "id": vectors["id"].combine_chunks().take(pa.array(columns)), "score": pa.array(found[rows, columns], pa.float64())})

    return scores


def _visited(index: CellIndex, visits: DataFrame, asked: DataFrame, chunks: int, k: int) -> DataFrame:
    """(qno, id, score): of every visited block the first ``k`` for each question that visits its cell (qno, cell)."""
    each = visits.join(asked, "qno").join(index.cells.select("cell", "blocks"), "cell")
    each = each.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", "qno", "embedding")
    wanted = visits.join(asked.select("qno", "chunk"), "qno").select("cell", "chunk").distinct()
    blocks = index.vectors.join(wanted, "cell") if chunks > 1 else index.vectors.join(wanted.select("cell").distinct(), "cell", "left_semi").withColumn("chunk", F.lit(0))
    schema = StructType().add("qno", LongType()).add("id", index.vectors.schema["id"].dataType).add("score", DoubleType())
    keys = ("cell", "block", "chunk")
    return blocks.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(_scores(k), schema)


def cell_rank(index: CellIndex, queries: DataFrame, k: int = TOP_K, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(qid, id, score, rank) of the ``k`` vectors with the largest dot product with each query (qid, embedding), exactly; and (qid, scored).

    By the triangle inequality no vector of a cell scores above q.c + |q| r, with its centre c and radius r. Every query scores
    its ``first`` best bounded cells, its k-th score there is a threshold, and of the other cells only those whose bound reaches
    it are scored. ``scored`` is the number of vectors compared with the query. Ties go to the smaller id; queries without
    embedding have no rank.
    """
    chunks = max(1, -(-queries.count() // CHUNK))
    asked = queries.where("embedding is not null").select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = stored(asked.withColumn("qno", F.monotonically_increasing_id()).withColumn("chunk", F.pmod(F.xxhash64("qno"), F.lit(chunks)).cast("int")), "asked")
    radius = np.full(len(index.centres), np.nan)
    for row in index.cells.select("cell", "radius").collect():  # at most CELLS rows
        radius[row["cell"]] = row["radius"]
    context = queries.sparkSession.sparkContext
    schema = StructType().add("qno", LongType()).add("cell", IntegerType()).add("most", DoubleType()).add("place", IntegerType())
    bounds = stored(asked.select("qno", "embedding").mapInArrow(_bounds(context.broadcast(index.centres), context.broadcast(radius)), schema), "bounds")
    own = asked.select("qno", "chunk", "embedding")
    ahead = stored(_visited(index, bounds.where(F.col("place") < first).select("qno", "cell"), own, chunks, k), "ahead")
    best = Window.partitionBy("qno").orderBy(F.desc("score"), "id")
    known = ahead.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("qno", F.col("score").alias("least"))
    others = bounds.where(F.col("place") >= first).join(known, "qno", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - MARGIN)).select("qno", "cell")
    others = stored(others, "visits")
    hits = ahead.unionByName(_visited(index, others, own, chunks, k)).withColumn("score", F.round("score", 6))
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = asked.select("qno", "qid")
    visits = bounds.where(F.col("place") < first).select("qno", "cell").unionByName(others)
    scored = visits.join(index.cells.select("cell", "n"), "cell").groupBy("qno").agg(F.sum("n").alias("scored")).join(names, "qno").select("qid", "scored")
    return ranked.join(names, "qno").select("qid", "id", "score", "rank"), scored

"""Which texts hold which terms, by the rarest character q-gram of each term."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from rankweave.session import stored

#: Characters of a gram; a shorter term is one gram of its own length.
Q = 8
#: Counters of gram frequencies, and bits of the filter of the terms' grams: powers of two, fixed whatever the number of texts and terms.
COUNTERS, FILTER_BITS = 1 << 16, 1 << 24
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _hashes(text: str, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` characters, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found = np.full(n, length, np.uint64)
    for k in range(length):
        found = (found + codes[k : k + n]) * _FACTOR
        found ^= found >> np.uint64(29)
    found *= _MIX
    return found ^ (found >> np.uint64(32))


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.int64)


def _counter(lengths: list[int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                grams = [_slot(_hashes(text.as_py(), n), COUNTERS) for text in batch.column(0).slice(at, 256) for n in lengths]
                total += np.bincount(np.concatenate([np.empty(0, np.int64), *grams]), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    return count


def _rarest(counts) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for term in batch.column(1):
                grams = _hashes(term.as_py(), min(Q, len(term.as_py())))
                keys.append(int(grams[counts.value[_slot(grams, COUNTERS)].argmin()].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64())], ["term_no", "key"])

    return pick


def _meeting(lengths: list[int], wanted) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            places, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for place, text in enumerate(batch.column(1)):
                for length in lengths:
                    grams = _hashes(text.as_py(), length)
                    at = _slot(grams, FILTER_BITS)
                    own = np.unique(grams[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1])
                    places.append(np.full(len(own), place, np.int64))
                    keys.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(places))), pa.array(np.concatenate(keys))], ["id", "key"])

    return meet


def holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, id): texts (id, text) that hold a term (term_id, term) as it stands; null and empty terms are held by none.

    One pass over the texts counts their grams in a table of fixed size; each term takes its rarest gram as its key. A second
    pass keeps the texts' grams that pass a bit filter of the keys, and those join the terms by key; what meets is compared
    whole. Neither texts nor terms are sent to all tasks, and the passes are two whatever the number of terms. A pair can come
    more than once where ids or terms do.
    """
    spark = texts.sparkSession
    terms = stored(terms.where(F.length("term") > 0).select("term_id", "term").withColumn("term_no", F.monotonically_increasing_id()), "terms")
    texts = texts.where("text is not null and id is not null").select("id", "text")
    lengths = [r[0] for r in terms.select(F.least(F.length("term"), F.lit(Q)).alias("n")).distinct().collect()]  # Q rows at most
    slots = texts.select("text").mapInArrow(_counter(lengths), StructType().add("slot", LongType()).add("n", LongType())).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    own = terms.select("term_no", "term").mapInArrow(_rarest(spark.sparkContext.broadcast(counts)), StructType().add("term_no", LongType()).add("key", LongType()))
    keyed = stored(own, "keys")
    # the filter has FILTER_BITS bits in words of 32; the words that have any are read back
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = keyed.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 5).alias("word")).agg(F.sum(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toArrow()
    wanted = np.zeros(FILTER_BITS // 32, np.uint32)
    wanted[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    schema = StructType().add("id", texts.schema["id"].dataType).add("key", LongType())
    met = texts.mapInArrow(_meeting(lengths, spark.sparkContext.broadcast(wanted.tobytes())), schema)
    pairs = stored(met.join(keyed, "key").select("id", "term_no").distinct(), "pairs")
    found = texts.join(pairs, "id").join(terms, "term_no")
    return found.where(F.contains("text", F.col("term"))).select("term_id", "id")

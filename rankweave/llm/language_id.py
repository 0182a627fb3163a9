"""Language identification: words first, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import filtered, release, small_batches
from rankweave.session import drop_stored, stored
from rankweave.sources.tables import spread, table

UNKNOWN = "und"
LONGEST = 5
_LETTERS = regex.compile(r"\p{L}+")


class _Rows:
    """Rows of one matrix by key."""

    def __init__(self, index: dict[str, int], matrix: np.ndarray) -> None:
        self.index, self.matrix = index, matrix

    def get(self, key: str) -> np.ndarray | None:
        at = self.index.get(key)
        return None if at is None else self.matrix[at]


class LanguageModel:
    """Per-language log frequencies of words and of n-grams of 1 to LONGEST characters.

    A known word scores by its own frequencies; of an unseen word the n-grams of the greatest length at which any is known
    score by their mean. A word in which not even a character is known tells nothing.
    """

    def __init__(self, languages: list[str], words: dict[str, np.ndarray] | _Rows, grams: list[dict[str, np.ndarray] | _Rows], kept: int = 200_000) -> None:
        self.languages, self.words, self.grams, self.kept = languages, words, grams, kept
        self._index: dict[str, int] = {}
        self._rows = np.zeros((1024, max(1, len(languages))))

    def __getstate__(self) -> tuple:
        return self.languages, self.words, self.grams, self.kept

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def word(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is not None:
            return found
        marked = f"^{word}$"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            table = self.grams[n - 1]
            parts = [r for i in range(len(marked) - n + 1) if (r := table.get(marked[i : i + n])) is not None]
            if parts:
                return sum(parts) / len(parts)
        return np.zeros(len(self.languages))

    def forget(self) -> None:
        """Drop what was remembered of the texts; what was learned stays."""
        self._index, self._rows = {}, np.zeros((1024, max(1, len(self.languages))))

    def _add(self, words: Iterable[str]) -> None:
        for word in words:
            at = len(self._index)
            if at == len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            self._rows[at] = self.word(word)
            self._index[word] = at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language of the whole text and its share of the likelihood; ties go to the first by name."""
        words = _LETTERS.findall(text.lower()) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if len(self._index) > self.kept:
            self._index.clear()
        self._add(set(words).difference(self._index))
        total = self._rows[np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))].sum(axis=0)
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def held_out(doc_id: Column) -> Column:
    """Rows never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _table(counts: pa.Table, languages: list[str]) -> _Rows:
    """Log frequencies of every item of ``counts`` (lang, item, n) in each language."""
    items = counts["item"].combine_chunks().dictionary_encode()
    codes, names = items.indices.to_numpy(), items.dictionary.to_pylist()
    langs = pc.index_in(counts["lang"].combine_chunks(), pa.array(languages, pa.string())).to_numpy()
    found = np.zeros((len(names), len(languages)))
    found[codes, langs] = counts["n"].to_numpy()
    return _Rows({name: k for k, name in enumerate(names)}, np.log((found + 0.5) / (found.sum(axis=0) + len(names) * 0.5 + 1)).astype(np.float32))


def _cuts(marked: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.length(marked) - n + 1)
    return F.transform(places, lambda i: F.struct(F.lit(n).alias("size"), F.substring(marked, i, F.lit(n)).alias("gram")))


def fit(docs: DataFrame, rows_per_language: int = 1500) -> LanguageModel:
    """Learn from text and lang of ``docs`` that are not held out.

    At most about ``rows_per_language`` documents of each language, drawn by a hash of doc_id, are counted, whole, and all
    of their words and n-grams are kept: this bound on labelled rows is the only one. Rows without text, lang or doc_id
    teach nothing; without any row no language is known.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], {}, [{} for _ in range(LONGEST)])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows_per_language / n))])
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("item"))
    counts = stored(words.groupBy("lang", "item").agg(F.count("*").alias("n")), "words")
    marked = F.concat(F.lit("^"), "item", F.lit("$"))
    none = F.array().cast("array<struct<size:int,gram:string>>")
    cuts = [F.when(F.length(marked) >= n, _cuts(marked, n)).otherwise(none) for n in range(1, LONGEST + 1)]
    grams = counts.select("lang", "n", F.explode(F.concat(*cuts)).alias("g")).groupBy("lang", "g.size", F.col("g.gram").alias("item")).agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    known, pieces = _table(counts.toArrow(), languages), grams.toArrow()
    tables = [_table(pieces.filter(pc.equal(pieces["size"], n)), languages) for n in range(1, LONGEST + 1)]
    drop_stored(counts)
    return LanguageModel(languages, known, tables)


def _predictor(model):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = [own.predict(text.as_py()) for text in batch.column(1)]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        own.forget()
        release()

    return predict


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for every row, from the whole text alone.

    A null text or one without letters is ``und`` with score 0. Other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of fit
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return small_batches(rows).mapInArrow(_predictor(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def _keeper(model, text_at: int, least: float):
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = [own.predict(text.as_py()) for text in batch.column(text_at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))
        own.forget()
        release()

    return keep


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of at least ``least``.

    Rows with a null or empty text, or one without letters, go. Equal rows have one fate; rows without doc_id are judged by
    their text like others. An empty table stays empty; further columns may have any name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of fit
    return filtered(small_batches(docs), _keeper(sent, docs.columns.index("text"), least))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return predict(docs, fit(docs))

"""Benchmark passages in documents: q-gram lemma filtering in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import filtered, small_batches
from rankweave.sources.tables import spread, table

#: Characters of a q-gram; edits allowed as a share of the passage.
Q, EDITS = 10, 0.08
#: Benchmark characters in one broadcast index; code points scanned at once.
INDEX_CHARS, CHUNK = 2_000_000, 1_000_000
#: Shared q-grams that are held at once, by place in text and passage.
HITS = 4_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BREAK = np.uint32(0xFFFFFFFF)


def _fold_table() -> np.ndarray:
    found = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        low = chr(c).lower()
        if chr(c).isspace():
            found[c] = 32
        elif len(low) == 1:
            found[c] = ord(low)
    return found


_FOLD = _fold_table()


def folded(text: str) -> np.ndarray:
    """Code points, lower-cased one by one, all white space as a blank; places stay those of the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 1 << 16, _FOLD[np.minimum(codes, 0xFFFF)], codes).astype(np.uint32)


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(int(_FACTOR), n, 1 << 64))


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams, by doubling."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts, have = {1: codes.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * have <= q:
        p = parts[have]
        parts[2 * have] = p[:-have] * _powers(have) + p[have:]
        have *= 2
    made, size = parts[have], have
    for part in sorted(parts, reverse=True):
        while size + part <= q:
            made = made[: len(codes) - size - part + 1] * _powers(part) + parts[part][size : size + len(codes) - size - part + 1]
            size += part
    made = made[:n]
    return (made ^ (made >> np.uint64(32))) * _FACTOR


class PassageIndex:
    """The q-grams of some passages with their places, and the edits and q-grams each passage allows and needs."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS) -> None:
        self.q = q
        self.ids = [i for i, _ in items]
        self.codes = [folded(t) for _, t in items]
        self.length = np.array([len(c) for c in self.codes], np.int64)
        # the lemma: a match with e edits keeps n - q + 1 - q e q-grams; e is lowered until that is at least 1
        self.edits = np.minimum((self.length * edits).astype(np.int64), np.maximum(0, (self.length - q) // q))
        self.need = np.maximum(1, self.length - q + 1 - q * self.edits)
        self.step = np.maximum(1, self.edits)
        self.short = [k for k, n in enumerate(self.length) if n < q]
        hashes = [grams(c, q) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.values, self.first = np.unique(flat[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(flat)))
        self.item, self.place = item[order], place[order].astype(np.int64)
        bits = max(16, int(len(self.values) * 32).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.values >> self.shift).astype(np.int64)] = True

    def hits(self, codes: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Place in ``codes``, passage, place in the passage of every shared q-gram; None where there are more than ``most``."""
        hashed = grams(codes, self.q)
        at = np.flatnonzero(self.seen[(hashed >> self.shift).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.values, hashed[at]), max(0, len(self.values) - 1))
        same = self.values[found] == hashed[at] if len(self.values) else np.zeros(0, bool)
        at, found = at[same], found[same]
        many = self.many[found]
        if most is not None and many.sum() > most:
            return None
        entry = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
        return np.repeat(at, many), self.item[entry], self.place[entry]

    def regions(self, hits: tuple[np.ndarray, np.ndarray, np.ndarray], starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, passage, from, to) of the diagonal bands with enough q-grams; ``starts`` are the places of the texts that were scanned."""
        at, item, place = hits
        if not len(at):
            return
        text = np.searchsorted(starts, at, "right") - 1
        group = text * len(self.ids) + item
        total = np.bincount(np.unique(group, return_inverse=True)[1])
        enough = total[np.unique(group, return_inverse=True)[1]] >= self.need[item]
        at, item, place, group = at[enough], item[enough], place[enough], group[enough]
        if not len(at):
            return
        diagonal = at - place
        band = np.floor_divide(diagonal, self.step[item])
        # every band spans two steps, so each hit counts in its own and in the one before
        group, band, place = np.tile(group, 2), np.concatenate([band, band - 1]), np.tile(place, 2)
        order = np.lexsort((place, band, group))
        group, band, place = group[order], band[order], place[order]
        new_band = np.append(True, (np.diff(group) != 0) | (np.diff(band) != 0))
        new_place = new_band | np.append(True, np.diff(place) != 0)
        heads = np.flatnonzero(new_band)
        counts = np.add.reduceat(new_place.astype(np.int64), heads)
        for head, count in zip(heads, counts, strict=True):
            passage = int(group[head] % len(self.ids))
            if count >= self.need[passage]:
                e, step = int(self.edits[passage]), int(self.step[passage])
                low = int(band[head]) * step - e
                yield int(group[head] // len(self.ids)), passage, low, low + 2 * step + 2 * e + int(self.length[passage])


def banded_alignment(passage: np.ndarray, text: np.ndarray, band: int) -> tuple[int, int, int]:
    """(edits, start, end) of the passage's best place in ``text``, over diagonals 0 to ``band``: fewest edits, then first."""
    n, unit = len(passage), 1 << 32
    k = np.arange(band + 1)
    padded = np.concatenate([text, np.full(max(0, n + band + 1 - len(text)), _BREAK)])
    cost = k.astype(np.int64)  # a start costs nothing and is carried along
    ramp = k * unit
    for i in range(n):
        across = cost + (padded[i : i + band + 1] != passage[i]) * unit
        across[:-1] = np.minimum(across[:-1], cost[1:] + unit)
        cost = np.minimum.accumulate(across - ramp) + ramp
    best = int(cost.argmin())
    return int(cost[best] // unit), int(cost[best] % unit), min(n + best, len(text))


def matches(index: PassageIndex, texts: list[str | None]) -> list[dict[int, tuple[int, int, int]]]:
    """For each text, passage -> (edits, start, end) of its best match within the edit budget, over the whole text."""
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    reach = int((index.length + 4 * index.step + 4 * index.edits).max(initial=index.q)) + index.q

    def flush(parts: list[tuple[int, int, np.ndarray]]) -> None:
        codes = np.concatenate([x for _, _, p in parts for x in (p, np.array([_BREAK], np.uint32))])
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for _, _, p in parts])[:-1]])
        whole = len(parts) == 1 and len(codes) <= 4 * reach
        hits = index.hits(codes, None if whole else HITS)
        if hits is None:  # very repetitive texts: in halves, which overlap where one text is parted
            if len(parts) > 1:
                flush(parts[: len(parts) // 2])
                flush(parts[len(parts) // 2 :])
            else:
                (k, at, piece), half = parts[0], len(parts[0][2]) // 2
                flush([(k, at, piece[: half + reach])])
                flush([(k, at + half, piece[half:])])
            return
        for part, passage, low, high in index.regions(hits, starts):
            text, offset, own = parts[part]
            low, high = low - int(starts[part]), min(len(own), high - int(starts[part]))
            target, e = index.codes[passage], int(index.edits[passage])
            region = np.concatenate([np.full(max(0, -low), _BREAK), own[max(0, low) : max(0, high)]])
            edits, start, end = banded_alignment(target, region, max(0, len(region) - len(target) + e))
            if edits <= e:
                new = (edits, offset + max(0, low + start), offset + max(0, low + end))
                found[text][passage] = min(new, found[text].get(passage, new))

    parts, held = [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        codes = folded(text)
        for passage in index.short:
            own = index.codes[passage]
            windows = np.lib.stride_tricks.sliding_window_view(codes, len(own)) if 0 < len(own) <= len(codes) else np.zeros((0, 1))
            exact = np.flatnonzero((windows == own).all(axis=1)) if len(windows) else []
            if len(exact):
                found[k][passage] = (0, int(exact[0]), int(exact[0]) + len(own))
        for at in range(0, max(1, len(codes)), CHUNK):
            piece = codes[at : at + CHUNK + reach]
            parts.append((k, at, piece))
            held += len(piece)
            if held >= CHUNK:
                flush(parts)
                parts, held = [], 0
    if parts:
        flush(parts)
    return found


def _indexes(benchmark: DataFrame) -> Iterator[PassageIndex]:
    """Indexes of the whole benchmark, in blocks of about INDEX_CHARS characters, so that each broadcast is bounded."""
    items = benchmark.where("length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = -(-chars // INDEX_CHARS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if rows:
            yield PassageIndex(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def _finder(index):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), matches(own, batch.column(1).to_pylist()), strict=True):
                rows += [(doc_id, own.ids[p], start, end, edits) for p, (edits, start, end) in sorted(found.items())]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

    return find


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: the best place of every benchmark passage that a document holds.

    Case and kinds of white space are ignored; up to 8 % of a passage's characters may be edited (fewer where the q-gram
    lemma asks: passages under 10 characters must be exact). All documents are scanned whole against the whole benchmark,
    in bounded blocks of passages. Null or empty texts and passages match nothing; equal rows each have their results; of
    equally good places the first counts. Empty tables give no rows; other columns are ignored.
    """
    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    context, result = docs.sparkSession.sparkContext, None
    for index in _indexes(benchmark):
        found = docs.mapInArrow(_finder(context.broadcast(index)), "doc_id long, item_id long, start long, end long, edits long")
        result = found if result is None else result.unionAll(found)
    return docs.limit(0).selectExpr("doc_id", "doc_id item_id", "doc_id start", "doc_id end", "doc_id edits") if result is None else result


def _keeper(index, text_at: int):
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x for x in matches(index.value, batch.column(text_at).to_pylist())], pa.bool_()))

    return keep


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage, as :func:`find_passages` would find it.

    Rows with a null or empty text stay, and so do all rows where the benchmark is empty. Equal rows have one fate; an empty
    table stays empty; further columns may have any name.
    """
    context = small_batches(docs).sparkSession.sparkContext
    for index in _indexes(benchmark):
        docs = filtered(docs, _keeper(context.broadcast(index), docs.columns.index("text")))
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))

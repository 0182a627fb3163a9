"""Token ids in range-coded binary files.

A file holds the ids of consecutive documents. Its ids are cut into segments; the blocks of a segment share one
frequency table and are coded each on its own by a static range asymmetric numeral system (rANS) with interleaved
lanes. The footer has a checkpoint for every block (place, words, symbols, checksum), so any block can be decoded alone,
in parallel, and a damaged one is noticed.

File layout, little endian::

    magic 8 | segment: table, block, block, ... | segment ... | document table | footer | footer offset 8, length 8, crc 4, magic 8

A block is its lanes' end states (8 bytes each) followed by 4-byte words in reading order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.llm.common import small_batches
from rankweave.session import new_scratch_path
from rankweave.sources.tables import table

MAGIC = b"RWTOKEN1"
SCALE_BITS = 20
SCALE = 1 << SCALE_BITS
LOW = 1 << 31
LANES = 64
BLOCK = 1 << 16
SEGMENT = 1 << 22
END_ID = 0

#: White space other than blanks and line feeds, and what one of the pattern languages may take for it.
_OTHER_SPACE = "\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A blank and a word, or white space: all of it at the end, else all but its last character, or that alone. Other white space is left out.
_UNIT = re.compile(f" ?[^ \n{_OTHER_SPACE}]+|[ \n]+(?![^ \n])|[ \n]")
#: A word of letters and the marks after it, which the pre-tokenizer parts there.
_MARKED = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@]*)")


def _byte_names() -> dict[int, str]:
    """What byte-level models call each byte: printing ones by their character, the others by those from U+0100 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTES = _byte_names()


# ---------------------------------------------------------------- coder


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of the symbols that occur, at least 1 each, that add up to SCALE."""
    if len(counts) > SCALE:
        raise ValueError(f"at most {SCALE} different symbols can be coded, not {len(counts)}")
    freq = np.maximum(1, counts.astype(np.int64) * SCALE // int(counts.sum()))
    order = np.argsort(-freq, kind="stable")
    short = SCALE - int(freq.sum())
    if short > 0:
        freq[order[0]] += short
    elif short < 0:
        room = np.cumsum(freq[order] - 1)
        taken = np.minimum(room, -short)
        freq[order] -= np.diff(taken, prepend=0)
    return freq


def encode_segment(ids: np.ndarray, lanes: int = LANES, block: int = BLOCK) -> tuple[bytes, list[tuple[bytes, int, int, int]]]:
    """The packed frequency table, and for each block its bytes, words, symbols and checksum."""
    tally = np.bincount(ids)
    symbols = np.flatnonzero(tally)
    counts = tally[symbols]
    place = np.zeros(len(tally), dtype=np.uint32)
    place[symbols] = np.arange(len(symbols))
    freq = quantised(counts)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    freq = freq.astype(np.uint64)
    packed = zlib.compress(np.concatenate([np.diff(symbols.astype(np.int64), prepend=0), freq.astype(np.int64)]).astype("<u4").tobytes(), 6)
    steps = -(-min(block, len(ids)) // lanes)
    block = steps * lanes
    blocks = -(-len(ids) // block)
    padded = np.zeros(blocks * block, dtype=np.uint32)
    padded[: len(ids)] = place[ids]
    dealt = np.ascontiguousarray(padded.reshape(blocks, steps, lanes).transpose(1, 0, 2))
    state = np.full((blocks, lanes), LOW, dtype=np.uint64)
    out = np.empty((steps, blocks, lanes), dtype=np.uint32)
    full = np.empty((steps, blocks, lanes), dtype=bool)
    limit, bits, half = np.uint64(43), np.uint64(SCALE_BITS), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        f = freq[dealt[s]]
        full[s] = state >= f << limit
        out[s] = state.astype(np.uint32)
        state = np.where(full[s], state >> half, state)
        q = state // f
        state = (q << bits) + (state - q * f) + cum[dealt[s]]
    made = []
    for b in range(blocks):
        words = out[:, b][full[:, b]]
        own = ids[b * block : (b + 1) * block]
        made.append((state[b].astype("<u8").tobytes() + words.astype("<u4").tobytes(), len(words), len(own), zlib.crc32(own.astype("<u4").tobytes())))
    return packed, made


def decode_blocks(packed: bytes, blocks: list[tuple[bytes, int, int, int]], lanes: int = LANES) -> list[np.ndarray]:
    """The ids of some blocks of one segment, each checked against its checksum."""
    flat = np.frombuffer(zlib.decompress(packed), dtype="<u4").astype(np.int64)
    symbols, freq = np.cumsum(flat[: len(flat) // 2]).astype(np.uint32), flat[len(flat) // 2 :]
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    freq = freq.astype(np.uint64)
    steps = max(-(-n // lanes) for _, _, n, _ in blocks)
    state = np.stack([np.frombuffer(raw, dtype="<u8", count=lanes) for raw, *_ in blocks]).astype(np.uint64)
    words = np.concatenate([*(np.frombuffer(raw, dtype="<u4", offset=8 * lanes) for raw, *_ in blocks), np.zeros(1, "<u4")]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([n for _, n, _, _ in blocks])[:-1]]).astype(np.int64)
    last, ends = len(words) - 1, at + np.array([n for _, n, _, _ in blocks])
    index = np.empty((steps, len(blocks), lanes), dtype=np.uint32)
    mask, bits, half, low = np.uint64(SCALE - 1), np.uint64(SCALE_BITS), np.uint64(32), np.uint64(LOW)
    for s in range(steps):
        slot = state & mask
        found = slots[slot]
        index[s] = found
        state = freq[found] * (state >> bits) + slot - cum[found]
        need = state < low
        place = np.minimum(at[:, None] + np.cumsum(need, axis=1) - 1, last)
        state = np.where(need, state << half | words[np.maximum(place, 0)], state)
        at = np.minimum(at + need.sum(axis=1), ends)
    ids = []
    for b, (_, _, n, crc) in enumerate(blocks):
        own = symbols[index[:, b].reshape(-1)[:n]]
        if zlib.crc32(own.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of token ids does not have its checksum")
        ids.append(own)
    return ids


# ---------------------------------------------------------------- files


class TokenFileWriter:
    """Streams documents' ids into one file; at most one segment is held in memory."""

    def __init__(self, sink, segment: int = SEGMENT) -> None:
        self.sink, self.segment, self.at = sink, segment, 0
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        self.segments: list[dict] = []
        self.docs: list[tuple[int, int, int]] = []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> int:
        at = self.at
        self.sink.write(raw)
        self.at += len(raw)
        return at

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.segment:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        while len(ids) >= self.segment or whole and len(ids):
            own, ids = ids[: self.segment], ids[self.segment :]
            packed, blocks = encode_segment(own)
            entry = {"table": [self._put(packed), len(packed), zlib.crc32(packed)], "blocks": []}
            for raw, n_words, n_symbols, crc in blocks:
                entry["blocks"].append([self._put(raw), len(raw), n_words, n_symbols, crc])
            self.segments.append(entry)
        self.held, self.n_held = [ids], len(ids)

    def close(self) -> None:
        self._flush(whole=True)
        docs = np.array(self.docs, dtype="<i8").reshape(-1, 3)
        packed = zlib.compress(docs.tobytes(), 6)
        footer = json.dumps({"lanes": LANES, "segments": self.segments, "docs": [self._put(packed), len(packed), len(docs)], "tokens": self.n_tokens}).encode()
        at = self._put(footer)
        self._put(struct.pack("<QQI", at, len(footer), zlib.crc32(footer)) + MAGIC)


class TokenFile:
    """Random access to a token file by its footer."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        at, length, crc = struct.unpack("<QQI", self._read(size - 28, 20))
        if self._read(size - 8, 8) != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        raw = self._read(at, length)
        if zlib.crc32(raw) != crc:
            raise ValueError("the footer of a token file does not have its checksum")
        self.footer = json.loads(raw)

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def documents(self) -> np.ndarray:
        """Rows of doc_id, whether it is null, and number of ids."""
        at, length, _ = self.footer["docs"]
        return np.frombuffer(zlib.decompress(self._read(at, length)), dtype="<i8").reshape(-1, 3)

    def blocks(self, segment: int, first: int = 0, last: int | None = None) -> list[np.ndarray]:
        """The ids of blocks ``first`` to ``last`` (not included) of a segment."""
        entry = self.footer["segments"][segment]
        at, length, crc = entry["table"]
        packed = self._read(at, length)
        if zlib.crc32(packed) != crc:
            raise ValueError("a frequency table does not have its checksum")
        chosen = entry["blocks"][first:last]
        raw = self._read(chosen[0][0], chosen[-1][0] + chosen[-1][1] - chosen[0][0])
        return decode_blocks(packed, [(raw[b[0] - chosen[0][0] :][: b[1]], *b[2:]) for b in chosen], self.footer["lanes"])

    def ids_by_document(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; a segment is decoded at a time."""
        rest, segment = np.zeros(0, np.uint32), 0
        for doc_id, null, n in self.documents():
            parts = [rest]
            while sum(map(len, parts)) < n:
                parts += self.blocks(segment)
                segment += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield (None if null else int(doc_id)), rest[:n]
            rest = rest[n:]


# ---------------------------------------------------------------- tokens


class _Units(dict):
    """The ids of units as bytes; what is not known is encoded."""

    def __init__(self, tokenizer, kind: str) -> None:
        self.tokenizer, self.model, self.kind = tokenizer, tokenizer.model, kind

    def ids(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Of letters alone, perhaps after a blank: one piece for the pre-tokenizer, so the library's model gets it at once."""
        shown = word.replace(" ", "Ġ") if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        if m := _MARKED.fullmatch(unit):
            letters, marks = m.groups()
            found = self[letters] + self[marks] if marks else self.word(letters)
        else:
            found = self.ids(unit)
        self[unit] = found
        return found

    def forget(self, kept: int) -> None:
        """Keep the units that came first: common ones come early."""
        first = list(islice(self.items(), kept))
        self.clear()
        self.update(first)


class UnitEncoder:
    """Ids of whole texts, as the tokenizer gives them for the whole text, special tokens in a text included.

    A byte-level pre-tokenizer with its own pattern never joins what stands on both sides of white space, and puts a single
    blank before a word to that word. So where the tokenizer file says that this is its only pre-tokenizer, the ids of a
    text whose white space is blanks and line feeds are those of its units in order, and a unit that comes again is not
    encoded again. All else is encoded whole: texts with other white space or with the text of an added token in them, and
    every text of another kind of tokenizer. At most about ``kept`` units are remembered between texts.
    """

    def __init__(self, path: str, kept: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, kind = (np.dtype("<u2"), "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.dtype("<u4"), "I")
        self.units, self.kept = _Units(self.tokenizer, kind), kept
        plan = json.loads(self.tokenizer.to_str())
        cutter, model = plan.get("pre_tokenizer") or {}, plan.get("model") or {}
        self.by_units = (
            cutter.get("type") == "ByteLevel" and cutter.get("use_regex") is True and cutter.get("add_prefix_space") is False and model.get("type") == "BPE"
            and not any(plan.get(k) for k in ("normalizer", "truncation", "padding")) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        self.added = [t["content"] for t in plan.get("added_tokens") or ()]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self.by_units and not any(x in text for x in self.added):
            own = _UNIT.findall(text)
            if "".join(own) == text:
                if len(self.units) > self.kept:
                    self.units.forget(self.kept // 2)
                return np.frombuffer(b"".join(map(self.units.__getitem__, own)), self.dtype)
        return np.frombuffer(self.units.ids(text), self.dtype)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def _writer(tokenizer_path: str, folder: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{task.taskAttemptId()}.tok"
        draft = f"{root}/.{name}.draft"
        own, n_docs = encoder(tokenizer_path), 0
        with fs.open_output_stream(draft) as sink:
            out = TokenFileWriter(sink)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    out.add(doc_id, np.append(own.encode(text.as_py()), own.dtype.type(END_ID)))
                n_docs += len(batch)
            out.close()
        fs.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [n_docs], "n_tokens": [out.n_tokens], "n_bytes": [out.at]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Encode every whole text, append the end id, and write files in ascending doc_id order.

    Documents are dealt by ranges of doc_id (null first, equal ids by text), so part numbers follow the order and no task
    holds more than its range; a task keeps one segment in memory. A null text is empty: its document is the end id
    alone. An empty table gives no documents. A file's name holds the attempt of its task; the manifest names those that count.
    Returns the manifest (part, path, n_docs, n_tokens, n_bytes, start), start being the ids of all files before.
    """
    ordered = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(_writer(tokenizer_path, folder), "part int, path string, n_docs long, n_tokens long, n_bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    spark = docs.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return spark.read.parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _reader(folder: str):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['path']}") as source:
                    at, found = row["start"], []
                    for doc_id, ids in TokenFile(source, row["n_bytes"]).ids_by_document():
                        found.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)
                            found = []
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return read


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the checksum of its ids. Files are dealt one to a task."""
    files = manifest.select("path", "n_bytes", "start")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files under ``folder`` (the shared scratch folder where None) and read them back."""
    folder = folder or new_scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, folder), folder)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

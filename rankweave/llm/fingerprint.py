"""Order MinHash fingerprints of documents, in DataFrame operations alone.

A text is cut into small tokens that cover every character, ended by what the characters are and not by how many came before
(at a few letters and digits, at white space, at every character of scripts without spaces), so an inserted character moves
the ends next to it alone. A k-mer is K tokens in a row. Every occurrence of a k-mer is
an element of its own, numbered by how often the k-mer came before. One hash of k-mer and number places the elements on a
ring; each of SLOTS equally spaced points selects the TUPLE elements that follow it (hash functions that are rotations of
one another), puts them back in the order of the text and hashes the tuple. Two texts agree in a slot when they share both
the selected elements and their order, so the share of equal slots falls with insertions, deletions and with rearrangement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.session import checkpointed, drop_stored, stored
from rankweave.sources.tables import spread, table

K, SLOTS = 4, 64
#: Scripts that are written without spaces: each character is a token. Characters that end a token; longest token.
_ALONE = "".join(rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
_ENDS, LONGEST = "aeoAEO05/", 8
#: A character of such a script, or others up to one that ends a token with the white space after them, or space.
TOKEN = rf"([{_ALONE}]|[^\s{_ALONE}{_ENDS}]{{0,{LONGEST - 1}}}[{_ENDS}]\s?|[^\s{_ALONE}{_ENDS}]{{1,{LONGEST}}}\s?|\s)"
#: The same tokens without scripts looked up for ASCII characters, and without going back: no character stands in two of the classes.
_PLAIN = "".join(rf"\x{k:02x}" for k in range(0x21, 0x7F) if chr(k) not in _ENDS)
_OTHER = rf"[[{_PLAIN}][^\s{_ALONE}{_ENDS}]]"
_FAST_TOKEN = rf"{_OTHER}{{1,{LONGEST - 1}}}+(?:[{_ENDS}]|{_OTHER}?+)\s?+|[{_ENDS}]\s?+|\s|[{_ALONE}]"
#: An element is a long: a hash in the upper bits, its place in the text in the lower (in steps where there are more places).
PLACE_BITS = 24
_PLACE = (1 << PLACE_BITS) - 1
_HASH = ~_PLACE


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _elements(tokens: Column) -> Column:
    """Sorted elements of the k-mers of the token hashes; texts of fewer than K tokens have one k-mer, empty ones none."""
    kmer = lambda t, place: lambda h, i: F.xxhash64(h, *[F.get(t, i + j) for j in range(1, K)]).bitwiseAND(F.lit(_HASH)).bitwiseOR(place(i).cast("long"))
    first = lambda t: F.slice(t, 1, F.least(F.size(t), F.greatest(F.size(t) - (K - 1), F.lit(1))))
    near, far = lambda i: i, lambda i: F.shiftright(i, 31 - PLACE_BITS)
    made = lambda t: F.when(F.size(t) <= 1 << PLACE_BITS, F.transform(first(t), kmer(t, near))).otherwise(F.transform(first(t), kmer(t, far)))
    return _let(tokens, lambda t: F.sort_array(made(t)))


def _runs(sorted_elements: Column) -> Column:
    """Numbers 0, 1, 2, ... within each run of elements with one hash, in sorted order."""
    same = lambda e, i: F.get(e, i).bitwiseAND(F.lit(_HASH))
    heads = lambda e: F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (same(e, i) != same(e, i - 1)))
    lengths = lambda e, h: F.transform(h, lambda at, j: F.coalesce(F.get(h, j + 1), F.size(e)) - at)
    return _let(sorted_elements, lambda e: _let(heads(e), lambda h: F.flatten(F.transform(lengths(e, h), lambda n: F.sequence(F.lit(0), n - 1)))))


def _ring(sorted_elements: Column) -> Column:
    """Of the numbered elements, sorted, those that a point can select or that can follow one.

    The first occurrences keep their hash and their order; the others are hashed anew with their number. Of the former, the
    first two of each bucket are enough: in its bucket, at most one stands before the one that follows the first.
    """
    again = lambda e: lambda x, i: (i > 0) & (x.bitwiseXOR(F.get(e, i - 1)).bitwiseAND(F.lit(_HASH)) == 0)
    once = lambda e: F.filter(e, lambda x, i: ~again(e)(x, i))
    early = lambda f: F.filter(f, lambda x, i: (i < 2) | (F.shiftright(x, 58) != F.shiftright(F.get(f, i - 2), 58)))
    anew = lambda x, n: F.xxhash64(x.bitwiseAND(F.lit(_HASH)), n + 1).bitwiseAND(F.lit(_HASH)).bitwiseOR(x.bitwiseAND(F.lit(_PLACE)))
    others = lambda e: _let(F.filter(e, again(e)), lambda r: F.zip_with(r, _runs(r), anew))
    return _let(sorted_elements, lambda e: _let(once(e), lambda f: F.when(F.size(f) == F.size(e), early(f)).otherwise(F.sort_array(F.concat(early(f), others(e))))))


def fingerprint(text: Column) -> Column:
    """The SLOTS tuple hashes of a text (null: empty) as an array of ints; equal texts have equal ones."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_FAST_TOKEN), 0), lambda w: F.xxhash64(w))
    bucket = lambda x: F.shiftright(x, 58) + SLOTS // 2
    starts = lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (bucket(F.get(r, i)) != bucket(F.get(r, i - 1))))
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))
    value = lambda x: x.bitwiseAND(F.lit(_HASH))
    ordered = lambda x, y: F.when(place(x) <= place(y), F.hash(value(x), value(y))).otherwise(F.hash(value(y), value(x)))
    tuple_at = lambda r, i: ordered(F.get(r, i), F.coalesce(F.get(r, i + 1), F.get(r, F.lit(0))))

    def slots(ring: Column) -> Column:
        """The points up to the first bucket with elements select its first one, and so on; points after the last wrap."""
        return _let(starts(ring), lambda s: F.concat(
            F.flatten(F.transform(s, lambda i, j: F.array_repeat(tuple_at(ring, i), (bucket(F.get(ring, i)) - F.when(j == 0, F.lit(-1)).otherwise(bucket(F.get(ring, F.get(s, j - 1))))).cast("int")))),
            F.array_repeat(tuple_at(ring, F.lit(0)), (SLOTS - 1 - bucket(F.get(ring, F.size(ring) - 1))).cast("int")),
        ))

    none = F.array_repeat(F.lit(0), SLOTS)
    return _let(_elements(tokens), lambda e: F.when(F.size(e) == 0, none).otherwise(_let(_ring(e), slots)))


def likeness(left: Column, right: Column) -> Column:
    """The share of equal slots."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(SLOTS))


def as_string(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, key, no, n_chars) -> the same with next_key, next_no, before_key, before_no, lent.

    The next document follows in descending order of doc_id (null last; equal ids by key and no), the first after the last.
    ``lent`` is how many characters the document before takes from this one: a third of its own length. Rows are dealt by
    ranges of that order and numbered within; only the numbers of rows of the ranges are added up, so no task sees all rows.
    """
    order = [F.desc_nulls_last("doc_id"), F.col("key"), F.col("no")]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    dealt = checkpointed(dealt)
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("least"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    numbered = checkpointed(dealt.join(F.broadcast(parts.select("part", "least", "first", "total")), "part").select("doc_id", "key", "no", "n_chars", "total", (F.col("row") - F.col("least") + F.col("first")).alias("at")))
    after = numbered.select(F.col("key").alias("next_key"), F.col("no").alias("next_no"), F.col("at").alias("next_at"))
    ahead = numbered.select(F.col("key").alias("before_key"), F.col("no").alias("before_no"), F.floor(F.col("n_chars") / 3).alias("lent"), F.col("at").alias("before_at"))
    found = numbered.join(after, F.pmod(numbered.at + 1, numbered.total) == F.col("next_at")).join(ahead, F.pmod(F.col("at") - 1, F.col("total")) == F.col("before_at"))
    return found.select("doc_id", "key", "no", "n_chars", "next_key", "next_no", "before_key", "before_no", "lent")


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds key, n_chars and no: rows that share a key get numbers by length and hash of the text.

    The key to deal by is the doc_id, or a hash of the text where there is none. Where the text isn't used, it isn't dealt;
    where it is, the joins by key find it dealt already.
    """
    key = F.coalesce("doc_id", F.xxhash64(F.lit("no id"), "text"))
    docs = docs.withColumns({"key": key, "n_chars": F.length("text").cast("long"), "h": F.xxhash64("text")})
    return docs.withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("n_chars", "h", F.col("doc_id").isNull()))).drop("h")


def _same(left: str, right: str) -> Column:
    """Joined by document number alone, so that one partitioning by it serves all joins; null numbers are one number."""
    return (F.col(f"{left}.key") == F.col(f"{right}.key")) & (F.col(f"{left}.no") <= F.col(f"{right}.no")) & (F.col(f"{left}.no") >= F.col(f"{right}.no"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness, and that to the next document's.

    The edited text has the last floor(n_chars / 3) characters replaced by the first as many (or all) of the next document,
    in descending order of doc_id, the first after the last. A null text is empty; empty texts have a fingerprint of zeros.
    Rows that share a doc_id follow one another by length of the text; rows without doc_id come last, by a hash of the text. A document alone is its own next.
    Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    near = stored(neighbours(_numbered(docs).select("doc_id", "key", "no", "n_chars")), "neighbours")
    texts = _numbered(docs).select("key", "no", "text")
    lent = texts.alias("t").join(near.alias("n"), _same("t", "n")).select(F.col("before_key").alias("key"), F.col("before_no").alias("no"), F.expr("left(t.text, cast(lent as int))").alias("part"))
    pair = texts.alias("t").join(near.alias("n"), _same("t", "n")).select("doc_id", "t.key", "t.no", "t.text", "n_chars", "next_key", "next_no").alias("a")
    pair = pair.join(lent.alias("b"), _same("a", "b"))
    edited = F.concat(F.expr("left(a.text, cast(n_chars - floor(n_chars / 3) as int))"), F.col("part"))
    made = pair.select("doc_id", "a.key", "a.no", "n_chars", "next_key", "next_no", F.col("a.text").alias("text"), edited.alias("edited"))
    made = made.select("doc_id", "key", "no", "n_chars", "next_key", "next_no", fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("changed"), F.sha2("edited", 256).alias("edited_sha256"))
    made = stored(made, "fingerprints")
    follower = made.select(F.col("key").alias("next_key"), F.col("no").alias("next_no"), F.col("own").alias("next"))
    result = made.join(follower, ["next_key", "next_no"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
    drop_stored(near)
    return result


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))

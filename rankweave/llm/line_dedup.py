"""Lines that repeat an earlier line, exactly or nearly: an exact set-similarity join.

Counting, cutting, dealing, joining and verifying are DataFrame operations. :func:`word_hashes` and :func:`token_rows` cut
the bytes of a text by numpy, for callers outside Spark; no query runs them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.session import drop_stored, stored
from rankweave.sources.tables import spread, table

#: Percent of the union that similar lines share.
PERCENT = 75
#: Cells in which tokens are counted for their rarity; classes of a count to a doubling.
CELLS, CLASSES = 1 << 16, 4
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20
#: Lists of a line whose earliest member is tried first.
TRIED = 2
#: Most lines whose places are broadcast (about 30 MB).
SENT = 1_000_000
_LAST, _NUMBER = (1 << 63) - 1, (1 << 31) - 1
#: Bit of a posting that says that its line is removed already.
_GONE = 1 << 62

_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, key and text: the document's place in the order, and bits of the hash of its text that tell rows of one doc_id apart."""
    key = F.xxhash64("text").bitwiseAND(F.lit(~_NUMBER))
    return docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), key.alias("key"), "text")


def _plain(text: Column) -> Column:
    """Lower case, with a blank for every other white space than a line feed."""
    return F.lower(F.when(text.rlike("[\t\x0b\x0c\r]"), F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text))


# ---------------------------------------------------------------- words and tokens of lines


class _Powers:
    """Powers of the hash's factor and of its inverse, as many as a piece of text needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE + 64)
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _FACTOR)]))
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BACK)]))
        return cls.up, cls.down


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` (parted by blanks and line feeds) and the places where they begin."""
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            ends = [e for e in (data.find(b" ", end), data.find(b"\n", end)) if e >= 0]
            end = min(ends, default=len(data))
        piece = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        gap = np.concatenate([[True], (piece == 32) | (piece == 10), [True]])
        first, last = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        up, down = _Powers.upto(len(piece))
        total = np.concatenate([[np.uint64(0)], np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)])])
        value = (total[last] - total[first]) * down[first]
        value = (value ^ (value >> np.uint64(33))) * _MIX
        value = (value ^ (value >> np.uint64(29))) * _FACTOR
        hashes.append(value ^ (value >> np.uint64(32)))
        places.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def token_rows(data: bytes, classes: np.ndarray) -> dict[str, np.ndarray]:
    """The lines of ``data`` that have words: line, s and s2 (of the set), n, x, y, and the tokens of their prefixes one after another with how many each has.

    Tokens are the distinct words, the rarest first. s and s2 are 128 bits that do not depend on order; x and y have 128
    more, each token turns over one of them, so two sets differ in at least as many tokens as bits.
    """
    hashes, places = word_hashes(data)
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(feeds, places)
    new = np.append(True, line[1:] != line[:-1]) if len(line) else np.zeros(0, bool)
    rank, numbers = np.cumsum(new) - 1, line[new]
    bits = max(1, int(len(numbers)).bit_length())
    token = (classes[_cells(hashes)].astype(np.uint64) << np.uint64(57) | hashes >> np.uint64(7)) >> np.uint64(bits)
    order = np.argsort(rank.astype(np.uint64) << np.uint64(64 - bits) | token)
    rank, hashes = rank[order], hashes[order]
    kept = np.append(True, (rank[1:] != rank[:-1]) | (hashes[1:] != hashes[:-1])) if len(rank) else np.zeros(0, bool)
    rank, hashes = rank[kept], hashes[kept]
    starts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(rank)))
    if not len(starts):
        return {"line": numbers, "s": numbers, "s2": numbers, "n": n, "x": numbers, "y": numbers, "many": n, "first": np.zeros(0, np.int32)}
    s = np.add.reduceat((hashes ^ (hashes >> np.uint64(31))) * _MIX, starts)
    s2 = np.add.reduceat((hashes ^ (hashes >> np.uint64(27))) * _FACTOR, starts)
    bit = np.uint64(1) << (hashes >> np.uint64(33) & np.uint64(63))
    x, y = (np.bitwise_xor.reduceat(np.where(hashes >> np.uint64(39) & np.uint64(1) == half, bit, 0), starts).view(np.int64) for half in (0, 1))
    # how many of the rarest tokens must hold one that any similar line has too; of 1 or 2 words, 75 % of the union are all
    many = np.where(n > 2, n + n * -PERCENT // 100 + 1, 0)
    at = np.arange(len(rank)) - starts[rank]
    first = (hashes[at < many[rank]] & np.uint64(_NUMBER)).astype(np.int32)
    return {"line": numbers, "s": s.view(np.int64), "s2": s2.view(np.int64), "n": n, "x": x, "y": y, "many": many, "first": first}


def _tokens(docs: DataFrame) -> DataFrame:
    """doc, ln, s, s2, n and the tokens of every line of ``docs`` (doc, key, text) that has words.

    Tokens are 31 bits of the hashes of the line's distinct words; words that share them count one by one. s and s2 are
    128 bits of the set of hashes.
    """
    sets = _lines(docs).where(F.trim("line") != "").select("doc", "ln", F.sort_array(_hashes(F.col("line"))).alias("words"))
    tokens = F.transform("words", lambda h: h.bitwiseAND(F.lit(_NUMBER)).cast("int"))
    return sets.select("doc", "ln", F.xxhash64("words").alias("s"), F.xxhash64(F.lit(1), "words").alias("s2"), F.size("words").alias("n"), tokens.alias("tokens"))


def _rarity(lines: DataFrame) -> Column:
    """For each cell of tokens the class of its count, as an array. All tokens of all lines are counted."""
    counts = lines.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.count("*").alias("n"))
    classes = ["0"] * CELLS
    for cell, found in counts.select("cell", F.floor(F.log2("n") * CLASSES).cast("int")).collect():  # CELLS rows at most
        classes[cell] = str(found)
    return F.split(F.lit(",".join(classes)), ",").cast("array<short>")


def _prefix(classes: Column) -> Column:
    """The rarest tokens of a line, as many as must hold one that any similar line has too; of 1 or 2 words, 75 % of the union are all."""
    ranked = F.sort_array(F.transform("tokens", lambda t: F.shiftleft(F.get(classes, t.bitwiseAND(F.lit(CELLS - 1))).cast("long"), 31).bitwiseOR(t.cast("long"))))
    many = F.when(F.col("n") > 2, F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("int") + 1).otherwise(0)
    return F.transform(F.slice(ranked, F.lit(1), many), lambda t: t.bitwiseAND(F.lit(_NUMBER)).cast("int"))


def _turned(one: Callable[[Column], Column]) -> Column:
    """64 bits of a line: each token t turns over the bit t modulo 64 if ``one(t)`` is 1."""
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(F.call_function("shiftleft", one(t), t)))


def _lines(docs: DataFrame) -> DataFrame:
    """doc, ln and line of every line of ``docs`` (doc, key, text); ln holds the key above and the number from 0 below."""
    lines = docs.select("doc", "key", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("at", "line"))
    return lines.select("doc", F.col("key").bitwiseOR(F.col("at")).alias("ln"), "line")


def _hashes(line: Column) -> Column:
    """Hashes of the line's distinct words."""
    words = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(words), F.xxhash64(F.lit("")))


# ---------------------------------------------------------------- the join


def _before(a: str, b: str) -> Column:
    of = lambda side, c: F.col(f"{side}.{c}")
    return (of(a, "doc") < of(b, "doc")) | ((of(a, "doc") == of(b, "doc")) & (of(a, "ln") < of(b, "ln")))


def _possible(n: Column, m: Column) -> Column:
    """Whether the numbers of tokens (``n`` of a, ``m`` of b) and the bits let two lines be similar."""
    needed = F.ceil((n + m) * PERCENT / (100 + PERCENT))
    differ = F.bit_count(F.col("a.x").bitwiseXOR(F.col("b.x"))) + F.bit_count(F.col("a.y").bitwiseXOR(F.col("b.y")))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (differ <= n + m - needed * 2)


def _sets(places: DataFrame, docs: DataFrame) -> DataFrame:
    """place and words (hashes of the distinct words) of the lines of ``docs`` at ``places`` (doc, ln): they alone are cut again."""
    wanted = stored(places.distinct(), "wanted")
    own = wanted.select("doc", F.col("ln").bitwiseAND(F.lit(~_NUMBER)).alias("key"), _number("ln").alias("at"), F.struct("doc", "ln").alias("place"))
    # rows that share doc_id and text bring their lines twice
    texts = docs.join(F.broadcast(own) if wanted.count() <= SENT else own, ["doc", "key"])
    cut = texts.select("place", F.get(F.split("text", "\n"), F.col("at")).alias("line")).dropDuplicates(["place"])
    sets = stored(cut.select("place", _hashes(_plain(F.col("line"))).alias("words")), "sets")
    drop_stored(wanted)
    return sets


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(late, early): those of ``pairs`` that are similar on their whole sets, one early line for each late one."""
    of = lambda side, words: sets.select(F.col("place").alias(side), F.col("words").alias(words))
    pairs = stored(pairs, "compared")
    found = (F.broadcast(pairs) if pairs.count() <= SENT // 2 else pairs).join(of("early", "p"), "early").join(of("late", "q"), "late")
    both = F.size(F.array_intersect("p", "q"))
    found = stored(found.where(both * 100 >= PERCENT * (F.size("p") + F.size("q") - both)).groupBy("late").agg(F.min("early").alias("early")), "found")
    drop_stored(pairs)
    return found


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(late, early): the pairs of places (doc, ln) that are similar on their whole sets, one early line for each late one.

    ``pairs`` has the share of bits that differ, too: each late line is compared with its likeliest early one first, and
    with the others only if that is not similar, so a group of near copies is compared once for each line.
    """
    pairs = stored(pairs.groupBy("late", "early").agg(F.min("share").alias("share")), "pairs")
    sets = _sets(pairs.select(F.explode(F.array("early", "late")).alias("place")).select("place.*"), docs)
    best = pairs.groupBy("late").agg(F.min_by("early", F.struct("share", "early")).alias("early"))
    first = _similar(best, sets)
    rest = pairs.select("late", "early").join(first.select("late"), "late", "left_anti").join(best, ["late", "early"], "left_anti")
    found = first.unionByName(_similar(rest, sets))
    drop_stored(pairs, sets)
    return found


def _matches(docs: DataFrame) -> DataFrame:
    """(late, early): places (doc, ln) of the lines of ``docs`` (doc, key, text) that are similar to an earlier one, each once."""
    lines = stored(_tokens(docs), "lines")
    classes = _rarity(lines)
    # lines with equal sets meet at their first one
    place = F.struct("doc", "ln")
    heads = stored(lines.groupBy("s", "s2").agg(F.min(place).alias("head"), F.count("*").alias("n_lines")).where("n_lines > 1").drop("n_lines"), "heads")
    heads = F.broadcast(heads) if heads.count() <= SENT else heads
    copies = stored(lines.join(heads, ["s", "s2"]).where(F.col("head") != place).select(place.alias("late"), F.col("head").alias("early")).distinct(), "copies")
    reps = lines.where("n > 2").join(heads, ["s", "s2"], "left").where(F.col("head").isNull() | (F.col("head") == place))
    reps = reps.select("doc", "ln", "n", _turned(lambda t: F.lit(1).cast("long")).alias("x"), _turned(lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1)).cast("long")).alias("y"), _prefix(classes).alias("first"), F.col("head").isNotNull().alias("shared"))
    # of 128 bits each token turns over one, so two sets differ in at least as many tokens as bits
    reps = dealt = stored(reps.withColumn("x", F.col("x").bitwiseXOR(F.col("y"))), "dealt")
    drop_stored(lines)
    # rows that share doc_id and text bring their lines twice
    reps = reps.where("not shared").unionByName(reps.where("shared").dropDuplicates(["doc", "ln"])).drop("shared")
    of = lambda side, c: F.col(f"{side}.{c}")
    names = lambda side: F.struct(f"{side}.doc", f"{side}.ln")
    differ = F.bit_count(of("a", "x").bitwiseXOR(of("b", "x"))) + F.bit_count(of("a", "y").bitwiseXOR(of("b", "y")))
    # the earliest line of a few of each line's lists is tried first: of many near copies most end here
    tried = reps.select("doc", "ln", "n", "x", "y", F.explode(F.slice(F.sort_array("first"), 1, TRIED)).alias("w"))
    earliest = tried.groupBy("w").agg(F.min(F.struct("doc", "ln", "n", "x", "y")).alias("a"), F.count("*").alias("m")).where("m > 1").select("w", "a.*")
    met = earliest.alias("a").join(tried.alias("b"), (F.col("a.w") == F.col("b.w")) & _before("a", "b") & _possible(F.col("a.n"), F.col("b.n")))
    found = _verified(met.select(names("a").alias("early"), names("b").alias("late"), (differ / (of("a", "n") + of("b", "n"))).alias("share")), docs)
    # then each line that is not removed meets all earlier ones that share a token of their prefixes; the smaller line has it
    # among its first tokens of a seventh, so the other tokens of lines do not meet one another
    gone = found.select("late.*").withColumn("gone", F.lit(_GONE))
    marked = reps.join(F.broadcast(gone) if gone.count() <= SENT else gone, ["doc", "ln"], "left").select("doc", "ln", "x", "y", F.coalesce("gone", F.lit(0)).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 31)).alias("info"), "n", "first")
    marked = stored(marked, "marked")
    drop_stored(dealt)
    postings = marked.select("doc", "ln", "x", "y", "n", "info", F.posexplode("first").alias("at", "w"))
    few = F.col("n") - F.ceil(F.col("n") * (2 * PERCENT) / (100 + PERCENT)).cast("int") + 1
    core, others = (postings.where(side).select("w", "doc", "ln", "x", "y", F.col("info").bitwiseOR(F.col("at")).alias("info")) for side in (F.col("at") < few, F.col("at") >= few))
    size = lambda side: F.shiftright(of(side, "info"), 31).bitwiseAND(F.lit(_NUMBER))
    left = lambda side: size(side) - of(side, "info").bitwiseAND(F.lit(_NUMBER))
    n, m = size("a"), size("b")
    placed = F.least(left("a"), left("b")) >= F.ceil((n + m) * PERCENT / (100 + PERCENT))
    meet = (of("a", "w") == of("b", "w")) & placed & _possible(n, m)
    share = (differ / (n + m)).alias("share")
    # of both sides, so that it is not taken before the exchange, which serves all sides of these tokens
    still = F.when(_before("a", "b"), of("b", "info")).otherwise(F.lit(_GONE)) < _GONE
    pairs = core.alias("a").join(core.alias("b"), meet & still).select(names("a").alias("early"), names("b").alias("late"), share)
    still = F.when(_before("a", "b"), of("b", "info")).otherwise(of("a", "info")) < _GONE
    early, late = (F.when(_before("a", "b"), names(x)).otherwise(names(y)) for x, y in ("ab", "ba"))
    unlike = core.alias("a").join(others.alias("b"), meet & still & (n < m)).select(early.alias("early"), late.alias("late"), share)
    more = _verified(pairs.unionByName(unlike), docs)
    result = stored(copies.unionByName(found).unionByName(more), "removed")
    drop_stored(copies, found, more, marked)
    return result


def _id(doc: str) -> Column:
    return F.nullif(F.col(doc), F.lit(_LAST))


def _number(ln: str) -> Column:
    return F.col(ln).bitwiseAND(F.lit(_NUMBER)).cast("int")


def later_matches(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, early_doc_id, early_line_no) of every line that is similar to an earlier one.

    Lines are what stands between line feeds; a line's tokens are its distinct words in lower case (words are runs of other
    than ASCII white space), whatever their number; blank lines alone are never compared; a line without spaces, as in
    Chinese, is one word and meets its copies alone. Similar: at least 75 % of the union is shared. Earlier: smaller doc_id
    (null last), then the smaller line number; rows that share a doc_id or have none follow one another by a hash of their
    texts. The line named is the first with an equal set, else one of the similar ones before it. Lines with equal sets
    meet at their first one, so copies make no pairs. Rows that share doc_id (or its lack) and text are one document. Null
    and empty texts have no lines; other columns are ignored; an empty table gives no rows. Sets are of 64-bit hashes of
    words, equal sets are known by 128 bits.
    """
    found = _matches(_keyed(docs))
    return found.select(_id("late.doc").alias("doc_id"), _number("late.ln").alias("line_no"), _id("early.doc").alias("early_doc_id"), _number("early.ln").alias("early_line_no"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that :func:`later_matches` finds; a text of which no line is left is empty.

    A row loses its own lines alone, also where others share its doc_id or have none; rows alike in doc_id and text are
    one document and keep the same lines. Null texts stay null.
    """
    keyed = _keyed(docs)
    removed = _matches(keyed).groupBy(F.col("late.doc").alias("doc"), F.col("late.ln").bitwiseAND(F.lit(~_NUMBER)).alias("key")).agg(F.collect_set(_number("late.ln")).alias("lines")).alias("g")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("d")
    own_key = F.xxhash64("d.row.text").bitwiseAND(F.lit(~_NUMBER))
    same = (F.coalesce(F.col("d.row.doc_id").cast("long"), F.lit(_LAST)) == F.col("g.doc")) & (own_key == F.col("g.key")) & F.col("d.row.text").isNotNull()
    joined = packed.join(removed, same, "left")
    numbered = F.transform(F.split("row.text", "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    kept = F.transform(F.filter(numbered, lambda x: ~F.array_contains("g.lines", x["i"])), lambda x: x["line"])
    text = F.when(F.col("g.lines").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return later_matches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))

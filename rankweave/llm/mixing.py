"""Mixing sources to target weights by entropy balancing, with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.llm.common import WORD
from rankweave.session import checkpointed
from rankweave.sources.tables import spread, table

#: Times that a document, and so a source, is taken at most; weights by rank of the source, repeating.
MOST, WEIGHTS = 3, (1, 2, 3)
#: Documents of a source that are rounded one after another.
RUN = 4000
STEPS = 60
#: Most sources that are broadcast (about 100 MB).
SENT = 1_000_000


def _sent(sources: DataFrame) -> DataFrame:
    """A table of a row for each source: it goes to the documents while it is small, so that a hot source is not dealt to one task."""
    return F.broadcast(sources) if sources.count() <= SENT else sources


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """sid, source, source_size, docs, target of every source of ``sized`` (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words. Filling up: by rising ratio of limit
    (MOST times the size) to weight, a source stops at its limit while that lies under the level that the words left over
    reach among the sources left over; that level is greatest where the first source stays under its limit.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long"))  # a row for each source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + F.when(F.col("sid") % len(WEIGHTS) == 0, len(WEIGHTS)).otherwise(0)).cast("int"))
    sources = sources.withColumn("weight", weight.cast("double")).withColumn("most", (F.col("source_size") * MOST).cast("double"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / F.sum("weight").over(after))
    target = F.least("most", F.col("weight") * F.max("level").over(everything))
    return sources.withColumn("target", target).select("sid", "source", "source_size", "docs", "target")


def _rate(tilt: Column, z: Column) -> Column:
    """The tilted rate, stopped at MOST."""
    return F.least(F.lit(float(MOST)), F.exp(F.least(tilt * z, F.lit(2.0))))


def tilts(tally: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, tilt): for each source the multiplier with which its documents' rates give its target.

    The rates nearest to 1 in relative entropy, between 0 and MOST, with sum(rate * size) = target are exp(tilt * z)
    stopped at MOST, z being the size over the source's mean. The dual is convex in tilt; a Newton step that leaves the
    bracket is replaced by halving it. ``tally`` (sid, size, n, z) counts documents of a size, so a step reads a row for
    each source and size and shuffles a row for each source. Sums are of decimals, so their order changes nothing.
    """
    state = sources.where("target > 0 and target < source_size * 3").selectExpr("sid", "target", "0D tilt", "-1D low", "1D high", "false low_found", "false high_found", "false done")
    state = checkpointed(state)
    for _ in range(STEPS):
        rows = tally.join(_sent(state.where("not done")), "sid")
        rate = _rate(F.col("tilt"), F.col("z"))
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        sums = rows.groupBy("sid").agg(
            exact(F.col("n") * F.col("size") * rate).alias("taken"),
            exact(F.when(rate < MOST, F.col("n") * F.col("size") * F.col("z") * rate).otherwise(0.0)).alias("slope"),
        )
        over = F.col("taken") > F.col("target")
        state = state.join(sums, "sid", "left")
        state = state.withColumns({
            "high": F.when(over, F.col("tilt")).otherwise(F.when(F.col("high_found"), F.col("high")).otherwise(F.greatest(F.col("high"), F.abs("tilt") * 4 + 1))),
            "low": F.when(over, F.when(F.col("low_found"), F.col("low")).otherwise(F.least(F.col("low"), -F.abs("tilt") * 4 - 1))).otherwise(F.col("tilt")),
            "high_found": F.col("high_found") | F.coalesce(over, F.lit(False)),
            "low_found": F.col("low_found") | F.coalesce(~over, F.lit(False)),
        })
        step = F.col("tilt") - (F.col("taken") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        close = F.abs(F.col("taken") - F.col("target")) <= F.greatest(F.lit(1e-3), F.col("target") * 1e-9)
        state = state.withColumns({
            "done": F.col("done") | close,
            "tilt": F.when(F.col("done") | close, F.col("tilt")).when(inside, step).otherwise(F.when(F.col("low_found") & F.col("high_found"), (F.col("low") + F.col("high")) / 2).when(F.col("low_found"), F.col("high")).otherwise(F.col("low"))),
        })
        state = checkpointed(state.select("sid", "target", "tilt", "low", "high", "low_found", "high_found", "done"))
        if state.where("not done").isEmpty():
            break
    return state.select("sid", "tilt")


def _before(df: DataFrame, run: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the source, runs one after another: no task sees a whole source."""
    totals = df.groupBy("sid", run).agg(F.sum(value).alias("of_run"))
    earlier = Window.partitionBy("sid").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", run, F.coalesce(F.sum("of_run").over(earlier), F.lit(0)).alias("of_runs"))
    own = Window.partitionBy("sid", run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("of_rows", F.coalesce(F.sum(value).over(own), F.lit(0))).join(totals, ["sid", run]).withColumn(name, F.col("of_rows") + F.col("of_runs")).drop("of_rows", "of_runs")


def mix(sized: DataFrame, corrections: int = 4) -> DataFrame:
    """``sized`` (doc_id, source, size, no) -> the same with source_size, target and copies (0 to MOST).

    Rates are tilted by entropy balancing and rounded systematically: in runs of about RUN documents of a source, by
    size, a document gets the whole numbers that its share of the running sum of rates passes. What a source then lacks or
    has too much is given to or taken from documents no larger than that, in hashed order, up to ``corrections`` times, so
    that a source ends nearer to its target than the size of a small document. All depends on doc_id, source, size and no
    alone, so reruns agree; rows alike in these get copies in any order. A null source is a source; rows without words
    are taken once and count 0; sources without words have target 0; an empty table gives no rows.
    """
    sized = checkpointed(sized)
    sources = checkpointed(source_targets(sized))
    docs = checkpointed(sized.alias("d").join(_sent(sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("sid", "d.doc_id", "d.source", "d.size", "d.no", "source_size", "docs", "target"))
    z = F.col("size") * F.col("docs") / F.col("source_size")
    tally = checkpointed(docs.where("size > 0").groupBy("sid", "size", "docs", "source_size").agg(F.count("*").alias("n")).select("sid", "size", "n", z.alias("z")))
    rated = docs.join(_sent(tilts(tally, sources)), "sid", "left")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") >= F.col("source_size") * MOST, float(MOST)).otherwise(_rate(F.col("tilt"), z))
    rated = rated.withColumn("rate", rate.cast("decimal(18,9)")).withColumn("run", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("docs") / RUN)))
    own = Window.partitionBy("sid", "run").orderBy("size", F.xxhash64("doc_id"), "doc_id", "no").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("rate").over(own) + (F.pmod(F.xxhash64("sid", "run"), F.lit(10**9)) / 10**9).cast("decimal(18,9)")
    copies = (F.floor(upto) - F.floor(upto - F.col("rate"))).cast("long")
    keys = ["sid", "doc_id", "source", "size", "no", "source_size", "docs", "target"]
    mixed = checkpointed(rated.select(*keys, copies.alias("copies")))
    for turn in range(corrections):
        lack = mixed.groupBy("sid", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).select("sid", F.round(F.col("target") - F.col("taken")).cast("long").alias("lack"))
        lack = checkpointed(lack)
        if lack.where("lack <> 0").isEmpty():
            break
        able = (F.col("size") > 0) & (F.col("size") <= F.abs("lack")) & F.when(F.col("lack") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
        near = mixed.join(_sent(lack), "sid").withColumn("place", F.xxhash64("doc_id", "size", "no", F.lit(turn)))
        near = near.withColumn("run", F.pmod("place", F.ceil(F.col("docs") / RUN))).withColumn("step", F.when(able, F.col("size")).otherwise(0))
        near = _before(near, "run", ["place", "doc_id", "no"], "step", "passed")
        change = F.when((F.col("step") > 0) & (F.col("passed") + F.col("step") <= F.abs("lack")), F.signum("lack").cast("long")).otherwise(0)
        mixed = checkpointed(near.select(*keys, (F.col("copies") + change).alias("copies")))
    return mixed


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and no, a number that tells rows apart which are alike in these."""
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return sized.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it (:func:`mix`): 0 to MOST times.

    Rows alike in doc_id, source and size are told apart by their texts; a null source is a source; rows with a null or
    empty text are taken once. An empty table stays empty; further columns may have any name.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    packed = packed.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("row.text"))).alias("p")
    copies = mix(sized_documents(docs)).where("copies > 0").alias("m")
    alike = F.lit(True)
    for key in ("doc_id", "source", "size", "no"):
        alike = alike & F.col(f"p.{key}").eqNullSafe(F.col(f"m.{key}"))
    return packed.join(copies, alike).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix(sized_documents(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")

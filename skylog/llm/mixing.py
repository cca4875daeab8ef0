"""Mixing sources to target weights by entropy balancing.

Document rates are the closest to 1 (in relative entropy) that give every source its target of words and
take no document more than ``most`` times: ``rate = least(most, exp(lambda * size / mean size))`` with one
multiplier per source, the solution of a convex dual. Newton steps, held inside a bracket, solve it.
A rate depends on source and size only, so each step aggregates (source, size, count) rows: the
documents are reduced once, with partial aggregation, and a hot source is just more of them.

Rates become copies: the whole part, and one more where a hash of the id falls below the fraction. What
then is missing or over is mended in rounds of single copies: in hash order, documents that still fit are given or
lose one copy, between their rate's whole neighbours except in the last round. Prefix sums run over hash buckets, first within each bucket, then over bucket totals, so
no source is gathered in one task. The hash makes reruns agree.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at
``most`` times its source's words, and what is over is shared again by weight. Only per-source rows are sorted for it.

Defined cases: null or empty text: size 0, nothing taken; a null source is a source; repeated rows are
separate documents with the same hash; a null id hashes as null; an empty table gives no rows. Columns that the
result names itself (size, source_size, target, rate, copies, taken) are replaced, others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, read, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
STEPS = 40  # each step is a Newton step or halves the bracket; about 6 are usual
CLOSE = 1e-6
BUCKETS = 256  # hash buckets of a source, for prefix sums
ROUNDS = 3


def weigh(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to per-source rows (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    full = most * F.col("source_size")
    # water level: sources fill up in order of full / weight; the level is where the rest shares the rest
    fill = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    rows = sources.withColumn("weight", weight).withColumns(
        {
            "over": F.coalesce(F.sum(full).over(before), F.lit(0)),
            "all": total,
            "left": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("all") - F.col("over")) / F.col("left")
    # the level belongs to the first source that does not fill up
    rows = rows.withColumn("level", F.when(full > level * F.col("weight"), level))
    lowest = F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(full.cast("double"), F.coalesce(lowest * F.col("weight"), full.cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def _rate(size: Column, mean: Column, multiplier: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(multiplier * size / mean, F.lit(50.0))))


def _solve(store: Store, sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, mean, multiplier) from (source, size, n) and per-source targets."""
    per = sizes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = per.join(sources, per["source"].eqNullSafe(sources["source"])).select(
        per["source"], "mean", "target", (most * F.col("source_size")).alias("full"), F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size")) / 2).otherwise(0.0).alias("multiplier"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"),
    )
    state = store.table("state-0", state)
    for step in range(1, STEPS + 1):
        s = state.withColumnRenamed("source", "s").where("NOT done")
        at = sizes.join(s, sizes["source"].eqNullSafe(s["s"])).where("size > 0")
        rate = _rate(F.col("size"), F.col("mean"), F.col("multiplier"), most)
        words = F.col("size") * F.col("n") * rate
        free = F.when(rate < most, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = at.groupBy("s").agg(F.sum(words).alias("words"), F.sum(free).alias("slope"))
        joined = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        gap = F.col("target") - F.col("words")
        low = F.when(gap >= 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap <= 0, F.col("multiplier")).otherwise(F.col("high"))
        # Newton on the logarithm of the words, which is nearly straight in the multiplier
        ahead = F.log(F.col("target") / F.col("words")) * F.col("words") / F.when(F.col("slope") > 0, F.col("slope"))
        newton = F.col("multiplier") + ahead
        # outside the bracket (or without slope): halve it on a scale that starts near 0
        half = F.when(low < -1, F.when(high > -1, F.lit(-1.0)).otherwise(-F.sqrt(low * high))).otherwise(
            F.when(high > 1, F.when(low < 1, F.lit(1.0)).otherwise(F.sqrt(low * high))).otherwise((low + high) / 2)
        )
        done = F.col("done") | F.col("words").isNull() | (F.abs(gap) <= CLOSE * F.greatest("target", F.lit(1.0)))
        edge = (F.col("target") >= F.col("full")) | (F.col("target") <= 0)
        state = joined.select(
            "source", "mean", "target", "full",
            F.when(F.col("target") <= 0, F.lit(-1e6)).when(edge, F.lit(1e6)).when(done, F.col("multiplier"))
            .when((newton > low) & (newton < high), newton).otherwise(half).alias("multiplier"),
            F.when(done, F.col("low")).otherwise(low).alias("low"),
            F.when(done, F.col("high")).otherwise(high).alias("high"),
            (done | edge).alias("done"),
        )
        state = store.table(f"state-{step}", state)
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "mean", "multiplier")


def _mend(store: Store, docs: DataFrame, sources: DataFrame, most: int, turn: int) -> DataFrame:
    """One more or one fewer copy for documents whose sizes, in hash order, fit into the source's gap."""
    have = docs.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
    gap = have.join(sources, have["source"].eqNullSafe(sources["source"])).select(
        have["source"].alias("s"), (F.col("target") - F.col("words")).alias("gap")
    )
    rows = docs.join(gap, docs["source"].eqNullSafe(gap["s"])).drop("s")
    upper, lower = (F.lit(most), F.lit(0)) if turn == ROUNDS else (F.ceil("rate"), F.floor("rate"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
    fits &= F.when(F.col("gap") > 0, F.col("copies") < upper).otherwise(F.col("copies") > lower)
    order = F.xxhash64("hash", F.lit(turn))
    rows = rows.withColumns({"fits": fits, "order": order, "bucket": F.pmod(order, F.lit(BUCKETS))})
    fit = rows.where("fits")
    totals = fit.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, 0)
    fit = fit.withColumn("upto", F.sum("size").over(within))
    fit = fit.join(totals, fit["source"].eqNullSafe(F.col("s")) & (fit["bucket"] == F.col("b")))
    change = fit.where(F.col("upto") + F.col("offset") <= F.abs("gap")).select("row", F.signum("gap").cast("int").alias("change"))
    mended = docs.join(change, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
    return store.table(f"copies-{turn}", mended)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row per document."""
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    return _mix(Store(docs.sparkSession, "mix"), rows, weights, most)


def _mix(store: Store, rows: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """``mix`` of (doc_id, source, size, row)."""
    rows = store.table("rows", rows.withColumn("hash", F.xxhash64("doc_id")))
    sizes = store.table("sizes", rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = store.table("sources", weigh(per, weights, most))
    solved = _solve(store, sizes, sources, most).withColumnRenamed("source", "s")
    rated = rows.join(solved, rows["source"].eqNullSafe(solved["s"]), "left").withColumn(
        "rate", F.when(F.col("size") > 0, _rate(F.col("size"), F.col("mean"), F.col("multiplier"), most)).otherwise(1.0)
    )
    lucky = F.pmod(F.xxhash64("hash", F.lit(0)), F.lit(1 << 40)) < (F.col("rate") - F.floor("rate")) * (1 << 40)
    copies = store.table("copies-0", rated.select("row", "hash", "doc_id", "source", "size", "rate", (F.floor("rate") + lucky.cast("int")).cast("int").alias("copies")))
    for turn in range(1, ROUNDS + 1):
        copies = _mend(store, copies, sources, most, turn)
    done = copies.join(sources.withColumnRenamed("source", "s"), copies["source"].eqNullSafe(F.col("s")), "left")
    return done.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row")


def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that the mix takes, and its source's target."""
    return mix(read(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def take(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
         weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken, numbered by ``copy``.

    Rows are stored with their number: reading ``docs`` again may split its files, and number them, in another way.
    """
    store = Store(docs.sparkSession, "mix")
    numbered = store.table("numbered", docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    rows = numbered.select(
        F.col(f"doc.`{doc_id}`").alias("doc_id"), F.col(f"doc.`{source}`").alias("source"), word_count(F.col(f"doc.`{text}`")).alias("size"), "row"
    )
    rates = _mix(store, rows, weights, most).where("copies > 0").select("row", F.col("copies").alias("times"))
    taken = numbered.join(rates, "row").withColumn("place", F.explode(F.sequence(F.lit(1), F.col("times"))))
    names = [c for c in docs.columns if c != "copy"]
    return taken.select(*[F.col(f"doc.`{c}`").alias(c) for c in names], F.col("place").alias("copy"))

"""Log statistics. Wide logs are reduced by map-side partial aggregation before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands, fields, geo, locator, modes
from ..functions.text import filled, upper_filled

UNKNOWN = "?"


def stat_columns(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The narrow, cleaned columns that statistics need, from stored (possibly text) columns."""
    types = dict(rows.dtypes)

    def real(name: str) -> Column:
        if types[name] == "string":
            return fields.coerce_real(name)
        return geo.clean_real(F.col(name).cast("double"))

    when = fields.parse_iso("qso_datetime") if types["qso_datetime"] == "string" else F.col("qso_datetime")
    code = fields.coerce_code("dxcc") if types["dxcc"] == "string" else F.when(
        F.col("dxcc") >= 0, F.col("dxcc").cast("long")
    )
    freq = real("freq_mhz")
    narrow = rows.select(
        *keep,
        upper_filled("call").alias("call"),
        when.alias("qso_datetime"),
        code.alias("dxcc"),
        filled("country").alias("country"),
        F.coalesce(upper_filled("cont"), F.lit(UNKNOWN)).alias("cont"),
        bands.clean_band("band").alias("_band"),
        freq.alias("_freq"),
        F.coalesce(F.nullif(modes.display_mode("mode", "submode"), F.lit("")), F.lit(UNKNOWN)).alias("mode"),
        locator.square("gridsquare").alias("square"),
        F.when(real("distance_km") >= 0.0, real("distance_km") + 0.0).alias("distance_km"),
    )
    band = F.coalesce("_band", bands.band_of_mhz("_freq"), F.lit(UNKNOWN))
    return narrow.withColumn("band", band).drop("_band", "_freq")


def _distinct(narrow: DataFrame, **keys: tuple[Column, Column | None]) -> DataFrame:
    """Distinct values of several columns from one pass: ``kind, key, n, coded, first, last``.

    A contact gives one short row for each kind; they are counted inside every task before the one shuffle, so a hot value
    arrives once from each task.
    """
    rows = F.array(*[
        F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), (F.lit(False) if coded is None else coded).alias("coded"))
        for kind, (key, coded) in keys.items()
    ])
    return narrow.select("qso_datetime", F.inline(rows)).groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("coded").alias("coded"), F.min("qso_datetime").alias("first"), F.max("qso_datetime").alias("last")
    )


def _entity_keys() -> dict[str, tuple[Column, Column | None]]:
    return {
        "code": (F.when(F.col("dxcc") > 0, F.col("dxcc")), None),
        "name": (F.nullif(fields.country_key("country"), F.lit("")), F.col("dxcc").isNotNull()),
    }


def _entities() -> Column:
    """Distinct codes above 0, plus names of code-less rows never seen beside a code."""
    counts = (F.col("kind") == "code") | ((F.col("kind") == "name") & ~F.col("coded"))
    return F.count_if(counts & F.col("key").isNotNull()).alias("dxcc_count")


def dxcc_count(narrow: DataFrame) -> DataFrame:
    return _distinct(narrow, **_entity_keys()).agg(_entities())


def summary(narrow: DataFrame) -> DataFrame:
    """One row: total, entities, unique calls, squares, first and last contact, from one scan and one shuffle of distinct keys."""
    distinct = _distinct(narrow, call=(F.col("call"), None), square=(F.col("square"), None), **_entity_keys())
    of = lambda kind: F.col("kind") == kind
    return distinct.agg(
        F.coalesce(F.sum(F.when(of("call"), F.col("n"))), F.lit(0)).alias("total"), _entities(),
        F.count_if(of("call") & F.col("key").isNotNull()).alias("unique_calls"),
        F.count_if(of("square") & F.col("key").isNotNull()).alias("grid_count"),
        F.min("first").alias("first_qso"), F.max("last").alias("last_qso"),
    )


def grid_count(narrow: DataFrame) -> DataFrame:
    return narrow.agg(F.count_distinct("square").alias("grid_count"))


def continent_rank(name: str) -> Column:
    known = F.array_position(F.lit(fields.CONTINENTS), F.col(name)).cast("int")
    return F.when(known > 0, known - 1).when(F.col(name) == UNKNOWN, 99).otherwise(50)


def band_sort(name: str) -> list[Column]:
    rank = F.when(F.col(name) == UNKNOWN, 99).otherwise(bands.band_rank(name))
    return [rank, F.col(name)]


def by_continent(narrow: DataFrame) -> DataFrame:
    counted = narrow.groupBy("cont").agg(F.count("*").alias("n"))
    return counted.orderBy(continent_rank("cont"), "cont")


def by_band(narrow: DataFrame) -> DataFrame:
    return narrow.groupBy("band").agg(F.count("*").alias("n")).orderBy(*band_sort("band"))


def by_mode(narrow: DataFrame) -> DataFrame:
    return narrow.groupBy("mode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mode")


def breakdowns(narrow: DataFrame) -> DataFrame:
    """All three breakdowns from one pass: ``metric, key, n``.

    The log is first counted by (continent, band, mode), a few thousand groups at most; the
    grouping sets expand only those.
    """
    cube = narrow.groupBy("cont", "band", "mode").agg(F.count("*").alias("n"))
    sets = cube.groupingSets([["cont"], ["band"], ["mode"]], "cont", "band", "mode").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("gid")
    )
    metric = F.when(F.col("gid") == 3, "continent").when(F.col("gid") == 5, "band").otherwise("mode")
    return sets.select(metric.alias("metric"), F.coalesce("cont", "band", "mode").alias("key"), "n")


def with_share(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``share``: percent of the total of its breakdown. ``counts`` is a small report."""
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", 100.0 * F.col("n") / total)


def longest(narrow: DataFrame, order: str) -> DataFrame:
    """The contact with the largest distance; ties go to the earliest time, then first ingested.

    A top-1: every task keeps one row.
    """
    return (
        narrow.where("distance_km IS NOT NULL")
        .orderBy(F.desc("distance_km"), F.asc_nulls_last("qso_datetime"), F.asc(order))
        .limit(1)
        .select(
            F.coalesce("call", F.lit("")).alias("call"), "distance_km", "country",
            F.nullif("band", F.lit(UNKNOWN)).alias("band"),
            F.nullif("mode", F.lit(UNKNOWN)).alias("mode"), "qso_datetime",
        )
    )


def share_by_continent_band(narrow: DataFrame) -> DataFrame:
    """Contacts and share by continent and band."""
    counts = narrow.groupBy("cont", "band").agg(F.count("*").alias("n"))
    return with_share(counts, [])


def import_summary(rows: DataFrame) -> DataFrame:
    """Counters of a normalised batch; duplicates are rows beyond the first of their key."""
    ok = F.col("skip_reason").isNull()
    per_key = rows.groupBy(ok.alias("ok"), "dedup_key").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("lat").isNull()).alias("no_position"),
        F.count_if(F.col("my_lat").isNull()).alias("no_origin"),
        F.count_if(F.col("skip_reason") == "missing_call").alias("no_call"),
        F.count_if(F.col("skip_reason") == "bad_datetime").alias("bad_time"),
    )
    good = F.col("ok")
    return per_key.agg(
        F.count_if(good).alias("imported"),
        F.sum(F.when(good, F.col("n") - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(~good, F.col("n")).otherwise(0)).alias("skipped"),
        F.sum("no_call").alias("missing_call"),
        F.sum("bad_time").alias("bad_datetime"),
        F.sum(F.when(good, F.col("no_position")).otherwise(0)).alias("without_position"),
        F.sum(F.when(good, F.col("no_origin")).otherwise(0)).alias("without_origin"),
    )


def polar_histogram(rows: DataFrame) -> DataFrame:
    """Contacts by 2 500 km ring and 30 degree sector."""
    ring = (F.floor(F.col("distance_km") / 2500.0) * 2500).cast("int")
    sector = (F.floor(F.col("bearing_deg") / 30.0) * 30).cast("int")
    return (
        rows.where("distance_km IS NOT NULL")
        .groupBy(ring.alias("ring_km"), sector.alias("sector_deg"))
        .agg(F.count("*").alias("n"))
    )


def warnings_rollup(warnings: DataFrame, log: str, order: list[str], keep: int = 100) -> DataFrame:
    """The first ``keep`` warnings of every log, each with the number of further ones.

    The rank filter is applied inside every task before the shuffle, and the counts are a
    partial aggregate, so one noisy log does not gather in one task.
    """
    rank = F.row_number().over(Window.partitionBy(log).orderBy(*order))
    first = warnings.withColumn("rank", rank).where(F.col("rank") <= keep)
    totals = warnings.groupBy(log).agg(F.count("*").alias("total"))
    further = F.greatest(F.col("total") - keep, F.lit(0)).cast("long")
    return first.join(totals, log).withColumn("further", further).drop("total")


def latest_per_client(rows: DataFrame, client: str, when: list[str], *columns: str) -> DataFrame:
    """The newest row of every client (``when`` breaks ties), by partial aggregation."""
    newest = F.max_by(F.struct(*columns), F.struct(*when))
    return rows.groupBy(client).agg(newest.alias("row")).select(client, "row.*")

"""Kept statistics: counts and distinct sets as mergeable rows, updated by new contacts only.

A row is (kind, key) with a count and what else its kind needs. Rows of any two sets of contacts are merged by sums, minima and
maxima, so new contacts add a few rows, which are published in the same version as the contacts: a batch that is repeated adds
no contact and no figure. Reading costs as much as there are distinct keys, never a pass over the contacts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from . import stats

_BEST = "struct<distance_km:double,earliness:bigint,call:string,country:string,band:string,mode:string,qso_datetime:timestamp_ntz>"


def _row(kind: str, key: Column, coded: Column | None = None, times: bool = False) -> Column:
    when = F.col("qso_datetime") if times else F.lit(None).cast("timestamp_ntz")
    best = F.struct(
        "distance_km", F.coalesce(-F.unix_micros(F.col("qso_datetime").cast("timestamp")), F.lit(-(2**62))).alias("earliness"), F.coalesce("call", F.lit("")).alias("call"),
        "country", F.nullif("band", F.lit(stats.UNKNOWN)).alias("band"), F.nullif("mode", F.lit(stats.UNKNOWN)).alias("mode"), "qso_datetime",
    )
    return F.struct(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.lit(1).cast("long").alias("n"),
        (F.lit(False) if coded is None else coded).alias("coded"), when.alias("first"), when.alias("last"),
        (F.when(F.col("distance_km").isNotNull(), best) if times else F.lit(None)).cast(_BEST).alias("best"),
    )


def of_contacts(contacts: DataFrame) -> DataFrame:
    """The figures of these contacts."""
    narrow = stats.stat_columns(contacts)
    name = F.nullif(fields.country_key("country"), F.lit(""))
    groups = F.to_json(F.struct("cont", "band", "mode"))
    rows = F.array(
        _row("total", F.lit(""), times=True), _row("group", groups), _row("call", F.col("call")), _row("square", F.col("square")),
        _row("code", F.when(F.col("dxcc") > 0, F.col("dxcc"))), _row("name", name, F.col("dxcc").isNotNull()),
    )
    every = narrow.select(F.inline(rows)).where("key IS NOT NULL")
    return collapse(every.select(F.concat_ws(":", "kind", "key").alias("dedup_key"), "*"))


def collapse(figures: DataFrame) -> DataFrame:
    """One row for each kind and key."""
    return figures.groupBy("dedup_key", "kind", "key").agg(
        F.sum("n").alias("n"), F.max("coded").alias("coded"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("best").alias("best")
    )


def summary(figures: DataFrame) -> DataFrame:
    """One row: total, entities, unique calls, squares, first, last and longest contact."""
    is_ = lambda kind: F.col("kind") == kind
    entity = is_("code") | (is_("name") & ~F.col("coded"))
    totals = collapse(figures).agg(
        F.coalesce(F.sum(F.when(is_("total"), F.col("n"))), F.lit(0)).alias("total"), F.count_if(entity).alias("dxcc_count"),
        F.count_if(is_("call")).alias("unique_calls"), F.count_if(is_("square")).alias("grid_count"),
        F.min("first").alias("first_qso"), F.max("last").alias("last_qso"), F.max("best").alias("best"),
    )
    shown = [F.col(f"best.{c}").alias(f"longest_{c}") for c in ("call", "distance_km", "country", "band", "mode", "qso_datetime")]
    return totals.select("total", "dxcc_count", "unique_calls", "grid_count", "first_qso", "last_qso", *shown)


def breakdowns(figures: DataFrame) -> DataFrame:
    """``metric, key, n`` by continent, band and mode."""
    group = F.from_json("key", "cont string, band string, mode string")
    counted = figures.where("kind = 'group'").select(group.alias("g"), "n")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"g.{c}").alias("key")) for m, c in (("continent", "cont"), ("band", "band"), ("mode", "mode"))])
    return counted.select(F.inline(pairs), "n").groupBy("metric", "key").agg(F.sum("n").alias("n"))

"""The batch algorithms, as functions on DataFrames and table folders."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .functions import locator
from .operators import grid, report
from .operators.countries import Countries, build_entities, countries, one_release, scan_codes, scan_country_files
from .operators.merge import LogTable, ensure_schema, insert_contacts, merge_batch, stage_batch
from .operators.normalize import normalize, tidy_names
from .operators.recalc import recalculate_table
from .session import scratch_dir
from .sources import adif, adif_blocks


def station_locator(spark: SparkSession, grid_text: str | None) -> str | None:
    """A job parameter: '' and None mean no station, an invalid locator is an error."""
    if not (grid_text or "").strip():
        return None
    found = spark.range(1).select(locator.normalize(F.lit(grid_text)).alias("g")).first()["g"]
    if found is None:
        raise ValueError(f"no such grid square: {grid_text!r}; expected two letters, two digits and so on")
    return found


def import_logs(
    spark: SparkSession, paths: str | list[str], table_root: str, station: str | None = None,
    dim: Countries | None = None, max_mb: int | None = None, large_files: bool = False,
) -> dict[str, int]:
    """Reads log files and merges their contacts; returns imported, duplicates, skipped, rejected.

    ``large_files`` reads each file in many tasks. :func:`last_report` tells what was noticed.
    """
    my_grid = station_locator(spark, station)
    table = LogTable(spark, table_root)
    ensure_schema(table)
    if large_files and max_mb is None:
        parsed = adif_blocks.scan_large_logs(spark, paths)
    else:
        parsed = adif.scan_logs(spark, paths, max_mb)
    return import_parsed(table, parsed, my_grid, dim)


def import_parsed(table: LogTable, parsed: DataFrame, my_grid: str | None = None, dim: Countries | None = None) -> dict[str, int]:
    """Merges parsed files (:data:`.sources.adif.RECORD_SCHEMA`) and stores the report beside the table."""
    spark = table.spark
    at = scratch_dir(spark, "parsed")  # files are read once: records, warnings and refusals come from here
    parsed.write.parquet(at)
    parsed = spark.read.parquet(at)
    records = adif.records(parsed).drop("warnings")
    source = F.concat(F.lit("adif:"), F.element_at(F.split("file", "/"), -1))
    rows, counters = report.observed(normalize(records, my_grid, dim, source, mark_station=True))
    batch = stage_batch(table, rows, "file", "record_no", "warnings")
    folder = f"{table.root.rstrip('/')}/reports/{uuid.uuid4().hex}"
    report.listed_warnings(report.all_warnings(parsed, batch)).write.parquet(f"{folder}/warnings")
    report.rejected_rows(batch).write.parquet(f"{folder}/rejected")
    refused = report.refused_files(parsed).count()
    counts = merge_batch(table, batch, "file", "record_no", meta={"last_report": folder}).first()
    seen = counters.get
    summary = [(seen["records"], seen["skipped"], seen["warnings"], counts["inserted"], counts["duplicates"], counts["failed"], refused)]
    spark.createDataFrame(
        summary, "records long, skipped long, warnings long, imported long, duplicates long, failed long, refused_files long"
    ).coalesce(1).write.parquet(f"{folder}/counts")
    return {
        "imported": counts["inserted"],
        "duplicates": counts["duplicates"],
        "skipped": counts["skipped"] + counts["failed"],
        "rejected_files": refused,
    }


def last_report(spark: SparkSession, table_root: str) -> dict[str, DataFrame] | None:
    """The tables ``warnings``, ``rejected`` and ``counts`` of the last import, None before the first."""
    folder = LogTable(spark, table_root).meta().get("last_report")
    return folder and {name: spark.read.parquet(f"{folder}/{name}") for name in ("warnings", "rejected", "counts")}


def save_records(
    records: DataFrame, table_root: str, source: Column | str, station: str | None = None,
    dim: Countries | None = None, order: tuple[str, ...] = ("record_no",),
) -> int:
    """Saves log-like records (``fields MAP``, names in any case); returns the new contacts."""
    spark = records.sparkSession
    table = LogTable(spark, table_root)
    ensure_schema(table)
    rows = normalize(tidy_names(records), station_locator(spark, station), dim, source)
    return insert_contacts(table, rows, *order).first()["inserted"]


def recalculate(
    spark: SparkSession, table_root: str, station: str | None = None,
    dim: Countries | None = None, force: bool = False,
) -> int:
    """Re-derives every stored contact; returns how many changed.

    An invalid station is ignored here (rows keep their own origin), also with ``force``, with a warning.
    """
    table = LogTable(spark, table_root)
    ensure_schema(table)
    my_grid = spark.range(1).select(
        locator.normalize(F.lit(station).cast("string")).alias("g")
    ).first()["g"]
    if station is not None and my_grid is None:
        warnings.warn(f"station {station!r} is no grid square; contacts keep their own origin", stacklevel=2)
    return recalculate_table(table, my_grid, dim, force and my_grid is not None)


def locators_to_points(df: DataFrame, column: str) -> DataFrame:
    """Centre points of all locators in the lists of a text column."""
    points = grid.locator_points(grid.split_locators(df, column))
    return points.where("locator IS NOT NULL")


def grid_cells(
    spark: SparkSession, extents: DataFrame, level: int, max_cells: int | None = None
) -> DataFrame:
    """Cells of the extents (antimeridian handled); the guard can be raised or left out."""
    return grid.grid_cells(grid.split_extents(extents), level, max_cells)


# --- reference data ------------------------------------------------------------------------------

_VERSION = r"=VER([0-9]{4})([0-9]{2})([0-9]{2})"


def load_countries(spark: SparkSession, root: str) -> Countries | None:
    """The current release of a reference folder, None when there is none."""
    current = LogTable(spark, root).meta().get("country_release")
    if not current:
        return None
    entries = spark.read.parquet(f"{root}/release={current}/entries")
    entities = spark.read.parquet(f"{root}/release={current}/entities")
    return countries(entries, entities)


def refresh_countries(
    spark: SparkSession, country_files: DataFrame, code_lines: DataFrame, root: str,
    minimum: int = 300,
) -> DataFrame:
    """Installs a new release when it is complete enough; one row says what happened.

    ``country_files (release, text)`` holds its files, numbered in ``release``, ``code_lines (release, line, text)`` its
    CSV. Every file is parsed by itself, nothing is put together as text. The release is written to a folder of its own; the pointer in ``meta`` moves last, so
    readers see the old or the new release, never a mixture.
    """
    release = scratch_dir(spark, "release").rsplit("-", 1)[-1]
    scan = one_release(scan_country_files(country_files))
    staged = f"{root}/release={release}"
    build_entities(scan.entities, scan_codes(code_lines, together=True)).write.parquet(f"{staged}/entities")
    scan.entries.write.parquet(f"{staged}/entries")
    built = spark.read.parquet(f"{staged}/entities")
    found = built.agg(F.count("*").alias("n"), F.count("dxcc").alias("coded")).first()
    problem = "dat" if found["n"] < minimum else "csv" if found["coded"] < minimum else None
    if problem is None:
        LogTable(spark, root).set_meta(country_release=release)
    date = F.concat_ws("-", *[F.regexp_extract("text", _VERSION, i) for i in (1, 2, 3)])
    version = country_files.select(F.max(F.when(F.col("text").rlike(_VERSION), date)).alias("v"))
    return version.select(
        F.lit(problem is None).alias("installed"),
        F.lit(problem).cast("string").alias("problem"),
        F.lit(found["n"]).cast("long").alias("entities"),
        F.lit(found["coded"]).cast("long").alias("with_code"),
        F.coalesce("v", F.lit("")).alias("version"),
    )


# --- SQL surface ---------------------------------------------------------------------------------


@udtf(returnType="record_no int, fields map<string,string>")
class AdifRecords:
    """``adif_records(text)``: the records of one log text, for SQL users."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            for number, fields, _ in adif.parse_text(text.removeprefix("﻿")):
                if number > 0 and fields is not None:
                    yield number, fields


# Temporary SQL functions: name -> (parameters, result type, builder over those parameters).
def register_sql(spark: SparkSession) -> list[str]:
    """Registers SQL functions that stay JVM-side, and the table function; returns the names."""
    from .functions.geo import RADIUS_KM

    half = "radians(lat2 - lat1) / 2"
    step = "radians(lon2 - lon1) / 2"
    hav = f"power(sin({half}), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin({step}), 2)"
    a = f"greatest(least({hav}, 1D), 0D)"
    points = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
    functions = {
        "distance_km": (points, "DOUBLE", f"2 * {RADIUS_KM}D * atan2(sqrt({a}), sqrt(1 - {a}))"),
        "bearing_deg": (
            points, "DOUBLE",
            "(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * "
            "sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * "
            "cos(radians(lon2 - lon1)))) + 360D) % 360D",
        ),
        "clean_band": ("band STRING", "STRING", "lower(nullif(trim(band), ''))"),
        "shown_mode": (
            "mode STRING, submode STRING", "STRING",
            "upper(coalesce(nullif(trim(submode), ''), nullif(trim(mode), ''), ''))",
        ),
        "locator_ok": (
            "loc STRING", "BOOLEAN",
            r"coalesce(loc rlike r'^[A-Ra-r]{2}([0-9]{2}([A-Xa-x]{2}([0-9]{2})?)?)?\z', false)",
        ),
    }
    for name, (params, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("adif_records", AdifRecords)
    return [*functions, "adif_records"]

"""Recalculation of stored contacts when the station or the reference data changed.

Every row is derived again by the normaliser's own rules and compared with what is stored. What is written is what
changed: years with a changed contact, and lines that changed, are missing or belong to no contact.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, geo, locator
from ..functions.text import filled
from ..schema import KEPT_PATH_COLUMNS, STATION_MARK, STORED_COLUMNS
from ..session import scratch_dir
from .countries import Countries, lookup
from .merge import LogTable, project, removed
from .normalize import derive, no_match, typed_texts
from .paths import contact_paths, has_line, shown_mode
from .versions import Change, year_of_key

# Precision rank of a position source (0: placed by hand).
RANK = {"latlon": 3, "grid": 2, "cty": 1}
SAME_POINT_DEG = 1e-7
CHANGED = (
    "my_gridsquare dxcc country cont cq_zone itu_zone distance_km bearing_deg loc_source adif_extra"
).split()


def rank(source: Column) -> Column:
    return F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in RANK.items()], F.lit(0))


def near(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-9) -> Column:
    """Equal within the tolerances."""
    room = F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.abs(a - b) <= room


def same(old: Column, new: Column, number: bool) -> Column:
    """Null-safe equality, numbers within 1e-9."""
    if not number:
        return old.eqNullSafe(new)
    both = old.isNotNull() & new.isNotNull()
    return F.when(both, near(old, new)).otherwise(old.isNull() & new.isNull())


def replaces(
    lat: Column, lon: Column, stored: Column, gridsquare: Column,
    new_lat: Column, new_source: Column, cell: tuple[Column, Column] | None = None,
) -> Column:
    """Whether a derived position replaces the stored point.

    A missing point is always filled, a hand-placed one never replaced; a more precise source
    wins; a point outside its (changed) locator is placed again; the untouched middle of a
    two-letter field yields to the entity inside that field. ``cell`` has the canonical locator of
    ``gridsquare`` and its middle, where the caller has worked them out.
    """
    grid, middle = cell or (locator.normalize(gridsquare), locator.centre(locator.normalize(gridsquare)))
    inside = locator.holds(grid, lat, lon)
    untouched = near(lat, middle["lat"], absolute=SAME_POINT_DEG) & near(
        lon, middle["lon"], absolute=SAME_POINT_DEG
    )
    decision = (
        F.when(lat.isNull() | lon.isNull(), True)
        .when(rank(stored) == 0, False)
        .when(rank(new_source) > rank(stored), True)
        .when((stored == "grid") & (new_source == "cty"), (F.char_length(grid) == 2) & (~inside | untouched))
        .when((stored == "grid") & (new_source == "grid"), ~inside)
        .otherwise(False)
    )
    return new_lat.isNotNull() & F.coalesce(decision, F.lit(False))


def _extra(key: str) -> Column:
    """A text field of the stored ``adif_extra`` object, NULL when blank.

    An object is parsed for a name only where its text has that name, or a backslash, by which a name may be written otherwise.
    """
    named = F.contains("adif_extra", F.lit(key)) | F.contains("adif_extra", F.lit("\\"))
    return filled(F.when(named, F.get_json_object("adif_extra", f"$.{key}")))


def rederive(
    stored: DataFrame, station_grid: str | None, dim: Countries | None, force: bool = False
) -> DataFrame:
    """Stored rows (:data:`STORED_COLUMNS`) with new values, ``changed`` and ``moved`` flags.

    Origin, first match: forced station; coordinates of the row when it is marked as following
    the station or has no locator (mark removed, the cell becomes its locator); station of a
    marked row; coordinates; the row's locator (refined by a station inside it); station.
    """
    station = F.lit(station_grid).cast("string")
    passing = [c for c in stored.columns if c not in STORED_COLUMNS]
    old = {n: F.col(n).alias(f"old_{n}") for n in STORED_COLUMNS}
    point = geo.clean_point("lat", "lon")
    df = stored.select(
        *passing,
        *old.values(),
        point["lat"].alias("pt_lat"),
        point["lon"].alias("pt_lon"),
        (F.upper(_extra(STATION_MARK)) == "Y").alias("_mark"),
        filled("my_gridsquare").alias("_mg"),
        filled("call").alias("_call"),
        *[_extra(n).alias(f"f_{n}") for n in ("LAT", "LON")],
        *[
            (F.lit(None).cast("string") if force else _extra(n)).alias(f"f_{n}")
            for n in ("MY_LAT", "MY_LON")
        ],
        filled("gridsquare").alias("f_GRIDSQUARE"),
        filled("country").alias("f_COUNTRY"),
        filled("cont").alias("f_CONT"),
        F.col("dxcc").cast("string").alias("f_DXCC"),
        F.col("cq_zone").cast("string").alias("f_CQZ"),
        F.col("itu_zone").cast("string").alias("f_ITUZ"),
    )
    valid_station = locator.normalize(station).isNotNull()
    mark = F.coalesce(F.col("_mark"), F.lit(False))
    own_position = fields.is_position(
        fields.parse_latlon("f_MY_LAT", "NS"), fields.parse_latlon("f_MY_LON", "EW")
    )
    df = df.withColumn(
        "_own_cell", (mark | F.col("_mg").isNull()) & own_position & F.lit(not force)
    )
    follows = F.lit(force) | (mark & valid_station & ~F.col("_own_cell"))
    df = df.withColumn("_follows", follows)
    df = df.withColumn(
        "f_MY_GRIDSQUARE", F.when(~F.col("_follows") & ~F.col("_own_cell"), F.col("_mg"))
    )
    df = typed_texts(df, station)
    df = derive(no_match(df) if dim is None else lookup(df, F.upper("_call"), dim))
    place = replaces(
        F.col("pt_lat"), F.col("pt_lon"), F.col("old_loc_source"), F.col("old_gridsquare"),
        F.col("lat"), F.col("loc_source"), (F.col("_loc"), F.col("_mid")),
    )
    df = df.withColumn("moved", place)
    moved = F.col("moved")
    cleaned = F.map_filter(
        F.from_json("old_adif_extra", "map<string,string>"), lambda k, _: k != STATION_MARK
    )
    grid = (
        F.when(F.col("_follows"), F.col("_station"))
        .when(F.col("_own_cell"), F.col("my_gridsquare"))
        .when(locator.normalize("old_my_gridsquare").isNotNull(), F.col("my_gridsquare"))
        .otherwise(F.col("old_my_gridsquare"))
    )
    extra = F.when(F.col("_own_cell") & mark, fields.json_object(cleaned)).otherwise(
        F.col("old_adif_extra")
    )
    df = df.select(
        *passing,
        *[f"old_{n}" for n in STORED_COLUMNS],
        "dxcc", "country", "cont", "cq_zone", "itu_zone", "my_lat", "my_lon", "moved",
        grid.alias("my_gridsquare"),
        extra.alias("adif_extra"),
        F.when(moved, F.col("lat")).otherwise(F.col("pt_lat")).alias("lat"),
        F.when(moved, F.col("lon")).otherwise(F.col("pt_lon")).alias("lon"),
        F.when(moved, F.col("loc_source")).otherwise(F.col("old_loc_source")).alias("loc_source"),
    )
    df = df.select(
        "*",
        geo.distance_km("my_lat", "my_lon", "lat", "lon").alias("distance_km"),
        geo.bearing_deg("my_lat", "my_lon", "lat", "lon").alias("bearing_deg"),
    )
    numbers = {n for n, k in STORED_COLUMNS.items() if k in ("int", "double")}
    differs = [~same(F.col(f"old_{n}"), F.col(n), n in numbers) for n in CHANGED]
    changed = moved
    for d in differs:
        changed = changed | d
    current = set(df.columns)
    return df.select(
        *passing,
        *[(F.col(n) if n in current else F.col(f"old_{n}").alias(n)) for n in STORED_COLUMNS],
        "moved",
        changed.alias("changed"),
    )


LINE_COLUMNS = "my_lat my_lon lat lon distance_km bearing_deg band mode submode".split()
PATH_VALUES = "distance_km bearing_deg band mode".split()


def recalculate_table(
    table: LogTable, station_grid: str | None, dim: Countries | None, force: bool = False
) -> int:
    """Recalculates a stored table; returns the number of contacts changed.

    Only years with a changed contact are written anew, and of the paths only years with a line that changed, is
    missing or lost its contact; only such lines are drawn. Both tables are published as one version; when nothing
    changed, none is. Lines that belong to no contact are removed.
    """
    seen = table.version()
    # the derived rows feed counts, contacts and paths: derive them once; a row is kept whole only where it changed
    staged = _scratch(table, "recalculated", _derived(table, station_grid, dim, force))
    changed = staged.where("changed")
    years = {r["year"]: r["n"] for r in changed.groupBy("year").agg(F.count("*").alias("n")).collect()}
    actions = _scratch(table, "lines", _line_actions(staged, table.kept_paths()))
    path_years = [r["year"] for r in actions.select("year").distinct().collect()]
    changes = {}
    if years:
        stored = table.all_contacts(years)
        kept = stored.join(changed.select("dedup_key"), "dedup_key", "left_anti")
        fresh = changed.select("row.*").select(*stored.columns)
        changes["qso"] = Change(kept.select(*stored.columns).unionByName(fresh), years, sizes=table.contacts(years))
    if path_years:
        changes["qso_path"] = _new_lines(table, staged, actions, path_years)
    if changes:
        table.publish(changes, seen=seen)
    removed(table, staged, actions)
    return sum(years.values())


def _scratch(table: LogTable, label: str, rows: DataFrame) -> DataFrame:
    path = scratch_dir(table.spark, label)
    rows.write.parquet(path)
    return table.spark.read.schema(rows.schema).parquet(path)


def _derived(table: LogTable, station_grid: str | None, dim: Countries | None, force: bool) -> DataFrame:
    """Key, year and what a line needs of every contact, and the ``row`` of those that changed."""
    stored = table.all_contacts()
    rows = rederive(stored, station_grid, dim, force)
    return rows.select(
        "dedup_key", year_of_key().alias("year"), "changed", *LINE_COLUMNS, has_line().alias("lined"),
        F.when(F.col("changed"), F.struct(*stored.columns)).alias("row"),
    )


def _line_actions(contacts: DataFrame, paths: DataFrame) -> DataFrame:
    """``dedup_key, year, draw``: lines that have to be drawn, or removed only."""
    new = contacts.select("dedup_key", "changed", "lined", "distance_km", "bearing_deg", "band", shown_mode().alias("mode"))
    have = paths.groupBy("dedup_key").agg(F.count("*").alias("lines"), *[F.first(c).alias(f"old_{c}") for c in PATH_VALUES])
    both = new.withColumn("known", F.lit(True)).join(have, "dedup_key", "full_outer")
    stale = reduce(or_, [~F.col(f"old_{c}").eqNullSafe(F.col(c)) for c in PATH_VALUES])
    draw = F.coalesce(F.col("lined") & (F.col("changed") | F.col("lines").isNull() | (F.col("lines") > 1) | stale), F.lit(False))
    remove = F.col("lines").isNotNull() & ~F.coalesce(F.col("lined"), F.lit(False))
    return both.select("dedup_key", year_of_key().alias("year"), draw.alias("draw"), remove.alias("remove")).where("draw OR remove").drop("remove")


def _new_lines(table: LogTable, contacts: DataFrame, actions: DataFrame, years: list[int]) -> Change:
    """The paths of these years with the actions done."""
    stored = table.kept_paths(years).where("dedup_key IS NOT NULL")
    kept = stored.join(actions.select("dedup_key"), "dedup_key", "left_anti").select(*stored.columns)
    wanted = actions.where("draw").select("dedup_key")
    drawn = contact_paths(contacts.join(wanted, "dedup_key", "left_semi"))
    foreign = [c for c in stored.columns if c not in KEPT_PATH_COLUMNS]
    if foreign:
        drawn = drawn.join(stored.select("dedup_key", *foreign).dropDuplicates(["dedup_key"]), "dedup_key", "left")
    sizes = stored.select("dedup_key").unionByName(wanted)
    return Change(kept.unionByName(project(drawn, KEPT_PATH_COLUMNS, foreign)), years, sizes)

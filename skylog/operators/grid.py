"""Locator grids: cells of an extent, points of locator lists, coverage, covering arcs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locator
from ..functions.text import WS

_CHUNK = 50_000


def split_extents(extents: DataFrame) -> DataFrame:
    """Extents in degrees as parts inside [-180, 180]; one past 180 is cut at the antimeridian.

    ``south, west, north, east``; latitudes are clamped to the world, parts wholly outside and
    extents that are no numbers are dropped. Adds ``part`` (1, 2).
    """
    s, w, n, e = (F.col(c) for c in ("south", "west", "north", "east"))
    sound = F.lit(True)
    for value in (s, w, n, e):
        sound = sound & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    rows = extents.where(sound & (s <= 90.0) & (n >= -90.0))
    shift = F.floor((w + 180.0) / 360.0) * 360.0
    rows = rows.withColumn("_w", w - shift).withColumn("_e", e - shift)
    south, north = F.greatest(s, F.lit(-90.0)), F.least(n, F.lit(90.0))

    def part(number: int, west: Column, east: Column) -> Column:
        return F.struct(
            F.lit(number).alias("part"), south.alias("south"), west.cast("double").alias("west"),
            north.alias("north"), east.cast("double").alias("east"),
        )

    whole = F.array(part(1, F.lit(-180.0), F.lit(180.0)))
    one = F.array(part(1, F.col("_w"), F.col("_e")))
    two = F.array(
        part(1, F.col("_w"), F.lit(180.0)), part(2, F.lit(-180.0), F.col("_e") - 360.0)
    )
    parts = F.when(e - w >= 360.0, whole).when(F.col("_e") <= 180.0, one).otherwise(two)
    keep = [c for c in extents.columns if c not in ("south", "west", "north", "east")]
    return rows.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.*")


def with_cells(extents: DataFrame, level: int) -> DataFrame:
    """Adds ``cells`` (row and column range) and ``n_cells`` without generating a cell."""
    cells = locator.cell_range(*[F.col(c) for c in ("south", "west", "north", "east")], level)
    return extents.withColumn("cells", cells).withColumn(
        "n_cells", locator.count_cells(F.col("cells"))
    )


def grid_cells(extents: DataFrame, level: int, max_cells: int | None = None) -> DataFrame:
    """All cells of the extents: ``locator`` and its bounds, west to east then south to north.

    Cells are generated in chunks spread over the cluster, so one huge extent is not one task.
    ``max_cells`` is an optional guard per extent; a larger one fails the job with its count.
    """
    size = locator.SPANS[level]
    keep = extents.columns
    rows = with_cells(extents, level).where("n_cells > 0")
    if max_cells is not None:
        message = F.concat(F.lit("the grid would have "), F.col("n_cells").cast("string"), F.lit(" cells"))
        guard = F.when(F.col("n_cells") > max_cells, F.raise_error(message).cast("long"))
        rows = rows.withColumn("n_cells", F.coalesce(guard, F.col("n_cells")))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_cells") - 1) / _CHUNK).cast("long"))
    chunked = rows.select(*keep, "cells", "n_cells", F.explode(chunks).alias("chunk")).repartition(
        *[F.col(c) for c in keep], "chunk"
    )
    last = F.least((F.col("chunk") + 1) * _CHUNK, F.col("n_cells")) - 1
    ids = chunked.select(*keep, "cells", F.explode(F.sequence(F.col("chunk") * _CHUNK, last)).alias("id"))
    height = F.col("cells.row_end") - F.col("cells.row_first")
    row = F.col("cells.row_first") + F.col("id") % height
    column = F.col("cells.col_first") + F.floor(F.col("id") / height).cast("long")
    placed = ids.select(*keep, "id", (row * size).alias("_y"), (column * size).alias("_x"))
    y, x = F.col("_y"), F.col("_x")
    return placed.select(
        *[c for c in keep if c not in ("south", "west", "north", "east")],
        "id",
        locator.encode(y, x, level).alias("locator"),
        locator.lat_degrees(y).alias("lat_min"),
        locator.lon_degrees(x).alias("lon_min"),
        locator.lat_degrees(y + size).alias("lat_max"),
        locator.lon_degrees(x + size).alias("lon_max"),
    )


def split_locators(df: DataFrame, text: str, out: str = "token") -> DataFrame:
    """One row per token of a locator list (white space, commas, semicolons), with ``pos``."""
    tokens = F.filter(F.split(F.col(text), f"[{WS},;]+"), lambda t: t != "")
    return df.select("*", F.posexplode(tokens).alias("pos", out))


def locator_points(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Centre points of locators: ``locator, precision, lat, lon`` and a ``note``.

    Invalid tokens keep a row with the note ``invalid`` (report) and no point.
    """
    rows = tokens.withColumn("locator", locator.normalize(token))
    point = locator.centre("locator")
    note = F.when(F.col("locator").isNull(), "invalid").when(
        F.char_length(token) > F.char_length("locator"), "cut"
    )
    return rows.select(
        "*", F.char_length("locator").alias("precision"), point["lat"].alias("lat"),
        point["lon"].alias("lon"), note.alias("note"),
    )


def coverage(points: DataFrame, lat: str, lon: str, level: int = 4) -> DataFrame:
    """Contacts per locator cell: points are counted by cell before anything else joins."""
    cell = locator.of_position(lat, lon, level)
    return (
        points.select(cell.alias("locator")).where("locator IS NOT NULL")
        .groupBy("locator").agg(F.count("*").alias("n"))
    )


def level_counts(points: DataFrame, lat: str, lon: str, levels: tuple[int, ...] = (2, 4, 6, 8)) -> DataFrame:
    """``level, locator, n``: contacts per cell of every level.

    Points are counted by the finest cell once; a coarser cell is a prefix of its finer ones, so the other levels are
    sums over cells, not over points.
    """
    fine = coverage(points, lat, lon, max(levels))
    each = F.array(*[F.struct(F.lit(v).alias("level"), F.left("locator", F.lit(v)).alias("cell")) for v in levels])
    return fine.select(F.inline(each), "n").groupBy("level", F.col("cell").alias("locator")).agg(F.sum("n").alias("n"))


def cell_hierarchy(
    extents: DataFrame, points: DataFrame, lat: str, lon: str, levels: tuple[int, ...] = (2, 4)
) -> DataFrame:
    """All cells of the extents at every level, with ``level`` and the number of contacts ``n``, 0 where there is none."""
    cells = [grid_cells(extents, v).withColumn("level", F.lit(v)) for v in levels]
    joined = reduce(DataFrame.unionByName, cells).join(level_counts(points, lat, lon, levels), ["level", "locator"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def covering_box(points: DataFrame, group: str, lat: str, lon: str) -> DataFrame:
    """Latitude range and shortest longitude arc that holds all points of each group.

    The arc leaves out the largest gap between neighbouring longitudes and may pass 180
    (``lon_max`` above 180 then). Longitudes are reduced to one-degree slices first, so a hot
    group is sorted in slices and its last step sees at most 360 rows.
    """
    # a longitude in range stays as it is: rounding would settle ties between equal gaps by chance
    inside = (F.col(lon) >= -180.0) & (F.col(lon) < 180.0)
    turned = F.when(inside, F.col(lon)).otherwise(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) - 180.0)
    rows = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        group, F.col(lat).alias("_lat"), turned.alias("_lon")
    )
    distinct = rows.groupBy(group, "_lon").agg(F.min("_lat").alias("_s"), F.max("_lat").alias("_n"))
    sliced = distinct.withColumn("_slice", F.floor("_lon"))
    in_slice = Window.partitionBy(group, "_slice").orderBy("_lon")
    previous = F.lag("_lon").over(in_slice)
    # per slice: ends, and its widest inner gap with the longitude that follows it
    slices = (
        sliced.withColumn("_prev", previous)
        .groupBy(group, "_slice")
        .agg(
            F.min("_lon").alias("_first"), F.max("_lon").alias("_last"),
            F.min("_s").alias("_s"), F.max("_n").alias("_n"),
            F.max(
                F.when(F.col("_prev").isNotNull(), F.struct(
                    (F.col("_lon") - F.col("_prev")).alias("gap"), F.col("_lon").alias("start"),
                    F.col("_prev").alias("before"),
                ))
            ).alias("_inner"),
        )
    )
    across = Window.partitionBy(group).orderBy("_slice")
    before = F.lag("_last").over(across)
    outer = F.when(
        before.isNotNull(),
        F.struct((F.col("_first") - before).alias("gap"), F.col("_first").alias("start"), before.alias("before")),
    )
    best = slices.select("*", outer.alias("_outer")).groupBy(group).agg(
        F.min("_first").alias("_west"), F.max("_last").alias("_east"),
        F.min("_s").alias("lat_min"), F.max("_n").alias("lat_max"),
        F.max(F.greatest("_inner", "_outer")).alias("_widest"),
    )
    wrap = F.col("_west") + 360.0 - F.col("_east")
    widest = F.col("_widest")
    # a tie goes to the gap between neighbours, as its index is higher than the wrap's
    inside = widest.isNotNull() & (widest["gap"] >= wrap)
    return best.select(
        group, "lat_min", "lat_max",
        F.when(inside, widest["start"]).otherwise(F.col("_west")).alias("lon_min"),
        F.when(inside, widest["before"] + 360.0).otherwise(F.col("_east")).alias("lon_max"),
    )

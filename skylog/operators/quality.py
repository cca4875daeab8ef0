"""Entry rules as a data-quality report over any log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, fields, geo, locator, modes
from ..functions.text import filled, reused, upper_filled

MIN_DISTANCE_KM = 0.01


@reused
def rule_codes(call, freq, band, mode, submode, grid) -> Column:
    """Codes of the broken rules of one entry, empty when it can be saved."""
    name = upper_filled(call)
    mhz = fields.parse_freq(freq)
    wanted = bands.clean_band(band)
    pair = modes.split_mode(mode)
    is_call = name.rlike(r"^[A-Z0-9/]+\z") & name.rlike("[0-9]") & name.rlike("[A-Z]")
    text = filled(grid)
    return F.array_compact(
        F.array(
            F.when(name.isNull(), "call_missing").when(~is_call, "call_invalid"),
            F.when(filled(freq).isNotNull() & mhz.isNull(), "freq_invalid"),
            F.when(wanted.isNull(), "band_missing").when(
                mhz.isNotNull() & ~bands.band_of_mhz(mhz).eqNullSafe(wanted), "band_mismatch"
            ),
            F.when(pair["mode"] == "", "mode_missing"),
            F.when(text.isNotNull() & locator.normalize(text).isNull(), "grid_invalid"),
        )
    )


def pointing_plan(
    rows: DataFrame, low: float, high: float, current: Column | None = None, long_way: bool = False
) -> DataFrame:
    """Antenna azimuth per contact, with the reason where there is none.

    ``rows`` has ``my_lat, my_lon, lat, lon``. Adds ``azimuth, aim_bearing, aim_km, no_aim``.
    """
    ends = [F.col(c) for c in ("my_lat", "my_lon", "lat", "lon")]
    df = rows.select(
        "*",
        geo.distance_km(*ends).alias("_d"),
        geo.bearing_deg(*ends).alias("_b"),
        geo.is_antipodal(*ends).alias("_anti"),
    )
    far = geo.long_path("_d", "_b")
    bearing = far["bearing_deg"] if long_way else F.col("_b")
    distance = far["distance_km"] if long_way else F.col("_d")
    df = df.select("*", bearing.alias("_aim"), distance.alias("_km"))
    target = geo.rotator_azimuth("_aim", F.lit(float(low)), F.lit(float(high)), current)
    reason = (
        F.when(F.col("my_lat").isNull(), "no_station")
        .when(F.col("lat").isNull(), "no_position")
        .when(F.col("_d") < MIN_DISTANCE_KM, "at_station")
        .when(F.col("_anti"), "antipode")
    )
    df = df.withColumn("_why", reason)
    open_ = F.col("_why").isNull()
    return df.select(
        *rows.columns,
        F.when(open_, target).alias("azimuth"),
        F.when(open_, F.col("_aim")).alias("aim_bearing"),
        F.when(open_, F.col("_km")).alias("aim_km"),
        F.when(open_ & target.isNull(), "out_of_range").otherwise(F.col("_why")).alias("no_aim"),
    )


def clean_stations(stations: DataFrame) -> DataFrame:
    """``station_id, call, grid`` with both cleaned; ``bad_grid`` marks a given, unusable locator."""
    grid = locator.normalize("grid")
    others = [c for c in stations.columns if c not in ("call", "grid")]
    return stations.select(
        *others,
        F.coalesce(upper_filled("call"), F.lit("")).alias("call"),
        F.coalesce(grid, F.lit("")).alias("grid"),
        (filled("grid").isNotNull() & grid.isNull()).alias("bad_grid"),
    )

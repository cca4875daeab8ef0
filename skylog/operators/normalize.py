"""Log records to contact rows: one projection pipeline and the lookup of their distinct calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, fields, geo, locator, modes
from ..functions.text import filled, reused, shown, strip
from ..schema import STATION_MARK, STORED_COLUMNS
from .countries import Countries, lookup

_POSITION_FIELDS = ["LAT", "LON", "MY_LAT", "MY_LON"]
WARNING_TYPE = "array<struct<code:string,field:string,value:string>>"


def tidy_names(records: DataFrame) -> DataFrame:
    """Field names upper-cased and stripped; of names that then coincide the last one wins."""
    entries = F.transform(
        F.map_entries("fields"),
        lambda e: F.struct(F.upper(strip(e["key"])).alias("key"), e["value"].alias("value")),
    )
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(
        names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    )
    return records.withColumn("fields", F.map_from_arrays(names, values))


def flatten_records(records: DataFrame) -> DataFrame:
    """``fields MAP`` -> one text column per mapped field plus the ``extra`` map."""
    keep = [c for c in records.columns if c != "fields"]
    get = F.col("fields").getItem
    wanted = fields.MAPPED_FIELDS + _POSITION_FIELDS
    present = F.map_filter("fields", lambda _, v: v.isNotNull())
    extra = F.transform_values(fields.extra_fields(present), lambda _, v: strip(v))
    return records.select(*keep, *[get(n).alias(n) for n in wanted], extra.alias("extra"))


def _warning(when: Column, code: str, field: str, value: Column | None = None) -> Column:
    text = F.lit(None).cast("string") if value is None else value
    return F.when(
        when,
        F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), text.alias("value")),
    )


def typed_texts(df: DataFrame, station_grid: Column) -> DataFrame:
    """The field texts (``f_*``, stripped, NULL when blank) as values, each parsed once.

    Adds coordinates ``_y, _x, _my_y, _my_x``, canonical locators ``_loc, _my_loc, _station`` and
    the log's own entity values ``_dxcc, _cont, _cq, _itu``.
    """
    return df.select(
        "*",
        fields.parse_latlon("f_LAT", "NS").alias("_y"),
        fields.parse_latlon("f_LON", "EW").alias("_x"),
        fields.parse_latlon("f_MY_LAT", "NS").alias("_my_y"),
        fields.parse_latlon("f_MY_LON", "EW").alias("_my_x"),
        locator.normalize("f_GRIDSQUARE").alias("_loc"),
        locator.normalize("f_MY_GRIDSQUARE").alias("_my_loc"),
        locator.normalize(station_grid).alias("_station"),
        fields.bounded_int("f_DXCC", 0, 999).alias("_dxcc"),
        fields.continent("f_CONT").alias("_cont"),
        fields.bounded_int("f_CQZ", 1, 40).alias("_cq"),
        fields.bounded_int("f_ITUZ", 1, 90).alias("_itu"),
    )


def derive(df: DataFrame) -> DataFrame:
    """Position, origin, entity columns, distance and bearing of typed rows with a ``match``.

    The other station: coordinates > locator > entity > middle of a two-letter field (the entity
    comes first when it lies inside that field). My position: coordinates > my locator > the
    station; a station locator inside a coarser logged one names the place better. Entity
    columns: the log's valid value wins.
    """
    station, mine = F.col("_station"), F.col("_my_loc")
    real, my_real = fields.is_position("_y", "_x"), fields.is_position("_my_y", "_my_x")
    df = df.select(
        "*", real.alias("_real"), my_real.alias("_my_real"),
        (~my_real & (F.char_length(mine) < F.char_length(station)) & F.startswith(station, mine))
        .alias("_refined"),
        locator.centre("_loc").alias("_mid"),
        (F.char_length("_loc") == 2).alias("_coarse"),
    )
    df = df.withColumn(
        "_origin_cell", F.when(F.col("_refined"), station).otherwise(F.coalesce(mine, station))
    )
    match, middle = F.col("match"), F.col("_mid")
    in_field = (F.abs(match["lat"] - middle["lat"]) <= 5.0) & (
        F.abs(match["lon"] - middle["lon"]) <= 10.0
    )
    usable = match.isNotNull() & (F.col("_loc").isNull() | (F.col("_coarse") & in_field))
    my_real = F.col("_my_real")
    own_cell = F.when(my_real, locator.of_position("_my_y", "_my_x", 6))
    df = df.select(
        "*",
        F.when(F.col("_real"), "latlon")
        .when(F.col("_loc").isNotNull() & ~F.col("_coarse"), "grid")
        .when(usable, "cty")
        .when(F.col("_loc").isNotNull(), "grid")
        .alias("loc_source"),
        F.when(F.col("_refined"), station)
        .otherwise(F.coalesce(mine, "f_MY_GRIDSQUARE", own_cell, station))
        .alias("my_gridsquare"),
        F.when(~my_real, locator.centre("_origin_cell")).alias("_my_mid"),
        F.coalesce("_dxcc", match["dxcc"]).alias("dxcc"),
        F.coalesce("f_COUNTRY", match["dxcc_name"]).alias("country"),
        F.coalesce("_cont", match["continent"]).alias("cont"),
        F.coalesce("_cq", match["cq_zone"]).alias("cq_zone"),
        F.coalesce("_itu", match["itu_zone"]).alias("itu_zone"),
    )
    source = F.col("loc_source")

    def axis(logged: str, name: str) -> Column:
        return (
            F.when(source == "latlon", F.col(logged))
            .when(source == "grid", middle[name])
            .when(source == "cty", match[name])
        )

    df = df.select(
        "*", axis("_y", "lat").alias("lat"), axis("_x", "lon").alias("lon"),
        F.when(my_real, F.col("_my_y")).otherwise(F.col("_my_mid.lat")).alias("my_lat"),
        F.when(my_real, F.col("_my_x")).otherwise(F.col("_my_mid.lon")).alias("my_lon"),
    )
    return df


def no_match(df: DataFrame) -> DataFrame:
    """A run without country data."""
    kinds = "struct<lat:double,lon:double,dxcc:int,dxcc_name:string,continent:string,"
    return df.withColumn("match", F.lit(None).cast(kinds + "cq_zone:int,itu_zone:int>"))


def normalize(
    records: DataFrame,
    station_grid: Column | str | None = None,
    dim: Countries | None = None,
    source: Column | str = "",
    mark_station: bool = False,
) -> DataFrame:
    """Records to contact rows, bad ones included with a ``skip_reason``.

    ``records`` holds ``fields MAP<STRING,STRING>`` or the flat columns of
    :func:`flatten_records`; other columns (file, record number, ingest order) pass through.
    ``station_grid`` is my locator, as text or as a column (many stations in one run).
    ``mark_station`` notes in ``adif_extra`` that my locator came from the station.
    """
    if "fields" in records.columns:
        records = flatten_records(records)
    texts = fields.MAPPED_FIELDS + _POSITION_FIELDS
    passing = [c for c in records.columns if c not in texts and c != "extra"]
    station = station_grid if isinstance(station_grid, Column) else F.lit(station_grid).cast("string")
    origin = source if isinstance(source, Column) else F.lit(source)
    df = records.select(
        *passing, "extra", *[filled(n).alias(f"f_{n}") for n in texts],
        station.alias("_station_text"), origin.alias("source"),
    )
    df = typed_texts(df, F.col("_station_text")).select(
        "*",
        F.upper("f_CALL").alias("call"),
        fields.parse_qso_time("f_QSO_DATE", "f_TIME_ON").alias("qso_datetime"),
        fields.parse_freq("f_FREQ").alias("freq_mhz"),
        F.upper("f_MODE").alias("mode"),
        F.upper("f_SUBMODE").alias("submode"),
        bands.clean_band("f_BAND").alias("_band"),
    )
    complete = F.col("f_COUNTRY").isNotNull() & (
        fields.is_position("_y", "_x") | (F.char_length("_loc") > 2)
    )
    for name in ("_dxcc", "_cont", "_cq", "_itu"):
        complete = complete & F.col(name).isNotNull()
    df = df.select(
        "*",
        F.when(F.col("call").isNull(), "missing_call")
        .when(F.col("qso_datetime").isNull(), "bad_datetime")
        .alias("skip_reason"),
        bands.band_of_mhz("freq_mhz").alias("_freq_band"),
        bands.is_band("_band").alias("_band_known"),
        F.coalesce(complete, F.lit(False)).alias("_complete"),
    )
    band = F.when(F.col("_band_known"), F.col("_band")).otherwise(F.coalesce("_freq_band", "_band"))
    df = df.withColumn("band", band)
    if dim is None:
        df = no_match(df)
    else:
        # the key stays the plain call: a longer expression would be repeated in every probe
        df = lookup(df, "f_CALL", dim)
    df = derive(df)
    extra = F.col("extra")
    if mark_station:
        marked = (
            F.col("_station").isNotNull()
            & F.col("f_MY_GRIDSQUARE").isNull()
            & ~F.col("_my_real")
        )
        mark = F.create_map(F.lit(STATION_MARK), F.lit("Y"))
        without = F.map_filter(extra, lambda k, _: k != STATION_MARK)
        extra = F.when(marked, F.map_concat(without, mark)).otherwise(extra)
    plain = {name: F.col(name) for name in STORED_COLUMNS}
    plain["rst_sent"], plain["rst_rcvd"] = F.col("f_RST_SENT"), F.col("f_RST_RCVD")
    plain["gridsquare"] = F.coalesce("_loc", "f_GRIDSQUARE")
    plain["distance_km"] = geo.distance_km("my_lat", "my_lon", "lat", "lon")
    plain["bearing_deg"] = geo.bearing_deg("my_lat", "my_lon", "lat", "lon")
    plain["dedup_key"] = fields.dedup_key("call", "qso_datetime", "band", "mode", "submode", True)
    plain["adif_extra"] = fields.json_object(extra)
    return df.select(
        *passing, *[plain[n].alias(n) for n in STORED_COLUMNS], "skip_reason",
        _warnings().alias("warnings"),
    )


@reused
def _warnings() -> Column:
    def given(field: str) -> Column:
        return F.col(f"f_{field}").isNotNull()

    def bad(field: str, value: str, code: str = "bad_value") -> Column:
        text = F.col(f"f_{field}")
        return _warning(text.isNotNull() & F.col(value).isNull(), code, field, text)

    def pair(lat: str, lon: str, y: str, x: str) -> list[Column]:
        return [
            bad(lat, y),
            bad(lon, x),
            _warning((F.col(y) == 0.0) & (F.col(x) == 0.0), "zero_position", f"{lat}/{lon}"),
            _warning(F.col(y).isNotNull() & ~given(lon), "lone_coordinate", lat),
            _warning(F.col(x).isNotNull() & ~given(lat), "lone_coordinate", lon),
        ]

    def locators(field: str, name: str) -> list[Column]:
        text = F.col(f"f_{field}")
        cut = F.char_length(name) < F.char_length(text)
        return [bad(field, name, "bad_locator"), _warning(cut, "locator_cut", field, text)]

    no_freq_band, unknown = F.col("_freq_band").isNull(), given("BAND") & ~F.col("_band_known")
    outside = ~given("BAND") & no_freq_band & F.col("freq_mhz").isNotNull()
    checks = [
        bad("FREQ", "freq_mhz"),
        _warning(outside, "freq_outside_bands", "FREQ", F.col("f_FREQ")),
        _warning(unknown & ~no_freq_band, "band_from_freq", "BAND", F.col("f_BAND")),
        _warning(unknown & no_freq_band, "unknown_band_kept", "BAND", F.col("f_BAND")),
        *locators("GRIDSQUARE", "_loc"),
        *locators("MY_GRIDSQUARE", "_my_loc"),
        *pair("LAT", "LON", "_y", "_x"),
        *pair("MY_LAT", "MY_LON", "_my_y", "_my_x"),
        bad("DXCC", "_dxcc"),
        bad("CQZ", "_cq"),
        bad("ITUZ", "_itu"),
        bad("CONT", "_cont"),
        # a complete record is never compared with the reference data
        _warning(
            (F.col("_dxcc") != F.col("match.dxcc")) & ~F.col("_complete"), "dxcc_mismatch", "DXCC", F.col("_dxcc").cast("string"),
        ),
        _warning(
            F.col("_coarse") & (F.col("loc_source") == "grid"), "field_centre", "GRIDSQUARE", F.col("_loc")
        ),
    ]
    skipped = F.array(
        F.struct(
            F.col("skip_reason").alias("code"),
            F.when(F.col("skip_reason") == "missing_call", "CALL").otherwise("QSO_DATE").alias("field"),
            F.lit(None).cast("string").alias("value"),
        )
    )
    found = F.transform(
        F.array_compact(F.array(*checks)),
        lambda w: F.struct(w["code"].alias("code"), w["field"].alias("field"), shown(w["value"]).alias("value")),
    )
    return F.when(F.col("skip_reason").isNotNull(), skipped).otherwise(found)


def accepted(rows: DataFrame) -> DataFrame:
    """The rows that are contacts."""
    return rows.where("skip_reason IS NULL").drop("skip_reason")

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skylog.functions import bands, fields, geo, locator, modes
from skylog.operators import grid, quality, recalc


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_known_values(spark):
    beograd, sydney = (F.lit(44.8125), F.lit(20.4612)), (F.lit(-33.8688), F.lit(151.2093))
    row = one(
        spark,
        locator.of_position(*beograd, 6), locator.of_position(*beograd, 8),
        locator.of_position(*sydney, 8), geo.distance_km(*beograd, *sydney),
        fields.parse_latlon(F.lit("S033 52.128")), locator.centre(F.lit("KN04ft")),
        locator.of_position(F.lit(90.0), F.lit(180.0), 8), locator.of_position(F.lit(91.0), F.lit(0.0), 6),
    )
    assert list(row)[:3] == ["KN04ft", "KN04ft55", "QF56od51"]
    assert row.c3 == pytest.approx(15679.7, abs=0.05)
    assert row.c4 == pytest.approx(-33.8688)
    assert tuple(row.c5) == (44.8125, 20.458333333333332)
    assert row.c6 == "RR99xx99" and row.c7 is None


@pytest.mark.parametrize("text,want", [
    ("N044 48.750", 44.8125), ("n44 48,75", 44.8125), ("W180 00.000", -180.0), ("W180 00.001", None),
    ("N044 60.000", None), ("N044", None), ("S000 00.000", 0.0), ("N090 00.000\n", 90.0), ("", None),
])
def test_parse_latlon(spark, text, want):
    got = one(spark, fields.parse_latlon(F.lit(text)))[0]
    assert got == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("text,want", [
    ("14,074", 14.074), (" +.5 ", 0.5), ("7.", 7.0), ("0", None), ("-3", None), ("1e3", None), ("9" * 400, None),
])
def test_parse_freq(spark, text, want):
    assert one(spark, fields.parse_freq(F.lit(text)))[0] == want


@pytest.mark.parametrize("day,clock,want", [
    ("20240229", "2359", dt.datetime(2024, 2, 29, 23, 59)), ("20240229", "235960", None),
    ("20260230", "1200", None), ("19291231", "0000", None), ("20240101", "2400", None),
    (" 20240101 ", "120001", dt.datetime(2024, 1, 1, 12, 0, 1)), ("2024010", "1200", None),
])
def test_parse_qso_time(spark, day, clock, want):
    assert one(spark, fields.parse_qso_time(F.lit(day), F.lit(clock)))[0] == want


@pytest.mark.parametrize("text,want", [
    ("2026-09-15T18:45:00Z", dt.datetime(2026, 9, 15, 18, 45)),
    ("20260915T184500+0200", dt.datetime(2026, 9, 15, 16, 45)),
    ("2026-09-15 18:45:00,5-01", dt.datetime(2026, 9, 15, 19, 45, 0, 500000)),
    ("2026-09-15", dt.datetime(2026, 9, 15)), ("2026-09-15T1845", dt.datetime(2026, 9, 15, 18, 45)),
    ("2026-02-30T10:00", None), ("2026-09-15T18:45+24:00", None), ("2026-0915", None), ("soon", None),
])
def test_parse_iso(spark, text, want):
    assert one(spark, fields.parse_iso(F.lit(text)))[0] == want


def test_modes(spark):
    none = F.lit(None).cast("string")
    row = one(
        spark,
        modes.dedup_mode(F.lit("MFSK"), F.lit("ft4")), modes.dedup_mode(F.lit("FT4"), none),
        modes.dedup_mode(F.lit("usb "), none), modes.dedup_mode(none, F.lit("JT65B")),
        modes.dedup_mode(F.lit("RTTY"), F.lit("USB")), modes.display_mode(F.lit(" mfsk"), F.lit(" ")),
        modes.default_rst(F.lit("ft4"), none), modes.default_rst(F.lit("SSB"), none),
        modes.default_rst(F.lit("PSK31"), none), modes.default_rst(none, none),
        modes.receiver_mode(F.lit(" cw-r ")), modes.is_data_mode(F.lit("fm-d")),
    )
    assert list(row) == ["FT4", "FT4", "SSB", "JT65", "RTTY", "MFSK", "-10", "59", "599", "", "CWR", True]


def test_bands(spark):
    row = one(
        spark, bands.band_of_mhz(F.lit(14.35)), bands.band_of_mhz(F.lit(14.351)), bands.band_of_mhz(F.lit(54.0)),
        bands.logged_band(F.lit(" 20M"), F.lit("40m")), bands.logged_band(F.lit("11m"), F.lit("10m")),
        bands.logged_band(F.lit("11M"), F.lit(None).cast("string")),
    )
    assert list(row) == ["20m", None, "6m", "20m", "10m", "11m"]


def test_locator_round_trip_and_bounds(spark):
    rows = spark.range(2000).selectExpr(
        "(id * 7919 % 17999 - 8999) / 100.0D AS lat", "(id * 104729 % 35999 - 17999) / 100.0D AS lon"
    )
    for n in (2, 4, 6, 8):
        loc = locator.of_position("lat", "lon", n)
        checked = rows.withColumn("loc", loc).withColumn("mid", locator.centre("loc"))
        again = locator.of_position(F.col("mid.lat"), F.col("mid.lon"), n)
        bad = checked.where((again != F.col("loc")) | ~locator.holds(F.col("loc"), F.col("lat"), F.col("lon")))
        assert bad.count() == 0


def test_destination_inverts_distance_and_bearing(spark):
    rows = spark.range(500).selectExpr(
        "(id * 7919 % 17001 - 8500) / 100.0D AS lat", "(id * 104729 % 35999 - 18000) / 100.0D AS lon",
        "CAST(id * 31 % 360 AS DOUBLE) AS b", "CAST(id * 37 % 19000 + 1 AS DOUBLE) AS d",
    )
    there = rows.withColumn("p", geo.destination("lat", "lon", "b", "d"))
    back = geo.distance_km("lat", "lon", F.col("p.lat"), F.col("p.lon"))
    assert there.where(F.abs(back - F.col("d")) > 1e-5).count() == 0


@pytest.mark.parametrize("args,want", [
    ((350.0, -180.0, 180.0, 0.0), -10.0), ((270.0, 0.0, 180.0, None), None), ((10.0, 0.0, 450.0, 400.0), 370.0),
    ((10.0, 0.0, 450.0, None), 10.0), ((-90.0, 0.0, 360.0, None), 270.0), ((5.0, 20.0, 10.0, None), None),
])
def test_rotator(spark, args, want):
    b, lo, hi, cur = args
    current = None if cur is None else F.lit(cur)
    assert one(spark, geo.rotator_azimuth(F.lit(b), F.lit(lo), F.lit(hi), current))[0] == want


def test_change_predicate_and_rules(spark):
    null = F.lit(None).cast("double")
    row = one(
        spark, recalc.same(F.lit(1.0), F.lit(1.0 + 1e-12), True), recalc.same(null, null, True),
        recalc.same(F.lit(1.0), null, True), recalc.same(F.lit("a"), F.lit("b"), False),
        quality.rule_codes(F.lit("abc"), F.lit("x"), F.lit(""), F.lit(""), F.lit(""), F.lit("ZZ")),
        quality.rule_codes(F.lit("yu1ab"), F.lit("14.1"), F.lit("20m"), F.lit("ft4"), F.lit(""), F.lit("KN04")),
    )
    assert list(row)[:4] == [True, True, False, False]
    assert row.c4 == ["call_invalid", "freq_invalid", "band_missing", "mode_missing", "grid_invalid"]
    assert row.c5 == []


def test_lines_by_invariants():
    """Ends, spacing, length, one shared cut on the antimeridian, no neighbours more than half a turn apart."""
    import numpy as np

    from skylog.operators.paths import RADIUS_KM, _lines, _unit

    r = np.random.default_rng(1)
    n = 400
    ends = np.array([r.uniform(-90, 90, n), r.uniform(-180, 180, n), r.uniform(-90, 90, n), r.uniform(-180, 180, n)])
    ends[:, :150] = np.round(ends[:, :150] / 90) * 90  # poles, meridians, the antimeridian itself
    angle = lambda u, v: np.arctan2(np.linalg.norm(np.cross(u, v)), u @ v)
    for (lat1, lon1, lat2, lon2), parts in zip(ends.T, _lines(*ends, 100.0).to_pylist()):
        if not parts or len(parts[0]) == 1:  # antipodes, or one and the same point (of a pole, by any longitude)
            continue
        first, last = parts[0][0], parts[-1][-1]
        assert (first["lat"], last["lat"]) == (lat1, lat2)
        assert abs((first["lon"] - lon1 + 180) % 360 - 180) < 1e-9 and abs((last["lon"] - lon2 + 180) % 360 - 180) < 1e-9
        total = 0.0
        for part in parts:
            for p, q in zip(part, part[1:]):
                assert abs(p["lon"] - q["lon"]) <= 180 + 1e-9
                step = angle(_unit(p["lat"], p["lon"]), _unit(q["lat"], q["lon"])) * RADIUS_KM
                assert step <= 100.0001
                total += step
        for a, b in zip(parts, parts[1:]):
            assert a[-1]["lat"] == b[0]["lat"] and a[-1]["lon"] == -b[0]["lon"] and abs(b[0]["lon"]) == 180
        whole = angle(_unit(lat1, lon1), _unit(lat2, lon2)) * RADIUS_KM
        assert abs(total - whole) <= 1e-6 * max(whole, 1)


def test_covering_arc_between_equal_gaps(spark):
    """Two gaps of 125.07 degrees: the longitudes as given settle the tie, not rounding noise."""
    points = spark.createDataFrame([(1, 0.0, -131.37), (1, 1.0, -6.3), (1, 2.0, 118.77), (2, 0.0, 190.0), (2, 0.0, -180.0)], "g int, y double, x double")
    got = {r["g"]: (round(r["lon_min"], 6), round(r["lon_max"], 6)) for r in grid.covering_box(points, "g", "y", "x").collect()}
    assert got == {1: (-6.3, 228.63), 2: (-180.0, -170.0)}

from collections import Counter

import pytest
from pyspark.sql import functions as F

from skylog import api
from skylog.operators import countries as cty
from skylog.operators import paths
from skylog.operators.merge import LogTable, ensure_schema
from skylog.plans import catalog
from skylog.plans.world import world
from skylog.schema import STATION_MARK, STORED_COLUMNS
from skylog.sources import adif

DAT = """# remark; with a semicolon
stray text;
Serbia:  15:  28:  EU:   44.00:   -21.00:    -1.0:  YU:
    YT,YU,=YU9XX/P(5)[7];
Broken:  99:  28:  EU:   44.00:   -21.00:    -1.0:  ZZ:
    ZZ;
Sicily:  15:  28:  EU:   37.50:   -14.00:    -1.0:  *IT9:
    IT9,bad(,IT9X<10.5/20.5>{AF}~2~
Italy:   15:  28:  EU:   42.82:   -12.58:    -1.0:  I:
    I,YU;
"""


def test_country_scan(spark):
    files = spark.createDataFrame([(0, DAT)], "release int, text string")
    scan = cty.scan_country_files(files)
    assert [r["name"] for r in scan.entities.orderBy("entity_id").collect()] == ["Serbia", "Sicily", "Italy"]
    found = {(r["code"], r["text"]) for r in scan.warnings.collect()}
    assert found == {("stray_text", ""), ("bad_entity", ""), ("bad_entry", "bad("), ("entity_not_closed", "")}
    entry = {r["key"]: r for r in scan.entries.collect()}
    assert (entry["IT9X"]["continent"], entry["IT9X"]["lon"], entry["IT9X"]["utc_offset"]) == ("AF", -20.5, 2.0)
    lines = spark.createDataFrame(
        [(0, 1, "I,Italy,248,EU"), (0, 2, "*IT9,Sicily,248,EU"), (0, 3, "YU,x,0"), (0, 4, "I,again,5")],
        "release int, line int, text string",
    )
    built = cty.build_entities(scan.entities, cty.scan_codes(lines))
    assert {r["name"]: (r["dxcc"], r["dxcc_name"]) for r in built.collect()} == {
        "Serbia": (None, "Serbia"), "Sicily": (248, "Italy"), "Italy": (248, "Italy"),
    }
    dim = cty.countries(scan.entries.drop("release"), built.drop("release"))
    calls = spark.createDataFrame([("YU1A",), ("yu9xx/p",), ("IT9AB",), ("Q1A",), ("X" * 70 + "1",)], "c string")
    got = {r["c"]: r["e"] for r in cty.lookup(calls, "c", dim).select("c", F.col("match.name").alias("e")).collect()}
    # YU is listed twice: the first entity wins
    assert [got["YU1A"], got["yu9xx/p"], got["IT9AB"], got["Q1A"]] == ["Serbia", "Serbia", "Sicily", None]


def test_refresh_and_load(spark, tmp_path):
    files = spark.createDataFrame([(0, DAT + "\n=VER20260915")], "release int, text string")
    lines = spark.createDataFrame([(0, 1, "I,Italy,248")], "release int, line int, text string")
    root = str(tmp_path / "ref")
    refused = api.refresh_countries(spark, files, lines, root, minimum=3).first()
    assert (refused["installed"], refused["problem"]) == (False, "csv")
    assert api.load_countries(spark, root) is None
    taken = api.refresh_countries(spark, files, lines, root, minimum=1).first()
    assert taken["installed"] and taken["version"] == "2026-09-15"
    assert api.load_countries(spark, root).longest_prefix == 4


def test_release_of_two_files(spark, tmp_path):
    """The first entry of a key wins in the order of files, whatever its line."""
    one, two = DAT, DAT.replace("Serbia:", "Later: ").replace("    YT,YU,", "    YT,YU,Z2,Z3,")
    files = spark.createDataFrame([(1, two), (0, one)], "release int, text string")
    lines = spark.createDataFrame([(1, 1, "I,Italy,248"), (0, 9, "I,Italy,249")], "release int, line int, text string")
    root = str(tmp_path / "ref")
    assert api.refresh_countries(spark, files, lines, root, minimum=1).first()["entities"] == 6
    dim = api.load_countries(spark, root)
    calls = spark.createDataFrame([("YU1A",), ("Z2A1",), ("I1A",)], "c string")
    got = {r["c"]: (r["e"], r["d"]) for r in cty.lookup(calls, "c", dim).select("c", F.col("match.name").alias("e"), F.col("match.dxcc").alias("d")).collect()}
    assert got == {"YU1A": ("Serbia", None), "Z2A1": ("Later", None), "I1A": ("Italy", 249)}


LOG_A = (
    "header<EOH>\n<CALL:5>YU1AB<QSO_DATE:8>20240105<TIME_ON:4>1200<BAND:3>20M<MODE:4>MFSK<SUBMODE:3>FT4"
    "<GRIDSQUARE:6>JN95wg<EOR>\n<CALL:6>DL1ABC<QSO_DATE:8>20260230<TIME_ON:4>1200<EOR>\n"
    "<CALL:6>VK4ABC<QSO_DATE:8>20240106<TIME_ON:6>101112<FREQ:6>14,074<MODE:3>FT8<NAME:5>Đorđe<EOR>\n"
)
LOG_B = "<CALL:5>YU1AB<QSO_DATE:8>20240105<TIME_ON:6>120031<BAND:3>20m<MODE:3>FT4<EOR>"


def test_import_is_idempotent_and_recalculates(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.adi").write_bytes(LOG_A.encode())
    (logs / "b.adi").write_bytes(LOG_B.encode())
    root, dim = str(tmp_path / "table"), world(spark)
    first = api.import_logs(spark, str(logs), root, "KN04FT", dim)
    assert first == {"imported": 2, "duplicates": 1, "skipped": 1, "rejected_files": 0}
    told = api.last_report(spark, root)
    assert told["counts"].first().asDict() == {"records": 4, "skipped": 1, "warnings": 1, "imported": 2, "duplicates": 1, "failed": 0, "refused_files": 0}
    assert [(r["record_no"], r["stage"], r["code"], r["field"]) for r in told["warnings"].collect()] == [(2, "skipped", "bad_datetime", "QSO_DATE")]
    assert [(r["call"], r["reason"]) for r in told["rejected"].collect()] == [("DL1ABC", "bad_datetime")]
    again = api.import_logs(spark, str(logs), root, "KN04FT", dim, large_files=True)
    assert (again["imported"], again["duplicates"]) == (0, 3)
    table = LogTable(spark, root)
    rows = {r["call"]: r for r in table.contacts().collect()}
    assert rows["YU1AB"]["dedup_key"] == "YU1AB|202401051200|20m|FT4" and rows["YU1AB"]["source"] == "adif:a.adi"
    assert (rows["VK4ABC"]["country"], rows["VK4ABC"]["itu_zone"], rows["VK4ABC"]["loc_source"]) == ("Australia", 55, "cty")
    assert STATION_MARK in rows["VK4ABC"]["adif_extra"] and "Đorđe" in rows["VK4ABC"]["adif_extra"]
    assert table.paths().count() == 2 and table.meta()["schema_version"] == "2"
    assert api.recalculate(spark, root, "KN04ft", dim) == 0
    assert api.recalculate(spark, root, "JN95wg", dim) == 2
    assert api.recalculate(spark, root, "JN95wg", dim) == 0
    moved = {r["call"]: r for r in table.contacts().collect()}
    assert moved["VK4ABC"]["my_gridsquare"] == "JN95wg" and moved["YU1AB"]["distance_km"] < 1
    # both stations in one cell: no path any more
    assert [r["dedup_key"][:6] for r in table.paths().collect()] == ["VK4ABC"]
    with pytest.raises(ValueError):
        api.import_logs(spark, str(logs), root, "ZZ99")


def test_save_records_takes_names_in_any_case(spark, tmp_path):
    rows = [(1, {"call ": "yu1ab", "qso_date": "20240105", "Time_On": "1200", "band": "20m", "mode": "cw"})]
    records = spark.createDataFrame(rows, "record_no int, fields map<string,string>")
    root = str(tmp_path / "t")
    assert api.save_records(records, root, "manual") == 1
    assert api.save_records(records, root, "manual") == 0
    assert LogTable(spark, root).contacts().first()["source"] == "manual"


def test_newer_schema_is_reported(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"))
    table.set_meta(schema_version="9")
    assert "newer" in ensure_schema(table)[0]


def test_admission_and_export_round_trip(spark, tmp_path):
    big = b"<CALL:4>YU1A<eor>" * 10_001
    files = spark.createDataFrame([("f", bytearray(big), len(big))], "file string, content binary, length long")
    assert adif.admission(files, 1).first()["reject_reason"] == "too_many_records"
    rows = spark.createDataFrame([("YU1AB", "Đorđe", None), ("DL1X", "a<b", "c")], "c string, n string, k string")
    adif.write_logs(rows, str(tmp_path / "out"), adif.record_text({"call": "c", "NAME": "n", "COMMENT": "k"}))
    back = adif.records(adif.scan_logs(spark, str(tmp_path / "out" / "*.txt")))
    got = sorted((dict(r["fields"]) for r in back.collect()), key=lambda f: f["CALL"])
    assert got == [{"CALL": "DL1X", "NAME": "a<b", "COMMENT": "c"}, {"CALL": "YU1AB", "NAME": "Đorđe"}]
    with pytest.raises(ValueError):
        adif.record_text({"EOR": "c"})


@pytest.mark.parametrize("ends,n_parts", [
    ((44.8, 20.5, -33.9, 151.2), 1), ((35.0, 140.0, 37.0, -122.0), 2), ((10.0, 180.0, 10.0, -170.0), 1),
    ((0.0, 0.0, 0.0, 180.0), 0), ((80.0, 0.0, 80.0, 180.0), 1), ((1.0, 2.0, 1.0, 2.0), 1), ((91.0, 0.0, 0.0, 0.0), None),
])
def test_great_circles(spark, ends, n_parts):
    df = spark.createDataFrame([ends], "a double, b double, c double, d double")
    parts = paths.add_great_circle(df, *[F.col(c) for c in "abcd"]).first()["parts"]
    if n_parts is None:
        assert parts is None
        return
    assert len(parts) == n_parts
    for part in parts:
        for p, q in zip(part, part[1:]):
            assert abs(p["lon"] - q["lon"]) <= 180.0 and -180.0 <= p["lon"] <= 180.0
    if n_parts:
        assert (parts[0][0]["lat"], parts[-1][-1]["lat"]) == (ends[0], ends[2])
    if n_parts == 2:
        assert parts[0][-1]["lon"] == 180.0 and parts[1][0]["lon"] == -180.0
        assert parts[0][-1]["lat"] == parts[1][0]["lat"]


def test_grid_of_europe_and_guard(spark):
    europe = spark.createDataFrame([(1, 34.0, -25.0, 72.0, 45.0)], "id int, south double, west double, north double, east double")
    cells = api.grid_cells(spark, europe.drop("id"), 4)
    assert cells.count() == 1368 and cells.select("locator").distinct().count() == 1368
    with pytest.raises(Exception, match="1368 cells"):
        api.grid_cells(spark, europe.drop("id"), 4, max_cells=1000).collect()


def test_sql_functions(spark):
    api.register_sql(spark)
    row = spark.sql("SELECT round(distance_km(44.8125, 20.4612, -33.8688, 151.2093), 1) AS d, locator_ok('KN04') AS ok").first()
    assert (row["d"], row["ok"]) == (15679.7, True)
    assert spark.sql("SELECT * FROM adif_records('<CALL:4>YU1A<EOR>')").first()["fields"] == {"CALL": "YU1A"}


def test_stored_schema(spark, tmp_path):
    assert LogTable(spark, str(tmp_path / "none")).contacts().columns == list(STORED_COLUMNS)


def test_the_log_is_derived_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Events of one row group are one task of the scan; the derivation is dealt by their number, whole and once."""
    monkeypatch.setattr(catalog, "DEAL", 100)
    events = spark.range(0, 1000, 1, 1).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-05 12:00:00' AS ts", "id % 7 AS user_id", "'view' AS event_type", "0.5D AS value", "'' AS props"
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    tasks = catalog.raw(spark, str(tmp_path)).select("seq", F.spark_partition_id().alias("p")).collect()
    sizes = Counter(r["p"] for r in tasks)
    assert sorted(r["seq"] for r in tasks) == list(range(1000)) and len(sizes) == 10 and max(sizes.values()) < 200


def test_no_filter_of_the_import_runs_in_the_task_of_a_row_group(spark, tmp_path, monkeypatch):
    """Filters are pushed below the exchange that deals the rows, so what is scanned has to be dealt as well."""
    monkeypatch.setattr(catalog, "DEAL", 100)
    events = spark.range(0, 1000, 1, 1).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-05 12:00:00' AS ts", "id % 7 AS user_id", "'view' AS event_type", "0.5D AS value", "'' AS props"
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    files = catalog.raw(spark, str(tmp_path)).inputFiles()
    assert len(files) == 10 and max(spark.read.parquet(f).count() for f in files) < 200
    assert spark.read.parquet(*files).count() == 1000


def test_a_large_log_is_written_in_many_tasks_and_numbered_through(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "DEAL", 100)
    written = []
    write = adif.write_logs
    monkeypatch.setattr(adif, "write_logs", lambda rows, path, text: (written.append(path), write(rows, path, text)))
    events = spark.range(0, 500, 1, 1).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-05 12:00:00' AS ts", "id % 7 AS user_id", "'view' AS event_type", "0.5D AS value", "'' AS props"
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.adif_scan_large(spark, str(tmp_path)).select("record_no", "call").collect()
    wanted = [r["call_"] for r in catalog.raw(spark, str(tmp_path)).orderBy("seq").select("call_").collect()]
    assert [r["call"] for r in sorted(got)] == wanted and sorted(r["record_no"] for r in got) == list(range(1, 501))
    assert len(spark.read.text(written[0]).inputFiles()) == 5

"""Tables in versions: only touched years are written, readers see one version, keys are found by sketches."""

import os

import pytest
from pyspark.sql import functions as F

from skylog.operators import merge, paths, recalc, versions
from skylog.operators.merge import LogTable, insert_contacts, project
from skylog.plans.world import world
from skylog.schema import PATH_COLUMNS, STORED_COLUMNS


def contacts(spark, rows):
    """(call, time, my locator's middle) as stored rows."""
    made = spark.createDataFrame(rows, "call string, t string, lat double, lon double").select(
        "call", F.col("t").cast("timestamp_ntz").alias("qso_datetime"), F.lit("20m").alias("band"), F.lit("CW").alias("mode"),
        "lat", "lon", F.lit("grid").alias("loc_source"), F.lit("KN04").alias("my_gridsquare"), F.lit(44.5).alias("my_lat"), F.lit(21.0).alias("my_lon"),
        F.concat_ws("|", "call", F.date_format("t", "yyyyMMddHHmm"), F.lit("20m"), F.lit("CW")).alias("dedup_key"), F.lit(1).alias("seq"),
    )
    return project(made, STORED_COLUMNS, ["seq"])


def folders(root, table):
    base = f"{root}/data/{table}"
    return {(v, y) for v in os.listdir(base) if v.startswith("v=") for y in os.listdir(f"{base}/{v}") if y.startswith("year=")}


def test_versions_of_two_tables(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path), retain=1)
    rows = lambda year, n, at=0: spark.range(at, at + n).selectExpr(f"concat('C', id, '|{year}01010000|b|m') AS dedup_key", "id AS x")
    assert store.read("a") is None and store.current()["version"] == 0
    store.publish({"a": versions.Change(rows(2020, 100).unionByName(rows(2021, 10))), "b": versions.Change(rows(2020, 5))})
    before = store.read("a")
    store.publish({"a": versions.Change(rows(2021, 1, 1000))})
    manifest = store.current()
    assert [p["v"] for p in manifest["tables"]["a"]["years"]["2021"]] == [1, 2]  # a small part stays apart
    assert before.count() == 110 and store.read("a").count() == 111  # a reader of the old version goes on
    store.publish({"a": versions.Change(rows(2021, 20, 2000))})
    assert [p["v"] for p in store.current()["tables"]["a"]["years"]["2021"]] == [3]  # not smaller than what was there: one part
    assert [p["v"] for p in store.current()["tables"]["a"]["years"]["2020"]] == [1]
    assert store.read("a", [2021]).where("year = 2021").count() == 31
    plan = store.read("a").where("year = 2021").select("dedup_key")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<dedup_key:string>" in plan
    store.publish({"a": versions.Change(rows(2021, 3, 3000), replace=[2021, 2020])})
    assert {(r["dedup_key"], r["x"]) for r in store.read("a").collect()} == {(f"C{i}|202101010000|b|m", i) for i in (3000, 3001, 3002)}
    store.publish({"b": versions.Change(rows(2022, 1))}, meta={"k": "v"})
    assert folders(tmp_path, "a") == {("v=4", "year=2021")} and store.current()["meta"] == {"k": "v"}
    assert len([x for x in os.listdir(tmp_path / "_versions") if x.endswith(".json")]) == 2


def test_a_second_writer_is_refused(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path))
    base = store.current()
    rows = spark.sql("SELECT 'a' AS dedup_key")
    store.publish({"a": versions.Change(rows)}, base)
    with pytest.raises(versions.VersionConflict):
        store.publish({"a": versions.Change(rows)}, base)
    assert store.read("a").count() == 1


def test_a_writer_that_was_overtaken_is_refused(spark, tmp_path, monkeypatch):
    table = LogTable(spark, str(tmp_path))
    known = LogTable.known
    # another writer publishes the same contact between the question and the answer's use
    monkeypatch.setattr(LogTable, "known", lambda self, *a: (self.set_meta(k="v") if self.version() < 1 else None) or known(self, *a))
    one = contacts(spark, [("YU1A", "2020-01-01 00:00:00", 45.0, 20.0)])
    with pytest.raises(versions.VersionConflict):
        insert_contacts(table, one, "seq")
    assert table.contacts().count() == 0 and table.meta() == {"k": "v"}
    assert insert_contacts(table, one, "seq").first()["inserted"] == 1


def test_known_keys_by_sketch(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path))
    keys = lambda a, b, year=2020: spark.range(a, b).selectExpr(f"concat('C', id, '|{year}01010000|b|m') AS dedup_key")
    store.publish({"a": versions.Change(keys(0, 9000).unionByName(keys(0, 50, 2021)).unionByName(spark.sql("SELECT 'odd' AS dedup_key UNION ALL SELECT NULL")))})
    asked = keys(8990, 9010).unionByName(keys(40, 60, 2021)).unionByName(keys(0, 5, 2022)).unionByName(spark.sql("SELECT 'odd' AS dedup_key UNION ALL SELECT NULL UNION ALL SELECT 'even'"))
    got = {r[0] for r in store.known("a", asked).collect()}
    assert got == {f"C{i}|202001010000|b|m" for i in range(8990, 9000)} | {f"C{i}|202101010000|b|m" for i in range(40, 50)} | {"odd"}
    # keys that are not stored seldom pass: with none of them passing no key column is read
    few = store.known("a", keys(100_000, 100_003))
    assert few.count() == 0 and "data/a/" not in few._jdf.queryExecution().toString()
    assert store.known("nothing", asked).count() == 0


def changed_calls(spark, table, station):
    before = {r["call"]: tuple(r) for r in table.contacts().collect()}
    n = recalc.recalculate_table(table, station, world(spark))
    return n, {c for c, r in ((r["call"], tuple(r)) for r in table.contacts().collect()) if before[c] != r}


def test_recalculation_writes_changed_years_only(spark, tmp_path, monkeypatch):
    table = LogTable(spark, str(tmp_path), retain=0)
    rows = [("YU1A", "2020-01-01 00:00:00", 45.0, 20.0), ("DL1A", "2021-01-01 00:00:00", 51.0, 10.0), ("VK4A", "2022-01-01 00:00:00", -23.0, 132.0)]
    assert insert_contacts(table, contacts(spark, rows), "seq").first()["inserted"] == 3
    recalc.recalculate_table(table, None, world(spark))  # fills country and zones
    assert changed_calls(spark, table, None) == (0, set())
    version = table.versions.current()["version"]
    # one contact loses its country, one line is lost, one line belongs to nobody
    edited = table.all_contacts().withColumn("country", F.when(F.col("call") != "DL1A", F.col("country"))).withColumn("note", F.lit("mine"))
    lines = table.paths().where("dedup_key NOT LIKE 'VK4A%'")
    stray = lines.limit(1).withColumn("dedup_key", F.lit("X|201901010000|20m|CW"))
    table.replace(edited, lines.unionByName(stray))
    base = table.versions.current()
    drawn = []
    monkeypatch.setattr(recalc, "contact_paths", lambda c: drawn.extend(r[0] for r in c.select("dedup_key").collect()) or merge.contact_paths(c))
    # a failure after the data is written leaves the old version
    commit = versions.Versions._commit
    monkeypatch.setattr(versions.Versions, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        recalc.recalculate_table(table, None, world(spark))
    assert table.versions.current() == base and table.contacts().where("country IS NULL").count() == 1
    monkeypatch.setattr(versions.Versions, "_commit", commit)
    drawn.clear()
    assert changed_calls(spark, table, None) == (1, {"DL1A"})
    now = table.versions.current()
    parts = lambda m, t: {y: [p["v"] for p in x] for y, x in m["tables"][t]["years"].items()}
    assert {y for y in parts(now, "qso") if parts(now, "qso")[y] != parts(base, "qso")[y]} == {"2021"}
    assert {k[:4] for k in drawn} == {"DL1A", "VK4A"}
    assert {r[0][:4] for r in table.paths().select("dedup_key").collect()} == {"YU1A", "DL1A", "VK4A"} and parts(now, "qso_path")["2020"] == parts(base, "qso_path")["2020"]
    assert {r["note"] for r in table.all_contacts().collect()} == {"mine"} and version < now["version"]
    assert changed_calls(spark, table, None) == (0, set()) and table.versions.current() == now


def test_an_earlier_layout_is_taken_over(spark, tmp_path):
    row = project(contacts(spark, [("YU1A", "2020-01-01 00:00:00", 45.0, 20.0)]), STORED_COLUMNS).withColumn("note", F.lit("mine"))
    row.withColumn("year", F.lit(2020)).write.partitionBy("year").parquet(f"{tmp_path}/qso")
    spark.createDataFrame([("schema_version", "2")], "key string, value string").write.parquet(f"{tmp_path}/meta")
    table = LogTable(spark, str(tmp_path))
    again = [("YU1A", "2020-01-01 00:00:00", 45.0, 20.0), ("DL1A", "2020-01-01 00:00:00", 51.0, 10.0)]
    assert insert_contacts(table, contacts(spark, again), "seq").first().asDict() == {"inserted": 1, "duplicates": 1, "failed": 0, "skipped": 0}
    assert table.contacts().count() == 2 and table.meta() == {"schema_version": "2"} and table.versions.current()["version"] == 2
    assert {(r["call"], r["note"]) for r in table.all_contacts().collect()} == {("YU1A", "mine"), ("DL1A", None)}


def test_many_small_inserts_stay_few_folders(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path), retain=0)
    for i in range(12):
        store.publish({"a": versions.Change(spark.range(i, i + 1).selectExpr("concat('C', id, '|202001010000|b|m') AS dedup_key"))})
    parts = store.current()["tables"]["a"]["years"]["2020"]
    assert sum(p["rows"] for p in parts) == 12 and len(parts) <= 4 and store.read("a").count() == 12
    assert store.known("a", store.read("a")).count() == 12


def test_lines_are_kept_by_their_ends_and_read_whole(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(merge, "scratch_dir", lambda _, label: made.append(f"{tmp_path}/scratch/{label}-{len(made)}") or made[-1])
    table = LogTable(spark, f"{tmp_path}/table")
    rows = [("YU1A", "2020-01-01 00:00:00", 45.0, 20.0), ("VK4A", "2020-02-01 00:00:00", -23.0, 132.0), ("KH6A", "2020-03-01 00:00:00", 21.0, -157.0), ("W6A", "2021-01-01 00:00:00", None, None)]
    insert_contacts(table, contacts(spark, rows), "seq").collect()
    assert len(made) == 2 and not any(os.path.exists(x) for x in made)  # no step of an insert stays behind
    ends = [F.col(c) for c in ("my_lat", "my_lon", "lat", "lon")]
    whole = paths.add_great_circle(table.contacts(), *ends).withColumn("wkt", paths.wkt("parts"))
    want = {r["dedup_key"]: (r["parts"], r["wkt"]) for r in whole.collect() if r["wkt"]}
    assert {r["dedup_key"]: (r["parts"], r["wkt"]) for r in table.paths().collect()} == want and len(want) == 3
    assert table.paths().columns == list(PATH_COLUMNS)
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(f"{tmp_path}/table/data/qso_path") for f in names)
    assert "parts" not in spark.read.parquet(f"{tmp_path}/table/data/qso_path").columns and size() < 10_000
    # a line that was given, not derived, stays as it was given
    given = table.paths().where("dedup_key LIKE 'VK4A%'").withColumn("wkt", F.lit("mine"))
    table.replace(table.contacts(), table.paths().where("dedup_key LIKE 'YU1A%'").unionByName(given))
    assert {r["dedup_key"][:4]: r["wkt"] for r in table.paths().collect()} == {"VK4A": "mine", "YU1A": next(w for k, (_, w) in want.items() if k[:4] == "YU1A")}

"""Stored steps go when the change that they served is published."""

import os
import re

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from skylog.functions.text import filled
from skylog.operators import recalc
from skylog.operators.merge import LogTable, insert_contacts, project
from skylog.plans import catalog
from skylog.schema import STORED_COLUMNS
from skylog.session import METHOD_LIMIT, prepared


def test_a_replacement_and_a_recalculation_leave_no_steps(spark, tmp_path):
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    row = project(
        spark.sql("SELECT 'YU1A|202401051200|20m|CW' AS dedup_key, 'YU1A' AS call, 'KN05' AS gridsquare, timestamp_ntz '2024-01-05 12:00:00' AS qso_datetime"),
        STORED_COLUMNS,
    ).withColumn("my_gridsquare", F.lit("KN04"))
    table = LogTable(spark, str(tmp_path / "log"))
    table.replace(row, table.paths())
    assert recalc.recalculate_table(table, "JN95wg", None) == 1
    assert recalc.recalculate_table(table, "JN95wg", None) == 0
    assert table.contacts().count() == 1 and table.paths().count() == 1
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert not left & {"replace-qso", "replace-qso_path", "recalculated", "lines"}


def test_a_batch_is_gone_before_the_tables_are_written(spark, tmp_path, monkeypatch):
    """Also are a few years written without a shuffle of their rows."""
    root, seen, plans = spark.conf.get("spark.checkpoint.dir"), [], []
    publish, hint = LogTable.publish, DataFrame.hint
    monkeypatch.setattr(LogTable, "publish", lambda *a, **k: (seen.append([n for n in os.listdir(root) if n.startswith("batch-")]), publish(*a, **k))[1])
    monkeypatch.setattr(DataFrame, "hint", lambda self, name, *a: (plans.append(name), hint(self, name, *a))[1])
    before = {n for n in os.listdir(root) if n.startswith("batch-")} if os.path.isdir(root) else set()

    def insert(*years: int) -> int:
        keys = spark.createDataFrame([(f"YU1A|{y}01051200|20m|CW", "YU1A") for y in years], "dedup_key string, call string")
        return insert_contacts(table, project(keys, STORED_COLUMNS).withColumn("seq", F.lit(1)), "seq").first()["inserted"]

    table = LogTable(spark, str(tmp_path / "log"))
    assert insert(2023, 2024) == 2 and insert(2024, 2025) == 1
    assert len(seen) == 2 and all(set(left) <= before for left in seen)
    assert "rebalance" not in plans
    assert insert(*range(2001, 2011)) == 10 and "rebalance" in plans
    assert sorted(r["dedup_key"][5:9] for r in table.contacts().collect()) == [str(y) for y in [*range(2001, 2011), 2023, 2024, 2025]]


def test_first_wins_moves_no_columns_that_nobody_asks_for(spark, monkeypatch, tmp_path):
    rows = project(spark.sql("SELECT 'k' AS dedup_key, 1L AS seq, 'SSB' AS mode, 2.0D AS distance_km"), STORED_COLUMNS).withColumn("seq", F.lit(1))
    rows.write.parquet(str(tmp_path / "contacts"))
    monkeypatch.setattr(catalog, "contacts", lambda *a: spark.read.parquet(str(tmp_path / "contacts")))
    for name in ("delete_cascade", "new_only"):
        got = catalog.QUERIES[name](spark, "")
        scans = re.findall(r"ReadSchema: struct<([^>]*)>", got._jdf.queryExecution().toString())
        assert scans and all(not re.search(r"\b(call|adif_extra|my_lat|country)\b", s) for s in scans if "mode" in s or name == "delete_cascade")
    assert sorted(tuple(r) for r in catalog.QUERIES["delete_cascade"](spark, "").collect()) == [("qso", "k"), ("qso_path", "k")]


def test_objects_are_parsed_for_names_that_they_have(spark):
    texts = ['{"LAT":"N1"}', '{"MY_LAT":"N2"}', r'{"L\u0041T":"N3"}', '{ "LAT" : " " }', '{"A":{"LAT":"x"}}', '{"LAT":5}', "{'LAT':'q'}", "{}", "bad LAT", None]
    rows = spark.createDataFrame([(t,) for t in texts], "adif_extra string")
    both = rows.select(recalc._extra("LAT").alias("got"), filled(F.get_json_object("adif_extra", "$.LAT")).alias("wanted"))
    assert all(r["got"] == r["wanted"] for r in both.collect()) and [r["got"] for r in both.collect()][:3] == ["N1", None, "N3"]
    assert "contains" in rows.select(recalc._extra("LAT"))._jdf.queryExecution().toString().lower()


def test_wide_projections_are_compiled_in_any_session(spark):
    session = spark.newSession()
    for given, wanted in (("65535", "8000"), ("100", "100")):
        session.conf.set(METHOD_LIMIT, given)
        assert prepared(session).conf.get(METHOD_LIMIT) == wanted

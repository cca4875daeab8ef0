"""Nothing a user stored or handed in gets lost."""

from pyspark.sql import functions as F

from skylog.functions.fields import parse_iso
from skylog.operators.merge import LogTable, project
from skylog.schema import PATH_COLUMNS, STORED_COLUMNS
from skylog.sources import adif


def test_foreign_columns_survive_a_rewrite(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "log"))
    row = project(spark.sql("SELECT 'k1' AS dedup_key, timestamp_ntz '2024-01-05 12:00:00' AS qso_datetime"), STORED_COLUMNS)
    noted = row.withColumn("my_note", F.lit("mine")).withColumn("year", F.lit(2024))
    noted.write.partitionBy("year").parquet(str(tmp_path / "log" / "qso"))
    project(spark.sql("SELECT 'k1' AS dedup_key"), PATH_COLUMNS).withColumn("colour", F.lit("red")).write.parquet(str(tmp_path / "log" / "qso_path"))
    for _ in range(2):
        table.replace(table.contacts(), table.paths())
    assert [r["my_note"] for r in spark.read.parquet(str(tmp_path / "log" / "qso")).collect()] == ["mine"]
    assert [r["colour"] for r in spark.read.parquet(str(tmp_path / "log" / "qso_path")).collect()] == ["red"]
    assert table.all_contacts().first()["my_note"] == "mine" and "my_note" not in table.contacts().columns


def test_all_meta_keys_survive(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "log"))
    assert table.meta() == {}
    table.set_meta(**{f"k{i}": str(i) for i in range(150)})
    table.set_meta(extra="x")
    assert len(table.meta()) == 151


def test_a_long_fraction_keeps_its_offset(spark):
    text = f"2024-01-05T12:00:00.{'1' * 80}+02:00"
    assert str(spark.range(1).select(parse_iso(F.lit(text)).alias("t")).first()["t"]).startswith("2024-01-05 10:00:00.11")


def test_a_refused_file_is_a_row(spark, tmp_path):
    (tmp_path / "good.adi").write_text("<CALL:4>YU1A<EOR>")
    (tmp_path / "big.adi").write_text("<CALL:4>YU1B<EOR>" * 10_001)
    everything = adif.scan_logs(spark, str(tmp_path / "*.adi"))
    assert adif.records(everything).count() == 10_002
    limited = adif.scan_logs(spark, str(tmp_path / "*.adi"), limit_mb=1)
    assert adif.records(limited).count() == 1
    assert [(r["file"].rsplit("/", 1)[-1], r["code"]) for r in adif.warnings(limited).collect()] == [("big.adi", "too_many_records")]
    assert adif.refused(adif.read_files(spark, str(tmp_path / "*.adi")), 1).count() == 1


def test_headers_of_files(spark, tmp_path):
    (tmp_path / "a.adi").write_text("<PROGRAMID:2>AB<EOH><CALL:4>YU1A<EOR>")
    got = adif.headers(adif.scan_logs(spark, str(tmp_path / "a.adi"))).collect()
    assert [(r["name"], r["value"]) for r in got] == [("PROGRAMID", "AB")]

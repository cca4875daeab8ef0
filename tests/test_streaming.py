import struct
import time

from pyspark.sql import functions as F

from skylog.operators import figures
from skylog.operators.merge import LogTable
from skylog.sources import datagram
from skylog.streaming import feed

MAGIC = bytes.fromhex("ADBCCBDA")


def text(value):
    if value is None:
        return b"\xff\xff\xff\xff"
    raw = value if isinstance(value, bytes) else value.encode()
    return struct.pack(">I", len(raw)) + raw


def message(code, client, body=b"", schema=3):
    return MAGIC + struct.pack(">II", schema, code) + text(client) + body


def test_decode_messages():
    status = message(1, "WSJT-X", struct.pack(">Q", 14074000) + text("FT8") + text(None) + text("-10"))
    got = datagram.decode(status)
    assert (got["type"], int(got["freq_hz"]), got["dx_call"], got["report"]) == ("status", 14074000, None, "-10")
    assert "tx_mode" not in got  # cut off: what was read is kept
    assert datagram.decode(message(0, "JTDX", struct.pack(">I", 3) + text("2.2")))["version"] == "2.2"
    assert datagram.decode(message(12, "a", text(b"M\xfcller")))["adif"] == "Müller"
    assert datagram.decode(message(3, "a"))["type"] == "other"
    for bad in (b"", b"junk", message(6, "a", schema=7), status[:20], message(12, "a")):
        assert datagram.decode(bad) is None
    tail = b"".join([text("")] * 2) + bytes(3) + struct.pack(">II", 1, 2) + text("a") * 3 + b"\0" + text("") + b"\1\1"
    jtdx = datagram.decode(message(1, "JTDX - x", struct.pack(">Q", 1) + text("a") + text("b") + tail))
    assert jtdx["tx_first"] is True and "special_op_mode" not in jtdx


def test_live_feed_survives_a_restart(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    record = "<CALL:5>YU1AB<QSO_DATE:8>20240105<TIME_ON:4>1200<BAND:3>20m<MODE:3>FT8<EOR>"
    table = LogTable(spark, str(tmp_path / "table"))

    def run():
        stream = feed.logged(feed.messages(feed.datagram_files(spark, str(drop))))
        records = feed.records_of_messages(stream, F.lit(0).cast("long"))
        batch = feed.merge_into(table, "KN04ft", None, "wsjtx", "ord", "record_no")
        feed.start_merge(records, str(tmp_path / "mark"), batch).start().awaitTermination()

    (drop / "1.bin").write_bytes(message(12, "WSJT-X", text(record)))
    (drop / "2.bin").write_bytes(message(6, "WSJT-X"))
    run()
    assert table.contacts().count() == 1
    (drop / "3.bin").write_bytes(message(12, "WSJT-X", text(record)))  # the same contact again
    (drop / "4.bin").write_bytes(message(12, "WSJT-X", text(record.replace("1200", "1300"))))
    run()
    assert sorted(r["dedup_key"][6:18] for r in table.contacts().collect()) == ["202401051200", "202401051300"]


def test_live_sessions(spark, tmp_path):
    src = str(tmp_path / "m")
    # two triggers: the session of c goes on in the second
    parts = [[("a", "status", 0), ("a", "close", 10), ("a", "status", 20), ("b", "close", 5), ("c", "status", 30)],
             [("c", "status", 60), ("a", "status", 200), ("z", "status", 900)]]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for rows in parts:
        frame = spark.createDataFrame(rows, "client string, type string, s int")
        frame.select("client", "type", F.timestamp_seconds(F.col("s") + 1000).alias("ingest_ts")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("client string, type string, ingest_ts timestamp").parquet(src)
        query = feed.live_sessions(stream).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r["client"], r["first_seen"].timestamp() - 1000, r["gone_at"].timestamp() - 1000, r["messages"], r["closed"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, 10, 1, True), ("a", 20, 65, 1, False), ("a", 200, 245, 1, False), ("c", 30, 105, 2, False)]


def test_kept_figures_follow_three_triggers_and_a_replay(spark, tmp_path, monkeypatch):
    drop = tmp_path / "drop"
    drop.mkdir()
    record = "<CALL:{}>{}<QSO_DATE:8>202401{:02}<TIME_ON:4>1200<BAND:3>{}<MODE:3>FT8<GRIDSQUARE:4>{}<EOR>"
    table = LogTable(spark, str(tmp_path / "table"))
    table.keep_figures()
    report = str(tmp_path / "report")
    batch = feed.merge_into(table, "KN04ft", None, "wsjtx", "ord", "record_no", after=feed.refresh_summary(report))

    def records(*rows):
        texts = [("rig", i, record.format(len(c), c, day, band, square)) for i, (c, day, band, square) in enumerate(rows)]
        return feed.records_of_messages(spark.createDataFrame(texts, "client string, ord long, adif string"), F.col("ord"))

    parts = [
        records(("YU1A", 1, "20m", "KN04"), ("DL1A", 2, "20m", "JO62"), ("YU1A", 1, "20m", "KN04")),
        records(("YU1A", 3, "40m", "KN05"), ("DL1A", 2, "20m", "JO62")), records(("VK4A", 4, "10m", "QG62")),
    ]
    # from here on the contacts are never read as a whole
    monkeypatch.setattr(LogTable, "contacts", lambda *a: 1 / 0)
    for number in (0, 1, 1, 2, 0):
        batch(parts[number], number)
    monkeypatch.undo()
    for kept in (table.figures(), figures.of_contacts(table.contacts())):
        got = figures.summary(kept).first()
        assert (got["total"], got["unique_calls"], got["grid_count"], got["longest_call"]) == (4, 3, 4, "VK4A")
        assert (str(got["first_qso"]), str(got["last_qso"])) == ("2024-01-01 12:00:00", "2024-01-04 12:00:00")
    assert figures.summary(table.figures()).first() == spark.read.parquet(f"{report}/summary").first()
    counts = {(r["metric"], r["key"]): r["n"] for r in spark.read.parquet(f"{report}/breakdowns").collect()}
    assert (counts["band", "20m"], counts["band", "40m"], counts["mode", "FT8"], counts["continent", "?"]) == (2, 1, 4, 4)
    # rows that are taken back are counted anew
    table.replace(table.contacts().where("call <> 'VK4A'"), table.paths())
    assert figures.summary(table.figures()).first()["total"] == 3 and "figures" in table.versions.current()["tables"]


def test_a_trigger_takes_a_bounded_number_of_files(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for i in range(7):
        (drop / f"{i}.bin").write_bytes(message(6, "WSJT-X") if i else b"junk")
    watch, sizes = feed.DatagramWatch(), []
    spark.streams.addListener(watch)
    try:
        stream = feed.messages(feed.datagram_files(spark, str(drop), files_per_trigger=3), watch=True)
        writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
        writer.foreachBatch(lambda rows, _: sizes.append(rows.count())).start().awaitTermination()
        for _ in range(100):  # progress arrives a little later
            if len(watch.triggers) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    counts = [(r["good"] + r["ignored"], r["ignored"]) for r in watch.counts(spark).collect()]
    assert [n for n, _ in counts] == [3, 3, 1] and sum(bad for _, bad in counts) == 1 and sum(sizes) == 6

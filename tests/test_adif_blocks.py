"""A large log read in many tasks equals the sequential reader."""

import random

import pytest

from skylog.sources import adif, adif_blocks

RECORDS = [
    "<CALL:5>YU1AB<QSO_DATE:8>20240105<TIME_ON:4>1200<EOR>\n", "<call:4>DL1A <NAME:5>Đorđe <eor>\n", "<CALL:4>VK4A<NAME:7>Đorđe<EOR>",
    "<CALL:4>K1AB<COMMENT:14>a <EOR> inside<EOR>\n", "<CALL:4>K1AC<COMMENT:{n}>{x}<EOR>\n", "<EOR> stray <NOLEN> <EOR>\n",
    "<CALL:4>I1AA<NOTES:6>a<b>c> <EOR>", "<CALL:x>bad <CALL:4>I2AA <EOR>\n", "<CALL:50>OE1A<EOR>\n", "// remark <EOR>\n",
]


def log(seed: int) -> str:
    r = random.Random(seed)
    long = "text <EOR> <CALL:1>Z <EOR> " * r.randrange(1, 40)
    texts = [r.choice(RECORDS).replace("{n}", str(len(long))).replace("{x}", long) for _ in range(r.randrange(1, 80))]
    head = r.choice(["", "free <EOR> text\n<ADIF_VER:5>3.1.4<EOH>\n", "<PROGRAMID:7>x<EOR>y<EOH>", "mention of <EOR> only\n"])
    second = r.choice(["", "<PROGRAMVERSION:3>1.0<PROGRAMID:2>ZZ<EOH>\n"])
    k = r.randrange(len(texts) + 1)
    return head + "".join(texts[:k]) + second + "".join(texts[k:]) + r.choice(["", "\n", "<CALL:4>LAST", "<CALL:4>LAST<NAME:9>abc", " <NOLEN>"])


@pytest.fixture
def logs(tmp_path):
    for seed in range(8):
        (tmp_path / f"log {seed}.adi").write_bytes(log(seed).encode(["utf-8", "utf-8-sig", "utf-16", "utf-8"][seed % 4]))
    (tmp_path / "latin.adi").write_bytes((log(99) + "<NAME:6>M\xfcller<CALL:4>YU1A<EOR>").replace("Đorđe", "Dorde").encode("latin-1"))
    (tmp_path / "empty.adi").write_bytes(b"")
    (tmp_path / "blank.adi").write_bytes(b"\n")
    (tmp_path / "no-record.adi").write_bytes(b"x" * 3000)
    return str(tmp_path)


def rows(df):
    plain = lambda r: (r.file, r.record_no, None if r.fields is None else tuple(sorted(r.fields.items())), tuple(tuple(w) for w in r.warnings))
    return sorted((plain(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("range_bytes, piece", [(2500, 400), (10**9, 150)])
def test_equals_the_sequential_reader(spark, logs, range_bytes, piece):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = rows(adif.scan_logs(spark, logs))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = rows(adif_blocks.scan_large_logs(spark, logs, piece))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(want) > 150 and got == want


def test_pieces_are_many(spark, tmp_path):
    (tmp_path / "a.adi").write_bytes(b"<CALL:4>YU1A<EOR>" * 2000)
    lines = spark.read.option("lineSep", ">").text(str(tmp_path / "a.adi")).selectExpr("_metadata.file_path", "_metadata.file_block_start", "cast(value AS binary)")
    pieces = lines.mapInArrow(adif_blocks._cut(1000), adif_blocks._PIECES).collect()
    assert len(pieces) > 30 and b"".join(bytes(p.content) for p in pieces) == b"<CALL:4>YU1A<EOR>" * 2000

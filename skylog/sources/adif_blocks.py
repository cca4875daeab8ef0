"""Large ADIF files in many tasks: pieces are parsed by guess, and a piece whose guess was wrong is parsed again.

Lengths decide where a value ends, so only a reader that comes from the left knows whether an ``<EOR>`` ends a record or stands
inside a value. Nearly all end records, hence: 1. A file is read in byte ranges, cut at ``>``, by Spark's text source. Each range is
cut into pieces behind some ``<EOR>``; what comes before the first one belongs to the piece before. 2. All pieces are parsed at
once, each as if a record ended before it. A piece is *sound* if its reading ended with a record end exactly at its end, with nothing pending
and no value that wanted more text: then the guess of the next piece was right. 3. The states of all pieces, a few numbers each, are
scanned in order of the file; a piece behind an unsound one joins it, and the joined text is parsed again, until all are sound. 4. Record
numbers are sums over the states.

The result equals that of the sequential reader. A file in UTF-16 stays in one piece. Texts go through memory by pieces of about
``PIECE`` bytes, or what lies between two record ends if that is more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .adif import FIELDS, NOTES, LogReader, Watch, decode_text, tokens

PIECE = 8 * 1024 * 1024
_END = re.compile(rb"<eor>", re.IGNORECASE)
_PIECES = "file string, start long, piece int, opens boolean, utf8 boolean, utf16 boolean, content binary"
_NOTE_SQL = "array<struct<code:string,field:string,value:string>>"
_PARSED = f"file string, part int, local int, fields map<string,string>, warnings {_NOTE_SQL}, sound boolean, n int"
_BATCH = 2_000


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _cut(least: int):
    """Texts between ``>`` of byte ranges, in order -> pieces. A range begins with what belongs to the range before, if it has a record end."""

    def piece(file: str, start: int, number: int, data: bytes) -> pa.RecordBatch:
        opens = start == 0 or number > 0
        values = [file, start, number, opens, _is_utf8(data), start == 0 and number == 0 and data[:2] in (b"\xff\xfe", b"\xfe\xff"), data]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
        names = [x.split()[0] for x in _PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, number, held, seen = None, 0, bytearray(), 0
        for batch in batches:
            files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < batch.num_rows:
                to = at
                while to < batch.num_rows and starts[to] == starts[at] and files[to] == files[at]:
                    to += 1
                if where != (files[at], starts[at]):
                    if where and held:
                        yield piece(*where, number, bytes(held))
                    where, number, held, seen = (files[at], starts[at]), 0, bytearray(), 0
                texts = pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), batch.column(2).slice(at, to - at))
                held += pc.binary_join(texts, b">")[0].as_py() + b">"
                at = to
                while True:
                    # a range that does not begin the file gives its first record end away at once
                    wanted = 0 if number == 0 and where[1] else least
                    end = _END.search(held, max(seen, wanted))
                    if end is None:
                        seen = max(0, len(held) - 5)
                        break
                    yield piece(*where, number, bytes(held[: end.end()]))
                    number, seen = number + 1, 0
                    del held[: end.end()]
        if where and held:
            yield piece(*where, number, bytes(held))

    return run


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined texts -> records with local numbers, and a row without a number for the state."""
    kinds = [pa.string(), pa.int32(), pa.int32(), FIELDS, NOTES, pa.bool_(), pa.int32()]
    names = ["file", "part", "local", "fields", "warnings", "sound", "n"]
    note = lambda notes: [dict(zip(("code", "field", "value"), n)) for n in notes]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for row in range(batch.num_rows):
            value = {n: batch.column(k)[row].as_py() for k, n in enumerate(batch.schema.names)}
            data = b"".join(x["content"] for x in sorted(value["texts"], key=lambda x: (x["start"], x["piece"])))
            first, final = value["part"] == 1, value["final"]
            if final and value["extra"]:
                data = data[:-1]  # the file does not end with the sign that the source cuts at
            if value["utf16"]:
                text = decode_text(data)[0]
            elif value["latin1"]:
                text = (data.removeprefix(b"\xef\xbb\xbf") if first else data).decode("latin-1")
            else:
                text = data.decode("utf-8-sig" if first else "utf-8")
            begin = 1 if first else 2  # behind the first record no rule asks for the number
            reader, watch, out = LogReader(begin), Watch(), []
            if first and value["latin1"]:
                reader.header_notes.append(("read_as_latin1", None, None))
            found = reader.feed(tokens(text, in_header=first, watch=watch))
            for number, fields, notes in found:
                out.append((value["file"], value["part"], number - begin, list(fields.items()), note(notes), None, None))
                if len(out) >= _BATCH:
                    yield rows_of(out)
                    out = []
            begun = reader.number > 1 or reader.headed
            sound = watch.end == len(text) and not watch.over and not reader.current and not reader.notes and begun
            if final:
                sound = True
                for number, fields, notes in reader.rest():
                    out.append((value["file"], value["part"], number - begin, None if fields is None else list(fields.items()), note(notes), None, None))
            out.append((value["file"], value["part"], None, list(reader.header.items()), note(reader.header_notes), sound, reader.number - begin))
            yield rows_of(out)


def _stored(spark: SparkSession, label: str, rows: DataFrame) -> DataFrame:
    path = scratch_dir(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def scan_large_logs(spark: SparkSession, paths: str | list[str], piece_bytes: int = PIECE) -> DataFrame:
    """Records, headers and warnings of all files, as the sequential scan gives them, each file in many tasks."""
    lines = spark.read.option("lineSep", ">").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")
    )
    pieces = _stored(spark, "pieces", lines.mapInArrow(_cut(piece_bytes), _PIECES))
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), "path", "length")
    # the source gives every text its ``>`` back, one too many at the end of some files, and takes a UTF-8 mark of three bytes away
    # one narrow row a piece: its part of the file, what is known of the whole file
    along, whole = Window.partitionBy("file").orderBy("start", "piece"), Window.partitionBy("file")
    narrow = pieces.select("file", "start", "piece", "opens", "utf8", "utf16", F.octet_length("content").cast("long").alias("bytes"))
    known = narrow.select(
        "file", "start", "piece", F.max("utf16").over(whole).alias("utf16"), (~F.min("utf8").over(whole)).alias("latin1"),
        F.sum(F.col("opens").cast("int")).over(along).cast("int").alias("part"), F.sum("bytes").over(whole).alias("total"),
    )
    part = F.when(F.col("utf16"), 1).otherwise(F.col("part"))
    known = known.join(files, "file").select(
        "file", "start", "piece", "utf16", (F.col("latin1") & ~F.col("utf16")).alias("latin1"), part.alias("part"), (F.col("total") - F.col("length")).isin(1, -2).alias("extra")
    )
    known = _stored(spark, "parts", known)
    # the pieces of a part, and the parts that have to be parsed in this round
    joined = known.groupBy("file", "part").agg(F.lit(0).alias("round")).select("file", "part", F.col("part").alias("into"), "round")
    rounds: list[DataFrame] = []
    while True:
        joined = _stored(spark, "joined", joined)
        last = joined.groupBy("file").agg(F.max("into").alias("last"))
        todo = joined.where(F.col("round") == len(rounds)).join(last, "file")
        texts = pieces.select("file", "start", "piece", "content").join(known.join(todo, ["file", "part"]), ["file", "start", "piece"])
        grouped = texts.groupBy("file", "into").agg(
            F.collect_list(F.struct("start", "piece", "content")).alias("texts"), F.max("utf16").alias("utf16"), F.max("latin1").alias("latin1"),
            F.max("extra").alias("extra"), F.max(F.col("into") == F.col("last")).alias("final"),
        ).withColumnRenamed("into", "part")
        rounds.append(_stored(spark, "parsed-parts", grouped.mapInArrow(_parse, _PARSED).withColumn("round", F.lit(len(rounds)))))
        states = _current(joined, [r.where("local IS NULL") for r in rounds])
        order = Window.partitionBy("file").orderBy("into")
        leads = states.select("file", "into", F.when(F.coalesce(F.lag("sound").over(order), F.lit(True)), F.col("into")).alias("lead"))
        leads = leads.select("file", "into", F.max("lead").over(order).alias("lead"))
        if leads.where("lead <> into").isEmpty():
            break
        grown = leads.groupBy("file", "lead").agg(F.count("*").alias("size"))
        moved = joined.join(leads, ["file", "into"]).join(grown, ["file", "lead"])
        joined = moved.select("file", "part", F.col("lead").alias("into"), F.when(F.col("size") > 1, len(rounds)).otherwise(F.col("round")).alias("round"))
    return _assembled(joined, states, rounds, files)


def _current(joined: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Rows of the round in which each part was parsed last."""
    now = joined.select("file", "into", "round").distinct()
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found.withColumnRenamed("part", "into").join(now, ["file", "into", "round"])


def _assembled(joined: DataFrame, states: DataFrame, rounds: list[DataFrame], files: DataFrame) -> DataFrame:
    before = Window.partitionBy("file").orderBy("into").rowsBetween(Window.unboundedPreceding, -1)
    bases = states.select("file", "into", "round", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(files, "file")
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    records = found.where("local IS NOT NULL").withColumnRenamed("part", "into").join(bases, ["file", "into", "round"]).select(
        F.col("path").alias("file"), (F.col("base") + F.col("local") + 1).cast("int").alias("record_no"), "fields", "warnings"
    )
    # the header: of a name that later parts repeat, the first counts; notes come from the first part
    names = states.select("file", "into", F.explode("fields").alias("name", "value")).groupBy("file", "name").agg(F.min_by("value", "into").alias("value"))
    header = names.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))
    notes = states.where("into = 1").select("file", "warnings")
    none = F.create_map().cast("map<string,string>")
    headers = files.join(header, "file", "left").join(notes, "file", "left").select(
        F.col("path").alias("file"), F.lit(0).alias("record_no"), F.coalesce("fields", none).alias("fields"),
        F.coalesce("warnings", F.array().cast(_NOTE_SQL)).alias("warnings"),
    )
    return records.unionByName(headers)

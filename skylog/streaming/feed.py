"""Continuous jobs: live feed, log drop folder, refreshed statistics.

Merges are keyed, so an at-least-once replay after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from ..operators import figures, stats
from ..operators.countries import Countries
from ..operators.merge import LogTable, insert_contacts
from ..operators.normalize import normalize
from ..operators.sessions import GONE_SECONDS, REPEAT_SECONDS
from ..sources import adif, datagram


def datagram_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of datagram files as a stream ``(ingest_ts, value)``; bounded work per trigger.

    On a cluster the source is usually Kafka: any stream with these two columns will do.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(adif.FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    return files.select(F.col("modificationTime").alias("ingest_ts"), F.col("content").alias("value"))


def log_files(
    spark: SparkSession, path: str, limit_mb: int | None = None, files_per_trigger: int = 100
) -> DataFrame:
    """New log files of a drop folder as a stream of parsed records; refused files are rows with a warning."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(adif.FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    return adif.parse_files(files, limit_mb)


def messages(datagrams: DataFrame, watch: bool = False) -> DataFrame:
    """Decoded messages; foreign and broken datagrams are left out.

    With ``watch`` the good and the ignored ones of every trigger are observed, for a :class:`DatagramWatch`.
    """
    decoded = datagram.decode_messages(datagrams)
    if watch:
        good = F.col("message").isNotNull()
        decoded = decoded.observe(DatagramWatch.NAME, F.count_if(good).alias("good"), F.count_if(~good).alias("ignored"))
    return decoded.where("message IS NOT NULL").select("ingest_ts", "message.*")


class DatagramWatch(StreamingQueryListener):
    """Good and ignored datagrams of every trigger of the streams of a session; ``spark.streams.addListener`` starts it.

    A trigger that is repeated after a failure takes the place of its first attempt.
    """

    NAME = "datagrams"

    def __init__(self):
        self.triggers: dict[tuple[str, int], tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.NAME)
        if seen is not None:
            self.triggers[str(event.progress.id), event.progress.batchId] = (seen["good"], seen["ignored"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def counts(self, spark: SparkSession) -> DataFrame:
        """``query, trigger, good, ignored``, a few numbers for each trigger."""
        rows = [(query, trigger, *n) for (query, trigger), n in sorted(self.triggers.items())]
        return spark.createDataFrame(rows, "query string, trigger long, good long, ignored long")


def logged(messages_: DataFrame) -> DataFrame:
    """Logged-contact messages with a text."""
    return messages_.where("type = 'logged_adif' AND trim(adif) <> ''")


def _timed(messages_: DataFrame, seconds: int) -> DataFrame:
    """Watermark on the arrival time (watermarks need the zoned timestamp type)."""
    zoned = messages_.withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp"))
    return zoned.withWatermark("ingest_ts", f"{seconds} seconds")


def live_dedup(messages_: DataFrame, seconds: int = REPEAT_SECONDS) -> DataFrame:
    """Drops repeats of one text from one client within the delay (state expires with it)."""
    stream = _timed(messages_, seconds)
    return stream.dropDuplicatesWithinWatermark(["client", "adif"])


_SESSION = "client string, first_seen timestamp, gone_at timestamp, messages long, closed boolean"
_SESSION_STATE = "times array<bigint>, byes array<boolean>, first bigint, last bigint, n bigint"


def _session_step(gap_us: int):
    """One client's step: settles what the watermark has passed, in time order, as the batch form does."""

    def step(key, frames, state):
        times, byes, first, last, n = state.get if state.exists else ([], [], 0, 0, 0)
        waiting = list(zip(times, byes))
        for frame in frames:
            us = frame["ingest_ts"].astype("datetime64[us]").astype("int64")
            waiting += list(zip(us.tolist(), (frame["type"] == "close").tolist()))
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        settled = [x for x in waiting if x[0] <= mark]
        waiting = waiting[len(settled) :]
        ended = []
        for us, bye in settled:
            if n and us - last > gap_us:
                ended.append((first, last + gap_us, n, False))
                n = 0
            if bye:
                if n:
                    ended.append((first, us, n, True))
                n = 0
            else:
                first, last, n = (first if n else us), us, n + 1
        if n and mark > last + gap_us:
            ended.append((first, last + gap_us, n, False))
            n = 0
        if n or waiting:
            state.update(([t for t, _ in waiting], [bool(b) for _, b in waiting], first, last, n))
            due = min([last + gap_us] * bool(n) + [t for t, _ in waiting])
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if ended:
            starts, ends, counts, closed = zip(*ended)
            yield pd.DataFrame({
                "client": [key[0]] * len(ended), "first_seen": pd.to_datetime(starts, unit="us"),
                "gone_at": pd.to_datetime(ends, unit="us"), "messages": counts, "closed": closed,
            })

    return step


def live_sessions(messages_: DataFrame, seconds: int = GONE_SECONDS) -> DataFrame:
    """Sessions per client; a row appears when the watermark has passed its end.

    A goodbye ends the session at once; one without a live session is nothing. A client's state is its open
    session and the messages that the watermark has not passed yet.
    """
    stream = _timed(messages_, seconds).select("client", "type", "ingest_ts")
    return stream.groupBy("client").applyInPandasWithState(
        _session_step(seconds * 1_000_000), _SESSION, _SESSION_STATE, "append", "EventTimeTimeout"
    )


def latest_status(messages_: DataFrame) -> DataFrame:
    """Newest status per client (batch, or stream in update mode)."""
    from ..functions.bands import band_of_mhz

    status = messages_.where("type = 'status'")
    row = F.max_by(F.struct("freq_hz", "mode", "dx_call"), "ingest_ts").alias("s")
    latest = status.groupBy("client").agg(row).select("client", "s.*")
    return latest.withColumn("band", band_of_mhz(F.col("freq_hz").cast("double") / 1e6))


def records_of_messages(messages_: DataFrame, order: Column) -> DataFrame:
    """Records of logged-contact texts: ``client, ord, record_no, fields``."""
    docs = messages_.select(
        F.to_json(F.struct("client", order.alias("ord"))).alias("file"),
        F.encode("adif", "UTF-8").alias("content"),
    )
    parsed = adif.records(adif.parse_documents(docs))
    origin = F.from_json("file", "client string, ord bigint")
    return parsed.select(origin["client"].alias("client"), origin["ord"].alias("ord"), "record_no", "fields")


def merge_into(
    table: LogTable, station_grid: str | None, dim: Countries | None, source: Column | str,
    *order: str, after: Callable[[LogTable], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: records -> contacts -> keyed merge."""

    def batch(records: DataFrame, _: int) -> None:
        rows = normalize(records, station_grid, dim, source)
        insert_contacts(table, rows, *order).collect()  # one row of counters
        if after is not None:
            after(table)

    return batch


def start_merge(
    records: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None],
    every: str | None = None,
) -> DataStreamWriter:
    """A writer for the merge; without ``every`` it handles what is there and stops."""
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def refresh_statistics(path: str) -> Callable[[LogTable], None]:
    """An ``after`` hook: statistics of the whole table, once per batch however many rows came."""

    def refresh(table: LogTable) -> None:
        narrow = stats.stat_columns(table.contacts())
        stats.breakdowns(narrow).write.mode("overwrite").parquet(path)

    return refresh


def refresh_summary(path: str) -> Callable[[LogTable], None]:
    """An ``after`` hook for a table that keeps its figures: summary and breakdowns, from the figures alone."""

    def refresh(table: LogTable) -> None:
        kept = table.figures()
        figures.summary(kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")
        figures.breakdowns(kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/breakdowns")

    return refresh

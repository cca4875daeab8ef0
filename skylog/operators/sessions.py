"""Replay of feed messages: repeat suppression and client sessions.

Both work in time slices and never sort all messages of a client or a listener in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPEAT_SECONDS = 2
GONE_SECONDS = 45
SLICE_SECONDS = 60


def micros(ts: Column | str) -> Column:
    """Microseconds of a UTC wall-clock time."""
    value = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value)


def suppress_repeats(
    messages: DataFrame, same: list[str], ts: str, order: str, window_s: int = REPEAT_SECONDS
) -> DataFrame:
    """Messages without those that repeat the one just before them within ``window_s``.

    Only the directly preceding message counts, and a suppressed one counts as preceding too.
    Each one-minute slice also sees the last ``window_s`` of the slice before it, so slices are
    independent and the result is that of one ordered pass.
    """
    slice_us, halo_us = SLICE_SECONDS * 1_000_000, window_s * 1_000_000
    rows = messages.withColumn("_us", micros(ts))
    own = F.floor(F.col("_us") / slice_us)
    near_end = F.col("_us") % slice_us >= slice_us - halo_us
    spread = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    sliced = rows.withColumn("_own", own).withColumn("_slice", F.explode(spread))
    w = Window.partitionBy("_slice").orderBy("_us", order)
    repeat = F.col("_us") - F.lag("_us").over(w) < halo_us
    for name in same:
        repeat = repeat & F.col(name).eqNullSafe(F.lag(name).over(w))
    flagged = sliced.withColumn("_repeat", F.coalesce(repeat, F.lit(False)))
    return flagged.where("_slice = _own AND NOT _repeat").select(*messages.columns)


def client_sessions(
    messages: DataFrame, client: str, ts: str, closing: Column, gap_s: int = GONE_SECONDS,
    slice_s: int = 3600,
) -> DataFrame:
    """Spans during which a client was alive: ``first_seen, last_seen, messages, ended_by``.

    A client is gone after ``gap_s`` without a message or when it says goodbye (``closing``).
    Messages become runs inside (client, hour) slices; only run ends go on to the second step,
    which joins runs across slices. A goodbye without a live session is nothing.
    """
    gap_us = gap_s * 1_000_000
    rows = messages.select(
        client, F.col(ts).alias("_ts"), micros(ts).alias("_us"), closing.alias("_bye")
    ).withColumn("_slice", F.floor(F.col("_us") / (slice_s * 1_000_000)))
    w = Window.partitionBy(client, "_slice").orderBy("_us", F.col("_bye").cast("int"))
    fresh = (
        F.lag("_us").over(w).isNull()
        | (F.col("_us") - F.lag("_us").over(w) > gap_us)
        | F.lag("_bye").over(w)
    )
    runs = (
        rows.withColumn("_run", F.sum(fresh.cast("int")).over(w))
        .groupBy(client, "_slice", "_run")
        .agg(
            F.min("_us").alias("_from"), F.max("_us").alias("_to"),
            F.min("_ts").alias("_first"),
            F.max(F.when(~F.col("_bye"), F.col("_ts"))).alias("_seen"),
            F.count_if(~F.col("_bye")).alias("_n"), F.max("_bye").alias("_bye"),
        )
    )
    v = Window.partitionBy(client).orderBy("_from", F.col("_bye").cast("int"))
    apart = (
        F.lag("_to").over(v).isNull()
        | (F.col("_from") - F.lag("_to").over(v) > gap_us)
        | F.lag("_bye").over(v)
    )
    return (
        runs.withColumn("_session", F.sum(apart.cast("int")).over(v))
        .groupBy(client, "_session")
        .agg(
            F.min(F.when(F.col("_n") > 0, F.col("_first"))).alias("first_seen"),
            F.max("_seen").alias("last_seen"),
            F.sum("_n").alias("messages"),
            F.max("_bye").alias("_bye"),
        )
        .where("messages > 0")
        .select(
            client, "first_seen", "last_seen", "messages",
            F.when(F.col("_bye"), "close").otherwise("timeout").alias("ended_by"),
        )
    )

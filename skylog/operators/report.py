"""What an import has to tell: warnings of documents, records and storage, refused files, rejected rows.

All of it comes from the two tables that an import stores anyway, the parsed files and the normalised batch; nothing is
parsed or looked up again. Counters are observed while the batch is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import adif
from . import stats
from .merge import coerce, rejected

# Reasons for which a whole file is refused.
REFUSALS = ("too_large", "too_many_records")
#: stages in the order in which a record goes through them
STAGES = ("file", "document", "skipped", "record", "storage")
KEPT = 100  # warnings of a file that are listed; the others are counted


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows with counters that are known once they have been written."""
    counters = Observation()
    return rows.observe(
        counters, F.count(F.lit(1)).alias("records"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
    ), counters


def all_warnings(parsed: DataFrame, batch: DataFrame) -> DataFrame:
    """``file, record_no, stage, pos, code, field, value`` of an import with parsed files and their normalised batch."""
    note = ["file", "record_no"]
    in_files = parsed.select(*note, F.posexplode("warnings").alias("pos", "w"))
    stage = F.when(F.col("w.code").isin(*REFUSALS), "file").otherwise("document")
    of_files = in_files.select(*note, stage.alias("stage"), "pos", "w.*")
    stage = F.when(F.col("skip_reason").isNotNull(), "skipped").otherwise("record")
    of_records = batch.select(*note, stage.alias("stage"), F.posexplode("warnings").alias("pos", "w")).select(*note, "stage", "pos", "w.*")
    of_storage = _unstored(batch).select(
        *note, F.lit("storage").alias("stage"), F.lit(0).alias("pos"), F.lit("bad_value").alias("code"),
        F.col("reject_reason").alias("field"), F.lit(None).cast("string").alias("value"),
    )
    return of_files.unionByName(of_records).unionByName(of_storage)


def _unstored(batch: DataFrame) -> DataFrame:
    return rejected(coerce(batch.where("skip_reason IS NULL")))


def listed_warnings(found: DataFrame, keep: int = KEPT) -> DataFrame:
    """The first warnings of every file in the order of its records, with the number of further ones."""
    place = F.array_position(F.lit(list(STAGES)), F.col("stage"))
    flat = found.withColumn("place", place)
    return stats.warnings_rollup(flat, "file", ["record_no", "place", "pos"], keep).drop("place", "pos")


def rejected_rows(batch: DataFrame) -> DataFrame:
    """Quarantine: rows that are not stored, whole, with ``reason``."""
    skipped = batch.where("skip_reason IS NOT NULL").withColumn("reason", F.col("skip_reason"))
    unstored = batch.join(_unstored(batch).select("file", "record_no", F.col("reject_reason").alias("reason")), ["file", "record_no"])
    return skipped.unionByName(unstored.select(*skipped.columns))


def refused_files(parsed: DataFrame) -> DataFrame:
    """``file, code`` of files that were kept out whole."""
    return adif.warnings(parsed).where(F.col("code").isin(*REFUSALS)).select("file", "code")

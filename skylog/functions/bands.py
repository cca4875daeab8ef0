"""Amateur bands: name clean-up, band of a frequency, sort order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col, filled, reused

# The ADIF 3.1 band enumeration (name, lower MHz, upper MHz), both ends included.
BANDS = (
    ("2190m", 0.1357, 0.1378),
    ("630m", 0.472, 0.479),
    ("560m", 0.501, 0.504),
    ("160m", 1.8, 2.0),
    ("80m", 3.5, 4.0),
    ("60m", 5.06, 5.45),
    ("40m", 7.0, 7.3),
    ("30m", 10.1, 10.15),
    ("20m", 14.0, 14.35),
    ("17m", 18.068, 18.168),
    ("15m", 21.0, 21.45),
    ("12m", 24.89, 24.99),
    ("10m", 28.0, 29.7),
    ("8m", 40.0, 45.0),
    ("6m", 50.0, 54.0),
    ("5m", 54.000001, 69.9),
    ("4m", 70.0, 71.0),
    ("2m", 144.0, 148.0),
    ("1.25m", 222.0, 225.0),
    ("70cm", 420.0, 450.0),
    ("33cm", 902.0, 928.0),
    ("23cm", 1240.0, 1300.0),
    ("13cm", 2300.0, 2450.0),
    ("9cm", 3300.0, 3500.0),
    ("6cm", 5650.0, 5925.0),
    ("3cm", 10000.0, 10500.0),
    ("1.25cm", 24000.0, 24250.0),
    ("6mm", 47000.0, 47200.0),
    ("4mm", 75500.0, 81000.0),
    ("2.5mm", 119980.0, 123000.0),
    ("2mm", 134000.0, 149000.0),
    ("1mm", 241000.0, 250000.0),
    ("submm", 300000.0, 7500000.0),
)

NAMES = [name for name, _, _ in BANDS]


@reused
def clean_band(value: Column | str) -> Column:
    return F.lower(filled(value))


@reused
def band_of_mhz(mhz: Column | str) -> Column:
    """Band that holds the frequency, NULL outside all of them: one CASE, no join."""
    if isinstance(mhz, str):
        cases = " ".join(f"WHEN {mhz} BETWEEN {lo}D AND {hi}D THEN '{n}'" for n, lo, hi in BANDS)
        return F.expr(f"CASE {cases} END")
    freq = mhz
    return F.coalesce(*[F.when(freq.between(lo, hi), F.lit(name)) for name, lo, hi in BANDS])


@reused
def is_band(name: Column | str) -> Column:
    return col(name).isin(NAMES)


def logged_band(text: Column, freq_band: Column) -> Column:
    """The band to store: a known logged band, else the band of the frequency, else as logged."""
    name = clean_band(text)
    return F.when(is_band(name), name).otherwise(F.coalesce(freq_band, name))


@reused
def band_rank(name: Column | str) -> Column:
    """Position in frequency order; unknown names after the known ones."""
    position = F.array_position(F.lit(NAMES), col(name)).cast("int")
    return F.when(position > 0, position - 1).otherwise(F.lit(len(NAMES)))


def band_table(spark: SparkSession) -> DataFrame:
    """The enumeration as a dimension (33 rows) for range joins."""
    rows = [(i, name, lo, hi) for i, (name, lo, hi) in enumerate(BANDS)]
    return spark.createDataFrame(rows, "ord int, band string, lo_mhz double, hi_mhz double")


def band_range_join(df: DataFrame, mhz: str, out: str = "band") -> DataFrame:
    """Left range join against the dimension. The build side is 33 fixed rows."""
    dim = band_table(df.sparkSession).select(F.col("band").alias(out), "lo_mhz", "hi_mhz")
    joined = df.join(F.broadcast(dim), F.col(mhz).between(F.col("lo_mhz"), F.col("hi_mhz")), "left")
    return joined.drop("lo_mhz", "hi_mhz")


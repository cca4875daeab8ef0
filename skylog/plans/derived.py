"""A contact log derived from the ``events`` table.

One SQL text that Spark and other engines read alike, so a query and its check start from the
same rows. ``seq`` is the ingest order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import MAPPED_FIELDS

PREFIXES = "YU1 YT0 9A2 DL1 W6 VE3 KH6 KL7 IT9 VK4 OE1 GM3 4O1 E71 TA1 KG4".split()
STATION = "KN04ft55"


def _case(expr: str, values: list[str | None], otherwise: str = "NULL") -> str:
    branches = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values)
    )
    return f"CASE {expr} {branches} ELSE {otherwise} END"


def _quoted(values: list[str | None]) -> list[str | None]:
    return [None if v is None else f"'{v}'" for v in values]


def _angle(hundredths: str, positive: str, negative: str) -> str:
    whole = f"CAST(floor(abs({hundredths}) / 100) AS BIGINT)"
    tenths = f"(abs({hundredths}) % 100) * 6"
    minutes = f"CAST(floor({tenths} / 10) AS BIGINT)"
    return (
        f"(CASE WHEN {hundredths} < 0 THEN '{negative}' ELSE '{positive}' END"
        f" || lpad(CAST({whole} AS STRING), 3, '0') || ' '"
        f" || lpad(CAST({minutes} AS STRING), 2, '0') || '.'"
        f" || CAST(({tenths}) % 10 AS STRING) || '00')"
    )


def _char(index: str, first: str) -> str:
    return f"chr(CAST({ord(first)} + {index} AS INT))"


def _div(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


_LOC6 = " || ".join(
    [
        _char(_div("ilo", 2400), "A"),
        _char(_div("ila", 2400), "A"),
        f"CAST({_div('ilo', 240)} % 10 AS STRING)",
        f"CAST({_div('ila', 240)} % 10 AS STRING)",
        _char(f"{_div('ilo', 10)} % 24", "a"),
        _char(f"{_div('ila', 10)} % 24", "a"),
    ]
)

RAW_LOG_SQL = f"""
SELECT event_id AS seq, ts, user_id, event_type,
  (CASE WHEN event_id % 20 = 3 THEN 'KH6/' ELSE '' END)
    || ({_case('user_id % 16', _quoted(PREFIXES))})
    || {_char('user_id % 26', 'A')} || {_char(f"{_div('user_id', 26)} % 26", 'A')}
    || (CASE WHEN user_id % 3 = 0 THEN 'X' ELSE '' END)
    || ({_case('event_id % 20', _quoted(['/P', '/MM', '/QRP', '', '/YU', '/P/QRP']), "''")})
    AS call_,
  CASE WHEN event_id % 211 = 0 THEN '20260230'
    ELSE CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS STRING) END AS qso_date,
  lpad(CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS STRING), 6, '0') AS time_on,
  {_case('event_id % 12', _quoted(['1.84', '3,573', '7.074', '10.136', '14.074', '18.1',
                                   '21.074', '24.915', ' 28.074', '50.313', 'abc', '27.0']))}
    AS freq,
  {_case('event_id % 9', _quoted(['20M', ' 40m', '11m']))} AS band,
  CASE event_type WHEN 'view' THEN 'FT8' WHEN 'click' THEN 'MFSK' WHEN 'purchase' THEN 'ssb'
    WHEN 'signup' THEN 'CW' ELSE 'USB' END AS mode,
  CASE event_type WHEN 'click' THEN 'FT4' WHEN 'purchase' THEN 'USB' END AS submode,
  CASE WHEN event_type IN ('view', 'click') THEN '-' || lpad(CAST(user_id % 25 AS STRING), 2, '0')
    ELSE '599' END AS rst_sent,
  {_case('event_id % 7', [None, 'substring(loc6, 1, 2)', 'substring(loc6, 1, 4)', 'lower(loc6)',
                          "loc6 || '55ab'", "'ZZ00'", 'loc6'])} AS gridsquare,
  CASE WHEN event_id % 4 = 0 THEN {_angle('clat', 'N', 'S')} END AS lat,
  CASE WHEN event_id % 4 = 0 THEN {_angle('clon', 'E', 'W')} END AS lon,
  {_case('event_id % 5', _quoted([None, 'KN04']), "'KN04ft'")} AS my_gridsquare,
  CASE WHEN event_id % 35 = 5 THEN 'N044 48.000' END AS my_lat,
  CASE WHEN event_id % 35 = 5 THEN 'E020 30.000' END AS my_lon,
  CASE WHEN event_id % 3 = 0 THEN CAST(1 + user_id % 16 AS STRING)
    WHEN event_id % 31 = 0 THEN '1000' END AS dxcc,
  'Op ' || CAST(user_id AS STRING) AS name,
  event_type AS comment,
  clat, clon, loc6
FROM (SELECT *, {_LOC6} AS loc6 FROM (
  SELECT *, CAST(floor((clat / 100.0 + 90.0) * 240 + 1e-9) AS BIGINT) AS ila,
    CAST(floor((clon / 100.0 + 180.0) * 120 + 1e-9) AS BIGINT) AS ilo FROM (
    SELECT *, event_id * 7919 % 17001 - 8500 AS clat, event_id * 104729 % 35999 - 18000 AS clon
    FROM {{events}} WHERE ts IS NOT NULL AND user_id IS NOT NULL) e0) e1) e2
"""

# The same contacts as another program logged them: FT4 under its own name, later ingest order.
SECOND_LOG_SQL = """
SELECT seq + 1000000000000 AS seq, ts, user_id, event_type, call_, qso_date, time_on, freq, band,
  CASE WHEN submode = 'FT4' THEN 'FT4' ELSE mode END AS mode,
  CASE WHEN submode = 'FT4' THEN NULL ELSE submode END AS submode,
  rst_sent, gridsquare, lat, lon, my_gridsquare, my_lat, my_lon, dxcc, name, comment,
  clat, clon, loc6
FROM {raw}
"""

# ADIF field name -> column of the derived log
ADIF_COLUMNS = {
    "CALL": "call_",
    "QSO_DATE": "qso_date",
    "TIME_ON": "time_on",
    "FREQ": "freq",
    "BAND": "band",
    "MODE": "mode",
    "SUBMODE": "submode",
    "RST_SENT": "rst_sent",
    "GRIDSQUARE": "gridsquare",
    "LAT": "lat",
    "LON": "lon",
    "MY_GRIDSQUARE": "my_gridsquare",
    "MY_LAT": "my_lat",
    "MY_LON": "my_lon",
    "DXCC": "dxcc",
    "NAME": "name",
    "COMMENT": "comment",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw_log(events_df: DataFrame) -> DataFrame:
    return events_df.sparkSession.sql(RAW_LOG_SQL, events=events_df)


def second_log(raw: DataFrame) -> DataFrame:
    return raw.sparkSession.sql(SECOND_LOG_SQL, raw=raw)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log of a scale-factor folder."""
    return raw_log(events(spark, sf_dir))


def records(raw: DataFrame, *keep: str) -> DataFrame:
    """Flat log columns as normaliser input: mapped fields plus the ``extra`` map.

    A field without a value is absent from the record, as in a log file.
    """
    null = F.lit(None).cast("string")
    fields = [F.col(ADIF_COLUMNS[n]).alias(n) if n in ADIF_COLUMNS else null.alias(n)
              for n in [*MAPPED_FIELDS, "LAT", "LON", "MY_LAT", "MY_LON"]]
    extra = [n for n in ADIF_COLUMNS if n not in MAPPED_FIELDS]
    return raw.select(
        *[F.col(k).alias(f"{k}_in") if k.upper() in ADIF_COLUMNS else F.col(k) for k in keep],
        *fields,
        present_map({n: F.col(ADIF_COLUMNS[n]) for n in extra}).alias("extra"),
    )


def present_map(values: dict[str, Column]) -> Column:
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]
    return F.map_from_entries(
        F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())
    )

"""ANSI SQL for the registered queries, written independently of the column builders."""

from __future__ import annotations

from ..functions.bands import BANDS
from ..functions.modes import (
    ALIASES,
    DATA_MODES,
    DB_REPORT,
    PHONE,
    RECEIVER_MODES,
    TYPED_SUBMODES,
    VARIANTS,
)
from ..schema import STATION_MARK
from .catalog import HALF_TIME, NEW_STATION, RIG_TEXTS, ROTATOR
from .derived import ADIF_COLUMNS, RAW_LOG_SQL, SECOND_LOG_SQL, STATION
from .world import dimension_rows

R = 6371.0088
MIN_PATH_KM = 0.001
RAW = f"raw AS ({RAW_LOG_SQL.format(events='events')})"
SECOND = f"second AS ({SECOND_LOG_SQL.format(raw='raw')})"
BOTH = f"{RAW}, {SECOND}, both_logs AS (SELECT * FROM raw UNION ALL SELECT * FROM second)"


def q(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], names: str, table: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"{table}({names}) AS (VALUES {body})"


def in_list(names: list[str]) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


def choose(expr: str, *texts: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


# --- scalar rules ----------------------------------------------------------------------------------


def latlon(c: str, letters: str = "NSEW") -> str:
    shape = r"\s*[NSEWnsew]\s*[0-9]{1,3}\s+[0-9]{1,2}([.,][0-9]*)?\s*"
    minutes = f"CAST(replace(regexp_extract({c}, '\\s([0-9]+[.,]?[0-9]*)\\s*$', 1), ',', '.') AS DOUBLE)"
    degrees = f"CAST(regexp_extract({c}, '[A-Za-z]\\s*([0-9]+)', 1) AS INTEGER)"
    letter = f"upper(trim({c})[1])"
    total = f"({degrees} + {minutes} / 60.0)"
    return (
        f"CASE WHEN regexp_full_match({c}, '{shape}') THEN CASE WHEN strpos('{letters}', {letter}) > 0 "
        f"AND {minutes} < 60 AND {total} <= CASE WHEN {letter} IN ('N', 'S') THEN 90 ELSE 180 END "
        f"THEN CASE WHEN {letter} IN ('S', 'W') AND {total} > 0 THEN -1.0 ELSE 1.0 END * {total} END END"
    )


def mhz(c: str) -> str:
    shape = r"\s*\+?([0-9]+([.,][0-9]*)?|[.,][0-9]+)\s*"
    number = f"CAST(replace(replace(trim({c}), ',', '.'), '+', '') AS DOUBLE)"
    return f"CASE WHEN regexp_full_match({c}, '{shape}') THEN CASE WHEN {number} > 0 THEN {number} END END"


def band(c: str) -> str:
    cases = " ".join(f"WHEN {c} >= {lo} AND {c} <= {hi} THEN '{n}'" for n, lo, hi in BANDS)
    return f"CASE {cases} END"


def qso_time(d: str, t: str) -> str:
    padded = f"CASE WHEN length({t}) = 4 THEN {t} || '00' ELSE {t} END"
    ok = (
        f"regexp_full_match({d}, '[0-9]{{8}}') AND regexp_full_match({t}, '[0-9]{{4}}([0-9]{{2}})?') "
        f"AND left({d}, 4) >= '1930' AND substr({padded}, 5, 2) < '60'"
    )
    return f"CASE WHEN {ok} THEN try_strptime({d} || {padded}, '%Y%m%d%H%M%S') END"


def family(c: str) -> str:
    cases = " ".join(
        f"WHEN {c} IN {in_list([m, *subs])} THEN '{m}'" for m, subs in VARIANTS.items()
    )
    return f"CASE {cases} END"


def dedup_mode(m: str, s: str) -> str:
    return (
        f"CASE WHEN {m} IS NOT NULL THEN coalesce({family(m)}, {s}, {m}) "
        f"ELSE coalesce({family(s)}, {s}, '') END"
    )


_FOUR = "[A-Ra-r]{2}[0-9]{2}"
LOC_SHAPE = "[A-Ra-r]{2}([0-9]{2}([A-Xa-x]{2}([0-9]{2})?)?)?"
TEN_SHAPE = _FOUR + "[A-Xa-x]{2}[0-9]{2}[A-Xa-x]{2}"


def loc_norm(c: str) -> str:
    t = f"CASE WHEN regexp_full_match({c}, '{TEN_SHAPE}') THEN left({c}, 8) ELSE {c} END"
    canon = f"upper(left({t}, 4)) || lower(substr({t}, 5, 2)) || substr({t}, 7, 2)"
    return f"CASE WHEN regexp_full_match({t}, '{LOC_SHAPE}') THEN {canon} END"


def units(c: str, first: int) -> str:
    """Corner units of a canonical locator on one axis (1 longitude, 2 latitude)."""

    def digit(place: int, base: str, step: int) -> str:
        return (
            f"CASE WHEN length({c}) >= {place} THEN "
            f"(ascii(upper(substr({c}, {place}, 1))) - {ord(base)}) * {step} ELSE 0 END"
        )

    steps = zip((0, 2, 4, 6), "A0A0", (2400, 240, 10, 1))
    return "(" + " + ".join(digit(first + k, b, s) for k, b, s in steps) + ")"


def span(c: str) -> str:
    return f"CASE length({c}) WHEN 2 THEN 2400 WHEN 4 THEN 240 WHEN 6 THEN 10 WHEN 8 THEN 1 END"


def mid_lat(c: str) -> str:
    return f"((2 * ({units(c, 2)} - 21600) + {span(c)}) / 480.0)"


def mid_lon(c: str) -> str:
    return f"((2 * ({units(c, 1)} - 21600) + {span(c)}) / 240.0)"


def edge(c: str, first: int, plus: bool) -> str:
    per = "240.0" if first == 2 else "120.0"
    extra = f" + {span(c)}" if plus else ""
    return f"(CASE WHEN {c} IS NOT NULL THEN ({units(c, first)}{extra} - 21600) / {per} END)"


def cell(y: str, x: str, n: int) -> str:
    """Locator of a position inside the world."""
    u = f"CAST(least(floor(({y} + 90.0) * 240 + 1e-9), 43199) AS BIGINT)"
    v = f"CAST(least(floor(({x} + 180.0) * 120 + 1e-9), 43199) AS BIGINT)"
    pairs = [
        [f"chr(CAST(65 + {a} // 2400 AS INTEGER))" for a in (v, u)],
        [f"CAST({a} // 240 % 10 AS VARCHAR)" for a in (v, u)],
        [f"chr(CAST(97 + {a} // 10 % 24 AS INTEGER))" for a in (v, u)],
        [f"CAST({a} % 10 AS VARCHAR)" for a in (v, u)],
    ]
    text = " || ".join(c for pair in pairs[: n // 2] for c in pair)
    return f"CASE WHEN {y} BETWEEN -90 AND 90 AND {x} BETWEEN -180 AND 180 THEN {text} END"


def km(y1: str, x1: str, y2: str, x2: str) -> str:
    h = (
        f"(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) "
        f"* pow(sin(radians({x2} - {x1}) / 2), 2))"
    )
    return f"(2 * {R} * asin(sqrt(CASE WHEN {h} > 1 THEN 1.0 ELSE {h} END)))"


def azimuth(y1: str, x1: str, y2: str, x2: str) -> str:
    east = f"sin(radians({x2} - {x1})) * cos(radians({y2}))"
    north = (
        f"cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) "
        f"* cos(radians({x2} - {x1}))"
    )
    return f"fmod(degrees(atan2({east}, {north})) + 360.0, 360.0)"


def wrap(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN -180 AND 180 THEN {x} ELSE {x} - 360.0 * round({x} / 360.0) END"


# --- the normalised log as common table expressions ----------------------------------------------------

MODIFIER = "([0-9]+|.|FD|FF|LH|LS|LT|YL|[A-Z]{3,})"
_DIM = [*dimension_rows()]
_USA = next(r for r in _DIM if r[1] == "K")
DIM = values(
    [*_DIM, ("U", "K", -1, *_USA[3:])],
    "kind, key, eid, entity, name, dxcc, dxcc_name, continent, cq_zone, itu_zone, lat, lon",
    "dim",
)

LOOKUP = f"""
calls AS (SELECT DISTINCT call_ FROM raw),
parts AS (SELECT call_, list_filter(string_split(upper(call_), '/'), lambda p: p <> '') AS parts FROM calls),
trimmed AS (SELECT *, list_max(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN i = 1
    OR NOT regexp_full_match(parts[i], '{MODIFIER}') THEN i ELSE 1 END)) AS n,
  list_concat(parts[1:1], list_filter(parts[2:], lambda p: NOT regexp_full_match(p, '{MODIFIER}'))) AS kept
  FROM parts),
cand AS (
  SELECT call_, array_to_string(parts[1:k], '/') AS key, len(parts) - k AS rank
  FROM (SELECT *, unnest(range(n, len(parts) + 1)) AS k FROM trimmed)
  UNION ALL SELECT call_, array_to_string(kept, '/'), 1000 FROM trimmed WHERE len(kept) <> n),
exact_hit AS (SELECT call_, arg_min(eid, rank) AS eid FROM cand JOIN dim ON dim.kind = 'E' AND dim.key = cand.key
  GROUP BY call_),
sides AS (SELECT call_, 1 AS side, kept[1] AS text FROM trimmed
  UNION ALL SELECT call_, 2, kept[2] FROM trimmed WHERE len(kept) > 1),
prefix_hit AS (SELECT call_, side, arg_max(eid, length(key)) AS eid, max(length(key)) AS len
  FROM sides JOIN dim ON dim.kind = 'P' AND starts_with(text, dim.key) GROUP BY call_, side),
split AS (SELECT t.*, p1.eid AS e1, p2.eid AS e2, p1.len AS l1,
    len(kept) = 1 OR length(kept[2]) < length(kept[1])
      OR (length(kept[2]) = length(kept[1]) AND coalesce(p2.len, 0) > coalesce(p1.len, 0)) AS first_home
  FROM trimmed t LEFT JOIN prefix_hit p1 ON p1.call_ = t.call_ AND p1.side = 1
    LEFT JOIN prefix_hit p2 ON p2.call_ = t.call_ AND p2.side = 2),
homes AS (SELECT *, CASE WHEN first_home THEN kept[1] ELSE kept[2] END AS home,
    CASE WHEN len(kept) > 1 THEN CASE WHEN first_home THEN e2 ELSE e1 END END AS loc_eid,
    CASE WHEN first_home THEN e1 ELSE e2 END AS home_eid FROM split),
resolved AS (SELECT s.call_, CASE WHEN x.eid IS NOT NULL THEN x.eid
    WHEN list_has_any(parts[2:], ['MM', 'AM']) OR regexp_full_match(home, '[A-Z]+') THEN NULL
    ELSE coalesce(loc_eid, hx.eid, CASE WHEN hd.key = 'KG4' AND regexp_full_match(home, 'KG4([A-Z]|[A-Z]{{3}})')
      THEN -1 END, home_eid) END AS eid
  FROM homes s LEFT JOIN exact_hit x ON x.call_ = s.call_
    LEFT JOIN dim hx ON hx.kind = 'E' AND hx.key = s.home AND len(s.kept) > 1
    LEFT JOIN dim hd ON hd.eid = s.home_eid),
match AS (SELECT r.call_, d.* FROM resolved r JOIN dim d ON d.eid = r.eid)
"""


def norm(source: str = "raw", countries: bool = True) -> str:
    """CTEs up to ``norm``: one row per record of ``source`` (skipped rows included)."""
    tail = f"{DIM}, {LOOKUP.replace('FROM raw)', f'FROM {source})')}" if countries else (
        "match(call_, entity, dxcc, dxcc_name, continent, cq_zone, itu_zone, lat, lon) AS (SELECT CAST(NULL AS VARCHAR), "
        "CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), "
        "CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) WHERE false)"
    )
    number = "CASE WHEN regexp_full_match(dxcc, '[0-9]{1,6}') AND CAST(dxcc AS INTEGER) <= 999 THEN CAST(dxcc AS INTEGER) END"
    station_lat, station_lon = mid_lat(q(STATION)), mid_lon(q(STATION))
    return f"""{tail},
texts AS (SELECT seq, ts, user_id, event_type, call_, nullif(upper(trim(call_)), '') AS call,
  {qso_time('qso_date', 'time_on')} AS qso_datetime, trim(freq) AS freq_text, {mhz('freq')} AS freq_mhz,
  nullif(lower(trim(band)), '') AS band_text, trim(band) AS band_raw,
  nullif(upper(trim(mode)), '') AS mode, nullif(upper(trim(submode)), '') AS submode, rst_sent,
  trim(gridsquare) AS grid_text, {loc_norm('trim(gridsquare)')} AS loc, my_gridsquare AS my_text,
  {loc_norm('trim(my_gridsquare)')} AS my_loc, lat AS lat_text, lon AS lon_text,
  {latlon('lat', 'NS')} AS y, {latlon('lon', 'EW')} AS x, {latlon('my_lat', 'NS')} AS my_y,
  {latlon('my_lon', 'EW')} AS my_x, my_lat AS my_lat_text, my_lon AS my_lon_text,
  dxcc AS dxcc_text, {number} AS log_dxcc, name, comment FROM {source}),
banded AS (SELECT *, {band('freq_mhz')} AS freq_band,
  band_text IN {in_list([b[0] for b in BANDS])} AS band_known FROM texts),
joined AS (SELECT b.*, m.entity, m.dxcc AS m_dxcc, m.dxcc_name, m.continent, m.cq_zone, m.itu_zone,
    m.lat AS m_lat, m.lon AS m_lon, y IS NOT NULL AND x IS NOT NULL AND NOT (y = 0 AND x = 0) AS real_pos,
    my_y IS NOT NULL AND my_x IS NOT NULL AND NOT (my_y = 0 AND my_x = 0) AS my_real,
    my_loc IS NOT NULL AND length(my_loc) < {len(STATION)} AND starts_with('{STATION}', my_loc)
      AND NOT (my_y IS NOT NULL AND my_x IS NOT NULL AND NOT (my_y = 0 AND my_x = 0)) AS refined
  FROM banded b LEFT JOIN match m ON m.call_ = b.call_),
placed AS (SELECT *, CASE WHEN real_pos THEN 'latlon' WHEN length(loc) > 2 THEN 'grid'
    WHEN m_lat IS NOT NULL AND (loc IS NULL OR (m_lat BETWEEN {edge('loc', 2, False)} AND {edge('loc', 2, True)}
      AND m_lon BETWEEN {edge('loc', 1, False)} AND {edge('loc', 1, True)})) THEN 'cty'
    WHEN loc IS NOT NULL THEN 'grid' END AS loc_source,
  CASE WHEN call IS NULL THEN 'missing_call' WHEN qso_datetime IS NULL THEN 'bad_datetime' END AS skip_reason,
  CASE WHEN band_known THEN band_text ELSE coalesce(freq_band, band_text) END AS band FROM joined),
norm AS (SELECT *, coalesce(loc, grid_text) AS gridsquare,
    CASE WHEN refined THEN '{STATION}' ELSE coalesce(my_loc, my_text,
      CASE WHEN my_real THEN {cell('my_y', 'my_x', 6)} END, '{STATION}') END AS my_gridsquare,
    CASE loc_source WHEN 'latlon' THEN y WHEN 'grid' THEN {mid_lat('loc')} WHEN 'cty' THEN m_lat END AS lat,
    CASE loc_source WHEN 'latlon' THEN x WHEN 'grid' THEN {mid_lon('loc')} WHEN 'cty' THEN m_lon END AS lon,
    CASE WHEN my_real THEN my_y WHEN my_loc IS NOT NULL AND NOT refined THEN {mid_lat('my_loc')}
      ELSE {station_lat} END AS my_lat,
    CASE WHEN my_real THEN my_x WHEN my_loc IS NOT NULL AND NOT refined THEN {mid_lon('my_loc')}
      ELSE {station_lon} END AS my_lon,
    coalesce(log_dxcc, m_dxcc) AS dxcc, dxcc_name AS country, continent AS cont,
    my_text IS NULL AND NOT my_real AS marked,
    call || '|' || strftime(qso_datetime, '%Y%m%d%H%M') || '|' || coalesce(band, '') || '|'
      || {dedup_mode('mode', 'submode')} AS dedup_key FROM placed),
good AS (SELECT *, {km('my_lat', 'my_lon', 'lat', 'lon')} AS distance_km,
    {azimuth('my_lat', 'my_lon', 'lat', 'lon')} AS bearing_deg,
    coalesce(submode, mode, '') AS shown FROM norm WHERE skip_reason IS NULL)"""


def with_log(body: str, countries: bool = True) -> str:
    return f"WITH {RAW}, {norm('raw', countries)} {body}"


def with_both(body: str, countries: bool = False) -> str:
    return f"WITH {BOTH}, {norm('both_logs', countries)} {body}"


def from_raw(body: str) -> str:
    return f"WITH {RAW} {body}"


FIRST = "first_ AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY seq) = 1)"
STORED = f"stored AS (SELECT * FROM good WHERE qso_datetime < TIMESTAMP '{HALF_TIME}')"

SQL: dict[str, str] = {}

SQL["parse_latlon"] = from_raw(
    f"""SELECT seq, round({latlon('lat')}, 9) AS lat_deg,
    round({latlon("lower(replace(lon, '.', ','))")}, 9) AS lon_deg,
    {latlon("(lat || 'x')")} AS garbage, round({latlon("('N' || substr(lon, 2))")}, 9) AS as_lat FROM raw"""
)
SQL["parse_freq"] = from_raw(
    f"""SELECT seq, {mhz('freq')} AS mhz, {mhz("('+' || replace(trim(freq), '.', ','))")} AS comma,
    {mhz("('-' || trim(freq))")} AS negative FROM raw"""
)
SQL["parse_qso_time"] = from_raw(
    f"""SELECT seq, {qso_time('qso_date', 'time_on')} AS at, {qso_time('qso_date', 'left(time_on, 4)')} AS at_minute,
    {qso_time('qso_date', "(left(time_on, 4) || '60')")} AS second_60 FROM raw"""
)
SQL["dedup_key"] = with_log("SELECT seq, dedup_key FROM good", False)
SQL["band_of_freq"] = from_raw(
    f"""SELECT seq, {band('m')} AS band, {band('(m * 10)')} AS band_x10
    FROM (SELECT seq, {mhz('freq')} AS m FROM raw) t"""
)
SQL["resolve_band"] = with_log(
    """SELECT seq, band, CASE WHEN band_text IS NULL THEN
      CASE WHEN freq_band IS NULL AND freq_mhz IS NOT NULL THEN 'freq_outside_bands' END
    WHEN NOT band_known THEN CASE WHEN freq_band IS NOT NULL THEN 'band_from_freq' ELSE 'unknown_band_kept' END
    END AS note FROM good""",
    False,
)
SQL["display_mode"] = from_raw(
    "SELECT seq, upper(coalesce(nullif(trim(submode), ''), nullif(trim(mode), ''), '')) AS shown FROM raw"
)
SQL["dedup_mode"] = (
    f"WITH {BOTH}, t AS (SELECT seq, upper(trim(mode)) AS m, upper(trim(submode)) AS s FROM both_logs) "
    f"SELECT seq, {dedup_mode('m', 's')} AS mode, coalesce({family('s')}, s, '') AS without_mode FROM t"
)
_rig = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())
SQL["rig_mode"] = (
    f"WITH {RAW}, "
    + values([(k, *v) for k, v in RECEIVER_MODES.items()], "rig, m, s", "dim")
    + f""", named AS (SELECT seq, CASE t WHEN '' THEN '' {_rig} ELSE t END AS rig_mode FROM (
      SELECT seq, upper(trim({choose(f'seq % {len(RIG_TEXTS)}', *[q(t) for t in RIG_TEXTS])})) AS t FROM raw))
    SELECT seq, rig_mode, rig_mode IN {in_list(DATA_MODES)} AS is_data, m AS adif_mode, s AS adif_submode
    FROM named LEFT JOIN dim ON rig = rig_mode"""
)
_typed = values([(s, p) for p, ss in TYPED_SUBMODES.items() for s in ss], "sub, parent", "typed")
SQL["split_mode"] = (
    f"WITH {RAW}, {_typed} SELECT seq, coalesce(parent, t) AS mode, CASE WHEN parent IS NULL THEN '' ELSE t END AS submode "
    "FROM (SELECT seq, upper(trim(coalesce(submode, mode))) AS t FROM raw) r LEFT JOIN typed ON sub = t"
)
SQL["default_rst"] = (
    f"""WITH {RAW}, {_typed}, t AS (SELECT seq, upper(trim(mode)) AS m, upper(trim(submode)) AS s FROM raw),
    u AS (SELECT seq, coalesce(s, CASE WHEN parent IS NOT NULL THEN m END) AS s, coalesce(parent, m) AS m
      FROM t LEFT JOIN typed ON sub = m)
    SELECT seq, CASE WHEN s IN {in_list(DB_REPORT)} THEN '-10' WHEN s IN {in_list(PHONE)} THEN '59'
      WHEN m IN {in_list(DB_REPORT)} THEN '-10' WHEN m IN {in_list(PHONE)} THEN '59'
      WHEN coalesce(s, m) IS NOT NULL THEN '599' ELSE '' END AS report FROM u"""
)
SQL["locator_valid"] = from_raw(
    f"SELECT seq, coalesce(regexp_full_match(gridsquare, '{LOC_SHAPE}'), false) AS ok, false AS newline FROM raw"
)
SQL["locator_norm"] = from_raw(f"SELECT seq, {loc_norm('gridsquare')} AS locator FROM raw")
_y, _x = "(clat / 100.0)", "(clon / 100.0)"
SQL["to_locator"] = from_raw(
    "SELECT seq, " + ", ".join(f"{cell(_y, _x, n)} AS loc{n}" for n in (2, 4, 6, 8))
    + f", {cell(f'({_y} * 2)', f'({_x} * 2)', 4)} AS outside FROM raw"
)
_LOC = f"SELECT seq, {loc_norm('gridsquare')} AS loc FROM raw"
SQL["locator_bounds"] = from_raw(
    f"""SELECT seq, loc, round({edge('loc', 2, False)}, 9) AS lat_min, round({edge('loc', 1, False)}, 9) AS lon_min,
    round({edge('loc', 2, True)}, 9) AS lat_max, round({edge('loc', 1, True)}, 9) AS lon_max,
    round(({span('loc')}) / 240.0, 9) AS dlat, round(({span('loc')}) / 120.0, 9) AS dlon FROM ({_LOC}) t"""
)
SQL["locator_centre"] = from_raw(
    f"SELECT seq, loc, round({mid_lat('loc')}, 9) AS lat, round({mid_lon('loc')}, 9) AS lon FROM ({_LOC}) t"
)
SQL["locator_view"] = from_raw(
    f"""SELECT seq, round(CASE WHEN s - (n - s) < -90 THEN -90 ELSE s - (n - s) END, 9) AS lat_min,
    round(CASE WHEN w - (e - w) < -180 THEN -180 ELSE w - (e - w) END, 9) AS lon_min,
    round(CASE WHEN n + (n - s) > 90 THEN 90 ELSE n + (n - s) END, 9) AS lat_max,
    round(CASE WHEN e + (e - w) > 180 THEN 180 ELSE e + (e - w) END, 9) AS lon_max
    FROM (SELECT seq, {edge('loc', 2, False)} AS s, {edge('loc', 1, False)} AS w, {edge('loc', 2, True)} AS n,
      {edge('loc', 1, True)} AS e FROM ({_LOC}) t) u"""
)


def axis_range(low: str, high: str, half: int, per: int, size: int) -> tuple[str, str]:
    a, b = f"least(greatest({low}, -{half}), {half})", f"least(greatest({high}, -{half}), {half})"
    first = f"(CAST(least(floor(({a} + {half}) * {per} + 1e-9), 43199) AS BIGINT) // {size})"
    top = f"CAST(least(ceil(({b} + {half}) * {per} - 1e-9), 43200) AS BIGINT)"
    return first, f"least(greatest(({top} + {size - 1}) // {size}, {first} + 1), {43200 // size})"


def cells(level: int, dlat: float, dlon: float) -> tuple[str, str, str, str]:
    size = {2: 2400, 4: 240, 6: 10}[level]
    rows = axis_range(_y, f"({_y} + {dlat})", 90, 240, size)
    cols = axis_range(_x, f"({_x} + {dlon})", 180, 120, size)
    return *rows, *cols


_r0, _r1, _c0, _c1 = cells(4, 7.5, 9.25)
SQL["snap_extent"] = from_raw(
    f"""SELECT seq, ({_r0} * 240 - 21600) / 240.0 AS lat_min, ({_c0} * 240 - 21600) / 120.0 AS lon_min,
    ({_r1} * 240 - 21600) / 240.0 AS lat_max, ({_c1} * 240 - 21600) / 120.0 AS lon_max FROM raw"""
)


def _count(level: int) -> str:
    a, b, c, d = cells(level, 7.5, 9.25)
    return f"({b} - {a}) * ({d} - {c}) AS n{level}"


SQL["count_cells"] = from_raw("SELECT seq, " + ", ".join(_count(n) for n in (2, 4, 6)) + " FROM raw")

_HOME = ("44.8125", "20.4612", _y, _x)
SQL["distance_km"] = from_raw(f"SELECT seq, round({km(*_HOME)}, 6) AS km FROM raw")
SQL["bearing_deg"] = from_raw(f"SELECT seq, round({azimuth(*_HOME)}, 6) AS deg FROM raw")
SQL["long_path"] = from_raw(
    f"""SELECT seq, round(2 * pi() * {R} - {km(*_HOME)}, 6) AS km,
    round(fmod({azimuth(*_HOME)} + 180.0, 360.0), 6) AS deg FROM raw"""
)
_NEAR = f"(-{_y} + (seq % 7) * 0.05)", f"(CASE WHEN {_x} > 0 THEN {_x} - 180 ELSE {_x} + 180 END)"
SQL["is_antipodal"] = from_raw(
    f"""SELECT seq, pi() * {R} - {km(*_HOME)} <= 20 AS from_home,
    {km(f'(-{_y})', f'({_x} + 180)', *_NEAR)} <= 20 AS near_antipode FROM raw"""
)


def dest(y: str, x: str, b: str, d: str) -> tuple[str, str]:
    delta = f"({d} / {R})"
    z = f"sin(radians({y})) * cos({delta}) + cos(radians({y})) * sin({delta}) * cos(radians({b}))"
    lat = f"asin(greatest(-1.0, least(1.0, {z})))"
    east = f"sin(radians({b})) * sin({delta}) * cos(radians({y}))"
    lon = f"({x} + degrees(atan2({east}, cos({delta}) - sin(radians({y})) * ({z}))))"
    return f"degrees({lat})", f"({wrap(lon)})"


_dy, _dx = dest("44.8125", "20.4612", "CAST(seq % 360 AS DOUBLE)", "CAST(seq * 13 % 39000 AS DOUBLE)")
SQL["destination"] = from_raw(f"SELECT seq, round({_dy}, 6) AS lat, round({_dx}, 6) AS lon FROM raw")
SQL["aeqd_xy"] = from_raw(
    f"""SELECT seq, round({km(*_HOME)} * sin(radians({azimuth(*_HOME)})), 5) AS x_km,
    round({km(*_HOME)} * cos(radians({azimuth(*_HOME)})), 5) AS y_km,
    '+proj=aeqd +lat_0=' || printf('%.6f', {_y}) || ' +lon_0=' || printf('%.6f', {_x})
      || ' +x_0=0 +y_0=0 +datum=WGS84 +units=km +no_defs' AS proj FROM raw"""
)
SQL["clean_point"] = from_raw(
    f"""SELECT seq, CASE WHEN ok THEN round(y, 9) END AS lat, CASE WHEN ok THEN round({wrap('x')}, 9) END AS lon
    FROM (SELECT seq, clat / 80.0 AS y, clon / 50.0 AS x, abs(clat / 80.0) <= 90 AND seq % 17 <> 0 AS ok FROM raw) t"""
)
SQL["clean_numbers"] = from_raw(
    """SELECT seq, CASE WHEN CAST(dxcc AS INTEGER) <= 999 THEN CAST(dxcc AS INTEGER) END AS dxcc,
    CASE WHEN user_id % 50 BETWEEN 1 AND 40 THEN CAST(user_id % 50 AS INTEGER) END AS cq_zone,
    CASE WHEN seq BETWEEN 1 AND 90 THEN CAST(seq AS INTEGER) END AS itu_zone,
    CASE user_id % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'NA' END AS cont FROM raw"""
)
_s = "date_trunc('second', ts)"
SQL["parse_iso"] = from_raw(
    f"""SELECT seq, CASE seq % 8 WHEN 0 THEN {_s} WHEN 1 THEN {_s} + INTERVAL '250 milliseconds' - INTERVAL '2 hours'
    WHEN 2 THEN {_s} + INTERVAL '330 minutes' WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('minute', ts)
    WHEN 6 THEN {_s} + INTERVAL '123456 microseconds' - INTERVAL '1 hour' END AS at FROM raw"""
)
SQL["coerce_code"] = from_raw("SELECT seq, CASE WHEN seq % 6 IN (0, 1, 2) THEN CAST(dxcc AS BIGINT) END AS code FROM raw")


def _json(pairs: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"'\"{k}\":\"' || {c} || '\"'" for k, c in sorted(pairs))
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


_EXTRA = [(k, c) for k, c in ADIF_COLUMNS.items() if k in ("LAT", "LON", "MY_LAT", "MY_LON", "NAME", "COMMENT")]
SQL["extra_json"] = from_raw(f"SELECT seq, {_json(_EXTRA)} AS extra FROM raw")
SQL["typed_coerce"] = from_raw(
    """SELECT seq, t AS qso_datetime, f AS freq_mhz, CAST(dxcc AS INTEGER) AS dxcc, CASE WHEN t IS NULL THEN 'qso_datetime'
    WHEN f IS NULL THEN 'freq_mhz' END AS reject_reason FROM (SELECT seq, dxcc,
    try_strptime(qso_date || time_on, '%Y%m%d%H%M%S') AS t, TRY_CAST(replace(trim(freq), ',', '.') AS DOUBLE) AS f FROM raw) t"""
)
SQL["dq_rules"] = from_raw(
    f"""SELECT seq, concat_ws(',', CASE WHEN f IS NULL AND freq IS NOT NULL THEN 'freq_invalid' END,
      CASE WHEN b IS NULL THEN 'band_missing' WHEN f IS NOT NULL AND {band('f')} IS DISTINCT FROM b THEN 'band_mismatch' END,
      CASE WHEN g IS NOT NULL AND {loc_norm('g')} IS NULL THEN 'grid_invalid' END) AS broken
    FROM (SELECT seq, freq, {mhz('freq')} AS f, lower(trim(band)) AS b, trim(gridsquare) AS g FROM raw) t"""
)
SQL["station_clean"] = from_raw(
    f"""SELECT seq, call_ AS call, coalesce({loc_norm('gridsquare')}, '') AS grid,
    gridsquare IS NOT NULL AND {loc_norm('gridsquare')} IS NULL AS bad_grid FROM raw"""
)

# --- enrichment ----------------------------------------------------------------------------------------

SQL["prefix_join"] = (
    f"WITH {RAW}, {DIM}, hit AS (SELECT seq, arg_max(key, length(key)) AS prefix, arg_max(entity, length(key)) AS entity "
    "FROM raw JOIN dim ON kind = 'P' AND starts_with(call_, key) GROUP BY seq) "
    "SELECT raw.seq, prefix, entity FROM raw LEFT JOIN hit ON hit.seq = raw.seq"
)
SQL["cty_lookup"] = (
    f"WITH {RAW}, {DIM}, {LOOKUP} SELECT raw.seq, raw.call_, entity, key AS matched, kind = 'E' AS exact, m.dxcc, dxcc_name, "
    "continent, cq_zone, itu_zone FROM raw LEFT JOIN match m ON m.call_ = raw.call_"
)
SQL["band_range_join"] = (
    f"WITH {RAW}, " + values([b for b in BANDS], "band, lo, hi", "dim")
    + f" SELECT seq, dim.band FROM (SELECT seq, {mhz('freq')} AS m FROM raw) t LEFT JOIN dim ON m BETWEEN lo AND hi"
)
SQL["enrich_fill"] = with_log(
    """SELECT seq, dxcc, country, cont, cq_zone, itu_zone,
    CASE WHEN log_dxcc <> m_dxcc THEN CAST(log_dxcc AS VARCHAR) END AS mismatch FROM good"""
)
SQL["resolve_position"] = with_log(
    "SELECT seq, gridsquare, loc_source, round(lat, 6) AS lat, round(lon, 6) AS lon FROM good"
)
SQL["resolve_origin"] = with_log(
    "SELECT seq, my_gridsquare, round(my_lat, 6) AS my_lat, round(my_lon, 6) AS my_lon FROM good", False
)
_NORMAL = (
    "seq, call, qso_datetime, band, mode, submode, freq_mhz, rst_sent, gridsquare, my_gridsquare, dxcc, country, cont, "
    "cq_zone, itu_zone, loc_source, dedup_key, "
    + ", ".join(f"round({n}, 6) AS {n}" for n in ("distance_km", "bearing_deg", "lat", "lon", "my_lat", "my_lon"))
)
SQL["normalize_log"] = with_log(f"SELECT {_NORMAL} FROM good")


def _warnings(order: bool = False) -> str:
    """Warnings of all rows, in the order they are reported."""
    rules = [
        ("bad_value", "FREQ", "freq_text", "freq_text IS NOT NULL AND freq_mhz IS NULL"),
        ("freq_outside_bands", "FREQ", "freq_text", "band_text IS NULL AND freq_band IS NULL AND freq_mhz IS NOT NULL"),
        ("band_from_freq", "BAND", "band_raw", "NOT band_known AND freq_band IS NOT NULL"),
        ("unknown_band_kept", "BAND", "band_raw", "NOT band_known AND freq_band IS NULL"),
        ("bad_locator", "GRIDSQUARE", "grid_text", "grid_text IS NOT NULL AND loc IS NULL"),
        ("locator_cut", "GRIDSQUARE", "grid_text", "length(loc) < length(grid_text)"),
        ("zero_position", "LAT/LON", "NULL", "y = 0 AND x = 0"),
        ("bad_value", "DXCC", "dxcc_text", "dxcc_text IS NOT NULL AND log_dxcc IS NULL"),
        ("dxcc_mismatch", "DXCC", "CAST(log_dxcc AS VARCHAR)", "log_dxcc <> m_dxcc"),
        ("field_centre", "GRIDSQUARE", "loc", "length(loc) = 2 AND loc_source = 'grid'"),
    ]
    parts = [
        f"SELECT seq, event_type, {i} AS place, '{code}' AS code, '{field}' AS field, {value} AS value FROM norm "
        f"WHERE skip_reason IS NULL AND {test}"
        for i, (code, field, value, test) in enumerate(rules)
    ]
    parts.append(
        "SELECT seq, event_type, 0, skip_reason, 'QSO_DATE', NULL FROM norm WHERE skip_reason IS NOT NULL"
    )
    return "w AS (" + " UNION ALL ".join(parts) + ")"


SQL["warnings"] = with_log(f", {_warnings()} SELECT seq, code, field, value FROM w")
SQL["warnings_rollup"] = with_log(
    f""", {_warnings()}, numbered AS (SELECT event_type AS log, seq,
      CAST(row_number() OVER (PARTITION BY seq ORDER BY place) - 1 AS INTEGER) AS pos, code FROM w),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY log ORDER BY seq, pos) AS INTEGER) AS rank,
      count(*) OVER (PARTITION BY log) AS total FROM numbered)
    SELECT log, seq, pos, code, rank, greatest(total - 100, 0) AS further FROM ranked WHERE rank <= 100"""
)
_lo, _hi = ROTATOR
SQL["pointing_plan"] = with_log(
    f""", aims AS (SELECT seq, lat, my_lat, distance_km AS d, bearing_deg AS b, CAST(seq % 360 AS DOUBLE) AS cur,
      pi() * {R} - distance_km <= 20 AS antip FROM good),
    turns AS (SELECT seq, k, b + 360 * k AS a, abs(b + 360 * k - cur) AS rot FROM aims, (VALUES (-1), (0), (1)) t(k)
      WHERE b + 360 * k BETWEEN {_lo} - 1e-9 AND {_hi} + 1e-9),
    best AS (SELECT seq, arg_min(a, (rot, abs(k), k)) AS a FROM turns GROUP BY seq),
    why AS (SELECT aims.*, best.a, CASE WHEN my_lat IS NULL THEN 'no_station' WHEN lat IS NULL THEN 'no_position'
      WHEN d < 0.01 THEN 'at_station' WHEN antip THEN 'antipode' END AS reason FROM aims LEFT JOIN best ON best.seq = aims.seq)
    SELECT seq, CASE WHEN reason IS NULL THEN round(a, 6) END AS azimuth, CASE WHEN reason IS NULL THEN round(d, 6) END AS aim_km,
      CASE WHEN reason IS NULL AND a IS NULL THEN 'out_of_range' ELSE reason END AS no_aim FROM why"""
)

# --- reference data ------------------------------------------------------------------------------------------

_S = "s_suppkey"
_CONTS = "(['EU','AS','AF','NA','SA','OC','AN'])[CAST(1 + s_nationkey % 7 AS INTEGER)]"
_ENT = f"""ent AS (SELECT {_S} // 50 AS release, {_S} AS k, trim(s_name) AS name, CAST(1 + {_S} % 40 AS INTEGER) AS cq,
  CAST(1 + {_S} % 90 AS INTEGER) AS itu, {_CONTS} AS cont,
  CAST(CAST({_S} * 37 % 181 - 90 AS VARCHAR) || '.25' AS DOUBLE) AS lat,
  0.0 - CAST(CAST({_S} * 53 % 359 - 179 AS VARCHAR) || '.5' AS DOUBLE) AS lon, CAST({_S} % 23 - 11 AS DOUBLE) AS tz,
  {_S} % 10 = 0 AS wae FROM supplier)"""
# an entity whose latitude is out of range (90.25) is broken and left out with its entries
_SOUND = "lat BETWEEN -90 AND 90"
SQL["cty_scan"] = f"""WITH {_ENT} SELECT release, kind, key, coalesce(c, cq) AS cq_zone, coalesce(i, itu) AS itu_zone,
  coalesce(t, cont) AS continent, coalesce(y, lat) AS lat, coalesce(x, lon) AS lon, coalesce(z, tz) AS utc_offset FROM (
  SELECT *, 'P' AS kind, 'S' || k AS key, NULL AS c, NULL AS i, NULL AS t, NULL AS y, NULL AS x, NULL AS z FROM ent
  UNION ALL SELECT *, 'E', 'S' || k || 'A/P', 5, 7, NULL, NULL, NULL, NULL FROM ent
  UNION ALL SELECT *, 'P', 'S' || k || 'B', NULL, NULL, 'AS', 10.5, 20.25, 3.5 FROM ent) u WHERE {_SOUND}"""
_CODE = "CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey + 1 ELSE s_suppkey END % 900 + 1"
_CODES = f"""codes AS (SELECT {_S} // 50 AS release, CASE WHEN {_S} % 10 = 0 THEN '*S' ELSE 'S' END || {_S} AS prefix,
  CAST({_CODE} AS INTEGER) AS dxcc FROM supplier WHERE {_S} % 20 <> 0)"""
SQL["cty_codes"] = f"WITH {_CODES} SELECT release, prefix, dxcc FROM codes"
SQL["cty_entities"] = f"""WITH {_ENT}, {_CODES}, own AS (SELECT e.*, c.dxcc FROM ent e LEFT JOIN codes c ON c.release = e.release
    AND c.prefix = CASE WHEN wae THEN '*S' ELSE 'S' END || k WHERE {_SOUND}),
  parents AS (SELECT release, dxcc, min(name) AS parent FROM own WHERE NOT wae AND dxcc IS NOT NULL
    GROUP BY release, dxcc HAVING count(*) = 1)
  SELECT o.release, 'S' || k AS primary_prefix, name, wae AS wae_only, lon, o.dxcc,
    CASE WHEN wae THEN coalesce(parent, name) ELSE name END AS dxcc_name
  FROM own o LEFT JOIN parents p ON p.release = o.release AND p.dxcc = o.dxcc"""

SQL["cty_refresh"] = f"""WITH {_ENT}, {_CODES}
  SELECT true AS installed, CAST(NULL AS VARCHAR) AS problem, count(*) AS entities, count(c.dxcc) AS with_code, '2026-09-15' AS version
  FROM ent e LEFT JOIN codes c ON c.prefix = CASE WHEN wae THEN '*S' ELSE 'S' END || k WHERE {_SOUND}"""

# --- maintenance -----------------------------------------------------------------------------------------------

SQL["dedup_first"] = with_both(f", {FIRST} SELECT dedup_key, seq, mode FROM first_")
SQL["multi_log_merge"] = with_both(
    f", {FIRST} SELECT band, mode, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM first_ GROUP BY band, mode"
)
SQL["new_only"] = with_log(
    f", {FIRST}, {STORED} SELECT dedup_key, seq FROM first_ WHERE dedup_key NOT IN (SELECT dedup_key FROM stored)", False
)
SQL["known_keys"] = with_log(
    f", {STORED} SELECT DISTINCT dedup_key FROM good WHERE dedup_key IN (SELECT dedup_key FROM stored)", False
)
SQL["qso_insert"] = with_log(
    f", {FIRST} SELECT dedup_key, call, qso_datetime, band, mode, round(distance_km, 6) AS distance_km FROM first_", False
)
SQL["insert_two_batches"] = with_log(
    f""", {FIRST}, {STORED} SELECT dedup_key, call, qso_datetime, band, round(distance_km, 6) AS distance_km, coalesce(distance_km >= {MIN_PATH_KM}, false) AS lined,
      (SELECT count(DISTINCT dedup_key) FROM stored) AS first_inserted,
      (SELECT count(*) FROM first_ WHERE dedup_key NOT IN (SELECT dedup_key FROM stored)) AS inserted,
      (SELECT count(*) FROM good) - (SELECT count(*) FROM first_ WHERE dedup_key NOT IN (SELECT dedup_key FROM stored)) AS duplicates,
      CAST(0 AS BIGINT) AS failed, (SELECT count(*) FROM norm WHERE skip_reason IS NOT NULL) AS skipped FROM first_""",
    False,
)
SQL["import_summary"] = with_both(
    """SELECT (SELECT count(DISTINCT dedup_key) FROM good) AS imported,
    (SELECT count(*) - count(DISTINCT dedup_key) FROM good) AS duplicates,
    count(*) FILTER (skip_reason IS NOT NULL) AS skipped, count(*) FILTER (skip_reason = 'missing_call') AS missing_call,
    count(*) FILTER (skip_reason = 'bad_datetime') AS bad_datetime,
    count(*) FILTER (skip_reason IS NULL AND lat IS NULL) AS without_position,
    count(*) FILTER (skip_reason IS NULL AND my_lat IS NULL) AS without_origin FROM norm""",
    True,
)
SQL["dup_report"] = with_both("SELECT dedup_key, count(*) AS n FROM good GROUP BY dedup_key HAVING count(*) > 1")
SQL["orphan_paths"] = with_log(
    f""", {STORED} SELECT dedup_key, round(distance_km, 6) AS distance_km FROM good WHERE distance_km IS NOT NULL
    AND dedup_key IN (SELECT dedup_key FROM stored) UNION ALL SELECT NULL, 0.0""",
    False,
)
SQL["delete_cascade"] = with_log(
    f""", {FIRST}, left_ AS (SELECT * FROM first_ WHERE mode <> 'CW')
    SELECT 'qso' AS tbl, dedup_key FROM left_
    UNION ALL SELECT 'qso_path', dedup_key FROM left_ WHERE distance_km IS NOT NULL""",
    False,
)
SQL["qso_scan"] = with_log(
    "SELECT dedup_key, call, qso_datetime, band, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS INTEGER) AS cq_zone FROM good",
    False,
)
SQL["schema_evolve"] = with_log(
    """SELECT 'kept' AS my_note, count(*) AS contacts, CAST(0 AS BIGINT) AS with_time, CAST(26 AS BIGINT) AS n_columns FROM good""",
    False,
)


def _recalculated(force: bool) -> str:
    """The stored, hand-edited log derived again for another station."""
    st = q(NEW_STATION)
    follows = "true" if force else "marked"
    # in this log a row is marked exactly when it has neither a locator nor coordinates of its own
    own = "false" if force else "my_real"
    return with_log(f""", edited AS (SELECT * REPLACE (
        CASE WHEN seq % 11 = 0 THEN 'KN05' ELSE gridsquare END AS gridsquare,
        CASE WHEN seq % 13 = 0 AND lat IS NOT NULL THEN lat / 2 ELSE lat END AS lat,
        CASE WHEN seq % 13 = 0 AND lat IS NOT NULL THEN NULL ELSE loc_source END AS loc_source,
        CASE WHEN seq % 19 = 0 THEN NULL ELSE country END AS country) FROM good),
    again AS (SELECT *, {loc_norm('gridsquare')} AS g2, {loc_norm('my_gridsquare')} AS mg2 FROM edited),
    fresh AS (SELECT *, CASE WHEN real_pos THEN 'latlon' WHEN length(g2) > 2 THEN 'grid'
        WHEN m_lat IS NOT NULL AND (g2 IS NULL OR (m_lat BETWEEN {edge('g2', 2, False)} AND {edge('g2', 2, True)}
          AND m_lon BETWEEN {edge('g2', 1, False)} AND {edge('g2', 1, True)})) THEN 'cty'
        WHEN g2 IS NOT NULL THEN 'grid' END AS src2,
      coalesce({follows}, false) AS fol FROM again),
    derived AS (SELECT *, CASE src2 WHEN 'latlon' THEN y WHEN 'grid' THEN {mid_lat('g2')} WHEN 'cty' THEN m_lat END AS lat2,
      CASE src2 WHEN 'latlon' THEN x WHEN 'grid' THEN {mid_lon('g2')} WHEN 'cty' THEN m_lon END AS lon2,
      CASE src2 WHEN 'latlon' THEN 3 WHEN 'grid' THEN 2 WHEN 'cty' THEN 1 ELSE 0 END AS r2,
      CASE loc_source WHEN 'latlon' THEN 3 WHEN 'grid' THEN 2 WHEN 'cty' THEN 1 ELSE 0 END AS r1,
      lat BETWEEN {edge('g2', 2, False)} AND {edge('g2', 2, True)}
        AND lon BETWEEN {edge('g2', 1, False)} AND {edge('g2', 1, True)} AS inside,
      CASE WHEN fol THEN {mid_lat(st)} WHEN {own} THEN my_y ELSE {mid_lat('mg2')} END AS my_lat2,
      CASE WHEN fol THEN {mid_lon(st)} WHEN {own} THEN my_x ELSE {mid_lon('mg2')} END AS my_lon2 FROM fresh),
    decided AS (SELECT *, lat2 IS NOT NULL AND coalesce(CASE WHEN lat IS NULL OR lon IS NULL THEN true WHEN r1 = 0 THEN false
      WHEN r2 > r1 THEN true WHEN loc_source = 'grid' AND src2 = 'cty' THEN length(g2) = 2 AND (NOT inside OR
        (abs(lat - {mid_lat('g2')}) <= 1e-7 AND abs(lon - {mid_lon('g2')}) <= 1e-7))
      WHEN loc_source = 'grid' AND src2 = 'grid' THEN NOT inside ELSE false END, false) AS moved FROM derived),
    final AS (SELECT *, CASE WHEN moved THEN lat2 ELSE lat END AS la, CASE WHEN moved THEN lon2 ELSE lon END AS lo,
      CASE WHEN moved THEN src2 ELSE loc_source END AS ls, CASE WHEN fol THEN {st} ELSE mg2 END AS mg3,
      coalesce(country, dxcc_name) AS c3 FROM decided),
    measured AS (SELECT *, {km('my_lat2', 'my_lon2', 'la', 'lo')} AS d3, {azimuth('my_lat2', 'my_lon2', 'la', 'lo')} AS b3 FROM final)
    SELECT seq, mg3 AS my_gridsquare, c3 AS country, ls AS loc_source, moved,
      moved OR mg3 IS DISTINCT FROM my_gridsquare OR c3 IS DISTINCT FROM country OR ls IS DISTINCT FROM loc_source
        OR (d3 IS NULL) <> (distance_km IS NULL) OR coalesce(abs(d3 - distance_km) > greatest(1e-9 * greatest(d3, distance_km), 1e-9), false)
        OR coalesce(abs(b3 - bearing_deg) > greatest(1e-9 * greatest(b3, bearing_deg), 1e-9), false) AS changed,
      round(la, 6) AS lat, round(lo, 6) AS lon, round(d3, 6) AS distance_km, round(b3, 6) AS bearing_deg, marked FROM measured""")


SQL["recalculate_table"] = with_log(
    f""", {FIRST}, again AS ({_recalculated(False)})
    SELECT f.dedup_key, f.seq, a.my_gridsquare, a.country, a.loc_source, a.lat, a.distance_km,
      CAST(coalesce(a.distance_km >= {MIN_PATH_KM}, false) AS BIGINT) AS n_lines,
      count(*) FILTER (a.changed) OVER () AS changed, CAST(0 AS BIGINT) AS changed_again
    FROM first_ f JOIN again a ON a.seq = f.seq"""
)
SQL["recalculate"] = _recalculated(False)
SQL["recalculate_force"] = _recalculated(True)
SQL["recalc_diff"] = from_raw(
    "SELECT seq, seq % 4 < 2 AS same_number, submode IS NOT DISTINCT FROM mode AS same_text FROM raw"
)
SQL["replace_rule"] = from_raw(
    f"""SELECT seq, coalesce(CASE WHEN seq % 23 = 0 THEN true WHEN o = 0 THEN false WHEN n > o THEN true
      WHEN o = 2 AND n = 1 THEN length(g) = 2 AND (NOT inside OR (abs(y - {mid_lat('g')}) <= 1e-7 AND abs(x - {mid_lon('g')}) <= 1e-7))
      WHEN o = 2 AND n = 2 THEN NOT inside ELSE false END, false) AS replaces
    FROM (SELECT *, y BETWEEN {edge('g', 2, False)} AND {edge('g', 2, True)}
        AND x BETWEEN {edge('g', 1, False)} AND {edge('g', 1, True)} AS inside
      FROM (SELECT seq, 3 - user_id % 3 AS n, CASE seq % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS o,
        {_y} AS y, {_x} AS x, {loc_norm('gridsquare')} AS g FROM raw) t) u"""
)

# --- statistics ------------------------------------------------------------------------------------------------

_BAND = "coalesce(band, '?')"
SQL["share_by_continent_band"] = with_log(
    f"""SELECT coalesce(cont, '?') AS cont, {_BAND} AS band, count(*) AS n,
    round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM good GROUP BY 1, 2"""
)
_ENTITIES = """(SELECT count(DISTINCT code) FROM pairs WHERE code > 0) + (SELECT count(*) FROM (
  SELECT DISTINCT name FROM pairs WHERE code IS NULL AND name <> '' EXCEPT SELECT name FROM pairs WHERE code IS NOT NULL))"""
SQL["stats_summary"] = with_log(
    f""", pairs AS (SELECT DISTINCT dxcc AS code, lower(coalesce(country, '')) AS name FROM good)
    SELECT count(*) AS total, {_ENTITIES} AS dxcc_count, count(DISTINCT call) AS unique_calls,
    count(DISTINCT CASE WHEN regexp_matches(gridsquare, '^{_FOUR}') THEN upper(left(gridsquare, 4)) END) AS grid_count,
    min(qso_datetime) AS first_qso, max(qso_datetime) AS last_qso FROM good"""
)
SQL["live_summary"] = with_log(
    f""", {FIRST}, pairs AS (SELECT DISTINCT dxcc AS code, lower(coalesce(country, '')) AS name FROM first_)
    SELECT count(*) AS total, {_ENTITIES} AS dxcc_count, count(DISTINCT call) AS unique_calls,
    count(DISTINCT CASE WHEN regexp_matches(gridsquare, '^{_FOUR}') THEN upper(left(gridsquare, 4)) END) AS grid_count,
    min(qso_datetime) AS first_qso, max(qso_datetime) AS last_qso, round(max(distance_km), 6) AS longest_km FROM first_"""
)
SQL["dxcc_count"] = with_log(
    f""", pairs AS (SELECT DISTINCT CASE WHEN call < 'K' THEN NULL ELSE dxcc END AS code, lower(coalesce(country, '')) AS name FROM good)
    SELECT {_ENTITIES} AS dxcc_count"""
)
SQL["grid_count"] = with_log(
    f"""SELECT count(DISTINCT CASE WHEN regexp_matches(gridsquare, '^{_FOUR}') THEN upper(left(gridsquare, 4)) END)
    AS grid_count FROM good""",
    False,
)
SQL["by_continent"] = with_log("SELECT coalesce(cont, '?') AS cont, count(*) AS n FROM good GROUP BY 1")
SQL["by_band"] = with_log(f"SELECT {_BAND} AS band, count(*) AS n FROM good GROUP BY 1", False)
SQL["by_mode"] = with_log("SELECT coalesce(nullif(shown, ''), '?') AS mode, count(*) AS n FROM good GROUP BY 1", False)
_SETS = f"""sets AS (SELECT 'continent' AS metric, coalesce(cont, '?') AS key, count(*) AS n FROM good GROUP BY 2
  UNION ALL SELECT 'band', {_BAND}, count(*) FROM good GROUP BY 2
  UNION ALL SELECT 'mode', coalesce(nullif(shown, ''), '?'), count(*) FROM good GROUP BY 2)"""
SQL["stats_grouping_sets"] = with_log(f", {_SETS} SELECT metric, key, n FROM sets")
SQL["stats_share"] = with_log(
    f", {_SETS} SELECT metric, key, n, round(100.0 * n / sum(n) OVER (PARTITION BY metric), 6) AS share FROM sets"
)
SQL["longest_qso"] = with_log(
    """SELECT call, round(distance_km, 6) AS distance_km, country, band, nullif(shown, '') AS mode, qso_datetime FROM good
    WHERE distance_km IS NOT NULL ORDER BY good.distance_km DESC, qso_datetime, seq LIMIT 1"""
)
SQL["polar_hist"] = with_log(
    """SELECT CAST(floor(distance_km / 2500) * 2500 AS INTEGER) AS ring_km, CAST(floor(bearing_deg / 30) * 30 AS INTEGER) AS sector_deg,
    count(*) AS n FROM good WHERE distance_km IS NOT NULL GROUP BY 1, 2"""
)
SQL["grid_coverage"] = with_log(
    f"SELECT {cell('lat', 'lon', 4)} AS locator, count(*) AS n FROM good WHERE lat IS NOT NULL GROUP BY 1"
)
_LEVELS = ((2, -90, -180, 10, 20, 18, 18), (4, -90, -180, 1, 2, 180, 180), (6, 45, 20, 1 / 24, 1 / 12, 12, 12), (8, 45, 20, 1 / 240, 1 / 120, 120, 120))
SQL["grid_hierarchy"] = with_log(", cells AS (" + " UNION ALL ".join(
    f"""SELECT {v} AS level, {cell('y', 'x', v)} AS locator FROM (SELECT {s} + (i + 0.5) * {h!r} AS y, {w} + (j + 0.5) * {d!r} AS x
      FROM range({m}) a(i), range({n}) b(j)) c{v}""" for v, s, w, h, d, m, n in _LEVELS
) + "), worked AS (" + " UNION ALL ".join(
    f"SELECT {v} AS level, {cell('lat', 'lon', v)} AS locator, count(*) AS n FROM good WHERE lat IS NOT NULL GROUP BY 2" for v, *_ in _LEVELS
) + ") SELECT level, locator, coalesce(n, 0) AS n FROM cells LEFT JOIN worked USING (level, locator)")
SQL["latest_qso"] = with_log(
    """SELECT user_id, call, band, shown, country, round(distance_km, 6) AS distance_km FROM good
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY qso_datetime DESC, seq DESC) = 1"""
)
SQL["bounding_arc"] = from_raw(
    f"""SELECT user_id, lat_min, lat_max, round(CASE WHEN best.gap > wrap OR (best.gap = wrap) THEN best.s ELSE w END, 6) AS lon_min,
      round(CASE WHEN best.gap >= wrap THEN best.p + 360 ELSE e END, 6) AS lon_max
    FROM (SELECT user_id, round(min(y), 6) AS lat_min, round(max(y), 6) AS lat_max, min(x) AS w, max(x) AS e,
        min(x) + 360 - max(x) AS wrap, max({{'gap': x - p, 's': x, 'p': p}}) FILTER (p IS NOT NULL) AS best
      FROM (SELECT user_id, {_y} AS y, {_x} AS x, lag({_x}) OVER (PARTITION BY user_id ORDER BY {_x}) AS p FROM raw) t
      GROUP BY user_id) u"""
)

# --- grids and lines --------------------------------------------------------------------------------------------

SQL["locator_points"] = from_raw(
    f"""SELECT seq, pos, token, loc AS locator, CAST(length(loc) AS INTEGER) AS precision, round({mid_lat('loc')}, 9) AS lat,
      round({mid_lon('loc')}, 9) AS lon, CASE WHEN loc IS NULL THEN 'invalid' WHEN length(token) > length(loc) THEN 'cut' END AS note
    FROM (SELECT *, {loc_norm('token')} AS loc FROM (SELECT seq, unnest(list) AS token,
      CAST(unnest(range(len(list))) AS INTEGER) AS pos FROM (SELECT seq, CASE WHEN gridsquare IS NULL
        THEN [loc6, 'KN04ft', 'QF56OD51', 'nowhere'] ELSE [loc6, gridsquare, 'KN04ft', 'QF56OD51', 'nowhere'] END AS list FROM raw) a) b) c"""
)


def _parts(dlat: float, dlon: str) -> str:
    w, e = _x, f"({_x} + {dlon})"
    return f"""parts AS (SELECT seq, 1 AS part, {_y} AS south, least({_y} + {dlat}, 90) AS north,
      CASE WHEN {dlon} >= 360 THEN -180.0 ELSE {w} END AS west, CASE WHEN {dlon} >= 360 THEN 180.0 ELSE least({e}, 180.0) END AS east FROM raw
      UNION ALL SELECT seq, 2, {_y}, least({_y} + {dlat}, 90), -180.0, {e} - 360 FROM raw WHERE {dlon} < 360 AND {e} > 180)"""


SQL["split_extent"] = (
    f"WITH {RAW}, {_parts(10.0, '(CASE WHEN seq % 50 = 0 THEN 400 ELSE 40 END)')} "
    "SELECT seq, part, round(south, 6) AS south, round(west, 6) AS west, round(north, 6) AS north, round(east, 6) AS east FROM parts"
)
_g = [*axis_range("south", "north", 90, 240, 240), *axis_range("west", "east", 180, 120, 240)]
SQL["grid_cells"] = (
    f"""WITH {RAW}, {_parts(1.5, '3.0')}, boxes AS (SELECT seq, part, {_g[0]} AS r0, {_g[1]} AS r1, {_g[2]} AS c0, {_g[3]} AS c1 FROM parts),
    rows_ AS (SELECT seq, part, c0, c1, unnest(range(r0, r1)) AS r FROM boxes),
    cells AS (SELECT seq, part, r, unnest(range(c0, c1)) AS c FROM rows_)
    SELECT seq, part, chr(CAST(65 + c // 10 AS INTEGER)) || chr(CAST(65 + r // 10 AS INTEGER)) || c % 10 || r % 10 AS locator,
      CAST(r - 90 AS DOUBLE) AS lat_min, CAST(2 * c - 180 AS DOUBLE) AS lon_min, CAST(r - 89 AS DOUBLE) AS lat_max,
      CAST(2 * c - 178 AS DOUBLE) AS lon_max FROM cells"""
)
_PAIRS = f"""pairs AS (SELECT seq, {_y} AS y1, {_x} AS x1, (seq * 3571 % 17001 - 8500) / 100.0 AS y2,
  (seq * 15485863 % 35999 - 18000) / 100.0 AS x2 FROM raw),
far AS (SELECT *, {km('y1', 'x1', 'y2', 'x2')} AS d, pi() * {R} - {km('y1', 'x1', 'y2', 'x2')} <= 20 AS antip FROM pairs)"""
SQL["great_circle"] = (
    f"""WITH {RAW}, {_PAIRS}, t AS (SELECT *, abs(x2 - x1) > 180 AND abs(x1) <> 180 AND abs(x2) <> 180 AS crosses FROM far)
    SELECT seq, CAST(CASE WHEN antip THEN 0 WHEN crosses THEN 2 ELSE 1 END AS BIGINT) AS n_parts,
      CAST(CASE WHEN antip THEN 0 WHEN d < 1e-8 THEN 1 ELSE greatest(ceil(d / 100), 1) + 1 + CASE WHEN crosses THEN 2 ELSE 0 END END
        AS BIGINT) AS n_points, CASE WHEN antip THEN 0 ELSE round(d, 3) END AS km FROM t"""
)
SQL["long_path_line"] = (
    f"WITH {RAW}, {_PAIRS} SELECT seq, CASE WHEN antip OR d < 0.01 THEN 0 ELSE round(2 * pi() * {R} - d, 3) END AS km FROM far"
)
SQL["qso_path"] = with_log(
    f""", {FIRST} SELECT dedup_key, band, nullif(shown, '') AS mode, round(distance_km, 6) AS distance_km,
    round(distance_km, 3) AS km FROM first_ WHERE distance_km >= 0.001 AND pi() * {R} - distance_km > 20"""
)


def _side(a: str, b: str) -> str:
    """Longitude as written: a start or end on the antimeridian takes the side of the path."""
    return (
        f"CASE WHEN abs({a}) <> 180 THEN {a} WHEN {b} > 0 THEN 180.0 WHEN {b} < 0 THEN -180.0 ELSE {a} END"
    )


SQL["path_wkt"] = with_log(
    f"""SELECT seq, 'POINT (' || printf('%.6f', lon) || ' ' || printf('%.6f', lat) || ')' AS point,
      CASE WHEN line THEN printf('%.6f', my_lon) || ' ' || printf('%.6f', my_lat) END AS first,
      CASE WHEN line THEN printf('%.6f', {_side('lon', 'my_lon')}) || ' ' || printf('%.6f', lat) END AS last
    FROM (SELECT *, pi() * {R} - distance_km > 20 AS line FROM good WHERE lat IS NOT NULL) t"""
)
_ry, _rx = dest("lat", "lon", "CASE kind WHEN 'ring' THEN 0.0 ELSE value END", "CASE kind WHEN 'ring' THEN value ELSE 0.0 END")
SQL["ring_lines"] = from_raw(
    f""", centres AS (SELECT user_id, {mid_lat('loc')} AS lat, {mid_lon('loc')} AS lon
      FROM (SELECT user_id, arg_min(loc6, seq) AS loc FROM raw GROUP BY user_id) t),
    lines AS (SELECT *, 'ring' AS kind, CAST(unnest(range(2500, 20001, 2500)) AS DOUBLE) AS value FROM centres
      UNION ALL SELECT *, 'azimuth', CAST(unnest(range(0, 331, 30)) AS DOUBLE) FROM centres),
    ends AS (SELECT *, {_ry} AS y, {_rx} AS x FROM lines)
    SELECT user_id, kind, value, CAST(CAST(value AS INTEGER) AS VARCHAR) || CASE kind WHEN 'ring' THEN ' km' ELSE '°' END AS label,
      CAST(CASE kind WHEN 'ring' THEN 361 ELSE 9 END AS BIGINT) AS n_points,
      printf('%.6f', CASE WHEN abs(y - lat) < 1e-9 OR kind = 'azimuth' THEN lon
        WHEN lat + value / {R} * 180 / pi() > 90 THEN CASE WHEN lon > 0 THEN lon - 180 ELSE lon + 180 END ELSE lon END)
        || ' ' || printf('%.6f', y) AS first FROM ends"""
)

# --- log files and live feed -----------------------------------------------------------------------------------------


def record_text() -> str:
    fields = ", ".join(
        f"'<{n}:' || length({c}) || '>' || {c}" for n, c in ADIF_COLUMNS.items()
    )
    return f"concat_ws(' ', {fields}, '<EOR>')"


_FIELDS = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in ADIF_COLUMNS.values())
_HEADER_SIZE = len("Contact log export\n<ADIF_VER:5>3.1.4\n<PROGRAMID:6>skylog\n<EOH>\n")
SQL["adif_export"] = from_raw(f"SELECT seq, {record_text()} AS line FROM raw")
SQL["adif_scan"] = from_raw(
    f"""SELECT CAST(seq // 500 AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY seq // 500 ORDER BY seq) AS INTEGER) AS record_no,
    CAST({_FIELDS} AS INTEGER) AS n_fields, 0 AS n_warnings, call_ AS call, qso_date, time_on, trim(freq) AS freq, trim(band) AS band,
    lat, comment FROM raw"""
)
SQL["adif_scan_large"] = from_raw(
    f"""SELECT CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS record_no,
    CAST({_FIELDS} AS INTEGER) AS n_fields, 0 AS n_warnings, call_ AS call, qso_date, time_on, trim(freq) AS freq, trim(band) AS band,
    lat, comment FROM raw"""
)
SQL["import_report"] = with_log(
    f""", {_warnings()}, docs AS (SELECT seq // 6000 AS doc, CAST({_HEADER_SIZE} + sum(length({record_text()}) + 1) AS BIGINT) AS size FROM raw GROUP BY 1),
    numbered AS (SELECT seq, seq // 6000 AS doc, CAST(row_number() OVER (PARTITION BY seq // 6000 ORDER BY seq) AS INTEGER) AS record_no FROM raw),
    told AS (SELECT n.doc, record_no, CASE WHEN code IN ('missing_call', 'bad_datetime') THEN 'skipped' ELSE 'record' END AS stage,
        code, field, value, place FROM w JOIN numbered n ON n.seq = w.seq JOIN docs d ON d.doc = n.doc AND d.size <= 1048576
      UNION ALL SELECT doc, 0, 'file', 'too_large', NULL, NULL, 0 FROM docs WHERE size > 1048576),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY record_no, place) AS INTEGER) AS rank,
      count(*) OVER (PARTITION BY doc) AS total FROM told)
    SELECT CAST(doc AS VARCHAR) AS file, record_no, stage, code, field, value, rank, greatest(total - 100, 0) AS further
    FROM ranked WHERE rank <= 100"""
)
SQL["adif_admission"] = from_raw(
    f"""SELECT CAST(doc AS VARCHAR) AS file, size AS length, n AS n_eor, CASE WHEN size > 1048576 THEN 'too_large'
      WHEN n > 10000 THEN 'too_many_records' END AS reject_reason FROM (SELECT seq // 5000 AS doc, count(*) AS n,
      CAST({_HEADER_SIZE} + sum(length({record_text()}) + 1) AS BIGINT) AS size FROM raw GROUP BY 1) t"""
)
_CLIENT = "'rig' || CAST(user_id % 20 AS VARCHAR)"
SQL["wsjtx_decode"] = from_raw(
    f"""SELECT seq, CASE event_type WHEN 'view' THEN 'status' WHEN 'click' THEN 'logged_adif' WHEN 'purchase' THEN 'heartbeat'
      WHEN 'signup' THEN 'close' END AS type, CASE WHEN event_type <> 'error' THEN {_CLIENT} END AS client,
    CASE event_type WHEN 'view' THEN mode END AS mode, CASE event_type WHEN 'view' THEN call_ END AS dx_call,
    CASE event_type WHEN 'view' THEN rst_sent END AS report, CASE event_type WHEN 'purchase' THEN '2.7.0' END AS version,
    CASE event_type WHEN 'click' THEN {record_text()} END AS adif,
    CAST(CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 2 ELSE 3 END AS BIGINT) AS schema,
    CASE event_type WHEN 'view' THEN 1000000 + seq * 7 % 50000000 END AS freq_hz FROM raw"""
)
SQL["latest_status"] = from_raw(
    f"""SELECT client, freq_hz, mode, call_ AS dx_call, {band('(freq_hz / 1e6)')} AS band FROM (
      SELECT {_CLIENT} AS client, 1000000 + seq * 7 % 50000000 AS freq_hz, mode, call_, ts FROM raw WHERE event_type = 'view') t
    QUALIFY row_number() OVER (PARTITION BY client ORDER BY ts DESC) = 1"""
)
_FEED = """feed AS (SELECT seq, ts, event_type AS client, call_ AS adif, user_id FROM raw UNION ALL
  SELECT seq + 1000000000000, ts + INTERVAL '1500 milliseconds', event_type, call_, user_id FROM raw)"""
SQL["replay_dedup"] = from_raw(
    f""", {_FEED}, w AS (SELECT *, lag(client) OVER o AS c, lag(adif) OVER o AS a, lag(ts) OVER o AS t FROM feed
      WINDOW o AS (ORDER BY ts, seq))
    SELECT seq, client, adif FROM w WHERE NOT coalesce(c = client AND a = adif AND ts - t < INTERVAL '2 seconds', false)"""
)
SQL["client_sessions"] = from_raw(
    f""", {_FEED}, m AS (SELECT client, ts, user_id % 10 = 0 AS bye FROM feed),
    flagged AS (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR ts - lag(ts) OVER o > INTERVAL '45 seconds' OR lag(bye) OVER o
      THEN 1 ELSE 0 END AS fresh FROM m WINDOW o AS (PARTITION BY client ORDER BY ts, bye)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY ts, bye ROWS UNBOUNDED PRECEDING) AS s FROM flagged)
    SELECT client, min(ts) AS first_seen, max(ts) FILTER (NOT bye) AS last_seen, count(*) FILTER (NOT bye) AS messages,
      CASE WHEN bool_or(bye) THEN 'close' ELSE 'timeout' END AS ended_by
    FROM numbered GROUP BY client, s HAVING count(*) FILTER (NOT bye) > 0"""
)
SQL["live_dedup"] = from_raw(f"SELECT DISTINCT {_CLIENT} AS client, {record_text()} AS adif FROM raw")
SQL["live_insert"] = with_log(
    f""", {FIRST} SELECT dedup_key, call, qso_datetime, band, 'wsjtx' AS source, round(distance_km, 6) AS distance_km FROM first_""",
    False,
)
SQL["live_stats"] = with_log(
    f""", {FIRST}, {_SETS.replace('FROM good', 'FROM first_')} SELECT metric, key, n FROM sets""", False
)
SQL["adif_stream"] = with_log(f", {FIRST} SELECT dedup_key, call, qso_datetime, band FROM first_", False)

assert STATION_MARK.startswith("APP_")

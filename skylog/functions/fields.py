"""Log field values as typed columns. Bad text gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import modes
from .bands import clean_band
from .text import WS, col, collapse, decimal_text, reused, strip, upper_filled

# Continents, in report order.
CONTINENTS = ["EU", "AS", "AF", "NA", "SA", "OC", "AN"]
# Fields with a column of their own; every other field goes to adif_extra.
MAPPED_FIELDS = [
    "CALL", "QSO_DATE", "TIME_ON", "BAND", "MODE", "SUBMODE", "FREQ", "RST_SENT", "RST_RCVD", "GRIDSQUARE",
    "MY_GRIDSQUARE", "DXCC", "COUNTRY", "CONT", "CQZ", "ITUZ",
]

_LATLON = rf"^[{WS}]*([NSEWnsew])[{WS}]*([0-9]{{1,3}})[{WS}]+([0-9]{{1,2}}(?:[.,][0-9]*)?)[{WS}]*\z"
_MHZ = rf"^[{WS}]*\+?([0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)[{WS}]*\z"
_ISO_DAY = "[0-9]{4}(?:-[0-9]{2}-[0-9]{2}|[0-9]{4})"
_ISO_CLOCK = "[0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?|[0-9]{2}(?:[0-9]{2}(?:[.,][0-9]+)?)?)"
_ISO = rf"^{_ISO_DAY}(?:[Tt ]{_ISO_CLOCK}(?:[Zz]|[+-][0-9]{{2}}(?::?[0-9]{{2}})?)?)?\z"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


@reused
def parse_latlon(value: Column | str, hemispheres: str = "NSEW") -> Column:
    """``XDDD MM.MMM`` in signed degrees; ``hemispheres`` are the letters allowed."""
    text = col(value)
    letter = F.upper(F.regexp_extract(text, _LATLON, 1))
    minutes = decimal_text(F.regexp_extract(text, _LATLON, 3))
    degrees = F.regexp_extract(text, _LATLON, 2).try_cast("int") + minutes / 60.0
    limit = F.when(letter.isin("N", "S"), 90.0).otherwise(180.0)
    ok = letter.isin(*hemispheres) & (minutes < 60.0) & (degrees <= limit)
    sign = F.when(letter.isin("S", "W") & (degrees > 0.0), -1.0).otherwise(1.0)
    return F.when(ok, sign * degrees)


@reused
def parse_freq(value: Column | str) -> Column:
    """MHz, comma or point; zero, negative and non-finite values are NULL."""
    mhz = decimal_text(F.nullif(F.regexp_extract(col(value), _MHZ, 1), F.lit("")))
    return F.when((mhz > 0.0) & (mhz < float("inf")), mhz)


@reused
def parse_qso_time(date: Column | str, time: Column | str) -> Column:
    """``YYYYMMDD`` and ``HHMM[SS]`` as a UTC wall-clock timestamp (no time zone)."""
    d, t = strip(date), strip(time)

    def part(text: Column, start: int, size: int) -> Column:
        return F.substring(text, start, size).try_cast("int")

    year, hour, minute = part(d, 1, 4), part(t, 1, 2), part(t, 3, 2)
    second = F.when(F.char_length(t) == 6, part(t, 5, 2)).otherwise(0)
    ok = d.rlike(r"^[0-9]{8}\z") & t.rlike(r"^[0-9]{4}(?:[0-9]{2})?\z")
    ok = ok & (year >= 1930) & (hour < 24) & (minute < 60) & (second < 60)
    when = F.try_make_timestamp_ntz(
        year, part(d, 5, 2), part(d, 7, 2), hour, minute, second.cast("decimal(8,6)")
    )
    return F.when(ok, when)


@reused
def dedup_key(
    call: Column | str, when: Column | str, band: Column | str, mode: Column | str,
    submode: Column | str, clean: bool = False,
) -> Column:
    """``CALL|YYYYMMDDHHMM|band|MODE``: one value per contact, seconds dropped.

    ``clean`` says that the texts went through the normaliser already.
    """
    return F.concat_ws(
        "|",
        F.coalesce(col(call) if clean else upper_filled(call), F.lit("")),
        F.coalesce(F.date_format(when, "yyyyMMddHHmm"), F.lit("")),
        F.coalesce(col(band) if clean else clean_band(band), F.lit("")),
        modes.dedup_mode(mode, submode, clean),
    )


@reused
def parse_iso(value: Column | str) -> Column:
    """ISO 8601 text (extended or basic, offset, comma fraction, date alone) in UTC."""
    text = strip(value)
    dashed = F.substring(text, 5, 1) == "-"
    day = F.when(dashed, F.replace(F.left(text, F.lit(10)), F.lit("-"), F.lit(""))).otherwise(
        F.left(text, F.lit(8))
    )
    rest = F.when(dashed, F.substring(text, F.lit(12), F.length(text))).otherwise(
        F.substring(text, F.lit(10), F.length(text))
    )
    clock = F.split_part(F.regexp_replace(rest, "[Zz+-]", "|"), F.lit("|"), F.lit(1))
    pieces = F.replace(clock, F.lit(","), F.lit("."))
    digits = F.replace(F.split_part(pieces, F.lit("."), F.lit(1)), F.lit(":"), F.lit(""))
    fraction = F.rpad(F.left(F.split_part(pieces, F.lit("."), F.lit(2)), F.lit(6)), 6, "0")

    def number(source: Column, start: int, size: int) -> Column:
        return F.coalesce(F.substring(source, start, size).try_cast("int"), F.lit(0))

    hour, minute, second = number(digits, 1, 2), number(digits, 3, 2), number(digits, 5, 2)
    offset = F.replace(F.regexp_extract(rest, r"[+-]([0-9:]+)\z", 1), F.lit(":"), F.lit(""))
    off_h, off_m = number(offset, 1, 2), number(offset, 3, 2)
    sign = F.when(F.contains(rest, F.lit("-")), -1).otherwise(1)
    micros = F.coalesce(fraction.try_cast("int"), F.lit(0))
    seconds = (second + micros / F.lit(1000000)).cast("decimal(8,6)")
    ok = text.rlike(_ISO) & (hour < 24) & (minute < 60) & (second < 60)
    ok = ok & (off_h < 24) & (off_m < 60)
    local = F.try_make_timestamp_ntz(
        number(day, 1, 4), number(day, 5, 2), number(day, 7, 2), hour, minute, seconds
    )
    shift = F.make_dt_interval(F.lit(0), sign * off_h, sign * off_m, F.lit(0))
    return F.when(ok, local - shift)


@reused
def bounded_int(value: Column | str, low: int, high: int) -> Column:
    """One to six ASCII digits within the bounds, else NULL."""
    text = strip(value)
    number = F.when(text.rlike(r"^[0-9]{1,6}\z"), text.try_cast("int"))
    return F.when(number.between(low, high), number)


@reused
def continent(value: Column | str) -> Column:
    name = upper_filled(value)
    return F.when(name.isin(CONTINENTS), name)


@reused
def coerce_real(value: Column | str) -> Column:
    """Number text as a finite double, else NULL."""
    text = strip(value)
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


@reused
def coerce_code(value: Column | str) -> Column:
    """Entity code: an integral number >= 0, also written as ``296.0``."""
    number = coerce_real(value)
    whole = (number == F.floor(number)) & number.between(0.0, 9.2e18)
    return F.when(whole, number.cast("long"))


@reused
def coerce_int32(value: Column | str) -> Column:
    """Integer text in the 32-bit range, else NULL."""
    text = strip(value)
    return F.when(text.rlike(r"^[+-]*[0-9]+\z"), text.try_cast("int"))


def country_key(value: Column | str) -> Column:
    """Country name for comparison; '' when missing."""
    return F.coalesce(F.lower(collapse(value)), F.lit(""))


def json_object(fields: Column) -> Column:
    """JSON text of a string map with sorted keys, non-ASCII kept; '{}' when empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(fields, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.map_from_entries(entries))


def extra_fields(fields: Column) -> Column:
    """The fields that have no column of their own."""
    return F.map_filter(fields, lambda name, _: ~name.isin(MAPPED_FIELDS))


@reused
def is_position(lat: Column | str, lon: Column | str) -> Column:
    """Both coordinates are known and they are not the placeholder 0/0."""
    y, x = col(lat), col(lon)
    return y.isNotNull() & x.isNotNull() & ~((y == 0.0) & (x == 0.0))

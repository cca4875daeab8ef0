"""Text helpers shared by the column builders."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of Unicode white space, which log values are stripped of (Spark's
# own trim knows only the blank).
SPACES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
SPACES += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITESPACE = "".join(map(chr, SPACES))
# The same set as the body of a Java character class.
WS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def reused(build: Callable) -> Callable:
    """Builds a column once per set of plain arguments.

    A column is an unbound expression, so one object serves any number of frames; building it
    costs a call into the JVM per node. Calls with column arguments are passed through.
    """
    built: dict = {}

    @wraps(build)
    def get(*args, **options):
        if any(isinstance(a, Column) for a in (*args, *options.values())):
            return build(*args, **options)
        context = SparkContext._active_spark_context
        key = (id(context._jvm) if context else None, args, tuple(sorted(options.items())))
        if key not in built:
            built[key] = build(*args, **options)
        return built[key]

    return get


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@reused
def strip(value: Column | str) -> Column:
    return F.trim(col(value), F.lit(WHITESPACE))


@reused
def filled(value: Column | str) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(value), F.lit(""))


@reused
def upper_filled(value: Column | str) -> Column:
    return F.upper(filled(value))


def collapse(value: Column | str) -> Column:
    """White space runs become one space, ends stripped."""
    return F.trim(F.regexp_replace(col(value), f"[{WS}]+", " "))


def shown(value: Column | str, length: int = 40) -> Column:
    """A value as a report quotes it: one line, at most ``length`` characters."""
    line = collapse(value)
    return F.when(
        F.char_length(line) > length, F.concat(F.left(line, F.lit(length - 1)), F.lit("…"))
    ).otherwise(line)


def decimal_text(value: Column) -> Column:
    """Number text with a decimal comma or point, as a double (NULL when it is none)."""
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")

"""ADIF logs: scan, admission check, export.

A file is one row of the ``binaryFile`` source, so the scan is parallel over files. The reader below goes through the
text of a file once, from left to right, keeps no list of its tags and hands records on in batches. Large files are read
in many tasks by :mod:`.adif_blocks`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col

RECORD_SCHEMA = (
    "file string, record_no int, fields map<string,string>, "
    "warnings array<struct<code:string,field:string,value:string>>"
)
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
MB = 1024 * 1024
RECORDS_PER_MB = 10_000
_ROWS_PER_BATCH = 2_000
FIELDS = pa.map_(pa.string(), pa.string())
NOTES = pa.list_(pa.struct([("code", pa.string()), ("field", pa.string()), ("value", pa.string())]))

# Header fields, fields that every contact has, end marks.
_HEADER_NAMES = ("ADIF_VER", "CREATED_TIMESTAMP", "PROGRAMID", "PROGRAMVERSION")
_CONTACT_NAMES = ("CALL", "QSO_DATE", "TIME_ON")
_MARKS = ("EOR", "EOH")

_ANGLES = re.compile(r"<([^<>\r\n]*)>")
_BLANKS = re.compile(r"\s*")
_NOT_IN_NAMES = frozenset(",:<>{}")


def is_standard_name(name: str) -> bool:
    """ASCII letters, digits, underscores and hyphens, no hyphen in front."""
    return name.isascii() and name[:1] != "-" and name.replace("_", "a").replace("-", "a").isalnum()


def is_free_name(name: str) -> bool:
    """A user-defined name: any text without list and tag punctuation, control characters and blanks at its ends."""
    plain = name.strip() == name != ""
    return plain and not any(c in _NOT_IN_NAMES or unicodedata.category(c) == "Cc" for c in name)


class Token(NamedTuple):
    """A field with its value, an end mark, or something to report. ``mark``: EOR, EOH or None."""

    name: str | None
    value: str | None = None
    code: str | None = None
    mark: str | None = None


def decode_text(data: bytes) -> tuple[str, bool]:
    """Text of a file and whether it had to be read as Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace"), False
    try:
        return data.decode("utf-8-sig"), False
    except UnicodeDecodeError:
        return data.removeprefix(b"\xef\xbb\xbf").decode("latin-1"), True


class Tag(NamedTuple):
    """What stands in angle brackets: a name, the digits of its length (None without one) and the end; or a ``bad`` length."""

    name: str
    digits: str | None
    end: int
    bad: bool = False


def _tag_at(text: str, at: int) -> Tag | None:
    """The tag at ``at``. A free name counts only with a length; a web address in brackets is no tag."""
    m = _ANGLES.match(text, at)
    if m is None:
        return None
    name, colon, size = m[1].partition(":")
    digits, _, kind = size.partition(":")
    standard = is_standard_name(name)
    if not colon:
        return Tag(name.upper(), None, m.end()) if standard else None
    sound = digits.isascii() and digits.isdigit() and (not kind or (kind.isascii() and kind.isalpha()))
    if sound and (standard or is_free_name(name)):
        return Tag(name.upper(), digits, m.end())
    return Tag(m[0], None, m.end(), True) if standard and not size.startswith("//") else None


def _settled(text: str, at: int) -> bool:
    """Whether a value may end here: what follows, blanks aside, is a tag, the end, or (after a blank) a comment."""
    follows = _BLANKS.match(text, at).end()
    if follows == len(text) or _tag_at(text, follows) is not None:
        return True
    return follows > at and text.startswith("//", follows)


def _next_tag(text: str, at: int, stop: int) -> tuple[int, str] | None:
    """(place, name) of the first tag with a length, or end mark, that starts in [at, stop)."""
    while (at := text.find("<", at, stop)) >= 0:
        tag = _tag_at(text, at)
        if tag and not tag.bad and (tag.digits is not None or tag.name in _MARKS):
            return at, tag.name
        at += 1
    return None


def _read(text: str, at: int, digits: str, in_header: bool) -> tuple[int, str | None]:
    """(end of the value that starts at ``at``, warning). The length is tried in characters, then in bytes."""
    digits = digits.lstrip("0") or "0"
    length = int(digits) if len(digits) < 16 else len(text) + 1
    stop = at + length
    inner = _next_tag(text, at, min(stop, len(text)))
    if inner or stop > len(text):
        # the length may count bytes: then the value ends before the tag that it would swallow
        room = text[at : inner[0] if inner else len(text)].encode("utf-8", "surrogatepass")
        if length < len(room):
            piece = room[:length].decode("utf-8", "ignore")
            whole = len(piece.encode("utf-8", "surrogatepass")) == length
            if whole and len(piece) < length and _settled(text, at + len(piece)):
                return at + len(piece), "byte_length"
        elif length == len(room) and len(room) > (inner[0] if inner else len(text)) - at:
            return inner[0] if inner else len(text), "byte_length"
    if stop <= len(text) and _settled(text, stop):
        return stop, None
    if in_header and inner and inner[1] == "EOH":
        return inner[0], "past_end"  # the header's end is worth more than a wrong length
    return (len(text), "past_end") if stop > len(text) else (stop, "length_mismatch")


class Watch:
    """What a reader of a part of a log notes: where its last record end was, whether a value wanted more than the part."""

    end = 0
    over = False


def tokens(text: str, in_header: bool = True, watch: Watch | None = None) -> Iterator[Token]:
    """Fields, marks and reports of a log from left to right."""
    at, watch = 0, watch or Watch()
    while (at := text.find("<", at)) >= 0:
        tag = _tag_at(text, at)
        if tag is None or tag.bad:
            if tag:
                yield Token(None, tag.name, "bad_tag")
            at = tag.end if tag else at + 1
            continue
        name, digits, start, _ = tag
        if name in _MARKS:
            in_header = False
            if name == "EOR":
                watch.end = start
            yield Token(name, mark=name)
            at = start
        elif digits is None:
            if not name.startswith("APP_"):
                yield Token(name, code="no_length")
            at = start
        else:
            watch.over |= len(digits.lstrip("0")) > 15 or int(digits) > len(text) - start
            stop, code = _read(text, start, digits, in_header)
            free = not is_standard_name(name)
            if free and (code not in (None, "byte_length") or _next_tag(text, start, stop)):
                at += 1  # angle brackets in running text, no user-defined field
                continue
            yield Token(name, text[start:stop].strip(), code)
            at = stop


def _is_header(name: str) -> bool:
    return name in _HEADER_NAMES or (name.startswith("USERDEF") and name[7:].isdigit())


class LogReader:
    """Puts tokens together to records; ``feed`` gives finished records as (number, fields, warnings)."""

    def __init__(self, number: int = 1):
        self.number, self.headed = number, False
        self.header: dict[str, str] = {}
        self.header_notes: list[tuple] = []
        self.current: dict[str, str] = {}
        self.notes: list[tuple] = []

    def _finish(self) -> tuple[int, dict, list]:
        done = self.number, self.current, self.notes
        self.current, self.notes, self.number = {}, [], self.number + 1
        return done

    def feed(self, stream: Iterator[Token]) -> Iterator[tuple[int, dict, list]]:
        for token in stream:
            if token.mark == "EOR":
                mentioned = self.number == 1 and not self.headed and all(map(_is_header, self.current))
                if self.current and not mentioned:
                    yield self._finish()
            elif token.mark == "EOH":
                contact = any(name in self.current for name in _CONTACT_NAMES)
                if self.number == 1 and not self.headed and not contact:
                    self.header, self.headed = self.current, True
                    # what the free text before the header's end looks like is no one's fault
                    self.header_notes += [n for n in self.notes if n[0] not in ("bad_tag", "no_length")]
                    self.current, self.notes = {}, []
                elif self.current:
                    # a second file was joined on: its header, or a contact that lost its end
                    self.notes.append(("missing_eor" if contact else "second_header", None, None))
                    for name in [n for n in self.current if _is_header(n) or not contact]:
                        self.header.setdefault(name, self.current.pop(name))
                    if self.current:
                        yield self._finish()
            elif token.code in ("bad_tag", "no_length"):
                self.notes.append((token.code, token.name, token.value))
            else:
                if token.code:
                    self.notes.append((token.code, token.name, None))
                if token.name in self.current:
                    self.notes.append(("duplicate_field", token.name, None))
                self.current[token.name] = token.value

    def rest(self) -> Iterator[tuple[int, dict | None, list]]:
        """What is left at the end of a log."""
        if self.current:
            self.notes.append(("missing_eor", None, None))
            yield self._finish()
        elif self.notes:
            yield self.number, None, self.notes


def parse_text(text: str, latin1: bool = False) -> Iterator[tuple[int, dict | None, list]]:
    """Records of a log as ``(record_no, fields, warnings)``; number 0 is the header.

    Never raises on content. Warnings behind the last record come with ``fields`` None.
    """
    reader = LogReader()
    if latin1:
        reader.header_notes.append(("read_as_latin1", None, None))
    yield from reader.feed(tokens(text))
    yield from reader.rest()
    yield 0, reader.header, reader.header_notes


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    files, numbers, fields, notes = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(files, pa.string()),
            pa.array(numbers, pa.int32()),
            pa.array([None if f is None else list(f.items()) for f in fields], FIELDS),
            pa.array([[dict(zip(("code", "field", "value"), n)) for n in ns] for ns in notes], NOTES),
        ],
        names=["file", "record_no", "fields", "warnings"],
    )


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1)):  # one file at a time
            name = file.as_py()
            for record in parse_text(*decode_text(content.as_py() or b"")):
                rows.append((name, *record))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield _batch(rows)
                    rows = []
    if rows:
        yield _batch(rows)


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Log files as rows ``(path, modificationTime, length, content)``."""
    return spark.read.format("binaryFile").load(paths)


def admission(files: DataFrame, limit_mb: int | None = None) -> DataFrame:
    """Adds ``n_eor`` (end tags, an upper bound of the records) and ``reject_reason``.

    Nothing is refused unless the caller gives a limit.
    """
    counted = F.regexp_count(
        F.decode("content", "ISO-8859-1"), F.lit("(?i)<eor[>:]")
    ).cast("long")
    reason = F.lit(None).cast("string")
    if limit_mb is not None:
        reason = F.when(F.col("length") > limit_mb * MB, "too_large").when(
            F.col("n_eor") > limit_mb * RECORDS_PER_MB, "too_many_records"
        )
    return files.withColumn("n_eor", counted).withColumn("reject_reason", reason)


def refused(files: DataFrame, limit_mb: int | None = None) -> DataFrame:
    """``(file, length, n_eor, reject_reason)`` of the files that a limit keeps out."""
    return admission(files, limit_mb).where("reject_reason IS NOT NULL").select(
        F.col("path").alias("file"), "length", "n_eor", "reject_reason"
    )


def parse_documents(documents: DataFrame) -> DataFrame:
    """``(file, content BINARY)`` -> :data:`RECORD_SCHEMA`, for batch and streaming frames."""
    return documents.select("file", "content").mapInArrow(_parse_batches, RECORD_SCHEMA)


def parse_files(files: DataFrame, limit_mb: int | None = None) -> DataFrame:
    """Records, headers and warnings of files; a refused file is one row, number 0, with its reason.

    Only the name of a refused file goes on to the reader, so its content is never parsed.
    """
    if limit_mb is None:
        return parse_documents(files.select(F.col("path").alias("file"), "content"))
    checked = admission(files, limit_mb)
    named = F.when(F.col("reject_reason").isNull(), F.col("content"))
    parsed = parse_documents(checked.where("reject_reason IS NULL").select(F.col("path").alias("file"), named.alias("content")))
    out = checked.where("reject_reason IS NOT NULL").select(
        F.col("path").alias("file"),
        F.lit(0).alias("record_no"),
        F.lit(None).cast("map<string,string>").alias("fields"),
        F.array(
            F.struct(F.col("reject_reason").alias("code"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
        ).alias("warnings"),
    )
    return parsed.unionByName(out)


def scan_logs(spark: SparkSession, paths: str | list[str], limit_mb: int | None = None) -> DataFrame:
    """Records, headers and warnings of all files."""
    return parse_files(read_files(spark, paths), limit_mb)


def records(parsed: DataFrame) -> DataFrame:
    return parsed.where("record_no > 0 AND fields IS NOT NULL")


def headers(parsed: DataFrame) -> DataFrame:
    """``(file, name, value)`` of the header fields."""
    rows = parsed.where("record_no = 0")
    return rows.select("file", F.explode("fields").alias("name", "value"))


def warnings(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", "record_no", F.inline("warnings"))


# --- export ------------------------------------------------------------------------------------

def field_text(name: str, value: Column) -> Column:
    """``<NAME:LENGTH>value``, NULL (left out by concat_ws) for a NULL value."""
    upper = name.strip().upper()
    if not (is_standard_name(upper) or is_free_name(upper)) or upper in _MARKS:
        raise ValueError(f"invalid ADIF field name: {name!r}")
    text = value.cast("string")
    return F.concat(F.lit(f"<{upper}:"), F.char_length(text), F.lit(">"), text)


def record_text(columns: Mapping[str, Column | str]) -> Column:
    """One record on one line, fields in the given order, NULL fields left out."""
    return F.concat_ws(" ", *[field_text(n, col(c)) for n, c in columns.items()], F.lit("<EOR>"))


def header_text(extra: Mapping[str, str] | None = None) -> str:
    values = {"ADIF_VER": "3.1.4", "PROGRAMID": "skylog", **(extra or {})}
    lines = [f"<{name}:{len(value)}>{value}" for name, value in values.items()]
    return "\n".join(["Contact log export", *lines, "<EOH>"])


def write_logs(rows: DataFrame, path: str, text: Column, header: Mapping[str, str] | None = None):
    """Writes one log file per partition: a header line block, then one record per line."""
    # the low bits of this id count the rows of a partition, so its first row carries the header
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = rows.select(text.alias("value"), nth.alias("nth"))
    top = F.lit(header_text(header) + "\n")
    lines.select(F.concat(F.when(F.col("nth") == 0, top).otherwise(F.lit("")), "value").alias("value")).write.mode("overwrite").text(path)

"""Live-feed datagrams: binary payload to a typed struct, in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wire format. Kinds: s text, ? flag, I u32, B u8, Q u64.
MAGIC = bytes.fromhex("ADBCCBDA")
STATUS_TAIL = [
    ("report", "s"),
    ("tx_mode", "s"),
    ("tx_enabled", "?"),
    ("transmitting", "?"),
    ("decoding", "?"),
    ("rx_df", "I"),
    ("tx_df", "I"),
    ("de_call", "s"),
    ("de_grid", "s"),
    ("dx_grid", "s"),
    ("tx_watchdog", "?"),
    ("sub_mode", "s"),
    ("fast_mode", "?"),
    ("special_op_mode", "B"),
    ("frequency_tolerance", "I"),
    ("tr_period", "I"),
    ("configuration_name", "s"),
    ("tx_message", "s"),
]
JTDX_TAIL = [*STATUS_TAIL[:13], ("tx_first", "?")]
LAYOUTS = {
    0: ("heartbeat", [("max_schema", "I"), ("version", "s")], [("revision", "s")]),
    1: ("status", [("freq_hz", "Q"), ("mode", "s"), ("dx_call", "s")], STATUS_TAIL),
    6: ("close", [], []),
    12: ("logged_adif", [("adif", "s")], []),
}
_SQL_KIND = {"s": "string", "?": "boolean", "I": "bigint", "B": "smallint", "Q": "decimal(20,0)"}


def _columns() -> dict[str, str]:
    found = {"type": "string", "client": "string", "schema": "bigint", "code": "bigint"}
    for _, needed, tail in LAYOUTS.values():
        found.update({name: _SQL_KIND[kind] for name, kind in [*needed, *tail]})
    found["tx_first"] = "boolean"
    return found


COLUMNS = _columns()
MESSAGE_DDL = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())


def decode(data: bytes) -> dict | None:
    """One message as a dict, None for anything that is not a whole message."""
    pos = 0

    def take(kind: str):
        nonlocal pos
        if kind != "s":
            (value,) = struct.unpack_from(f">{kind}", data, pos)
            pos += struct.calcsize(f">{kind}")
            return Decimal(value) if kind == "Q" else value
        size = take("I")
        if size == 0xFFFFFFFF:
            return None
        raw = data[pos : pos + size]
        if len(raw) < size:
            raise struct.error("text is cut off")
        pos += size
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    try:
        if data[:4] != MAGIC:
            return None
        pos = 4
        schema, code = take("I"), take("I")
        if schema not in (2, 3):
            return None
        client = take("s")
        name, needed, tail = LAYOUTS.get(code, ("other", [], []))
        message = {"type": name, "client": client, "schema": schema, "code": code}
        for field, kind in needed:
            message[field] = take(kind)
    except struct.error:
        return None
    if name == "status" and (client or "").startswith("JTDX"):
        tail = JTDX_TAIL
    try:
        for field, kind in tail:
            message[field] = take(kind)
    except struct.error:
        pass  # an older sender writes fewer fields
    return message


_ARROW_KIND = {
    "string": pa.string(), "bigint": pa.int64(), "smallint": pa.int16(), "boolean": pa.bool_(),
    "decimal(20,0)": pa.decimal128(20, 0),
}
_ARROW_MESSAGE = pa.struct([(name, _ARROW_KIND[kind]) for name, kind in COLUMNS.items()])


def decode_messages(datagrams: DataFrame, value: str = "value") -> DataFrame:
    """Adds the struct ``message`` (NULL for foreign or broken datagrams). Batch or stream.

    Arrow batches go through the worker whole; only the payload column is looked at.
    """

    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(value).to_pylist()
            found = [None if data is None else decode(data) for data in payloads]
            messages = pa.array(found, _ARROW_MESSAGE)
            names = [*batch.schema.names, "message"]
            yield pa.RecordBatch.from_arrays([*batch.columns, messages], names)

    message = T.StructType.fromDDL(MESSAGE_DDL)
    schema = T.StructType([*datagrams.schema.fields, T.StructField("message", message)])
    return datagrams.mapInArrow(decode_batches, schema)


# --- encoding as columns (replays and tests over table data) -----------------------------------


def u32(value: Column | int) -> Column:
    number = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0"))


def text(value: Column) -> Column:
    raw = F.encode(value, "UTF-8")
    return F.coalesce(F.concat(u32(F.octet_length(raw)), raw), F.unhex(F.lit("FFFFFFFF")))


def datagram(code: int, client: Column, *body: Column, schema: int = 3) -> Column:
    head = F.concat(F.lit(MAGIC), u32(schema), u32(code), text(client))
    return F.concat(head, *body)


"""Helpers that the corpus operators share: stored intermediate tables, words and their hashes.

Words are the runs of ``[^\\x20\\x09-\\x0D]``. ``hash_words`` hashes all words of many texts with a few
array passes (a tabulated polynomial over the UTF-8 bytes), so no Python object per word is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
SEGMENT = 1 << 17  # bytes hashed at once; a longer word makes a longer segment

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


class Store:
    """Tables of one job in the shared folder of ``spark.checkpoint.dir``; cuts lineage.

    A lost executor only repeats the step that is running. ``drop`` removes a table that no later
    step reads; the tables behind a returned DataFrame stay, as it is evaluated later.
    """

    def __init__(self, spark: SparkSession, label: str, compression: str = "snappy"):
        self.spark, self.root, self.compression = spark, scratch_dir(spark, label), compression

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=self.compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()  # shuffle files of finished jobs go when the driver forgets them


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


_TABLE = np.array([splitmix(i) for i in range(256)], dtype=U64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits parts words here.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 4096), base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have if len(have) <= 4 * SEGMENT else have[: 4 * SEGMENT].copy()
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _hash_segment(data: bytes, lower: bool, space: np.ndarray) -> np.ndarray:
    """Hashes of the words of one segment, in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=U64)
    edge = np.flatnonzero(np.diff(space[raw].view(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    if lower:
        raw = _LOWER[raw]
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_TABLE[raw] * _power(_BASE, len(raw)), out=total[1:])
    value = (total[ends] - total[starts]) * _power(_INVERSE, len(raw))[starts]
    return mix(value + (ends - starts).astype(U64) * U64(_BASE))


def _segments(data: bytes, space: np.ndarray) -> Iterator[bytes]:
    """Cuts long data at blanks."""
    at = 0
    while len(data) - at > 2 * SEGMENT:
        cut = at + SEGMENT
        while True:
            piece = np.frombuffer(data, dtype=np.uint8, count=min(SEGMENT, len(data) - cut), offset=cut)
            blank = np.flatnonzero(space[piece])
            if len(blank):
                cut += int(blank[0])
                break
            cut += len(piece)
            if cut >= len(data):
                break
        yield data[at:cut]
        at = cut
    yield data[at:]


def hash_words(texts: list[str | None], lower: bool, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts in order, offsets of each text's words: one more than texts).

    ``space`` tells which bytes part words.
    """
    parts, counts, group, size = [], [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            # a blank between texts ends the words; an own mark finds the texts again
            joined = b" ".join(group)
            for piece in _segments(joined, space):
                parts.append(_hash_segment(piece, lower, space))
            raw = space[np.frombuffer(joined, dtype=np.uint8)]
            starts = np.flatnonzero(np.diff(raw.view(np.int8), prepend=1) == -1)
            limits = np.cumsum([len(x) + 1 for x in group])
            at = np.searchsorted(starts, limits, side="left")
            counts.append(np.diff(at, prepend=0))
        group, size = [], 0

    for text in texts:
        data = encode(text)
        if group and size + len(data) > SEGMENT:
            flush()
        group.append(data)
        size += len(data) + 1
    flush()
    lengths = np.concatenate(counts) if counts else np.empty(0, dtype=np.int64)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return (np.concatenate(parts) if parts else np.empty(0, dtype=U64)), offsets


def hash_grams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of n consecutive words; the caller drops those that cross two texts."""
    count = max(0, len(words) - n + 1)
    value = np.full(count, splitmix(salt + n), dtype=U64)
    for i in range(n):
        value = mix(value * U64(_BASE) + words[i : i + count])
    return value


def inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of the positions of ``hash_grams`` lie within one text."""
    total = int(offsets[-1])
    ok = np.ones(max(0, total - n + 1), dtype=bool)
    for back in range(1, n):
        at = offsets[1:-1] - back
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def listed(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and list lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), without Python."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id is in the fold, so nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")

"""WARC archives and their index: captures are written as records, read back, and indexed by an external merge.

*Writing.* Of captures with equal payloads one is a response, the others revisits without payload. Tasks pack records into
archives of about ``ARCHIVE`` bytes, one gzip member a record, so that a record can be fetched by its offset. Spark's text
sink writes them, one archive a file, so commits, retries and remote stores are Spark's; the sink's line separator gives the last byte
of an archive, a zero that ends the last member.

*Reading.* Each archive is parsed record by record and gives one run: its entries sorted by URL key, timestamp and page.

*Index.* The runs are range-partitioned by (URL key, timestamp, page), so a frequent key is spread over ranges; each range merges its
slices of all runs with a loser tree. Captures of a key that spans ranges are numbered by adding the counts of the ranges before. The
result is one global order (``range``, ``place``) and each capture's number in the history of its key.

Defined cases: a null payload is empty; a null url is empty; a null time is 1970-01-01T00:00:00; a null id is written without one and comes
last among equals; of repeated rows with the smallest id of their payload each is a response, and if all ids of a payload are null all are. Line
ends in a url are written as %0D and %0A. An empty table gives an empty index. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, read

ARCHIVE = 16 << 20  # bytes after which an archive is closed
RANGE = 100_000  # entries of an index range
LEAST = 0  # payloads of fewer bytes are always responses
PIECE = 1 << 16  # bytes given to the decompressor at once
NO_TIME = "1970-01-01T00:00:00"
ENTRY = (
    "url_key string, stamp string, page_id long, archive string, offset long, length long, url string, "
    "record_type string, refers_to long, payload_bytes long, payload_digest string, sound boolean, pos int"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
ENTRY_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in ENTRY.split(", ")])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host labels from the last to the first, without ``www.``, then path and query; a text without ``://`` is its own key."""
    scheme, found, rest = url.partition("://")
    if not found:
        return url
    rest = rest.partition("#")[0]
    end = min(k for k in (rest.find("/"), rest.find("?"), len(rest)) if k >= 0)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[end:] or "/")


def make_record(page: int | None, url: str, stamp: str, size: int, digest: str, payload: bytes | None, refers: int | None) -> bytes:
    """One WARC/1.1 record; without payload a revisit of ``refers``."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    kind = "revisit" if payload is None else "response"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {stamp}Z",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        open_, parts, start = zlib.decompressobj(31), [], at
        while not open_.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a record")
            parts.append(open_.decompress(view[at : at + PIECE]))
            at += min(PIECE, len(data) - at)
        at -= len(open_.unused_data)
        yield start, at - start, b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes] | None:
    """Fields, HTTP fields and payload of a record; None for empty content."""
    if not data:
        return None

    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}

    end = data.index(b"\r\n\r\n")
    own = fields(data[:end])
    block = data[end + 4 : end + 4 + int(own["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return own, fields(head), payload


def _archives(limit: int):
    def close(parts: list[bytes], large: bool) -> pa.RecordBatch:
        if large:  # its length needs the fourth byte: an empty member ends the archive with a zero
            parts.append(gzip_member(b""))
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, large = [], 0, False
        for batch in batches:
            for row in range(batch.num_rows):
                values = [c[row].as_py() for c in batch.columns]
                record = make_record(*values)
                parts.append(gzip_member(record))
                size, large = size + len(parts[-1]), len(record) >= 1 << 24
                if size >= limit:
                    yield close(parts, large)
                    parts, size = [], 0
        if parts:
            yield close(parts, large)

    return run


def write_archives(captures: DataFrame, path: str, archive_bytes: int = ARCHIVE, least: int = LEAST) -> None:
    """Writes page_id (long), url (string), captured (timestamp without zone) and payload (binary) as archives to ``path``."""
    payload = F.coalesce("payload", F.lit(b"").cast("binary"))
    stamp = F.coalesce(F.replace(F.col("captured").cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), F.lit(NO_TIME))
    rows = captures.select("page_id", F.coalesce("url", F.lit("")).alias("url"), stamp.alias("stamp"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha"), F.xxhash64("payload").alias("hash")
    )
    same = ["sha", "hash", "size"]
    firsts = rows.groupBy(*same).agg(F.min("page_id").alias("first"))
    # equal payloads meet in one join, where a hot payload can be split; only one of them is written
    rows = rows.join(firsts, same)
    response = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("size") < least)
    records = rows.select(
        "page_id", "url", "stamp", "size", _base32(F.col("sha")).alias("digest"),
        F.when(response, F.col("payload")).alias("payload"), F.when(~response, F.col("first")).alias("refers"),
    )
    packed = records.mapInArrow(_archives(archive_bytes), "content binary")
    packed.select(F.col("content").cast("string").alias("value")).write.options(lineSep="\0", maxRecordsPerFile=1).text(path)


def _base32(hexadecimal):
    """Bare upper-case base32 of a hexadecimal text of 40 digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for k in range(8):  # five hexadecimal digits are four letters
        value = F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _number(name: str) -> int | None:
    return int(name[len("<urn:page:") : -1] or 0) if name[len("<urn:page:") : -1] else None


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            archive, rows = path.as_py().rpartition("/")[2], []
            for offset, length, data in members(content.as_py()):
                parsed = parse_record(data)
                if parsed is None:
                    continue
                own, http, payload = parsed
                full = own["warc-type"] == "response"
                said = own["warc-payload-digest"].removeprefix("sha1:")
                digest = base32_sha1(payload) if full else said
                size = len(payload) if full else int(http["content-length"])
                refers = None if full else _number(own["warc-refers-to"])
                url = own["warc-target-uri"]
                rows.append((
                    url_key(url), own["warc-date"].removesuffix("Z"), _number(own["warc-record-id"]), archive, offset, length, url,
                    own["warc-type"], refers, size, digest, digest == said,
                ))
            rows.sort(key=_order)
            for at in range(0, len(rows), 10_000):
                part = [(*r, at + k) for k, r in enumerate(rows[at : at + 10_000])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), ENTRY_SCHEMA.types)], schema=ENTRY_SCHEMA)


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is None, entry[2] or 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives under ``path``; ``pos`` is the place in the archive's sorted run."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_entries, ENTRY)


class LoserTree:
    """Merges k sorted lists: each inner node keeps the loser of its match, so a step replays one path only."""

    def __init__(self, lists: list[list[tuple]]):
        self.lists, self.at, k = lists, [0] * len(lists), len(lists)
        self.losers = [-1] * k
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.lists[a]):
            return False
        if self.at[b] >= len(self.lists[b]):
            return True
        x, y = self.lists[a][self.at[a]], self.lists[b][self.at[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, place in it) of all items in order; of equal items the earlier list's first."""
        k = len(self.lists)
        for _ in range(sum(map(len, self.lists))):
            best = self.winner
            yield best, self.at[best]
            self.at[best] += 1
            node = (best + k) // 2
            while node >= 1:
                if self._less(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.winner = best


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges one range: the slices of the runs, by their archive, in the order of ``pos``."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    archive = table.column("archive").combine_chunks().dictionary_encode()
    archive = archive if isinstance(archive, pa.DictionaryArray) else archive.chunk(0)
    run, pos = np.asarray(archive.indices), np.asarray(table.column("pos"))
    order = np.lexsort((pos, run))
    table, run = table.take(pa.array(order)), run[order]
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    keys = [_order(x) for x in zip(*(table.column(c).to_pylist() for c in ("url_key", "stamp", "page_id")))]
    edges = [*starts.tolist(), len(keys)]
    merged = np.fromiter((edges[a] + b for a, b in LoserTree([keys[a:b] for a, b in zip(edges[:-1], edges[1:])])), np.int64, len(keys))
    local, last = np.empty(len(keys), np.int64), None
    for place, k in enumerate(merged.tolist()):
        local[place] = local[place - 1] + 1 if keys[k][0] == last else 1
        last = keys[k][0]
    table = table.take(pa.array(merged)).drop_columns(["pos"])
    table = table.append_column("place", pa.array(np.arange(len(keys)))).append_column("local", pa.array(local))
    yield from table.to_batches(max_chunksize=10_000)


def merge_runs(entries: DataFrame, store: Store, entries_of_range: int = RANGE) -> DataFrame:
    """All entries in one order (``range``, ``place``), each with its ``capture`` number in the history of its URL key."""
    runs = store.table("runs", entries)
    ranges = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // entries_of_range))
    dealt = runs.repartitionByRange(ranges, "url_key", "stamp", F.col("page_id").asc_nulls_last())
    merged = dealt.mapInArrow(_merge, f"{ENTRY.rpartition(', ')[0]}, place long, local long")
    merged = store.table("merged", merged.withColumn("range", F.spark_partition_id()))
    # a key that goes on from an earlier range is the first of its range
    going = merged.where("place = 0").select(F.col("url_key").alias("key")).distinct()
    counts = merged.join(going, F.col("url_key") == F.col("key"), "left_semi").groupBy("url_key", "range").agg(F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("url_key", "range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    numbered = merged.join(offsets, ["url_key", "range"], "left")
    return numbered.withColumn("capture", F.col("local") + F.coalesce("before", F.lit(0))).drop("local", "before")


def op11_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as archives, read back and indexed. A page has no time: its id gives one, in seconds, within ten years."""
    time = F.expr("timestampadd(SECOND, pmod(page_id, 315360000), TIMESTAMP_NTZ'2015-01-01 00:00:00')")
    pages = read(spark, sf, "pages").select("page_id", "url", time.alias("captured"), F.col("html").cast("binary").alias("payload"))
    store = Store(spark, "warc")
    write_archives(pages, f"{store.root}/archives")
    index = merge_runs(read_archives(spark, f"{store.root}/archives"), store)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture")


OP11_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), parts AS (
  SELECT *, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first,
         regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest
  FROM p
), keyed AS (
  SELECT *, CASE WHEN NOT contains(url, '://') THEN url ELSE
    array_to_string(list_reverse(string_split(regexp_replace(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), '.')), ',')
    || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS url_key
  FROM parts
)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(sha, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
  url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id % 315360000, page_id) AS capture
FROM keyed
"""

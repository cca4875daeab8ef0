"""Repeated passages by prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of one document. A window is repeated if its words also start earlier
(smaller id, or same document and earlier start); all words that repeated windows cover are removed.

1. Only suffixes at anchors are indexed. The anchor of a window is the start of its least ``SEED``-word prefix by
   hash, which depends on the window's words only, so equal windows have equal anchors at the same place. This
   leaves about an eighth of all positions.
2. Suffixes with equal windows collapse into one leaf, known by its first place. Leaves are partitioned by prefix. A prefix that starts one suffix only is a leaf of the tree's top and
   is pruned. Prefixes of at most ``GROUP`` suffixes make one subtree each; the prefixes of larger groups are made
   longer, up to the whole window, where every group is one node and partial aggregation finds its first
   leaf, so no group outgrows memory and a hot one is split.
3. A subtree's nodes at the window's depth (by 128 bits: prefix and window hash) with two or more leaves are
   the deep internal nodes, the repeats; all places but the first are marked. Overlapping marks join into maximal repeats.

Documents with the words of an earlier document are repeated as a whole and are left out of the trees. Windows are
judged on the input. Defined cases: a null or empty text has no words; texts shorter than a window keep all;
a null id comes after all others (null ids count as one id); repeated rows of one id and text are one document and get
the same result; rows of one id with different texts share their marks. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Store, encode, hash_grams, hash_words, inside, listed, mix, read, signed

WINDOW = 20
SEED = 6
GROUP = 4096  # suffixes of one subtree
TEXTS = 400
LAST = (1 << 63) - 1  # stands for a null id


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value among ``width`` neighbours, for each start."""
    count = len(values) - width + 1
    if count < 1:
        return np.empty(0, np.int64)
    best, place, span = values, np.arange(len(values)), 1
    while span < width:
        shift = min(span, width - span)
        n = len(best) - shift
        right = best[shift:] < best[:n]
        place = np.where(right, place[shift:], place[:n])
        best = np.where(right, best[shift:], best[:n])
        span += shift
    return place


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed hashes by position, anchor position of the window at each start)."""
    seeds = hash_grams(words, SEED)
    return seeds, _least(seeds, window - SEED + 1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield [c.to_pylist() for c in batch.slice(at, TEXTS).columns]


def _print(words: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a word sequence."""
    place = np.arange(1, len(words) + 1, dtype=U64)
    one, two = mix(words + place * U64(0x9E3779B97F4A7C15)), mix(words ^ mix(place))
    return int(one.sum(dtype=U64).view(np.int64)), int(two.sum(dtype=U64).view(np.int64))


_DESCRIBED = "id long, n long, f1 long, f2 long, key long, pos int"


def _describe(window: int):
    """A row for each document (n, f1, f2) and for each of its anchors (key, pos)."""

    def run(batches):
        for ids, texts in _parts(batches):
            words, offsets = hash_words(texts, lower=False)
            seeds, place = anchors(words, window)
            ok = inside(offsets, window)[: len(place)]
            place = place[ok]
            place = place[np.flatnonzero(np.diff(place, prepend=-1))] if len(place) else place
            owner = np.searchsorted(offsets, place, side="right") - 1
            prints = [_print(words[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            docs, many = len(ids), len(place)
            own = np.array(ids, np.int64)
            null = lambda n: pa.nulls(n, pa.int64())
            join = lambda a, b: pa.concat_arrays([a.cast(pa.int64()), b.cast(pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [join(pa.array(own), pa.array(own[owner])), join(pa.array(np.diff(offsets)), null(many)),
                 join(pa.array([p[0] for p in prints], pa.int64()), null(many)), join(pa.array([p[1] for p in prints], pa.int64()), null(many)),
                 join(null(docs), pa.array(signed(seeds[place]))), join(null(docs), pa.array(place - offsets[owner])).cast(pa.int32())],
                names=[x.split()[0] for x in _DESCRIBED.split(", ")],
            )

    return run


_SUFFIXES = "key long, id long, big boolean, anchor int, first int, windows array<long>"


def _suffixes(window: int):
    """The windows at the wanted anchors: a row per anchor with the hashes of its windows in order."""

    def run(batches):
        for ids, texts, wanted in _parts(batches):
            out = []
            for doc, text, want in zip(ids, texts, wanted):
                words, _ = hash_words([text], lower=False)
                seeds, place = anchors(words, window)
                whole = signed(hash_grams(words, window, salt=7))
                starts = np.flatnonzero(np.diff(place, prepend=-1))
                ends = np.append(starts[1:], len(place))
                at = {int(a): k for k, a in enumerate(place[starts].tolist())}
                for w in want:
                    k = at.get(w["pos"])
                    if k is not None:
                        out.append((seeds[w["pos"]].view(np.int64), doc, w["big"], w["pos"], starts[k], whole[starts[k] : ends[k]]))
            if out:
                key, doc, big, anchor, first, hashes = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(key, np.int64)), pa.array(doc, pa.int64()), pa.array(big, pa.bool_()), pa.array(anchor, pa.int32()),
                     pa.array(np.array(first, np.int32)), listed(np.concatenate(hashes), np.array([len(h) for h in hashes]), pa.int64())],
                    names=[x.split()[0] for x in _SUFFIXES.split(", ")],
                )

    return run


_NODES = "key long, leaf long, id long, first int, n long, bits long"


def _marks(table: pa.Table) -> pa.RecordBatch:
    """For the leaves of whole prefix groups: which of a leaf's windows (bits) start earlier in another leaf."""
    t = table.combine_chunks()
    key, leaf, doc, first, count = (t[c].chunk(0).to_numpy() for c in ("key", "leaf", "id", "first", "n"))
    windows = t["windows"].chunk(0)
    lengths = np.diff(windows.offsets.to_numpy())
    row = np.repeat(np.arange(len(key)), lengths)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes = windows.flatten().to_numpy()
    start = first[row] + nth
    order = np.lexsort((start, doc[row], hashes, key[row]))
    r, h = row[order], hashes[order]
    again = np.zeros(len(order), bool)  # one node with the suffix before it: not its first leaf
    again[1:] = (key[r][1:] == key[r][:-1]) & (h[1:] == h[:-1])
    keep = order[again]
    bits = np.zeros(len(key), np.int64)
    np.bitwise_or.at(bits, row[keep], np.int64(1) << nth[keep])
    found = np.flatnonzero((bits != 0) | (count > 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(x[found]) for x in (key, leaf, doc, first.astype(np.int32), count, bits)], names=[x.split()[0] for x in _NODES.split(", ")]
    )


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a group that goes on in the next batch waits for it."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        keys = rest["key"].to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield _marks(rest.slice(0, last))
            rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield _marks(rest)


def _cover(n: int, marks: list | None, window: int) -> np.ndarray:
    """Which words lie in a marked window."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks or ():
        bits, start = m["bits"], m["first"]
        while bits:
            if bits & 1 and start + window <= n:
                edge[start] += 1
                edge[start + window] -= 1
            bits >>= 1
            start += 1
    return np.cumsum(edge[:n]) > 0


_KEPT = "id long, n_words long, n_removed long, kept string, spans array<struct<start: int, stop: int>>"


def _keep(window: int):
    def run(batches):
        for ids, texts, infos, marks in _parts(batches):
            out = []
            for doc, text, info, mark in zip(ids, texts, infos, marks):
                words = encode(text).split()
                n = len(words)
                if n >= window and info:
                    hashes, _ = hash_words([text], lower=False)
                    one, two = _print(hashes)
                    copy = any(x["copy"] and x["f1"] == one and x["f2"] == two for x in info)
                else:
                    copy = False
                gone = np.ones(n, bool) if copy else _cover(n, mark, window)
                turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                spans = [{"start": a, "stop": b} for a, b in zip(turn[0::2], turn[1::2])]
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if spans else b" ".join(words)
                out.append((doc, n, int(gone.sum()), kept.decode("utf-8", "surrogatepass"), spans))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "n_words", "n_removed", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay), spans (maximal
    repeated runs of words that go)."""
    store = Store(docs.sparkSession, "repeats")
    docs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("id"), F.col(f"`{text}`").alias("text"),
                       F.col(f"`{doc_id}`").isNull().alias("unnamed"))
    described = store.table("described", docs.select("id", "text").mapInArrow(_describe(window), _DESCRIBED))
    own = described.where("key IS NULL").select("id", "f1", "f2")
    firsts = own.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    info = own.distinct().join(firsts, ["f1", "f2"]).withColumn("copy", F.col("rep") < F.col("id"))
    info = store.table("info", info.groupBy("id").agg(F.collect_set(F.struct("f1", "f2", "copy")).alias("info"), F.max(~F.col("copy")).alias("leads")))

    starts = described.where("key IS NOT NULL").select("key", "id", "pos")
    prefixes = starts.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    wanted = starts.join(prefixes, "key").groupBy("id").agg(F.collect_list(F.struct("pos", (F.col("size") > GROUP).alias("big"))).alias("wanted"))
    wanted = store.table("wanted", wanted.join(info.where("leads").select("id"), "id", "left_semi"))
    store.drop("described")
    texts = docs.select("id", "text").join(wanted, "id").select("id", "text", "wanted")
    suffixes = store.table("suffixes", texts.mapInArrow(_suffixes(window), _SUFFIXES))
    store.drop("wanted")

    # equal runs of windows are one leaf, known by its first place: copies collapse before anything is compared
    runs = suffixes.withColumn("leaf", F.xxhash64("windows"))
    leaves = runs.groupBy("key", "leaf").agg(
        F.min(F.struct("id", "first")).alias("low"), F.count("*").alias("n"), F.max("big").alias("big"), F.first("windows").alias("windows")
    ).select("key", "leaf", "low.id", "low.first", "n", "big", "windows")
    leaves = store.table("leaves", leaves)
    small = leaves.where("NOT big").drop("big").repartition("key").sortWithinPartitions("key")
    nodes = small.mapInArrow(_subtrees, _NODES)
    longer = leaves.where("big").select("key", "leaf", "id", "first", F.posexplode("windows").alias("nth", "hash"))
    longer = longer.withColumn("at", F.struct("id", (F.col("first") + F.col("nth")).alias("start")))
    firsts = longer.groupBy("key", "hash").agg(F.min("at").alias("least"), F.count("*").alias("same")).where("same > 1")
    later = longer.join(firsts, ["key", "hash"]).where("at <> least").groupBy("key", "leaf").agg(F.expr("bit_or(shiftleft(1L, nth))").alias("bits"))
    big = leaves.where("big").join(later, ["key", "leaf"], "left").select("key", "leaf", "id", "first", "n", F.coalesce("bits", F.lit(0)).cast("long").alias("bits"))
    nodes = store.table("nodes", nodes.unionByName(big))
    # a leaf's first place loses what other leaves have earlier, its other places lose all
    many = nodes.where("n > 1").select("key", "leaf", F.col("id").alias("low"), F.col("first").alias("begin"), F.col("bits").alias("own"))
    every = F.expr("shiftleft(1L, size(windows)) - 1")
    places = runs.select("key", "leaf", "id", "first", every.alias("every")).join(many, ["key", "leaf"])
    places = places.select("id", "first", F.when((F.col("id") == F.col("low")) & (F.col("first") == F.col("begin")), F.col("own")).otherwise(F.col("every")).alias("bits"))
    marks = nodes.where("n = 1").select("id", "first", "bits").unionByName(places).where("bits <> 0")
    marks = store.table("marks", marks.groupBy("id").agg(F.collect_set(F.struct("first", "bits")).alias("marks")))
    store.drop("leaves", "nodes")
    store.drop("suffixes")

    per = info.select("id", "info").join(marks, "id", "left")
    rows = docs.join(per, "id", "left")
    kept = rows.select("id", "text", "info", "marks").mapInArrow(_keep(window), _KEPT)
    unnamed = F.when(F.col("id") != LAST, F.col("id"))
    return kept.select(unnamed.alias("doc_id"), "n_words", "n_removed", "kept", "spans")


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words, removed words and digest of what stays, for every document."""
    found = remove_repeats(read(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r'''
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), every AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), win AS (
  SELECT doc_id, p AS i, concat_ws(' ', word, ''' + ", ".join(f"lead(word, {k}) OVER own" for k in range(1, 20)) + r''') AS words,
         lead(word, 19) OVER own AS last
  FROM every WINDOW own AS (PARTITION BY doc_id ORDER BY p)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS nth FROM win WHERE last IS NOT NULL
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE nth > 1) GROUP BY doc_id
), lost AS (SELECT doc_id, unnest(ps) AS p FROM gone), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS text, count(*) AS n
  FROM every e LEFT JOIN lost l ON e.doc_id = l.doc_id AND e.p = l.p WHERE l.p IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
'''

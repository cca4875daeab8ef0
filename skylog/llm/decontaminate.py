"""Benchmark decontamination by greedy string tiling.

A benchmark item leaks into a document if enough of its words lie in matches of at least ``least``
words. Tiling finds the longest match of unmarked words, marks it on both sides and repeats, so parts that
were moved around are found as well; matches are looked up by running Karp-Rabin hashes of windows that
shrink from the whole item to ``least`` words.

1. Items and documents are cut into seeds, windows of ``least`` words. A filter of fixed size, filled with the
   items' seeds, leaves of a document only runs of words that may lie in a match. The whole of every match
   lies in such a run, so nothing is lost.
2. A join on seeds gives (document, item) pairs. An item with c covered words has at least c / least of its
   seed positions in the document; pairs below that go.
3. Each remaining pair is tiled, on the words themselves.

Words are runs of letters and digits of the lower-cased text (bytes above ASCII count as letters), so
punctuation and case don't hide a leak. Defined cases: a null or empty text, an empty benchmark or an item of
fewer than ``least`` words never matches; repeated rows of a document or item count once; null ids never match.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PUNCTUATION, U64, Store, hash_grams, hash_words, inside, read, signed

LEAST = 5
COVERAGE = 0.5
PLACES = 1 << 22  # of the seed filter: its size is fixed
TEXTS = 500
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def _lower(text: str | None) -> str:
    return "" if text is None else text.lower()


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall(_lower(text).encode("utf-8", "surrogatepass").lower())


def _windows(texts: list[str | None], least: int):
    """Per text: the hashes of its windows of ``least`` words."""
    words, offsets = hash_words([_lower(x) for x in texts], True, PUNCTUATION)
    grams = hash_grams(words, least)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield grams[start : max(start, end - least + 1)]


def _places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (grams & U64(PLACES - 1)).astype(np.int64), ((grams >> U64(40)) & U64(PLACES - 1)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _item_seeds(least: int):
    def run(batches):
        for ids, texts in _parts(batches):
            item, seed = [], []
            for i, grams in zip(ids, _windows(texts, least)):
                item += [i] * len(grams)
                seed.append(signed(grams))
            flat = np.concatenate(seed) if seed else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(flat)], names=["item", "seed"])

    return run


def _runs(least: int, filled):
    """(id, distinct seeds, runs of words that may match) of the documents that have any."""

    def run(batches):
        table = np.zeros(PLACES, bool)
        table[filled.value] = True
        for ids, texts in _parts(batches):
            out_id, out_seeds, out_runs = [], [], []
            words, offsets = hash_words([_lower(x) for x in texts], True, PUNCTUATION)
            grams = hash_grams(words, least)
            first, second = _places(grams)
            hit = table[first] & table[second]
            hit &= inside(offsets, least)
            at = np.flatnonzero(hit)
            owner = np.searchsorted(offsets, at, side="right") - 1
            for k in np.unique(owner).tolist():
                if ids[k] is None:
                    continue
                own = at[owner == k] - offsets[k]
                spelled = words_of(texts[k])
                ends = np.flatnonzero(np.diff(own) > 1)
                starts = own[np.concatenate(([0], ends + 1))]
                stops = own[np.concatenate((ends, [len(own) - 1]))] + least
                out_id.append(ids[k])
                out_seeds.append(signed(np.unique(grams[own + offsets[k]])))
                out_runs.append([b" ".join(spelled[a:b]).decode("utf-8", "surrogatepass") for a, b in zip(starts, stops)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_id, pa.int64()), pa.array(out_seeds, pa.list_(pa.int64())), pa.array(out_runs, pa.list_(pa.string()))],
                names=["id", "seeds", "runs"],
            )

    return run


def tile(item: list, runs: list[list], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (position in the item, position in the joined runs, length), longest first."""
    text: list = []
    for r in runs:
        text += [*r, None]  # the mark equals no word
    used_i, used_t = [False] * len(item), [False] * len(text)
    for i, w in enumerate(text):
        used_t[i] = w is None
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), max((len(r) for r in runs), default=0)))
    while True:
        starts = defaultdict(list)
        for t, h in _rolling(text, used_t, size):
            starts[h].append(t)
        found = []
        for i, h in _rolling(item, used_i, size):
            for t in starts.get(h, ()):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and not used_i[i + n] and not used_t[t + n]:
                    n += 1
                if n >= size:
                    found.append((-n, i, t))
        marked = False
        for n, i, t in sorted(found):
            if any(used_i[i : i - n]) or any(used_t[t : t - n]):
                continue
            used_i[i : i - n] = used_t[t : t - n] = [True] * -n
            tiles.append((i, t, -n))
            marked = True
        if not marked:
            if size == least:
                return sorted(tiles, key=lambda x: (-x[2], x[0]))
            size = max(least, size // 2)


_PRIME, _STEP = (1 << 61) - 1, 1_000_003


def _rolling(words: list, used: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each window of ``size`` unmarked words."""
    lead = pow(_STEP, size, _PRIME)
    value = run = 0
    for end, word in enumerate(words):
        if used[end]:
            value = run = 0
            continue
        value = (value * _STEP + hash(word)) % _PRIME
        run += 1
        if run > size:
            value = (value - lead * hash(words[end - size])) % _PRIME
        if run >= size:
            yield end - size + 1, value


def _tiled(least: int):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                item = words_of(r["item_text"])
                tiles = tile(item, [x.encode("utf-8", "surrogatepass").split(b" ") for x in r["runs"]], least)
                covered = sum(n for _, _, n in tiles)
                out.append((r["id"], r["item"], len(item), covered, len(tiles), max((n for _, _, n in tiles), default=0)))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "item", "words", "covered", "tiles", "longest"])

    return run


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE,
          text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item with at least ``coverage`` of the item's words in tiles:
    doc_id, item_id, item_words, covered_words, n_tiles, longest_tile, coverage."""
    spark = docs.sparkSession
    store = Store(spark, "leaks")
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    items = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("item_text"))
    items = items.where("item IS NOT NULL").groupBy("item").agg(F.min("item_text").alias("item_text"))
    items = store.table("items", items)
    seeds = store.table("seeds", items.mapInArrow(_item_seeds(least), "item long, seed long"))
    places = F.array(F.col("seed").bitwiseAND(PLACES - 1), F.shiftrightunsigned("seed", 40).bitwiseAND(PLACES - 1))
    filled = seeds.select(F.explode(places).alias("place")).distinct().toPandas()["place"].to_numpy(np.int64)
    runs = docs.mapInArrow(_runs(least, spark.sparkContext.broadcast(filled)), "id long, seeds array<long>, runs array<string>")
    runs = store.table("runs", runs.distinct())

    counted = seeds.groupBy("item", "seed").agg(F.count("*").alias("positions"))
    sizes = seeds.groupBy("item").agg((F.count("*") + least - 1).alias("words"))
    own = runs.select("id", F.explode("seeds").alias("seed")).distinct()
    pairs = own.join(counted, "seed").groupBy("id", "item").agg(F.sum("positions").alias("positions")).join(sizes, "item")
    pairs = pairs.where(F.col("positions") * least >= coverage * F.col("words")).select("id", "item")
    given = pairs.join(items, "item").join(runs, "id").select("id", "item", "item_text", "runs")
    found = given.mapInArrow(_tiled(least), "id long, item long, words long, covered long, tiles long, longest long")
    found = found.where(F.col("covered") >= coverage * F.col("words")).dropDuplicates(["id", "item"])
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("words").alias("item_words"),
        F.col("covered").alias("covered_words"), F.col("tiles").alias("n_tiles"), F.col("longest").alias("longest_tile"),
        (F.col("covered") / F.col("words")).alias("coverage"),
    )


def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that holds enough of a benchmark item, with the item and its coverage."""
    return leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))

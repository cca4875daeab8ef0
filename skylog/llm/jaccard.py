"""Jaccard join of documents on word shingles with adaptive multi-match prefixes.

Two documents link when ``100 * |A n B| >= percent * |A u B|`` for their sets of distinct n-word shingles.

1. Documents with the same set form a class; only its smallest id goes on.
2. All shingles have one global order, rare before frequent. If a document of n shingles must share at
   least t = ceil(percent * n / 100) of them, its ``l``-prefix has its first n - t + l shingles, and two
   documents that link share at least min(l1, l2) shingles of their prefixes. Each document lengthens
   its prefix (l = 1 to 64) where that lowers its estimated cost: postings read plus candidates to verify.
3. A posting list never emits all its pairs. First every member is compared with three hubs of its list
   only, under the same bounds; the links found merge most of a large group of near copies. Then the exact round: pairs of one list
   that lie in different components and meet early enough in both prefixes to share min(l1, l2) tokens are counted over all lists, must reach that number, pass
   the length and position bounds and a bound from bitmaps of their sets, and are verified on the whole sets. Pairs within one component need
   no test, as only the component is asked for.

Frequency is known from a table of hashed shingles over all documents. It orders shingles and
estimates costs; any order gives the same links.

Defined cases: no text or no word: an empty set, linked with nothing; fewer than n words: the whole
sequence is the one shingle; a null id: set size is given, no component (null). Repeated rows are one
class. Rows with one id and different texts are judged by their own texts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Store, hash_grams, hash_words, mix, read, signed
from .graph import components

BUCKETS = 1 << 20  # of the frequency table: its size is fixed
HEAVY = 8  # times the mean that make a bucket count as frequent
VERIFY = 0.05  # cost of verifying a shingle of a candidate against reading a posting
OTHERS = 0.05  # other documents expected to have a shingle that is not frequent
LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
CLASSES = (1, 2, 6, 24)  # match numbers that pairs meet under, each with those up to the next
TEXTS = 500  # texts hashed at once
SLICES = 4  # of the tokens, taken one after the other to keep the shuffles on disk small
SKETCH = (1 << 11, 1 << 16)  # least and most bits of a set's bitmap


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, offsets = hash_words(texts, lower=True)
    grams = hash_grams(words, n)
    found = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if end - start >= n:
            found.append(np.unique(grams[start : end - n + 1]))
        elif end > start:
            found.append(hash_grams(words[start:end], end - start, salt=1))
        else:
            found.append(words[:0])
    return found


def _prints(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of the set."""
    one, two = mix(shingles).sum(dtype=U64), mix(shingles + U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


_SETS = "id long, n long, f1 long, f2 long, bits array<long>, bucket long, weight long"


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of the set, of about four bits a shingle, as 64-bit words."""
    size = SKETCH[0]
    while size < min(4 * len(shingles), SKETCH[1]):
        size *= 2
    marked = np.zeros(size, bool)
    marked[(shingles >> U64(32)).astype(np.int64) & (size - 1)] = True
    return np.packbits(marked, bitorder="little").view(np.int64)


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        kinds = [*[pa.int64()] * 4, pa.list_(pa.int64()), *[pa.int64()] * 2]
        names = [x.split()[0] for x in _SETS.split(", ")]

        def rows(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for ids, texts in _texts(batches):
            sets = shingle_sets(texts, n)
            table += np.bincount((np.concatenate(sets) & U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            prints = [_prints(s) for s in sets]
            none = [None] * len(ids)
            yield rows([ids, [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints], [_bitmap(s) for s in sets], none, none])
        heavy = np.flatnonzero(table >= max(4, HEAVY * table.mean()))
        none = [None] * len(heavy)
        yield rows([none, none, none, none, none, heavy, table[heavy]])

    return run


def need(n, percent: int):
    """Least overlap of a document of n shingles with any partner."""
    return (percent * n + 99) // 100


def prefix(shingles: np.ndarray, weight: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The document's prefix in global order and its match number l, by least estimated cost."""
    order = np.lexsort((shingles, weight))
    shingles, others = shingles[order], np.where(weight[order] > 0, weight[order], OTHERS)
    least = need(len(shingles), percent)
    best = None
    for l in LENGTHS:
        size = len(shingles) - least + l
        if best and (l > least or size > len(shingles)):
            break
        met = others[:size].sum()
        # a candidate with l matches has one outside the l - 1 most frequent shingles, and takes l of all meetings
        rare = met - (np.sort(others[:size])[size - l + 1 :].sum() if l > 1 else 0)
        estimate = size + met + VERIFY * len(shingles) * min(rare, met / l)
        if best is None or estimate < best[0]:
            best = (estimate, size, l)
    return shingles[: best[1]], best[2]


def _postings(n: int, percent: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        table[heavy.value[0]] = heavy.value[1]
        for ids, texts in _texts(batches):
            heads, meta = [], []
            for doc, shingles in zip(ids, shingle_sets(texts, n)):
                size = len(shingles)
                if doc is None or 100 * size < percent * (size + 1):  # no other set can be near
                    continue
                head, l = prefix(shingles, table[(shingles & U64(BUCKETS - 1)).astype(np.int64)], percent)
                heads.append(head)
                meta.append((doc, size, l, len(head)))
            if not heads:
                continue
            ids_, sizes, ls, lengths = (np.array(x, np.int64) for x in zip(*meta))
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(heads))), pa.array(np.repeat(ids_, lengths)),
                 pa.array(np.repeat(sizes, lengths).astype(np.int32)), pa.array(np.repeat(ls, lengths).astype(np.int8)),
                 pa.array(place.astype(np.int32))],
                names=["token", "id", "n", "l", "pos"],
            )

    return run


def _whole(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            sets = [signed(s) for s in shingle_sets(texts, n)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return run


def _sketched(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps let them link: a bit of one set that the other lacks is a shingle it lacks."""
    one, two = (bitmaps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")

    def folded(own: str, other: str) -> Column:
        """The bitmap at the other's size; partners differ too little for more than one folding."""
        half = F.size(other)
        upper = F.slice(own, half + 1, half)
        return F.when(F.size(own) > half, F.zip_with(F.slice(own, F.lit(1), half), upper, lambda x, y: x.bitwiseOR(y))).otherwise(F.col(own))

    def common(n: str, own: str, other: str) -> Column:
        lacking = F.zip_with(own, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.col(n) - F.aggregate(lacking, F.lit(0), lambda s, x: s + x)

    most = F.least(common("na", "fa", "fb"), common("nb", "fb", "fa"))
    both = pairs.join(one, "a").join(two, "b").withColumns({"fa": folded("bitsa", "bitsb"), "fb": folded("bitsb", "bitsa")})
    near = both.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))
    return near.select("a", "b").distinct()


def _verified(store: Store, docs: DataFrame, bitmaps: DataFrame, pairs: DataFrame, n: int, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) that link, judged on their whole sets."""
    pairs = store.table(f"{label}-pairs", _sketched(pairs, bitmaps, percent))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = docs.join(wanted, "id", "left_semi").mapInArrow(_whole(n), "id long, s array<long>")
    sets = store.table(f"{label}-sets", sets)
    one, two = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    near = pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
    links = store.table(f"{label}-links", near.select("a", "b").distinct())
    store.drop(f"{label}-pairs", f"{label}-sets")
    return links


def _possible(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the prefix entries they share (structs x and y, a row for each) let link."""
    first = F.col("x.id") < F.col("y.id")
    rest = [F.col(f"{s}.n") - F.col(f"{s}.pos") for s in "xy"]
    pairs = shared.where(100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.least("x.l", "y.l").alias("l"),
        (F.col("x.n") + F.col("y.n")).alias("both"),
        F.when(first, rest[0]).otherwise(rest[1]).alias("resta"), F.when(first, rest[1]).otherwise(rest[0]).alias("restb"),
    )
    pairs = pairs.groupBy("a", "b").agg(
        F.count("*").alias("c"), F.min("l").alias("l"), F.min("both").alias("both"), F.min("resta").alias("resta"), F.min("restb").alias("restb"),
    )
    most = F.col("c") + F.least("resta", "restb") - 1  # the pair cannot share more
    return pairs.where((F.col("c") >= F.col("l")) & ((100 + percent) * most >= percent * F.col("both"))).select("a", "b")


def _slices(name: str) -> list[str]:
    return [f"{name}-{k}" for k in range(SLICES)]


def _by_slices(store: Store, name: str, rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A step that treats each token alone, over one slice of the tokens after the other: the shuffle files of one go before the next."""
    done = []
    for k, part in enumerate(_slices(name)):
        done.append(store.table(part, step(rows.where(F.pmod("token", F.lit(SLICES)) == k))))
        store.drop()
    return reduce(DataFrame.union, done)


def _met_early(mixed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a token early enough in both prefixes.

    A pair shares at least l = min(l1, l2) tokens, so its rarest one has l - 1 shared ones behind it in both prefixes, and all
    that it shares stands from there on, which bounds the overlap by what is left of either set.
    Frequent tokens stand at the ends of prefixes and so bring no pair together, unless a prefix has nothing rarer. A member
    with the smaller l meets its partners under that l; members of the largest component never meet each other.
    """
    last = F.col("n") - F.floor((percent * F.col("n") + 99) / 100)  # place of the last token of a prefix with l = 1
    classes = F.array(*[F.lit(l) for l in CLASSES])
    own = mixed.where(F.col("pos") <= last).withColumn("under", F.array_max(F.filter(classes, lambda l: l <= F.col("l"))))
    allowed = F.filter(classes, lambda l: (l <= F.col("l")) & (F.col("pos") <= last + F.col("l") - l))
    other = mixed.withColumn("ahead", last + F.col("l") - F.col("pos")).withColumn("under", F.explode(allowed))
    pairs = []
    for one, two in ((own.where("comp <> bulk"), other), (own.where("comp = bulk"), other.where("comp <> bulk"))):
        x, y = one.alias("x"), two.alias("y")
        rule = (
            (F.col("x.token") == F.col("y.token")) & (F.col("x.under") == F.col("y.under")) & (F.col("x.comp") != F.col("y.comp"))
            & (F.col("y.l") >= F.col("x.l")) & (F.col("y.ahead") >= F.col("x.l"))
            & ((F.col("y.l") > F.col("x.l")) | (F.col("x.id") < F.col("y.id")) | (F.col("x.comp") == F.col("x.bulk")) | (F.col("y.comp") == F.col("y.bulk")))
            & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
            & ((100 + percent) * F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= percent * (F.col("x.n") + F.col("y.n")))
        )
        pairs.append(x.join(y, rule).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    return pairs[0].union(pairs[1]).distinct()


def _counted(pairs: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough, by the bounds of ``_possible``; tokens of one component's lists are shared by none of them."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    entries = F.array_sort(F.collect_list(F.struct("pos", "token")))
    heads = mixed.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.first("l").alias("l"), entries.alias("e"))
    one, two = (heads.select(F.col("id").alias(x), F.struct("n", "l", F.col("e.token").alias("token"), F.col("e.pos").alias("pos")).alias(f"h{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.array_intersect("ha.token", "hb.token")).where("size(shared) > 0")
    latest = F.element_at("shared", -1)
    rest = [F.col(f"h{x}.n") - F.element_at(F.col(f"h{x}.pos"), F.array_position(F.col(f"h{x}.token"), latest).cast("int")) for x in "ab"]
    most = F.size("shared") + F.least(*rest) - 1  # the pair cannot share more
    enough = (F.size("shared") >= F.least("ha.l", "hb.l")) & ((100 + percent) * most >= percent * (F.col("ha.n") + F.col("hb.n")))
    return both.where(enough).select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    store = Store(spark, "jaccard")
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    described = store.table("described", docs.mapInArrow(_describe(n), _SETS))
    sets = described.where("bucket IS NULL").select("id", "n", "f1", "f2")
    bitmaps = described.where("bucket IS NULL").select("id", "n", "bits")
    frequent = described.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("weight").alias("weight")).toPandas()
    heavy = spark.sparkContext.broadcast((frequent["bucket"].to_numpy(np.int64), frequent["weight"].to_numpy(np.int64)))  # at most BUCKETS

    classes = sets.where("id IS NOT NULL AND n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    classes = store.table("classes", classes)
    posts = store.table("posts", docs.mapInArrow(_postings(n, percent, heavy), "token long, id long, n int, l byte, pos int"))

    def shared_by_some(part: DataFrame) -> DataFrame:
        shared = part.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
        return part.join(shared.select("token"), "token", "left_semi").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")

    live = _by_slices(store, "live", posts, shared_by_some)
    store.drop("posts")

    # hubs: a few pairs for each member of a list, never all
    entry = F.struct("id", "n", "l", "pos")
    hubs = live.groupBy("token").agg(
        F.min(entry).alias("h1"), F.max(entry).alias("h2"), F.min_by(entry, F.xxhash64("id")).alias("h3")
    ).where("h1.id < h2.id")
    member = live.join(hubs, "token").select(entry.alias("x"), F.explode(F.array_distinct(F.array("h1", "h2", "h3"))).alias("y"))
    near = _possible(member.where("x.id <> y.id"), percent)
    links = _verified(store, docs, bitmaps, near, n, percent, "hubs")
    joined = components(store, links, "first")

    # exact: every list's pairs across components
    member = live.join(joined, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    member = store.table("member", member)
    bulk = member.groupBy("token", "comp").count().groupBy("token").agg(
        F.max_by("comp", F.struct("count", "comp")).alias("bulk"), F.count("*").alias("kinds")
    ).where("kinds > 1").select("token", "bulk")
    mixed = store.table("mixed", member.join(bulk, "token"))
    store.drop(*_slices("live"), "member")
    met = store.table("met", _by_slices(store, "met-early", mixed, lambda part: _met_early(part, percent)).distinct())
    store.drop(*_slices("met-early"))
    found = _counted(met, mixed, percent)
    rest = _verified(store, docs, bitmaps, found, n, percent, "rest")
    store.drop("mixed", "met")
    final = components(store, links.union(rest), "last")

    rows = sets.join(classes, ["f1", "f2"], "left").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("comp", "rep")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all documents that share nine tenths of their 3-word shingles."""
    return jaccard_components(read(spark, sf, "documents"), n=3, percent=90)

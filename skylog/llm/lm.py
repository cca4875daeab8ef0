"""Language-model scoring by deleted interpolation over word bigrams.

P(w | u) = l2[b] * c(u, w) / c(u) + l1[b] * c(w) / N + l0[b] / (V + 1), where b is the bucket of the context's
frequency (its binary logarithm). The weights l of each bucket are learned by expectation-maximisation on
held-out counts: for every training document its own counts are deleted from all counts, so each is predicted from
the rest of the corpus. All tokens of all training documents count; those of a bucket whose two estimates agree within
1 / ``FINE`` of an octave meet in one cell with their number and means, so a step reads cells, not tokens.
A bucket without tokens takes the weights of the nearest bucket that has some.

All counts are over all training documents:

1. words: counted with partial aggregation. The ``HOT`` most frequent (a fixed number) are broadcast.
2. bigrams of two words among the ``PAIRS`` most frequent are counted in a table of fixed size, which is
   broadcast too. Any bigram that makes up more than 1 / PAIRS of the corpus is among them, so no key below is hotter.
3. all other bigrams, and words outside the broadcast, are looked up by a shuffle: documents go in chunks of
   neighbouring rows; a chunk sends to each hash bucket one array of keys and gets back an array of counts in the
   same order. A bucket holds about ``KEYS`` keys at any corpus size, as their number follows the corpus.

Tokens are lower-cased (A-Z) words and one end per text. Defined cases: a null or empty text is the end alone;
no training rows: all counts are 0 and only the uniform part speaks; repeated rows are documents of their
own; null ids are scored, not learned from. Rows are numbered once and stored with their number, as a second
reading may split the files in another way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Store, hash_words, in_fold, listed, mix, read, signed, splitmix

HOT = 1 << 17
PAIRS = 512
KEYS = 1 << 22
CHUNK = 32  # documents that look up together
LEVELS = 48  # buckets of the context frequency
FINE = 4  # cells of an octave of an estimate
CELLS = 1 << 9  # more than FINE times the octaves of any estimate
STEPS = 30
CLOSE = 1e-3
END, BEGIN = splitmix(11), splitmix(12)


@dataclass
class Words:
    """What every task knows: corpus sizes and the most frequent words (sorted hashes, counts, ranks)."""

    tokens: int
    types: int
    documents: int
    hot: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    buckets: int
    side: int
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))


@dataclass
class Part:
    """Tokens of a few documents, with what has to be looked up, in lookup order."""

    tokens: np.ndarray
    before: np.ndarray  # context token
    offsets: np.ndarray
    known: np.ndarray  # place among the hot words, -1 if none
    pair: np.ndarray  # place in the pair table, -1 if none
    bigrams: np.ndarray
    keys: np.ndarray
    bucket: np.ndarray
    order: np.ndarray


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    words, offsets = hash_words(texts, lower=True)
    offsets = offsets + np.arange(len(offsets))
    tokens = np.empty(len(words) + len(texts), U64)
    last = np.zeros(len(tokens), bool)
    last[offsets[1:] - 1] = True
    tokens[~last] = words
    tokens[last] = END
    return tokens, offsets


def part_of(texts: list[str | None], words: Words) -> Part:
    tokens, offsets = _tokens(texts)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = BEGIN
    known = np.full(len(tokens), -1)
    rank = np.full(len(tokens), words.side)
    if len(words.hot):
        place = np.minimum(np.searchsorted(words.hot, tokens), len(words.hot) - 1)
        found = words.hot[place] == tokens
        known[found] = place[found]
        rank[found] = words.ranks[place[found]]
    context = np.empty_like(rank)
    context[1:] = rank[:-1]
    context[offsets[:-1]] = words.side  # the begin mark is the last row of the pair table
    begin = np.zeros(len(tokens), bool)
    begin[offsets[:-1]] = True
    dense = (rank < words.side) & ((context < words.side) | begin)
    pair = np.where(dense, np.minimum(context, words.side) * words.side + np.minimum(rank, words.side - 1), -1)
    bigrams = mix(before * U64(0x9E3779B97F4A7C15) + mix(tokens))
    keys = np.concatenate((bigrams[~dense], tokens[known < 0]))
    owner = np.concatenate((np.flatnonzero(~dense), np.flatnonzero(known < 0)))
    bucket = (mix(keys) % U64(words.buckets)).astype(np.int64)
    return Part(tokens, before, offsets, known, pair, bigrams, keys, bucket, np.stack((np.argsort(bucket, kind="stable"), owner)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            tokens, _ = _tokens(batch.column(0).slice(at, 2000).to_pylist())
            word, count = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(count.astype(np.int64))], names=["word", "n"])


def _count_pairs(shared):
    def run(batches):
        side = shared.value.side
        total = np.zeros((side + 1) * side, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                pair = part_of(batch.column(0).slice(at, 500).to_pylist(), shared.value).pair
                total += np.bincount(pair[pair >= 0], minlength=len(total))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "n"])

    return run


_ASKED = "bucket int, chunk long, first long, size int, keys array<long>, train array<boolean>"


def _ask(shared):
    """For neighbouring documents of one chunk: a row for each bucket with all keys that go there."""

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            train = batch.column(2).to_numpy(zero_copy_only=False)
            texts = batch.column(1)
            cuts = np.flatnonzero(np.diff(rows // CHUNK)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                part = part_of(texts.slice(a, b - a).to_pylist(), shared.value)
                order, owner = part.order
                doc = np.searchsorted(part.offsets, owner, side="right") - 1
                bucket, lengths = np.unique(part.bucket, return_counts=True)
                many = len(bucket)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.astype(np.int32)), pa.array(np.full(many, rows[a] // CHUNK)), pa.array(np.full(many, rows[a])),
                     pa.array(np.full(many, b - a, np.int32)), listed(signed(part.keys[order]), lengths, pa.int64()),
                     listed(train[a:b][doc[order]], lengths, pa.bool_())],
                    names=[x.split()[0] for x in _ASKED.split(", ")],
                )

    return run


_TOLD = "bucket int, chunk long, first long, size int, counts array<int>"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts keys bucket by bucket (rows come sorted by it) and sends them back in place."""
    held: list[pa.RecordBatch] = []

    def told() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: table[c].chunk(0)
        keys, train = column("keys"), column("train")
        flat, weight = keys.flatten().to_numpy(), train.flatten().to_numpy(zero_copy_only=False)
        _, place = np.unique(flat, return_inverse=True)
        counts = np.bincount(place, weights=weight).astype(np.int32)[place] if len(flat) else np.zeros(0, np.int32)
        lengths = np.diff(keys.offsets.to_numpy())
        return pa.RecordBatch.from_arrays(
            [*(column(c) for c in ("bucket", "chunk", "first", "size")), listed(counts, lengths, pa.int32())],
            names=[x.split()[0] for x in _TOLD.split(", ")],
        )

    for batch in batches:
        buckets = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(buckets)]):
            if held and held[0].column(0)[0].as_py() != buckets[a]:
                yield told()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield told()


@dataclass
class Counted:
    part: Part
    word: np.ndarray  # c(w)
    context: np.ndarray  # c(u)
    bigram: np.ndarray  # c(u, w)


def _counted(texts: list, told: dict[int, list[int]], words: Words) -> Counted:
    part = part_of(texts, words)
    order, owner = part.order
    found = np.zeros(len(part.keys), np.int64)
    answers = [told[b] for b in sorted(told)]
    if answers:
        found[order] = np.concatenate(answers)
    rare = int((part.pair < 0).sum())
    bigram = np.zeros(len(part.tokens), np.int64)
    dense = part.pair >= 0
    bigram[dense] = words.pairs[part.pair[dense]]
    bigram[owner[:rare]] = found[:rare]
    word = np.zeros(len(part.tokens), np.int64)
    hot = part.known >= 0
    word[hot] = words.counts[part.known[hot]]
    word[owner[rare:]] = found[rare:]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[part.offsets[:-1]] = words.documents
    return Counted(part, word, context, bigram)


def _segments(row: dict, words: Words) -> Iterator[tuple[list[dict], Counted]]:
    """Documents of a chunk in the groups that asked together."""
    docs = sorted(row["docs"], key=lambda d: d["row"])
    asked: dict[int, tuple[int, dict]] = {}
    for t in row["told"] or ():
        asked.setdefault(t["first"], (t["size"], {}))[1][t["bucket"]] = t["counts"]
    done = set()
    for first, (size, told) in asked.items():
        own = [d for d in docs if first <= d["row"] < first + size]
        done |= {d["row"] for d in own}
        yield own, _counted([d["text"] for d in own], told, words)
    if rest := [d for d in docs if d["row"] not in done]:  # nothing to look up
        yield rest, _counted([d["text"] for d in rest], {}, words)


def _level(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), LEVELS - 1)


def _times(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each value occurs in its own document."""
    _, place, count = np.unique(mix(values + mix(owner.astype(U64) + U64(1))), return_inverse=True, return_counts=True)
    return count[place]


class Cells:
    """Number and sums of (c(u,w)/c(u), c(w)/N) by bucket and cell."""

    ROOM = 1 << 20  # tokens that wait to be summed

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, level: np.ndarray, two: np.ndarray, one: np.ndarray) -> None:
        place = (level * CELLS + _cell(two)) * CELLS + _cell(one)
        self.parts.append((place, np.ones(len(place), np.int64), two, one))
        self.waiting += len(place)
        if self.waiting > self.ROOM:
            self.sum()

    def sum(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        place, n, two, one = (np.concatenate(x) for x in zip(*self.parts))
        cells, at = np.unique(place, return_inverse=True)
        many = len(cells)
        whole = np.bincount(at, weights=n, minlength=many).astype(np.int64)
        self.parts = [(cells, whole, np.bincount(at, weights=two, minlength=many), np.bincount(at, weights=one, minlength=many))]
        self.waiting = 0
        return self.parts[0]


def _cell(estimate: np.ndarray) -> np.ndarray:
    octaves = -np.log2(np.where(estimate > 0, estimate, 1.0))
    return np.where(estimate > 0, np.clip(octaves * FINE, 0, CELLS - 2).astype(np.int64) + 1, 0)


def _deleted(c: Counted, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, c(u,w)/c(u) and c(w)/N of each token, with its own document's counts deleted."""
    lengths = np.diff(c.part.offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    own = _times(c.part.tokens, owner)
    own_context = np.empty_like(own)
    own_context[1:] = own[:-1]
    own_context[c.part.offsets[:-1]] = 1
    context = np.maximum(c.context - own_context, 0)
    two = (c.bigram - _times(c.part.bigrams, owner)) / np.maximum(context, 1)
    one = (c.word - own) / np.maximum(words.tokens - lengths[owner], 1)
    return _level(context), np.maximum(two, 0), np.maximum(one, 0)


_PLACED = "train boolean, words array<int>, bigrams array<int>, place long, n long, two double, one double"


def _placed(shared):
    """Each document with what its counts are, then the task's cells of training tokens.

    A count that every task knows is stored as -1 - its place, any other as itself.
    """

    def run(batches):
        words, cells, kind = shared.value, Cells(), None
        names = ["doc_id", *(x.split()[0] for x in _PLACED.split(", "))]
        for batch in batches:
            kind = batch.schema.field("docs").type.value_type.field("doc_id").type
            for row in batch.to_pylist():
                for docs, c in _segments(row, words):
                    lengths, many = np.diff(c.part.offsets), len(docs)
                    train = np.array([bool(d["train"]) for d in docs])
                    if train.any():
                        used = np.repeat(train, lengths)
                        cells.add(*(x[used] for x in _deleted(c, words)))
                    word = np.where(c.part.known >= 0, -1 - c.part.known, c.word).astype(np.int32)
                    bigram = np.where(c.part.pair >= 0, -1 - c.part.pair, c.bigram).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d["doc_id"] for d in docs], kind), pa.array(train), listed(word, lengths, pa.int32()), listed(bigram, lengths, pa.int32()),
                         *(pa.nulls(many, pa.int64()) for _ in range(2)), *(pa.nulls(many, pa.float64()) for _ in range(2))], names=names,
                    )
        place, n, two, one = cells.sum()
        if len(place):
            many = len(place)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(many, kind), pa.nulls(many, pa.bool_()), *(pa.nulls(many, pa.list_(pa.int32())) for _ in range(2)),
                 pa.array(place), pa.array(n), pa.array(two), pa.array(one)], names=names,
            )

    return run


def _expect(weights: np.ndarray, uniform: float):
    """Sums of each component's responsibility by level."""

    def run(batches):
        total = np.zeros((LEVELS, 3))
        for batch in batches:
            place, n, two, one = (batch.column(k).to_numpy() for k in range(4))
            level = place // (CELLS * CELLS)
            share = weights[level] * np.stack((two / n, one / n, np.full(len(n), uniform)), axis=1)
            share *= (n / share.sum(axis=1))[:, None]
            for k in range(3):
                total[:, k] += np.bincount(level, weights=share[:, k], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(LEVELS, dtype=np.int32)), *(pa.array(total[:, k].copy()) for k in range(3))], names=["level", "s0", "s1", "s2"]
        )

    return run


START = (0.4, 0.4, 0.2)


def maximise(tuples: DataFrame, uniform: float) -> np.ndarray:
    """Mixture weights by level from (place, n, two, one); only LEVELS sums come to the driver in a step."""
    weights, known = np.tile(START, (LEVELS, 1)), np.zeros(LEVELS, bool)
    for _ in range(STEPS):
        sums = tuples.mapInArrow(_expect(weights, uniform), "level int, s0 double, s1 double, s2 double")
        new = weights.copy()
        for r in sums.groupBy("level").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(3))).collect():
            total = np.array([r["s0"], r["s1"], r["s2"]])
            if total.sum() > 0:
                known[r["level"]] = True
                new[r["level"]] = (total + 1e-6) / (total + 1e-6).sum()  # no weight becomes 0
        change, weights = np.abs(new - weights).max(), new
        if change < CLOSE:
            break
    have = np.flatnonzero(known)
    for b in np.flatnonzero(~known) if len(have) else ():
        weights[b] = weights[have[np.abs(have - b).argmin()]]
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]  # an unseen context says nothing
    return weights


_SCORED = "train boolean, n_tokens long, n_known long, base_score double, score double"
TOKENS = 1 << 18  # scored at once; a longer text is scored alone


def _score(shared):
    def run(batches):
        words = shared.value
        room = words.tokens + words.types + 1
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1)
                part, at = batch.slice(at, upto - at), upto
                word, bigram = part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy().astype(np.int64)
                lengths = np.diff(part.column(2).offsets.to_numpy())
                starts = np.cumsum(lengths) - lengths
                known, dense = word < 0, bigram < 0
                word[known] = words.counts[-1 - word[known]]
                bigram[dense] = words.pairs[-1 - bigram[dense]]
                context = np.empty_like(word)
                context[1:] = word[:-1]
                context[starts] = words.documents
                l = words.weights[_level(context)]
                p = l[:, 0] * bigram / np.maximum(context, 1) + l[:, 1] * word / max(words.tokens, 1) + l[:, 2] / (words.types + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lengths.astype(np.int64)),
                     pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)),
                     pa.array(np.add.reduceat(np.log10((word + 1) / room), starts)), pa.array(np.add.reduceat(np.log10(p), starts))],
                    names=["doc_id", *(x.split()[0] for x in _SCORED.split(", "))],
                )

    return run


def score(docs: DataFrame, train, text: str = "text", doc_id: str = "doc_id",
          hot_words: int = HOT, side: int = PAIRS, keys: int = KEYS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score; ``train`` is a condition on ``docs``."""
    spark = docs.sparkSession
    store = Store(spark, "lm", "zstd")
    context = spark.sparkContext
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), train.alias("train")
    )
    rows = store.table("rows", rows)
    learned = rows.where("train").select("text")
    counts = store.table("words", learned.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == signed(np.array([END], U64))[0].item(), F.col("n"))).alias("d")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(hot_words).toPandas()
    hot = top["word"].to_numpy(np.int64).view(U64)
    order = np.argsort(hot)
    rows_in = rows.select("row").count()
    buckets = max(1, int((total["n"] or 0) // keys) + 1, rows_in // keys)
    words = Words(total["n"] or 0, total["v"], total["d"] or 0, hot[order], top["n"].to_numpy(np.int64)[order], order, buckets, side)
    shared = context.broadcast(words)

    pairs = learned.mapInArrow(_count_pairs(shared), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((side + 1) * side, np.int64)
    table[pairs["place"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    words.pairs = table

    asked = rows.select("row", "text", "train").mapInArrow(_ask(shared), _ASKED)
    told = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, _TOLD)
    told = store.table("told", told)
    store.drop("words")
    chunk = F.floor(F.col("row") / CHUNK).cast("long").alias("chunk")
    grouped = told.groupBy("chunk").agg(F.collect_list(F.struct("first", "size", "bucket", "counts")).alias("told"))
    texts = rows.groupBy(chunk).agg(F.collect_list(F.struct("row", "doc_id", "text", "train")).alias("docs"))

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = texts.join(grouped, "chunk", "left").select("docs", "told")
    placed = placed.mapInArrow(_placed(context.broadcast(words)), f"doc_id {kind}, {_PLACED}")
    placed = store.table("placed", placed)
    store.drop("told", "rows")
    cells = placed.where("place IS NOT NULL").groupBy("place").agg(*(F.sum(c).alias(c) for c in ("n", "two", "one")))
    words.weights = maximise(store.table("cells", cells), 1 / (words.types + 1))
    scored = placed.where("place IS NULL").select("doc_id", "train", "words", "bigrams")
    scored = scored.mapInArrow(_score(context.broadcast(words)), f"doc_id {kind}, {_SCORED}")
    return scored.withColumn("train_tokens", F.lit(words.tokens).cast("long"))


def held_out(doc_id):
    return in_fold(doc_id, 7, 2)


def op2_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    """The model's and the base score of every document, learned from six of seven folds."""
    found = score(read(spark, sf, "documents"), ~held_out(F.col("doc_id")))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Hard negatives by exact integer scores, several candidates in one multiplication (Kronecker packing).

A component x counts as floor(256 * x). The components of several candidates, made non-negative by a bias, sit in
separate fields of one 64-bit integer; one multiplication by the anchor's component serves all of them, and the sum over
the components holds every score in its own field. A field is as wide as the largest score can be (from the
bounds of the table), so fields never touch and scores are exact. Where a field needs over 63 bits, integers of any width are used.

Anchors are a stated query set, compared with all rows in blocks: a cell holds one block of anchors and one stripe of the rows, goes to
one task, keeps its anchors and reads its rows as a stream in the order of their ids, so memory is bounded by the block. Two
passes: the best rows of the same label (only products of equal labels), then the best rows below each of them.
Each cell gives a few rows an anchor; windows keep the best of all cells. The rows are numbered once and stored.

Defined cases: a null id, label, vector or component, a component that is not finite, or a vector whose score with itself exceeds
2**62 (a score would not fit): the row takes no part. Vectors of unequal length are compared on their common part. Repeated rows are
rows of their own, but a row with the anchor's id is never its positive or negative. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, read

SCALE = 256
WORD_BITS = 63
BLOCK = 1 << 21  # components of a block of anchors, and of the rows multiplied at once
ANCHORS = 2048  # most anchors of a block
ROWS = (1 << 11, 1 << 21)  # of a stripe: least, where there are enough cells for all cores, and most
FIRST, CHUNK = 64, 3072  # rows multiplied at first, when every row may be among the best, and later

ROW = "row long, vec_id long, label int, parts array<long>"
FOUND = "row long, slot int, vec_id long, score long"


class Packing:
    """Fields for the scores of vectors within known bounds.

    ``lowest`` and ``highest`` bound every component, ``reach`` the sum of an anchor's absolute components.
    """

    def __init__(self, lowest: int, highest: int, reach: int):
        self.bias = -min(lowest, 0)
        self.start = reach * (max(highest, 0) + self.bias)  # keeps every partial sum of a field positive
        self.width = (2 * self.start).bit_length() + 1
        self.fields = max(1, WORD_BITS // self.width)
        self.wide = self.width > WORD_BITS

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Rows (number, components) as words (components, number of words)."""
        kind = object if self.wide else np.int64
        words = -(-len(rows) // self.fields)
        full = np.zeros((words * self.fields, rows.shape[1]), kind)
        full[: len(rows)] = rows.astype(kind) + self.bias
        packed = np.zeros((words, rows.shape[1]), kind)
        for j in range(self.fields):
            packed += full[j * words : (j + 1) * words] << (j * self.width)
        return packed.T

    def scores(self, anchors: np.ndarray, packed: np.ndarray, count: int) -> np.ndarray:
        """Exact inner products (anchors, rows) from one product of anchors and words."""
        kind = packed.dtype
        offset = sum(self.start << (j * self.width) for j in range(self.fields))
        sums = anchors.astype(kind) @ packed + (offset if self.wide else np.int64(offset))
        mask = (1 << self.width) - 1
        fields = [(sums >> (j * self.width)) & mask for j in range(self.fields)]
        plain = np.concatenate(fields, axis=1)[:, :count] - self.start
        return (plain - self.bias * anchors.astype(kind).sum(axis=1)[:, None]).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List rows as a matrix, padded with zeros."""
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = np.asarray(column.values)[offsets[0] : offsets[-1]]
    return out


class Best:
    """The best k rows of each of many lists, fed in the order of the rows' ids: an equal score comes later and loses."""

    def __init__(self, lists: int, k: int, floor: np.ndarray):
        self.k, self.bound = k, floor.copy()  # a row must exceed its list's bound
        self.found = [np.zeros(0, np.int64)] * 3  # list, score, id: best first within a list

    def feed(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        lists, scores, ids = (np.concatenate([a, b]) for a, b in zip(self.found, (lists, scores, ids)))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        keep = place < self.k
        last = place == self.k - 1
        self.bound[lists[last]] = scores[last]
        self.found = [lists[keep], scores[keep], ids[keep]]


def _ask(work: Iterator[tuple], packing: Packing, width: int, top: int, negatives: bool) -> Iterator[pa.RecordBatch]:
    """The best rows of each anchor and slot of one cell; ``work`` gives the anchors, then the rows in the order of their ids."""
    rows, ids, labels, parts, low, high = next(work)
    slots = low.shape[1]
    # positives have the one slot; a bound below every score
    best = Best(len(rows) * slots, top, (low - 1).ravel() if negatives else np.full(len(rows), np.iinfo(np.int64).min))
    groups = {} if negatives else {x: np.flatnonzero(labels == x) for x in np.unique(labels).tolist()}
    everyone = np.arange(len(rows))
    seen = 0
    for c_ids, c_labels, c_parts in work:
        at = 0
        while at < len(c_ids):
            size = min(FIRST if seen < 2 * FIRST else CHUNK, max(1, BLOCK // max(width, 1)))
            chunk = slice(at, at + size)
            at, seen = at + size, seen + size
            i, l, p = c_ids[chunk], c_labels[chunk], c_parts[chunk]
            parts_of = [(everyone, np.arange(len(i)))] if negatives else [(groups[x], np.flatnonzero(l == x)) for x in np.unique(l).tolist() if x in groups]
            for who, what in parts_of:
                scores = packing.scores(parts[who], packing.pack(p[what]), len(what))
                fits = ids[who][:, None] != i[what][None, :]
                if negatives:
                    fits &= labels[who][:, None] != l[what][None, :]
                for slot in range(slots):
                    mine = who * slots + slot
                    good = fits & (scores > best.bound[mine][:, None])
                    if negatives:
                        good &= scores <= high[who, slot][:, None]
                    a, c = np.nonzero(good)
                    best.feed(mine[a], scores[a, c], i[what][c])
    lists, scores, found = best.found
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows[lists // slots]), pa.array((lists % slots).astype(np.int32)), pa.array(found), pa.array(scores)],
        names=["row", "slot", "vec_id", "score"],
    )


def _cells(packing: Packing, width: int, top: int, negatives: bool, low: int, high: int):
    """Reads partitions sorted by (cell, part, vec_id), the anchors (part 0) of a cell first."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            cell, part = (np.asarray(batch.column(batch.schema.get_field_index(x))) for x in ("cell", "part"))
            cuts = np.flatnonzero((np.diff(cell, prepend=cell[:1]) != 0) | (np.diff(part, prepend=part[:1]) != 0))
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a:
                    yield int(cell[a]), int(part[a]), batch.slice(a, b - a)

    def values(batch: pa.RecordBatch) -> tuple:
        get = lambda name: np.asarray(batch.column(batch.schema.get_field_index(name)))
        return get("row"), get("vec_id"), get("label"), _matrix(batch.column(batch.schema.get_field_index("parts")), width)

    def limits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each slot from its positive's score; a slot that is not used has none between."""
        scores = [x or [] for x in batch.column(batch.schema.get_field_index("against")).to_pylist()]
        slots = max([1, *map(len, scores)])
        least, most = np.ones((len(scores), slots), np.int64), np.zeros((len(scores), slots), np.int64)
        for k, own in enumerate(scores):
            for slot, score in enumerate(own):
                least[k, slot], most[k, slot] = -((-score * low) // 100), score * high // 100
        return least, most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = pieces(batches)
        ahead = next(stream, None)
        while ahead is not None:
            cell, held = ahead[0], []
            while ahead is not None and ahead[:2] == (cell, 0):
                held.append((*values(ahead[2]), *limits(ahead[2])))
                ahead = next(stream, None)

            def rows():
                nonlocal ahead
                most = max(x[4].shape[1] for x in held)
                fit = lambda x, v: np.pad(x, ((0, 0), (0, most - x.shape[1])), constant_values=v)
                whole = [np.concatenate(x) for x in zip(*[x[:4] for x in held])]
                yield (*whole, np.concatenate([fit(x[4], 1) for x in held]), np.concatenate([fit(x[5], 0) for x in held]))
                while ahead is not None and ahead[0] == cell:
                    yield values(ahead[2])[1:]
                    ahead = next(stream, None)

            if held:
                yield from _ask(rows(), packing, width, top, negatives)
            while ahead is not None and ahead[0] == cell:  # rows of a cell without anchors
                ahead = next(stream, None)

    return run


def usable(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label and integer parts of the rows that take part."""
    table = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("int").alias("label"),
        F.transform(F.col(f"`{vector_col}`"), lambda x: SCALE * x.cast("double")).alias("vector"),
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) + 1, F.lit(2.0)))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    return table.where(whole & ~bad & (square < 2.0**62)).select("vec_id", "label", F.transform("vector", lambda x: F.floor(x)).alias("parts"))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, parts) for which ``anchor`` holds.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor's ``positives`` best rows of its label,
    the ``negatives`` best rows of other labels that score from ``low`` to ``high`` percent of the positive.
    """
    spark = rows.sparkSession
    store = Store(spark, "negatives")
    table = store.table("rows", rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "parts", anchor.alias("asks")))
    reach = F.when(F.col("asks"), F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + F.abs(x)))
    known = table.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("asks"), 1)).alias("anchors"), F.max(F.size("parts")).alias("width"),
        F.min(F.array_min("parts")).alias("low"), F.max(F.array_max("parts")).alias("high"), F.max(reach).alias("reach"),
    ).first()
    width = known["width"] or 0
    packing = Packing(known["low"] or 0, known["high"] or 0, known["reach"] or 0)
    blocks = max(1, -(-known["anchors"] // max(1, min(ANCHORS, BLOCK // max(width, 1)))))
    spread = -(-4 * spark.sparkContext.defaultParallelism // blocks)
    stripes = max(1, -(-known["rows"] // ROWS[1]), min(-(-known["rows"] // ROWS[0]), spread))

    def ask(asking: DataFrame, top: int, second: bool) -> DataFrame:
        """Best rows of all cells for each anchor and slot; ``asking`` has the anchors, ``against`` the scores of its slots."""
        part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        names = ["row", "vec_id", "label", "parts", "against"]
        left = asking.select(*names, part(blocks).alias("block"), every(stripes).alias("stripe"), F.lit(0).alias("part"))
        others = table.withColumn("against", F.lit(None).cast("array<long>"))
        right = others.select(*names, every(blocks).alias("block"), part(stripes).alias("stripe"), F.lit(1).alias("part"))
        cells = left.unionByName(right).withColumn("cell", (F.col("block") * stripes + F.col("stripe")).cast("int")).drop("block", "stripe")
        dealt = cells.repartitionById(blocks * stripes, F.col("cell")).sortWithinPartitions("cell", "part", "vec_id")
        best = dealt.mapInArrow(_cells(packing, width, top, second, low, high), FOUND)
        order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    anchors = table.where("asks")
    first = ask(anchors.withColumn("against", F.lit(None).cast("array<long>")), positives, False)
    slot = F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    slots = first.groupBy("row").agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    asking = store.table("asking", anchors.join(slots, "row").withColumn("against", F.col("slots.positive_score")))
    found = ask(asking, negatives, True).join(asking.select("row", F.col("vec_id").alias("anchor_id"), "slots"), "row")
    own = F.col("slots")[F.col("slot")]
    return found.select(
        "anchor_id", own["positive_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        own["positive_score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Three hard negatives of each positive of each anchor (ids divisible by 50); every seventh id has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(read(spark, sf, "embeddings")).withColumn("label", label)
    return mine(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 3
"""

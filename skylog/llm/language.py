"""Language identification with language-bitmask n-gram filters.

The model is one bit-sliced Bloom filter: row ``r`` holds a bitmask with one bit per language, so one
probe of an n-gram returns every language that has it (the AND of its rows). A text's n-grams are
probed once; each language's popcount is corrected for that language's false-positive rate
``(fill ** hashes)``, and the largest corrected count decides.

An n-gram belongs to every language in which its rate is at least ``share`` of its highest rate. The
filter is learned from at most about ``per_language`` labelled texts of each language, chosen by the
hash of their id (the documented bound of the sample); it has a fixed number of rows, so what is
collected and broadcast does not grow with the corpus.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a text whose n-grams no
language has (or a tie) gets the first best language in order of code; rows without ``lang`` teach
nothing; with no labelled row at all every text is ``und``. Repeated rows are answered alike. Columns
named ``lang_pred`` or ``score`` are replaced, all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Store, in_fold, mix, read, signed

UNKNOWN = "und"
ORDERS = (2, 3, 4)
ROWS = 1 << 19
PER_LANGUAGE = 3000
SHARE = 0.2
PIECE = 1 << 17  # code points looked at together

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


@dataclass
class Model:
    """Languages in order of code, the filter's rows (ROWS x words of 64 languages), fill per language."""

    languages: list[str]
    rows: np.ndarray
    false_rate: np.ndarray


def _symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points; every run of other characters, and both ends, is one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[points]
    kept = np.where(letter, points, 0).astype(U64)
    inner = kept[letter | np.concatenate(([False], letter[:-1]))] if len(kept) else kept
    return np.concatenate((np.zeros(1, U64), inner, np.zeros(1, U64)))


def grams(symbols: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams that cross no gap between words (a gap may be their first or last sign)."""
    found = []
    for n in ORDERS:
        count = len(symbols) - n + 1
        if count < 1:
            continue
        value = np.full(count, n, dtype=U64)
        for i in range(n):
            value = value * U64(0x1F0A2BE71D163FA1) + symbols[i : i + count]
        ok = symbols[:count] + symbols[n - 1 : n - 1 + count] > 0
        for i in range(1, n - 1):
            ok &= symbols[i : i + count] > 0
        found.append(mix(value[ok]))
    return np.concatenate(found) if found else np.empty(0, U64)


def _pieces(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """Long texts in pieces that overlap by one n-gram less one sign, so that no n-gram is lost."""
    at = 0
    while True:
        yield symbols[at : at + PIECE]
        at += PIECE
        if at >= len(symbols):
            return


def _probes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (gram & U64(ROWS - 1)).astype(np.int64), ((gram >> U64(40)) & U64(ROWS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list[np.ndarray]] = {}
        for language, text in zip(languages, texts):
            for piece in _pieces(_symbols(text)):
                by.setdefault(language, []).append(grams(piece))
        for language, found in by.items():
            gram, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(gram), pa.string()), pa.array(signed(gram)), pa.array(count.astype(np.int64))],
                names=["language", "gram", "n"],
            )


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          per_language: int = PER_LANGUAGE, share: float = SHARE) -> Model:
    """The model from labelled rows; about ``per_language`` texts of each language are read."""
    rows = labelled.select(F.col(lang).alias("language"), F.col(text).alias("text"), F.col(doc_id).alias("id"))
    rows = rows.where(F.col("language").isNotNull() & F.col("text").isNotNull())
    sizes = {r["language"]: r["count"] for r in rows.groupBy("language").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((ROWS, 1), np.int64), np.zeros(0))
    span = 1 << 30
    limit = F.create_map(*[F.lit(x) for k in languages for x in (k, min(span, span * per_language // sizes[k] + 1))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(span)) < limit[F.col("language")])
    counts = sample.select("language", "text").mapInArrow(_count, "language string, gram long, n long")
    counts = counts.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    counts = Store(labelled.sparkSession, "language").table("counts", counts)
    totals = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    total = F.create_map(*[F.lit(x) for k in languages for x in (k, float(totals.get(k, 1)))])
    rates = counts.select("gram", number[F.col("language")].alias("number"), (F.col("n") / total[F.col("language")]).alias("rate"))
    # one entry per language and n-gram: a group has as many entries as there are languages
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("number", "rate")).alias("all"))
    held = best.select("gram", "best", F.explode("all").alias("x")).where(F.col("x.rate") >= share * F.col("best"))
    places = F.array(F.col("gram").bitwiseAND(ROWS - 1), F.shiftrightunsigned("gram", 40).bitwiseAND(ROWS - 1))
    bit = F.expr("shiftleft(1L, cast(number % 64 AS INT))")
    bits = (
        held.select(F.explode(places).alias("row"), F.col("x.number").alias("number"))
        .groupBy("row", F.floor(F.col("number") / 64).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("mask"))
    ).toPandas()
    table = np.zeros((ROWS, (len(languages) + 63) // 64), np.int64)
    table[bits["row"], bits["word"]] = bits["mask"]
    fill = np.array([np.count_nonzero(table[:, i // 64] & np.int64(_bit(i))) / ROWS for i in range(len(languages))])
    return Model(languages, table, fill**2)


def _bit(i: int) -> int:
    value = 1 << (i % 64)
    return value - (1 << 64) if i % 64 == 63 else value


def decide(model: Model, text: str | None) -> tuple[str, float]:
    """Language and score: the winner's share of n-grams after correction for false positives."""
    if text is None or not model.languages:
        return UNKNOWN, 0.0
    symbols = _symbols(text)
    if not symbols.any():
        return UNKNOWN, 0.0
    hits, total = np.zeros(len(model.languages), np.int64), 0
    for piece in _pieces(symbols):
        gram = grams(piece)
        total += len(gram)
        first, second = _probes(gram)
        masks = model.rows[first] & model.rows[second]
        for word in range(masks.shape[1]):
            values, counts = np.unique(masks[:, word], return_counts=True) if masks.shape[0] else ([], [])
            for value, count in zip(values, counts):
                for i in range(64 * word, min(64 * word + 64, len(model.languages))):
                    if value & np.int64(_bit(i)):
                        hits[i] += count
    share = (hits / max(total, 1) - model.false_rate) / np.maximum(1e-9, 1 - model.false_rate)
    best = int(np.argmax(share))
    return model.languages[best], float(min(1.0, max(0.0, share[best])))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: ROWS masks

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([decide(shared.value, x) for x in texts], columns=["lang_pred", "score"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*[F.col(f"`{c}`") for c in names], predict(F.col(f"`{text}`")).alias("_found"))
    return found.select(*[F.col(f"`{c}`") for c in names], "_found.lang_pred", "_found.score")


def held_out(doc_id: Column) -> Column:
    return in_fold(doc_id, 5, 0)


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document; nothing is learned from the held-out fifth."""
    docs = read(spark, sf, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

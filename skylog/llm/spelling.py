"""Spelling variants: words one edit apart, found by asymmetric chunks and positional grams.

1. Words are counted over all texts. 2. A word of L code points owns two disjoint chunks, its halves; one edit leaves one of
them whole, and the half that holds the edit is chunked once more, so three of its four quarters are whole. The other
word, of L or L + 1 code points, answers with its grams of the same lengths at the same places, those
behind the edit shifted by the difference of the lengths (none or one). 3. Both sides meet in one equi-join on (L, shift, quarter,
whole text) and the pair is verified on the quarter that is left. Of the quarters that can hold the edit of a pair only one
is taken, the one where the words first part, so each pair comes once and nothing has to be made distinct.
4. A word's form is the most frequent of its near words, if at least twice as frequent; forms are followed to
the root by doubling pointers, one stored table a round, so a chain of c steps takes log2(c) rounds.

A key holds three quarters of a word, so it is shared by few words; where many share one, the join splits it (adaptive skew join).
Both sides of that join are shuffled at any size: neither is broadcast.
Everything is DataFrame operations.

Defined cases: a null text has no words; with a null id nothing is deleted; repeated rows count again; a text without words or an
empty table gives no rows; ties of near words go to the smallest in code-point order. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, lower_ascii, read

LEAST_LENGTH = 5
LEAST_COUNT = 3
FACTOR = 2  # a form is at least so many times as frequent
DAMAGE = 97  # one run in so many loses a code point
QUARTERS = 4


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, each run damaged as its crc32 says."""
    # a run shorter than a word can't become one
    runs = F.regexp_extract_all(lower_ascii(F.col(f"`{text_col}`")), F.lit(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(runs).alias("run"))
    code = F.crc32(F.concat_ws(":", "id", "run"))
    at = (code % F.char_length("run")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("id").isNotNull() & (code % DAMAGE == 0), left).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _bounds(length: Column) -> list[Column]:
    """Where the quarters of a word of this length begin, and its end: the halves of both halves."""
    half = F.floor(length / 2)
    return [F.lit(0).cast("long"), F.floor(half / 2), half, half + F.floor((length - half) / 2), length.cast("long")]


def _sent(words: DataFrame, gram: bool) -> DataFrame:
    """The keys of each word: as owner of the chunks, or (``gram``) as the other, equally long or longer by one."""
    keys = []
    for shift in (0, 1):
        owner = F.char_length("word") - (shift if gram else 0)
        bounds = _bounds(owner)
        for k in range(QUARTERS):
            start, end = bounds[k], bounds[k + 1]
            before = F.substring(F.col("word"), F.lit(1), start.cast("int"))
            after = F.substring(F.col("word"), (end + 1 + (shift if gram else 0)).cast("int"), F.char_length("word"))
            piece = F.substring(F.col("word"), (start + 1).cast("int"), (end - start + (shift if gram else 0)).cast("int"))
            keys.append(F.struct(
                owner.cast("int").alias("length"), F.lit(shift).alias("shift"), F.lit(k).alias("quarter"),
                F.concat(before, after).alias("whole"), piece.alias("piece"),
            ))
    sent = words.select("word", "n", F.explode(F.array(*keys)).alias("key")).select("word", "n", "key.*")
    return sent.where(F.col("length") >= LEAST_LENGTH)


def near_pairs(words: DataFrame) -> DataFrame:
    """(short, short_n, long, long_n): every pair of words one edit apart, once. Words are distinct."""
    owners = _sent(words, gram=False).withColumnsRenamed({"word": "short", "n": "short_n", "piece": "short_piece"})
    others = _sent(words, gram=True).withColumnsRenamed({"word": "long", "n": "long_n", "piece": "long_piece"})
    # Spark sizes the exploded keys as the words alone, eight times too low, and would broadcast them through the driver
    met = owners.hint("merge").join(others.hint("merge"), ["length", "shift", "quarter", "whole"])
    same_length = (F.col("shift") == 0) & (F.col("short") < F.col("long"))
    # inserted behind this quarter: the next one finds the pair
    parts_here = (F.col("quarter") == QUARTERS - 1) | ~F.col("long_piece").startswith(F.col("short_piece"))
    near = F.levenshtein("short_piece", "long_piece") == 1
    return met.where((same_length | ((F.col("shift") == 1) & parts_here)) & near).select("short", "short_n", "long", "long_n")


def roots(links: DataFrame, store: Store) -> DataFrame:
    """(word, root) from (word, form), which has no cycle: forms followed to the last."""
    have = store.table("round-0", links.select("word", F.col("form").alias("root")))
    done = 0
    while True:
        ahead = have.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = have.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        done += 1
        table = store.table(f"round-{done}", moved)
        have = table.select("word", "root")
        if table.where("moved").isEmpty():
            return have


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with their counts n."""
    store = Store(words.sparkSession, "spelling")
    words = store.table("words", words.select("word", "n"))
    pairs = near_pairs(words)
    ends = [("short", "long"), ("long", "short")]
    both = F.array(*[F.struct(F.col(a).alias("word"), F.col(f"{b}_n").alias("near_n"), F.col(b).alias("near")) for a, b in ends])
    best = pairs.select(F.explode(both).alias("x")).select("x.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    rows = words.join(best, "word", "left")
    chosen = -F.col("best.minus") >= factor * F.col("n")
    rows = store.table("forms", rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.minus")).alias("form_n"),
    ))
    last = roots(rows.where("form IS NOT NULL"), store)
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the documents with its near words' number, its form and its root."""
    return variants(count_words(read(spark, sf, "documents")))


def _crc_table() -> str:
    """SQL for the 256 remainders of CRC-32, by its rule."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor(3988292384, {0} >> 1) ELSE {0} >> 1 END"
    inner = "i0"
    chain = "SELECT i AS i0, i FROM range(256) t(i)"
    for k in range(8):
        chain = f"SELECT {step.format('i0')} AS i0, i FROM ({chain})"
    return f"SELECT list({inner} ORDER BY i) AS t FROM ({chain})"


OP13_SQL = rf"""
WITH RECURSIVE crc AS ({_crc_table()}),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL
), coded AS (
  SELECT run, c, coalesce(xor(4294967295, list_reduce(
    list_transform(range(strlen(doc_id || ':' || run)), lambda k: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * k + 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)), 1) AS h FROM each, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM coded
), v AS (
  SELECT word, sum(c)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), less AS (
  SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)
), pairs AS (
  SELECT a.word AS x, b.word AS y, b.n AS m FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word
), best AS (
  SELECT x, count(*) AS n_near, first(y ORDER BY m DESC, y) AS y, max(m) AS m FROM pairs GROUP BY x
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN y END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM v LEFT JOIN best ON x = word
), path AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON f.word = p.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN path p ON p.word = f.word JOIN forms last ON last.word = p.at AND last.form IS NULL
"""

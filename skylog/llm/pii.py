"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Base spans (fixed rules for e-mail, IP, card and phone) are the seed entities. Every identifier-like run
of a text (neighbouring words with a digit or ``@``) is a candidate, with its context as patterns: the two
words before it, and the words on both sides. Over the graph of patterns and instances Spark iterates:

* a pattern's confidence for a kind is the mean score of the distinct instances it extracts (one unknown instance
  is added); it counts from ``min_seeds`` distinct scored instances and ``min_confidence`` on,
* an instance's score is 1 for seeds, else 1 - product(1 - confidence) over its accepted patterns.

Candidates that an accepted pattern extracts with a high enough score, and that touch no base span, are added
with the pattern's kind. Texts are read once and never shuffled; only candidates and patterns are. All counts
are partial aggregates, so a pattern that a third of all texts share is no hot task.

Positions count code points, ends are exclusive. Defined cases: a null or empty text has no span; repeated rows
(same id and text) get the same spans and count once as evidence per instance; ties keep both spans; null
ids are judged like others. An identifier has 4 to 64 code points. Other columns pass through ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, read

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.75
ROUNDS = 3
CONTEXT = 64  # code points around a candidate in which context words are looked for

# The look-behinds only skip starts from which no leftmost match can begin, and the possessive
# quantifiers only forbid retries that cannot help, so long runs take linear time.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARDS = {"email": "instr(t, '@') > 0", "ip": r"t RLIKE r'[0-9]\.[0-9]'", "card": r"t RLIKE r'[0-9][ -]?[0-9]'", "phone": "instr(t, '+') > 0"}
_DIGITS = "regexp_replace(x.hit, r'[^0-9]', '')"
_LUHN = (
    f"aggregate(transform(sequence(1, length({_DIGITS})), i -> CAST(substring({_DIGITS}, -i, 1) AS INT) * (2 - i % 2)),"
    " 0, (a, d) -> a + d - CASE WHEN d > 9 THEN 9 ELSE 0 END) % 10 = 0"
)
_VALID = {
    "email": "true",
    "ip": r"forall(split(x.hit, r'\.'), p -> length(ltrim('0', p)) < 4 AND coalesce(try_cast(ltrim('0', p) AS INT), 0) < 256)",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
_WORDLIKE = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_CANDIDATE = rf"(?<![^\x20\x09-\x0D]){_WORDLIKE}(?:\x20{_WORDLIKE})*+"
_SPAN = "ARRAY<STRUCT<start: BIGINT, stop: BIGINT, hit: STRING, before: STRING, after: STRING>>"


def _located(pattern: str, guard: str) -> str:
    """SQL for all matches in column t with positions, from the pieces between the matches."""
    pieces = f"split(t, r'{pattern}', -1)"
    return f"""CASE WHEN {guard} THEN aggregate(
        arrays_zip({pieces}, slice({pieces}, 2, 2147480000), regexp_extract_all(t, r'{pattern}', 0)),
        CAST(named_struct('pos', 0L, 'out', array()) AS STRUCT<pos: BIGINT, out: {_SPAN}>),
        (s, z) -> CASE WHEN z.`2` IS NULL THEN s ELSE named_struct(
            'pos', s.pos + length(z.`0`) + length(z.`2`),
            'out', concat(s.out, array(named_struct('start', s.pos + length(z.`0`),
                'stop', s.pos + length(z.`0`) + length(z.`2`), 'hit', z.`2`,
                'before', right(z.`0`, {CONTEXT}), 'after', left(z.`1`, {CONTEXT}))))) END,
        s -> s.out) ELSE CAST(array() AS {_SPAN}) END"""


def _base() -> str:
    """SQL for the sorted base spans of column t: (start, kind number, stop)."""
    parts = [
        f"transform(filter({_located(PATTERNS[k], _GUARDS[k])}, x -> {_VALID[k]}),"
        f" x -> named_struct('start', x.start, 'kind', {i}, 'stop', x.stop))"
        for i, k in enumerate(KINDS)
    ]
    return f"array_sort(concat({', '.join(parts)}))"


def spelled(spans: str) -> str:
    """SQL: spans as kind:start:end, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"concat_ws(',', transform({spans}, x -> concat(element_at(array({kinds}), x.kind + 1), ':', x.start, ':', x.stop)))"


def _candidates(found: DataFrame) -> DataFrame:
    """(key, id, start, stop, instance, kinds, pattern) of every candidate and each of its patterns."""
    # quotes and brackets around the run are no part of the identifier
    rows = found.selectExpr("key", "id", "base", "explode(cand) AS c").selectExpr(
        "key", "id", "base", "c.before", "c.after", "c.start", "c.stop", "c.hit",
        "length(c.hit) - length(regexp_replace(c.hit, r'^[^A-Za-z0-9+(]+', '')) AS lead",
        "length(c.hit) - length(regexp_replace(reverse(c.hit), r'^[^A-Za-z0-9]+', '')) AS trail",
    ).selectExpr(
        "key", "id", "base", "start + lead AS start", "stop - trail AS stop",
        "lower(substring(hit, lead + 1, length(hit) - lead - trail)) AS instance",
        r"lower(regexp_replace(regexp_extract(before, r'([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$', 1), r'[0-9]', '0')) AS w1",
        r"lower(regexp_replace(regexp_extract(before, r'([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$', 1), r'[0-9]', '0')) AS w2",
        r"lower(regexp_replace(regexp_extract(after, r'^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)', 1), r'[0-9]', '0')) AS n1",
    ).where("length(instance) BETWEEN 4 AND 64")
    return rows.selectExpr(
        "key", "id", "start", "stop", "instance",
        "array_distinct(transform(filter(base, b -> b.start < stop AND b.stop > start), b -> b.kind)) AS kinds",
        """explode(filter(array(
            CASE WHEN w1 <> '' AND w2 <> '' THEN concat('before ', w2, ' ', w1) END,
            CASE WHEN w1 <> '' AND n1 <> '' THEN concat('around ', w1, ' ', n1) END), p -> p IS NOT NULL)) AS pattern""",
    )


def _learn(store: Store, cand: DataFrame, min_seeds: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """(accepted patterns: pattern, kind, confidence; instance scores: instance, kind, score)."""
    edges = store.table("edges", cand.select("pattern", "instance").distinct())
    size = store.table("pattern-size", edges.groupBy("pattern").agg(F.count("*").alias("size")))
    seeds = store.table("seeds", cand.select("instance", F.explode("kinds").alias("kind")).distinct().withColumn("score", F.lit(1.0)))
    scores = seeds
    for turn in range(ROUNDS):
        sums = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("scored"))
        accepted = sums.join(size, "pattern").withColumn("confidence", F.col("sum") / (F.col("size") + 1))
        accepted = accepted.where((F.col("scored") >= min_seeds) & (F.col("confidence") >= min_confidence))
        accepted = store.table(f"patterns-{turn}", accepted.select("pattern", "kind", "confidence"))
        reached = edges.join(accepted, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")
        )
        scores = seeds.unionByName(reached).groupBy("instance", "kind").agg(F.max("score").alias("score"))
        scores = store.table(f"scores-{turn}", scores)
    return accepted, scores


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
             min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per row of ``docs``: id, key (hash of id and text), base and learned spans."""
    store = Store(docs.sparkSession, "pii")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    found = rows.selectExpr(
        "id", "xxhash64(id, t) AS key", f"{_base()} AS base", f"{_located(_CANDIDATE, 't RLIKE ' + chr(39) + '[0-9@]' + chr(39))} AS cand"
    )
    found = store.table("found", found)
    cand = store.table("candidates", _candidates(found))
    patterns, scores = _learn(store, cand, min_seeds, min_confidence)
    unseen = cand.where(F.size("kinds") == 0)
    hits = unseen.join(patterns, "pattern").join(scores, ["instance", "kind"]).where(F.col("score") >= min_confidence)
    learned = hits.groupBy("key", "id").agg(
        F.array_sort(F.collect_set(F.struct("start", F.col("kind").cast("int").alias("kind"), "stop"))).alias("learned")
    )
    a, b = found.select("id", "key", "base"), learned.select(F.col("id").alias("id_"), F.col("key").alias("key_"), "learned")
    both = a.join(b, (a["key"] == b["key_"]) & a["id"].eqNullSafe(b["id_"]), "left")
    empty = "CAST(array() AS ARRAY<STRUCT<start: BIGINT, kind: INT, stop: BIGINT>>)"
    return both.selectExpr("id", "key", "base", f"coalesce(learned, {empty}) AS learned")


def _masked(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones together) replaced by its kind in brackets."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(s, x):
        plain = F.when(
            x["start"] >= s["pos"],
            F.concat(s["out"], F.substring(text, (s["pos"] + 1).cast("int"), (x["start"] - s["pos"]).cast("int")), F.element_at(kinds, x["kind"] + 1)),
        ).otherwise(s["out"])
        return F.struct(F.greatest(s["pos"], x["stop"]).alias("pos"), plain.alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["pos"] + 1).cast("int"), F.length(text))))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with all spans replaced by their kinds; all rows and columns stay, null texts too."""
    found = find_pii(docs, text, doc_id).where(F.size("base") + F.size("learned") > 0)
    spans = found.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.array_sort(F.concat("base", "learned")).alias("_spans"))
    spans = spans.dropDuplicates(["_id", "_key"])
    key = F.xxhash64(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    keyed = docs.withColumn("_row", key)
    joined = keyed.join(spans, (F.col("_row") == F.col("_key")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")), "left")
    new = F.when(F.col("_spans").isNull(), F.col(f"`{text}`")).otherwise(_masked(F.col(f"`{text}`"), F.col("_spans")))
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    found = find_pii(read(spark, sf, "documents"))
    counts = [f"CAST(size(filter(base, x -> x.kind = {i})) AS BIGINT) AS n_{k}" for i, k in enumerate(KINDS)]
    return found.selectExpr(
        "id AS doc_id", *counts, f"sha2({spelled('base')}, 256) AS base_sha256",
        f"{spelled('array_sort(concat(base, learned))')} AS spans", "CAST(size(learned) AS BIGINT) AS n_learned",
    )

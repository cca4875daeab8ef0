"""Archives with their index, hard negatives and spelling variants: brute force, round trips and edge cases."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylog.llm import negatives, spelling, warc
from skylog.llm.common import Store
from tests.llm import data


def test_loser_tree():
    r = random.Random(5)
    for k in (1, 2, 3, 7, 16):
        lists = [sorted((r.randrange(20), r.randrange(3)) for _ in range(r.randrange(0, 30))) for _ in range(k)]
        out = [lists[a][b] for a, b in warc.LoserTree(lists)]
        assert out == sorted(x for part in lists for x in part)


def captures(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, captured string, payload binary").select(
        "page_id", "url", F.col("captured").cast("timestamp_ntz").alias("captured"), "payload"
    )


def test_archives_round_trip(spark):
    long = random.Random(1).randbytes(1 << 20) * 17  # over 16 MB: its length needs four bytes
    payloads = {0: b"", 1: b"<p>\r\n\r\n</p>", 2: bytes(range(256)), 3: long}
    rows = [(i, f"http://WWW.Site{i % 3}.example.com/a?b#c", f"2024-01-0{i % 7 + 1} 00:00:00", payloads[i % 4]) for i in range(40)]
    rows += [(None, None, None, None), (None, "x\ny", None, b"only without ids"), (7, "://u", "2024-01-01 00:00:00.5", b"same"), (7, "://u", "2024-01-01 00:00:00.5", b"same")]
    store = Store(spark, "warc-test")
    table = captures(spark, rows).repartition(3).selectExpr("*", "1 AS size", "2 AS sha", "3 AS range")
    warc.write_archives(table, f"{store.root}/archives", archive_bytes=2000)
    index = warc.merge_runs(warc.read_archives(spark, f"{store.root}/archives"), store, entries_of_range=10).collect()
    assert len(index) == len(rows) and all(r.sound for r in index)
    order = sorted(index, key=lambda r: (r["range"], r.place))
    key = lambda r: (r.url_key, r.stamp, r.page_id is None, r.page_id or 0)
    assert [key(r) for r in order] == sorted(key(r) for r in index)
    seen = {}
    for r in order:
        seen[r.url_key] = seen.get(r.url_key, 0) + 1
        assert r.capture == seen[r.url_key]
    first = {}
    for i, _, _, p in rows:
        first[p or b""] = min([x for x in (first.get(p or b""), i) if x is not None], default=None)
    want = sorted((i, p or b"") for i, _, _, p in rows if i is not None)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index if r.page_id is not None))
    assert got == [
        (i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p])
        for i, p in want
    ]
    assert {(r.payload_bytes, r.record_type, r.refers_to) for r in index if r.page_id is None} == {(0, "revisit", 0), (16, "response", None)}
    # every entry's offset and length give its record alone
    files = {r.path.rpartition("/")[2]: bytes(r.content) for r in spark.read.format("binaryFile").load(f"{store.root}/archives").select("path", "content").collect()}
    for r in index:
        own, http, payload = warc.parse_record(gzip.decompress(files[r.archive][r.offset : r.offset + r.length]))
        assert own["warc-type"] == r.record_type and (r.record_type == "revisit" or len(payload) == r.payload_bytes)
    assert sum(len(gzip.decompress(x)) > 0 for x in files.values()) == len(files) > 3


def test_archives_empty(spark):
    store = Store(spark, "warc-none")
    warc.write_archives(captures(spark, []), f"{store.root}/archives")
    assert warc.merge_runs(warc.read_archives(spark, f"{store.root}/archives"), store).count() == 0


def test_url_keys():
    assert [warc.url_key(x) for x in ("http://www.A.org/x?y#z", "https://b.A.org", "a", "", "s://h?q")] == ["org,a)/x?y", "org,a,b)/", "a", "", "h)?q"]


@pytest.mark.parametrize("low, high, width", [(-3, 3, 5), (-256, 255, 64), (0, 7, 3), (-9, -2, 4), (-(2**40), 2**40, 6)])
def test_packed_scores(low, high, width):
    r = np.random.default_rng(3)
    a, b = r.integers(low, high + 1, (7, width)), r.integers(low, high + 1, (23, width))
    packing = negatives.Packing(int(b.min()), int(b.max()), int(np.abs(a).sum(axis=1).max()))
    want = a.astype(object) @ b.astype(object).T
    if low == -(2**40):
        assert packing.wide
        want, a, b = [x // 2**12 for x in (want, a, b)]
        want = a.astype(object) @ b.astype(object).T
    else:
        assert packing.fields > 1
    assert (packing.scores(a, packing.pack(b), len(b)) == want.astype(np.int64)).all()


def brute_negatives(rows):
    vec = {k: (i, l, np.floor(256 * np.array(v, float)).astype(int)) for k, (i, l, v) in enumerate(rows)}
    dot = lambda x, y: int((x[: len(y)] * y[: len(x)]).sum())
    out = []
    for i, l, v in vec.values():
        if i % 50:
            continue
        best = lambda test: sorted(((-dot(v, w), j) for j, m, w in vec.values() if j != i and test(m)))
        for minus, p in best(lambda m: m == l)[:5]:
            good = [(j, -s) for s, j in best(lambda m: m != l) if 50 * -minus <= 100 * -s <= 95 * -minus][:3]
            out += [(i, p, k + 1, j, -minus, s) for k, (j, s) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("anchors, stripe", [(2048, (1 << 11, 1 << 21)), (3, (50, 100))])
def test_negatives_brute(spark, anchors, stripe, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "ROWS", stripe)
    r = random.Random(9)
    rows = [(i, r.choice([0, 0, 1, 2, 3]), [r.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, 0, [0.5] * 6) for i in range(300)]  # many equal rows, of anchors too
    rows += [(450, 9, [1.0] * 6), (500, 8, []), (550, 1, [3.0]), (51, 1, [1.0] * 9), (51, 1, [1.0] * 9)]
    bad = [(600, None, [1.0]), (650, 1, None), (700, 1, [None, 1.0]), (750, 1, [float("nan")]), (800, 1, [float("inf")]), (None, 1, [1.0]), (850, 1, [1e30])]
    table = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS row", "2 AS cell", "'x' AS parts").repartition(3)
    got = negatives.mine(negatives.usable(table), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(x) for x in got) == brute_negatives(rows)


def test_negatives_edges(spark):
    table = spark.createDataFrame([(50, 1, [1.0]), (51, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(negatives.usable(table), F.col("vec_id") % 50 == 0).count() == 0  # no positive
    assert negatives.mine(negatives.usable(table), F.lit(False)).count() == 0
    assert negatives.mine(negatives.usable(table.where("false")), F.lit(True)).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijÀÿ"])
def test_variants_brute(spark, letters):
    r = random.Random(4)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(5, 10))) for _ in range(250)}
    for w in list(words)[:120]:  # plant edits
        k, c = r.randrange(len(w) + 1), r.choice(letters)
        words |= {w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]}
        if len(w) > 5:
            words.add(w[:k] + w[k + 1 :])
    counts = {w: r.choice([3, 4, 7, 15, 40, 100]) for w in words if len(w) >= 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "1 AS length", "2 AS whole").repartition(3)
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(table).collect()}
    assert got == brute_variants(counts)


def test_variants_chain(spark):
    """A chain of forms is followed to its end, many words share one form."""
    counts = {"a" * 5 + "b" * k: 3 * 2**k for k in range(12)}
    counts |= {"aaaaabbbbb" + c: 3 for c in "cdefghijk"}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {x.word: x.root for x in spelling.variants(table).collect()}
    assert got == {w: v[1] for w, v in brute_variants(counts).items()} and got["aaaaa"] == "a" * 5 + "b" * 11


def test_word_counts(spark):
    import re
    import zlib
    from collections import Counter

    rows = data.edge_rows() + [(i, "Stra\u00dfe \u00c9tude-\u00e9tude abcde_fghij Wort9wort \u0100nders\u00d7\u00f7x", None, None, 0) for i in range(300)]
    docs = data.clashing(spark.createDataFrame(rows, data.SCHEMA)).withColumn("run", F.lit(1)).withColumn("word", F.lit("w"))
    want = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == want
    assert spelling.variants(spelling.count_words(docs.where("false"))).count() == 0


def test_keys_of_words_are_not_broadcast(spark):
    """Spark sizes them as the words alone, so they look small enough for it."""
    words = Store(spark, "spelling-test").table("words", spark.createDataFrame([("alphabet", 3), ("alphabets", 4), ("alphabte", 5)], "word string, n long"))
    pairs = spelling.near_pairs(words)
    assert {(r.short, r.long) for r in pairs.collect()} == {("alphabet", "alphabets")}
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()

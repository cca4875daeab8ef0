"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from skylog.llm import decontaminate, html, images, jaccard, language, lm, mixing, pii, substrings, urls
from tests.llm import data


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "docs")
    data.clashing(spark.createDataFrame(data.edge_rows(), data.SCHEMA)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs")
    docs.where("false").write.parquet(path)
    return spark.read.parquet(path)


def test_language(docs, none):
    model = language.learn(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 5)] == ["und"] * 4 and got[4].lang_pred in model.languages
    assert set(language.identify(docs, model).columns) == set(docs.columns)
    empty = language.learn(none)
    assert language.identify(none, empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def test_jaccard(docs, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 90).collect()]
    assert len(got) == docs.count()
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (8, 1, 8), (9, 1, 8), (6, 29997, 6), (7, 29997, 6)} - {(d, n if d not in (6, 7) else 29997, c) for d, n, c in got} == set()
    assert {c for d, _, c in got if d in (10, 11, 12, 13)} == {10} and [c for d, _, c in got if d is None] == [None]
    assert jaccard.jaccard_components(none).count() == 0


def test_substrings(docs, none):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[7] == (30000, 30000) and got[6] == (30000, 0)
    assert got[22] == (300, 299) and got[21][1] >= 60 and got[10] == (120, 0)  # a repeated row is no earlier one
    assert substrings.remove_repeats(none).count() == 0


def test_pii(docs, none):
    assert pii.find_pii(docs).count() == docs.count()
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert pii.redact(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in got)
    sizes = {r.source: (r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in sizes.values()) - sum(s for s, _ in sizes.values())) < 1e-6 and sizes[None][0] == 2
    assert mixing.take(docs).count() == sum(r.copies for r in got)
    assert mixing.take(none).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, data.prose(3, 60)), (1, data.prose(3, 60)), (2, None), (3, ""), (None, "a b c d e f"), (4, "one")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(20, 1), (21, 1)}
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.where("false")).count() == 0


def test_lm(docs, none):
    got = lm.score(docs, ~lm.held_out(docs["doc_id"])).collect()
    assert len(got) == docs.count() and all(r.score < 0 and r.base_score < 0 for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert lm.score(none, ~lm.held_out(none["doc_id"])).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "x://Net/es/"), (3, "x://Net/es/"), (4, "no url")], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS key")
    listed = spark.createDataFrame([], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("net", "/es/", "net/es/", "block"), 4: ("", "", None, "allow")}
    assert urls.judge(pages.where("false"), listed).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a<p>b"), (3, "<p>a<p>b"), (4, "<div>" * 5000 + "x")], "page_id long, html string").selectExpr("*", "'t' AS text")
    assert sorted((r.page_id, r.text) for r in html.extract(pages).collect()) == [(1, ""), (2, ""), (3, "a\n\nb"), (3, "a\n\nb"), (4, "x")]
    assert html.extract(pages.where("false")).count() == 0


def test_images(spark):
    flat = bytes(400)
    rows = [(1, 20, 20, flat), (2, 20, 20, flat), (2, 20, 20, flat), (3, 5, 5, b"x"), (4, None, 3, None), (None, 20, 20, flat)]
    table = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary").selectExpr("*", "1 AS id", "2 AS key")
    got = {(r.image_id, r.class_id) for r in images.copies(table).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (None, None)}
    assert images.copies(table.where("false")).count() == 0

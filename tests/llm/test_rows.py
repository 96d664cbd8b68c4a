"""Every operator and stage over awkward tables: nulls, empty and very long texts, ties, repeats, no rows, clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import bpe, decontaminate, html_extract, language, line_dedup, near_dedup, quality, secret_scan, top_k, toxicity

CLASH = ["h", "id", "key", "x", "lines", "_gone", "_left", "_map", "_id", "_h", "_cuts", "_cut_id", "cell", "component", "decoded", "value", "c0", "c1", "TEXT2"]
PASSAGE = "the quick brown fox jumps over the lazy dog near the river bank"
LINES = "\n".join(f"line {k} says one two three four five six seven eight nine ten" for k in range(8))


def table(spark, clash: bool = False, rows: bool = True):
    long = " ".join(f"word{k % 997}" for k in range(200_000))
    data = [
        (1, f"Some text before. {PASSAGE} and then a little more of it", "en", "a", 10), (1, f"Some text before. {PASSAGE} and then a little more of it", "en", "a", 10), (2, None, "en", None, None), (3, "", None, "a", 0), (None, "an id that is missing", "en", "b", 21),
        (5, long, "en", "b", len(long)), (6, long, "de", "b", len(long)), (7, LINES, "de", "c", len(LINES)), (8, "begin\n" + LINES, "de", "c", 1), (9, "\n\n \n", "fr", "c", 4), (10, "🙂🙂 ÄÖÜ \u0000 x", "fr", "d", 9), (11, PASSAGE, None, "d", 63), (12, "!!! ???", "en", "d", 7),
    ]
    df = spark.createDataFrame(data if rows else [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(CLASH))) if clash else df


def others(spark, rows: bool = True):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 0, None), (None, 1, 1), (7, 1, 0), (7, 1, 0)] if rows else [], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(0, PASSAGE), (1, None), (2, ""), (3, "..."), (4, PASSAGE)] if rows else [], "item_id bigint, text string")
    return labels, bench


def operators(spark, rows: bool = True):
    labels, bench = others(spark, rows)
    return {
        "spans": lambda d: decontaminate.removal_spans(d, bench), "cut": lambda d: decontaminate.decontaminate(d, bench), "language": language.identify, "accepted": language.accepted, "toxic": lambda d: toxicity.toxic_passages(d, labels), "quality": lambda d: quality.score(d, labels),
        "lines": line_dedup.deleted_lines, "line stage": line_dedup.deduplicate, "secrets": secret_scan.scan, "near": near_dedup.near_duplicates, "near stage": near_dedup.deduplicate, "bpe": bpe.round_trip, "bpe stage": lambda d: bpe.decode(bpe.encode(d)),
    }


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["spans", "cut", "language", "accepted", "toxic", "quality", "lines", "line stage", "secrets", "near", "near stage", "bpe", "bpe stage"])
def test_awkward(spark, name):
    op = operators(spark)[name]
    got = op(table(spark))
    clashing = op(table(spark, clash=True))
    keep = [c for c in clashing.columns if c not in CLASH or c in got.columns and c not in ("decoded",)] + (["decoded"] if "decoded" in got.columns else [])
    assert plain(got.select(*got.columns)) == plain(clashing.select(*dict.fromkeys(keep)).select(*got.columns))
    empty = operators(spark, rows=False)[name](table(spark, rows=False))
    assert empty.columns == got.columns and empty.count() == 0
    if name in ("cut", "line stage", "near stage", "accepted"):
        assert got.columns == table(spark).columns and clashing.columns == table(spark, clash=True).columns
    if name == "line stage":
        texts = {r.doc_id: r for r in got.collect()}
        assert texts[8].text == "begin" and texts[8].n_chars == 5 and texts[7].text == LINES and texts[2].text is None and texts[3].text == "" and texts[10].n_chars == 9
    if name == "cut":
        texts = {r.doc_id: r.text for r in got.collect()}
        assert texts[1] == "Some text before.  and then a little more of it" and 11 not in texts and texts[2] is None and texts[9] == "\n\n \n"
    if name == "near stage":
        ids = [r.doc_id for r in got.collect()]
        assert 6 not in ids and {1, 2, 3, 5, 9, None} <= set(ids) and ids.count(1) == 2
    if name == "bpe stage":
        assert all(r.text == r.decoded and (r.n_tokens is None) == (r.text is None) for r in got.collect())


def test_pages_and_vectors(spark):
    schema = "page_id bigint, url string, html string, host string, pivot int"
    page = lambda n: f"<html><body><nav><a href=/>Home</a></nav><p>text {n}</p></body></html>"
    data = [(1, "http://a.b/1", page(1), "x", 1), (2, "http://a.b/2", page(2), "x", 1), (2, "http://a.b/2", page(2), "x", 1), (3, None, page(3), "x", 1), (4, "http://a.b/4", None, "x", 1), (5, "http://a.b/5", "", "x", 1), (None, "nonsense", "<p>a<b>c<p>d", "x", 1), (7, "http://deep/", "<div>" * 5000 + "deep", "x", 1), (8, "http://deep/", "<div>" * 4000 + "<i>deep" + "<p>" * 10, "x", 1)]
    got = {(r.page_id, r.content, r.n_content, r.n_template) for r in html_extract.extract(spark.createDataFrame(data, schema)).collect()}
    assert got == {(1, "text 1", 1, 1), (2, "text 2", 1, 1), (3, "Home\ntext 3", 2, 0), (4, None, 0, 0), (5, "", 0, 0), (None, "a c\nd", 3, 0), (7, "deep", 1, 0), (8, "deep", 1, 0)}
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [0.0, 0.0])]
    got = {(r.query_id, r.rank): (r.neighbour_id, r.score) for r in top_k.top_k(spark.createDataFrame(vectors, "vec_id int, embedding array<double>").withColumn("v", F.lit(0)), 2, every=1).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (3, 0.0), (2, 1): (1, 1.0), (2, 2): (3, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0), (9, 1): (1, 0.0), (9, 2): (2, 0.0)}
    assert top_k.top_k(spark.createDataFrame([], "vec_id int, embedding array<float>")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    labels, bench = others(spark)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, clash=True)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0 and docs.where("not (decoded <=> text)").count() == 0

"""Findings of the third review on time and memory: F13 to F19."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from marginalia.functions import formulas, text
from marginalia.operators import layout, retrieval
from marginalia.plans import document_queries, ingest, report_queries, text_queries
from marginalia.streaming import folds


def test_contents_of_known_files_are_not_read(spark, tmp_path):
    rows = [(f"x/{k}.txt", 4, b"same") for k in range(9)] + [("x/none.txt", 0, b"")]
    found = spark.createDataFrame(rows, "path string, size long, content binary").withColumn("modified", F.lit("2020-01-01").cast("timestamp"))
    found.write.parquet(f"{tmp_path}/found")
    found, store = spark.read.parquet(f"{tmp_path}/found"), str(tmp_path / "store")
    assert ingest.ingest(found, store).count() == 10
    torn = F.when(F.length("content") >= 0, F.raise_error(F.lit("content was read")).cast("binary"))
    assert ingest.ingest(found.withColumn("content", torn), store).collect() == []


def test_titles_of_books_are_those_of_block_kind(spark):
    units = ["1. First title", "第 1 章 Opening", "Chapter 2 of it", "三、Part", "2.1 late title", "1999", "plain text", "Table 1. A", "x = 1. y"]
    pages = ["\n\n".join(units[k:] + units[:k]) for k in range(len(units))] + ["", " \n "]
    books = spark.createDataFrame([("p", "d", pages), ("q", "e", [""]), ("r", "f", None)], "path string, doc_id string, pages array<string>")
    sections = [int(r.section_key[1:]) if r.section_key != "front" else 0 for r in ingest.chunks_of(books).orderBy("chunk_index").collect()]
    lines = spark.createDataFrame([(u.strip(), at) for p in pages for at, u in enumerate(p.split("\n\n")) if u.strip()], "u string, at int")
    titles = lines.filter(layout.block_kind(F.col("u"), F.col("at")) == "title").count()
    assert max(sections) == titles > 4


def test_drawings_are_made_once(spark, sf):
    plan = document_queries.visual_clusters(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_boxes_reach_python_as_one_array(spark, sf):
    plan = document_queries.page_visual_profile(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS tiny#" not in plan and plan.count("drawn(images#") == 1


def test_batches_are_taken_in_slices_of_text():
    texts = pa.array(["x" * n for n in (5, 900, 3, 2500, 0, 10)] + [None, "é" * 400])
    numbers = pa.array(range(8))
    found = list(text.slices([numbers, texts], size=1000))
    assert [k for s in found for k in s[0].to_pylist()] == list(range(8)) and [t for s in found for t in s[1].to_pylist()] == texts.to_pylist()
    assert all(len(s[0]) == len(s[1]) == 1 or sum(len((t or "").encode()) + 1 for t in s[1].to_pylist()) <= 1000 for s in found) and len(found) == 3
    assert list(text.slices([texts.slice(0, 0)])) == []


def test_slices_keep_warnings_and_folds_whole(spark, monkeypatch):
    rows = [(k, "{" * (k % 3) + "x" * 700_000) for k in range(12)]
    frame = spark.createDataFrame(rows, "k int, body string").coalesce(1)
    got = {r.k: len(r.w) for r in frame.select("k", formulas.markup_warnings(F.col("body"), F.col("body").substr(1, 0)).alias("w")).collect()}
    assert got == {k: int(k % 3 > 0) for k in range(12)}

    def step(state, row):
        n = (state or [0])[0] + len(row[2])
        return [n], (row[1], n)

    folded = folds.ordered_fold(frame.withColumn("key", F.lit(1)), "key", ["k"], ["key", "k", "body"], step, "k int, n long").orderBy("k").collect()
    assert [r.n for r in folded] == [sum(len(t) for _, t in rows[: k + 1]) for k in range(12)]


def test_neighbours_need_three_joins(spark, sf):
    plan = report_queries.evidence_neighbors(spark, sf)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join Inner") == 3


def test_terms_are_counted_where_a_row_is_read(spark, sf):
    plan = text_queries.tokenize_tf(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_terms_of_shared_keys_are_added_up(spark, monkeypatch):
    words = ["alpha", "x-ray1", "a.b/c", "阻尼比", "尼", "Größen", "_", "ALPHA", "-", "\n"]
    rows = [(k, " ".join(words[(k * n + n) % len(words)] for n in range(k % 17))) for k in range(60)]
    rows += [(None, "alpha beta"), (None, "alpha"), (7, None), (8, ""), (9, "alpha x-ray1"), (9, "x-ray1"), (-1, "beta " * 40)]
    frame = spark.createDataFrame(rows, "k long, body string").repartition(5)
    tokens = spark.createDataFrame(rows, "k long, body string").select("k", text.tokens(F.col("body")).alias("t")).collect()
    want = Counter((r.k, term) for r in tokens for term in r.t)
    for kept, bound, slice_tokens in (("true", 50_000, 1_000_000), ("true", 50_000, 9), ("true", 1, 9), ("k > 9 or k < 0", 50_000, 9)):
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", bound)
        monkeypatch.setattr(retrieval, "SLICE_TOKENS", slice_tokens)
        got = retrieval.term_frequencies(frame.filter(kept), "k", "body").collect()
        assert len(got) == len({(r.k, r.term) for r in got})
        held = {p: n for p, n in want.items() if kept == "true" or p[0] is not None and (p[0] > 9 or p[0] < 0)}
        assert {(r.k, r.term): r.tf for r in got} == held
    assert retrieval.term_frequencies(frame.limit(0), "k", "body").collect() == []
    assert retrieval.term_frequencies(frame.filter("k = 8"), "k", "body").filter("term = ''").collect() == []

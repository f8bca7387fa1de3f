"""Bibliography, repair of GB 18030, recall by language and citations on small fixtures."""

import re

from pyspark.sql import functions as F

from marginalia.functions import bibliography, text
from marginalia.operators import evidence, reports

TEXTS = [
    ("A Title\nAuthor: Roe, Jane\nPublisher: North House Press\n2019年 12345", 2019, ["Roe, Jane"], "North House Press"),
    ("by Jane Roe, John Doe and Ann Poe.\nCambridge University Press, 1998", 1998, ["Jane Roe", "John Doe", "Ann Poe"], "Cambridge University Press, 1998"),
    ("编著：张三、李四\n机械工业出版社 2005 年", 2005, ["张三", "李四"], "机械工业出版社"),
    ("written by Jane Roe in 120190 days", None, [], None),
    ("Authors: ;\r\nAuthor: Late & Later", None, ["Late", "Later"], None),
    ("Elsevier and others", None, [], "Elsevier and others"),
    ("x" * 90 + " springer", None, [], None),
    ("", None, [], None),
    (None, None, [], None),
]


def test_bibliography_of_texts(spark):
    df = spark.createDataFrame([(k, t[0]) for k, t in enumerate(TEXTS)], "k int, t string")
    got = {r.k: r.b for r in df.select("k", bibliography.from_text(F.col("t")).alias("b")).collect()}
    for k, (_, year, authors, publisher) in enumerate(TEXTS):
        assert (got[k].year, got[k].authors, got[k].publisher) == (year, authors, publisher), k


def test_metadata_goes_before_text(spark):
    rows = [("Roe, J.; Doe, K.", "D:20110203", "D:2014", TEXTS[1][0]), ("", "none", "D:2014", TEXTS[1][0]), (None, None, None, TEXTS[1][0]), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, c string, m string, t string").coalesce(1)
    both = bibliography.merged(bibliography.from_metadata(F.col("a"), F.col("c"), F.col("m")), bibliography.from_text(F.col("t")))
    got = [(r.year, r.authors, r.publisher) for r in df.select(both.alias("b")).select("b.*").collect()]
    names, house = TEXTS[1][2], TEXTS[1][3]
    assert got == [(2011, ["Roe, J", "Doe, K"], house), (2014, names, house), (1998, names, house), (None, [], None)]


def slow_repair(t):
    if not t or not any(m in t for m in text.GB_MARKERS):
        return t
    read = t.encode("gb18030", "ignore").decode("utf-8", "replace")
    bad = lambda s: len(re.findall(f"[{text.GB_MARKERS}�]", s))
    return read if bad(read) < bad(t) else t


def test_gb_repair_matches_a_plain_version(spark):
    good = ["图的中文说明", "国际标准", "plain", "é and ü", "", "锟 alone", "转子的临界转速为每分钟三千转"]
    rows = [(t,) for t in [*good, *(g.encode().decode("gb18030", "replace") for g in good), None]]
    got = spark.createDataFrame(rows, "t string").coalesce(1).select("t", text.gb_repaired(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == [slow_repair(r.t) for r in got]
    assert any(r.m != r.t for r in got) and all(r.m == r.t for r in got[: len(good)])


def test_recall_by_language(spark):
    rows = [(1, 0, "a", "en", 1.0, 900.0), (2, 1, "a", "zh", 1.0, 10.0), (3, 2, "b", "en", 1.0, 30.0), (4, 3, "b", "zh", 0.5, 20.0), (5, 4, "c", "en", 1.0, None)]
    cases = spark.createDataFrame(rows, "case_id int, place int, intent string, language string, recall double, latency_ms double")
    r = reports.language_report(cases).collect()[0]
    assert (r.cases, r.recall, r.missing_cases, r.pair_recall, r.cold_start, r.steady_p50, r.steady_p95) == (5, 0.9, 1, 0.333, 900.0, 20.0, 30.0)
    assert [tuple(x) for x in r.by_language] == [("en", 1.0), ("zh", 0.75)]
    none = reports.language_report(cases.limit(0)).collect()[0]
    assert none.cases == 0 and none.recall is None and none.by_language == [] and none.steady_p50 is None


def test_citations_of_hits(spark):
    ddl = "chunk_id string, doc_id int, pages array<int>, page_start int, page_end int, confidence double, ocr_confidence_min double, score double, filename string, source_path string, title string, text string, api_context string"
    rows = [
        ("a", 1, [4, 7], 1, 2, 1.5, 0.2, 0.3, "f.pdf", "/x/y.pdf", "T", "two\n  words ", None),
        ("b", 1, None, 2, 4, None, 0.2, 0.3, "", "C:\\x\\y.pdf", "", "", "context"),
        ("c", 1, None, None, None, None, None, -3.0, None, "/x/z/", None, "w" * 179 + " " + "v" * 30, None),
        ("d", 1, None, 5, 4, None, None, None, None, None, None, None, None),
        (None, 1, None, 1, 1, None, None, None, None, None, None, None, None),
        ("e", None, None, 1, 1, None, None, None, None, None, None, None, None),
    ]
    got = [tuple(r) for r in evidence.cited(spark.createDataFrame(rows, ddl)).orderBy("chunk_id").collect()]
    assert got == [
        ("a", "1", [4, 7], "documented", 1.0, "f.pdf", "T", "two words"),
        ("b", "1", [2, 3, 4], "documented", 0.2, "y.pdf", None, "context"),
        ("c", "1", None, "documented", 0.0, "z", None, "w" * 179 + "…"),
        ("d", "1", [], "documented", 1.0, None, None, None),
    ]
    bare = evidence.cited(spark.createDataFrame([("a", "d")], "chunk_id string, doc_id string")).collect()
    assert [tuple(r) for r in bare] == [("a", "d", None, "documented", 1.0, None, None, None)]

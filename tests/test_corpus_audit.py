"""Sentences of segments, cascading deletes and audits of nested fields, against values and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.operators import audit, sentences
from marginalia.sources import cascades

SEGMENTS = "key long, text string, segments array<struct<text:string,start:int,end:int,block_type:string,layout_role:string>>"


@pytest.mark.parametrize(
    "text, kept",
    [
        ("The shaft runs\nat speed. It vi-\nbrates.", ["The shaft runs at speed. It vibrates."]),
        ("1.2\nDamping of rotors\nIt is low.", ["It is low."]),
        ("Header line\nHeader line\nBody goes on.", ["Body goes on."]),
        ("A long enough first line\n\nof one sentence.", ["A long enough first line of one sentence."]),
        ("Short line\n\nanother one.", ["Short line", "another one."]),
        ("振动烈度是\n\n速度值，均方根。", ["振动烈度是", "速度值，均方根。"]),
        ("振动烈度是\n\n值，均方根。", ["振动烈度是值，均方根。"]),
        ("振动烈度是\n\n值\n，均方根。", ["振动烈度是值，均方根。"]),
        ("转子振动\n该值为三。", ["该值为三。"]),
        ("[3] Some book\n- item\n(2) item\nGB 1234\n12\nText stays.", ["Text stays."]),
        ("GB 12A3 草案 修订版 说明\nText.", ["Text."]),
        ("He said \"stop.\"\nThen left.", ['He said "stop."', "Then left."]),
        ("", []),
        (" \n\n ", []),
    ],
)
def test_units(text, kept):
    assert [u for u, label in sentences.units_of(text) if not label] == kept


def test_fixed_values_of_labels():
    assert sentences.ASSERTIONS == ("是", "为", "表示", "用于", "产生", "影响", "规定", "提供", "支持", "增大", "减小")
    assert sentences.FINAL == ("。", "！", "？", "!", "?", "；", ";", "…", ".", "．")
    for line in ("第三章 转子", "2.1 Scope", "样品概述", "ISO 10816-3", "A • B", "7", "· x"):
        assert sentences.is_label(line), line
    for line in ("振动是运动", "Speed rises", "12345", "第三章。", "x" * 50 + " • " + "y" * 50):
        assert not sentences.is_label(line), line


def test_very_long_texts_take_linear_time():
    line = "12A3 " * 40_000
    assert not sentences.is_label("x" + line) and sentences.is_label("x" + line + "修订版")
    assert len(sentences.units_of("\n".join(["word without an end here"] * 20_000))) == 20_000
    assert len(sentences.units_of("\n\n".join(f"word {k} without an end" for k in range(5_000)))) == 1


def test_segments_by_role(spark):
    text = "[head]\nTitle here. Alpha rises. Beta falls."
    whole = [(None, 0, 11, "title", "body"), (None, 12, 24, "text", "body"), (None, 25, 36, "text", None)]
    rows = [
        (1, text, whole),
        (2, text, [("Label one.", None, None, "text", "label"), ("Ref. two.", None, None, "text", "bibliography"), ("Stays.", None, None, None, None)]),
        (3, text, [(None, 30, 900, "text", "body"), (None, -1, 4, "text", "body"), (None, 5, 2, "text", "body"), (None, None, 4, "text", "body")]),
        (4, text, None),
        (5, None, None),
        (6, None, whole),
        (7, text, []),
        (8, "Same text. Same text.", None),
        (8, "Same text. Same text.", None),
        (None, "No key.", None),
    ]
    found = spark.createDataFrame(rows, SEGMENTS).select("key", sentences.segment_sentences(F.col("text"), F.col("segments")).alias("s"))
    got = sorted(((r.key, r.s) for r in found.collect()), key=repr)
    want = [
        (1, ["Alpha rises.", "Beta falls."]), (2, ["Stays."]), (3, []), (4, ["Title here.", "Alpha rises.", "Beta falls."]), (5, []), (6, []), (7, []),
        (8, ["Same text.", "Same text."]), (8, ["Same text.", "Same text."]), (None, ["No key."]),
    ]
    assert got == sorted(want, key=repr)
    assert spark.createDataFrame([], SEGMENTS).select(sentences.segment_sentences(F.col("text"), F.col("segments"))).count() == 0


def test_sentences_split_and_orphans(spark):
    text = "一句。二句！ Third one.  Fourth one; fifth?司A续。x"
    row = spark.range(1).select(sentences.segment_sentences(F.lit(text), F.lit(None).cast(SEGMENTS.split("segments ")[1]))).first()[0]
    assert row == ["一句。", "二句！", "Third one.", "Fourth one;", "fifth?"]


def test_cascade_against_a_plain_version(spark):
    draw = random.Random(5)
    docs, sections = list(range(12)), list(range(80))
    parent = {s: draw.choice([None, *sections]) for s in sections}  # cycles too
    owner = {s: draw.choice([None, 0, *docs]) for s in sections}
    chunks = {c: (draw.choice(docs), draw.choice([None, 3, *sections])) for c in range(200)}
    cited = [(k, draw.choice([None, *chunks])) for k in range(150)]
    tables = {
        "documents": spark.createDataFrame([(d,) for d in docs], "id long"),
        "document_sections": spark.createDataFrame([(s, owner[s], parent[s], "x") for s in sections], "id long, doc_id long, parent_id long, heading string"),
        "chunks": spark.createDataFrame([(c, d, s) for c, (d, s) in chunks.items()], "id long, doc_id long, section_id long"),
        "citations": spark.createDataFrame(cited, "id long, chunk_id long"),
    }
    went = {2, 7}
    gone = {s for s in sections if owner[s] in went} | {11}
    while more := {s for s in sections if parent[s] in gone} - gone:
        gone |= more
    start = {"documents": spark.createDataFrame([(2,), (7,), (7,), (99,), (None,)], "id long"), "document_sections": spark.createDataFrame([(11,)], "id long")}
    left = cascades.without(tables, cascades.deleted(tables, start))
    kept = {c: (d, None if s in gone else s) for c, (d, s) in chunks.items() if d not in went}
    assert {r.id for r in left["documents"].collect()} == set(docs) - went
    assert {r.id for r in left["document_sections"].collect()} == set(sections) - gone
    assert {r.id: (r.doc_id, r.section_id) for r in left["chunks"].collect()} == kept
    assert {r.id for r in left["citations"].collect()} == {k for k, c in cited if c is None or c in kept}
    assert cascades.orphans(left).count() == 0
    assert left["document_sections"].columns == tables["document_sections"].columns
    broken = {**tables, "documents": left["documents"]}
    lost = {(r.table_name, r.column_name, r.value): r.n for r in cascades.orphans(broken).collect()}
    assert lost[("chunks", "doc_id", 2)] == sum(d == 2 for d, _ in chunks.values()) and {v for _, _, v in lost} == went


def test_cascade_of_nothing(spark):
    empty = {name: spark.createDataFrame([], ddl) for name, ddl in schemas.TABLES.items()}
    none = spark.createDataFrame([], "id long")
    left = cascades.without(empty, cascades.deleted(empty, {"documents": none}))
    assert all(rows.count() == 0 for rows in left.values()) and cascades.orphans(empty).count() == 0
    order = list(schemas.TABLES)
    assert all(order.index(r.target) <= order.index(r.table) for r in schemas.REFERENCES)


def test_audit_walks_every_type(spark):
    ddl = "`a.b` string, id long, m map<string,array<struct<t:string,n:int>>>, s struct<id:string,deep:struct<list:array<array<string>>>>, path string"
    bad = "�"
    rows = [
        ("x", 3, {"k": [("v", 1), (bad, 2)]}, (None, ([["a"], [bad, " "]],)), "p"),
        (bad, 1, {bad: []}, ("", None), None),
        (None, 2, None, None, "p"),
        (bad, 2, None, None, "p"),
    ]
    got = {r.path: r for r in audit.field_audit(spark.createDataFrame(rows, ddl), "id", samples=2).collect()}
    assert set(got) == {"a.b", "m{key}", "m{}[].t", "s.id", "s.deep.list[][]", "path"}
    a, deep, values = got["a.b"], got["s.deep.list[][]"], got["m{}[].t"]
    assert (a.n_rows, a.n_values, a.n_filled, a.coverage, a.n_garbled, a.garbled_rows, a.first_garbled) == (4, 4, 3, 0.75, 2, 2, ["1", "2"])
    assert (deep.n_values, deep.n_filled, deep.coverage, deep.n_garbled, deep.first_garbled) == (3, 2, 0.25, 1, ["3"])
    assert (values.n_values, values.n_garbled, got["m{key}"].first_garbled, got["path"].first_garbled) == (2, 1, ["1"], [])
    assert audit.field_audit(spark.createDataFrame([], ddl), "id").count() == 0
    assert audit.field_audit(spark.createDataFrame([(1,)], "id long"), "id").count() == 0


def test_kinds_and_aliases(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,), ("a",)], "t string")
    assert {r.kind: r.n for r in audit.kind_counts(rows, "t").collect()} == {"a": 2, "unknown": 2}
    facts = spark.createDataFrame([(1, "f", "Critical  Speed"), (1, "f", "critical speed"), (2, "g", " "), (2, "g", None), (3, "h", "Q")], "case_id long, fact_id string, alias string")
    known = spark.createDataFrame([("CRITICAL SPEED",), (None,), ("critical speed ",)], "alias string")
    assert tuple(audit.alias_coverage(facts, known).first()) == (3, 2, 0.6667, 1)
    assert [tuple(r) for r in audit.missing_aliases(facts, known).collect()] == [(3, "h", "Q")]
    assert tuple(audit.alias_coverage(facts.limit(0), known).first()) == (0, 0, 0.0, 0)

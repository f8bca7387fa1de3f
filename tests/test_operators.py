"""Operators without SQL against brute force, Han and mixed texts, and edge cases."""

import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.functions import question, redact, text
from marginalia.operators import chunking, claims, evaluation, evidence, layout, retrieval
from marginalia.plans import claim_queries, document_queries
from marginalia.sources import files, sinks
from marginalia.streaming import folds


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first().x


def test_tokens_of_compounds_and_han(spark):
    assert one(spark, "Rotor-bearing ISO/7919.3 x", text.tokens) == ["rotor-bearing", "rotor", "bearing", "iso/7919.3", "iso", "7919", "3", "x"]
    assert one(spark, "阻尼比 a 轴", text.tokens) == ["a", "阻尼", "尼比", "阻尼比", "轴"]
    assert one(spark, "临界转速度", text.tokens) == ["临界", "界转", "转速", "速度", "临界转", "界转速", "转速度", "临界转速", "界转速度"]
    assert one(spark, None, text.tokens) == [] and one(spark, " ", text.tokens) == []


@pytest.mark.parametrize("value,name", [("阻尼比定义", "zh"), ("damping ratio", "en"), ("阻尼比abc", "mixed"), ("123", "unknown"), (" ", "unknown"), ("größe naïve", "en")])
def test_language(spark, value, name):
    assert one(spark, value, text.language) == name


def test_estimates(spark):
    for value in ("", "a", "two words", "阻尼比 ratio-x 12", "x" * 100):
        han = len(re.findall("[一-鿿]", value))
        words = len(re.findall(r"[A-Za-z0-9_]+(?:[-./][A-Za-z0-9_]+)*", value))
        assert one(spark, value, text.estimated_tokens) == max(1, int(han + words * 1.25 + (len(value) - han) / 6))


def test_text_units_previews_and_runs(spark):
    assert one(spark, "One.\nTwo\nthree!\n\n\nfour；\n五", text.text_units) == ["One.", "Two\nthree!", "four；", "五"]
    assert one(spark, "  a \n b ", text.preview) == "a b" and one(spark, " ", text.preview) is None
    assert len(one(spark, "w" * 300, text.preview)) == 181
    assert one(spark, "dir/a\\b.pdf", text.basename) == "b.pdf" and one(spark, "x/", text.basename) == "x"
    pages = spark.createDataFrame([([3, 1, 2, 7, None, 9, 8, 3],)], "p array<int>")
    assert pages.select(text.page_runs(F.col("p"))).first()[0] == "1-3,7-9"


def test_standards_aliases_and_braces(spark):
    assert one(spark, "GB/T 6075.1, iso-7919 and ISO 7919; api684", text.standard_ids) == ["API 684", "GB/T 6075", "ISO 7919"]
    swap = lambda c: text.replace_aliases(c, [("unbalance", "imbalance"), ("cs", "critical speed"), ("共振", "谐振")])
    assert one(spark, "unbalance at cs, docs [cs] 共振", swap) == "imbalance at critical speed, docs [cs] 谐振"
    assert [one(spark, v, text.unbalanced_braces) for v in ("{a{b}}", "}{", "{", "x")] == [False, True, True, False]


def test_redaction_sets_differ(spark):
    raw = "API_KEY=abc Bearer abcdefghijkl /home/u/x.txt password: hunter2"
    assert one(spark, raw, redact.for_log) == "API_KEY=[redacted] Bearer [redacted] [local-path] password: hunter2"
    assert one(spark, raw, redact.secrets) == "API_KEY=[REDACTED] Bearer [REDACTED] /home/u/x.txt password: [REDACTED]"
    assert one(spark, "x" * 300, redact.for_log) == "[redacted-long-text]"
    fields = spark.createDataFrame([({"Api-Key": "v", "note": "a /tmp/b/c"},)], "m map<string,string>").select(redact.fields_for_log(F.col("m"))).first()[0]
    assert fields == {"Api-Key": "[redacted]", "note": "a [local-path]"}


def test_questions(spark):
    for value, name in (("标准的适用范围", "standard_lookup"), ("what is damping", "definition"), ("A vs B", "comparison"), ("总结", "summary"), ("rotor", "engineering"), ("", "unknown")):
        assert one(spark, value, question.intent) == name
    assert one(spark, "临界转速 共振", question.focus) == "critical_speed" and one(spark, "none", question.focus) is None
    assert one(spark, "damping ratio", question.expanded).startswith("damping ratio zeta ζ 阻尼比")
    assert one(spark, "bearing fault analysis", question.in_scope) and not one(spark, "elevator shaft analysis", question.in_scope) and not one(spark, "bearing", question.in_scope)
    assert one(spark, "which model and sensor", lambda c: question.advisory_lanes(c, F.lit("engineering"))) == ["s7_model_selection", "s8_experiment_advice"]


def slow_chunks(sizes, sections, target, overlap):
    chunks, current = [], []

    def flush(keep):
        nonlocal current
        if current:
            chunks.append((current[0], current[-1]))
        tail = []
        if keep and overlap > 0:
            for k in reversed(current):
                if sections[k] != sections[current[-1]]:
                    break
                tail.insert(0, k)
                if sum(sizes[j] for j in tail) >= overlap:
                    break
        current = tail

    for k in range(len(sizes)):
        if current and sections[k] != sections[current[-1]]:
            flush(False)
        if current and sum(sizes[j] for j in current) + sizes[k] > target:
            flush(True)
        current.append(k)
        if sizes[k] >= target:
            flush(False)
    flush(False)
    return chunks


def test_packing_matches_the_plain_rule():
    random.seed(1)
    for _ in range(300):
        n = random.randint(0, 25)
        sizes = [random.choice([1, 5, 20, 60, 130]) for _ in range(n)]
        sections = sorted(random.randint(0, 3) for _ in range(n))
        assert chunking.pack(sizes, sections, 100, 15) == slow_chunks(sizes, sections, 100, 15)
    assert chunking.pack([10, 10, 10], [0, 0, 0], 20, 5, True) == [(0, 1), (1, 2)]


def test_chunks_cover_paragraphs_and_keep_sections(spark):
    units = ["Title", "a " * 50, "b " * 80, "Next", "c " * 300, "d"]
    rows = spark.createDataFrame([("d", units, [u in ("Title", "Next") for u in units], [1, 1, 2, 2, 3, 3]), ("e", [], [], [])], "doc_id string, units array<string>, titles array<boolean>, pages array<int>")
    got = chunking.chunks(rows, 120, 20).orderBy("chunk_index").collect()
    assert {k for r in got for k in range(r.first_ix, r.last_ix + 1)} == set(range(6))
    assert [r.section_key for r in got] == sorted(r.section_key for r in got) and all((r.first_ix < 3) == (r.last_ix < 3) for r in got)
    assert got[0].chunk_id == "d_p0001_00001" and all(r.doc_id == "d" for r in got)


def test_section_parents_and_gaps(spark):
    rows = [("d", 1, 1), ("d", 2, 2), ("d", 3, 4), ("d", 4, 2), ("d", 5, 1), ("d", 6, 0), ("d", 7, 2)]
    got = {r.section_no: (r.parents, r.gap) for r in chunking.ancestors(spark.createDataFrame(rows, "doc_id string, section_no int, section_level int")).collect()}
    assert got == {1: ([], False), 2: ([1], False), 3: ([1, 2], True), 4: ([1], False), 5: ([], False), 6: ([], False), 7: ([5], False)}


def test_evidence_selection(spark):
    long = "Rotor response rises near the critical speed and falls behind it. " * 4
    rows = [("q", "a", long, 50, 1), ("q", "b", long.replace("Rotor", "rotor"), 50, 2), ("q", "c", "short text", 60, 3), ("q", "d", "other", 10, 4), ("q", "e", "", 1, 5), ("q", "f", "last one", 10, 6)]
    got = evidence.select_evidence(spark.createDataFrame(rows, "query_id string, chunk_id string, text string, tokens int, rank int"), max_chunks=3, token_budget=100).orderBy("pick").collect()
    assert [(r.chunk_id, r.pick) for r in got] == [("a", 1), ("d", 2), ("f", 3)]


def test_evidence_budget_looks_past_many_copies(spark, tmp_path):
    long = " ".join(f"rotor{k}" for k in range(60))
    rows = [(k, long, "s") for k in range(80)] + [(100 + k, f"{name} " * 12, "s") for k, name in enumerate(["north", "south", "east"])] + [(200, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = document_queries.evidence_budget(spark, str(tmp_path)).orderBy("pick").collect()
    assert [(r.query_id, r.chunk_id, r.pick) for r in got] == [("s", 0, 1), ("s", 100, 2), ("s", 101, 3), ("s", 102, 4)]


def test_alias_expand_all_takes_every_document(spark, tmp_path):
    texts = [None, "", "  a \n plain  text", "a licence", "my password " + "x " * 1500, "y" * 2500 + " mail", "z" * 1999]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, t in enumerate(texts):
        squeezed = " ".join((t or "").split())
        more = [a for aliases in claim_queries.DATA_FAMILIES.values() if any(x in squeezed.lower() for x in aliases) for a in aliases]
        want[k] = " ".join([squeezed, *more])
    assert {r.doc_id: r.expanded for r in claim_queries.alias_expand_all(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.expanded for r in claim_queries.alias_expand(spark, str(tmp_path)).collect()} == want


def test_claim_checks(spark):
    rows = [
        ("a", 1, "Damping is 5 Hz at Q", "c1", "The damping is 7Hz."),
        ("a", 2, "Vibration amplitude increases with speed", "c2", "Vibration amplitude decreases with speed, noted."),
        ("a", 3, "The critical speed is 1500 rpm", "c3", "The running speed is 1500 rpm here"),
        ("a", 4, "unrelated words", "c4", "nothing shared"),
        ("a", 5, "gone", "none", None),
        ("b", 1, "Damping ratio rises", "c5", "damping ratio rises"),
    ]
    df = spark.createDataFrame(rows, "answer_id string, claim_ix int, claim string, chunk_id string, body string")
    gated = claims.support_gate(df.drop("body"), df.filter("body is not null").select("answer_id", "chunk_id", F.col("body").alias("text")))
    got = {(r.answer_id, r.claim_ix): (r.reasons, r.blocked) for r in gated.collect()}
    assert got["a", 1][0] == ["missing items"] and got["a", 2][0] == ["direction conflict"] and got["a", 3][0] == ["quantity conflict"]
    assert got["a", 4][0] == ["no lexical support"] and got["a", 5][0] == ["chunk not visible"] and got["b", 1] == ([], False) and got["a", 1][1]
    items = df.filter("claim_ix = 1 and answer_id = 'a'").select(claims.missing_items(F.col("claim"), F.col("body"))).first()[0]
    assert items == ["5", "5hz", "q"]


def test_step_problems(spark):
    rows = [("g", "a", []), ("g", "b", ["a", "x"]), ("g", "c", ["d"]), ("g", "d", ["c"]), ("g", "e", ["c"]), ("g", "f", ["f"]), ("h", "a", [])]
    got = {(r.graph_id, r.step_id): (r.missing, r.self_link, r.reaches_cycle) for r in claims.step_problems(spark.createDataFrame(rows, "graph_id string, step_id string, depends_on array<string>")).collect()}
    assert got["g", "b"] == (["x"], False, False) and got["g", "f"] == ([], True, True)
    assert {k for k, v in got.items() if v[2]} == {("g", "c"), ("g", "d"), ("g", "e"), ("g", "f")}


def test_fusion_keeps_raw_scores_and_priorities(spark):
    lexical = spark.createDataFrame([(0, 1, 4.0, 1), (0, 2, 2.0, 2)], "query_id int, chunk_id int, score double, rank int")
    dense = spark.createDataFrame([(0, 2, 0.5, 1)], "query_id int, chunk_id int, score double, rank int")
    chunks = spark.createDataFrame([(1, "note"), (2, "Standard")], "chunk_id int, source_type string")
    got = {r.chunk_id: r.score for r in retrieval.reciprocal_rank_fusion(lexical, dense, chunks).collect()}
    assert got[1] == pytest.approx(1 / 61 + 0.01 + 0.0001) and got[2] == pytest.approx(1 / 62 + 0.005 + 1 / 61 + 0.01 + 0.0005)
    weighted = {r.chunk_id: r.score for r in retrieval.weighted_fusion(lexical, dense, chunks).collect()}
    assert weighted[1] == pytest.approx(0.9001) and weighted[2] == pytest.approx(0.45 + 0.1 + 0.0005)


def test_ordered_folds_match_loops(spark):
    random.seed(2)
    rows = [(random.choice("abc"), k, round(random.random() * 500, 3), random.random() < 0.5) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, id long, at double, ok boolean")
    got = {r.id: r.allowed for r in folds.ordered_fold(df, "key", ["at", "id"], ["key", "id", "at"], folds.rate_limit_step(3, 60.0), "key string, id long, allowed boolean").collect()}
    cool = {r.id: r.s for r in folds.ordered_fold(df, "key", ["at", "id"], ["key", "id", "at", "ok"], folds.cooldown_step(30.0), "key string, id long, s boolean").collect()}
    hits, failed = {}, {}
    for key, k, at, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        recent = [t for t in hits.get(key, []) if at - t < 60]
        assert got[k] == (len(recent) < 3)
        hits[key] = recent + [at] * got[k]
        assert cool[k] == (key in failed and at - failed[key] < 30)
        if not cool[k]:
            failed.pop(key, None)
            if not ok:
                failed[key] = at


def test_budget_and_review_steps():
    step, state, out = folds.budget_step(100, 150), None, []
    for row in (("s", 1, "t", 80), ("s", 2, "t", 30), ("s", 3, "u", 60), ("s", 4, "u", 80), ("s", 5, "v", 10)):
        state, result = step(state, row)
        out.append(result[2:])
    assert out == [(True, "reserved", 70), (False, "task budget", 70), (True, "reserved", 10), (False, "task budget", 10), (True, "reserved", 0)]
    step, state, actions = folds.review_step(), None, []
    for k, (role, ok) in enumerate([("review", False), ("correct", False), ("review", False), ("correct", False), ("review", False), ("review", True)]):
        state, result = step(state, ("t", k, role, ok))
        actions.append(result[2])
    assert actions == ["correct", "corrected", "correct", "corrected", "fall back", "ignored"]


def test_stream_gives_what_the_batch_gives(spark, sf):
    from marginalia import catalog

    queries = catalog.queries()
    batch = sorted(map(tuple, queries["rate_limit_log"](spark, sf).collect()))
    assert sorted(map(tuple, queries["stream_rate_limit"](spark, sf).collect())) == batch


def test_layout_rules(spark):
    kinds = [one(spark, v, lambda c: layout.block_kind(c, F.lit(1))) for v in ("表 1 数据", "Figure 2: x", "F = m a", "3.1 Rotor balance", "plain text here", " ", "第3章 转子")]
    assert kinds == ["table", "figure", "formula", "title", "body", "unknown", "title"]
    signature = spark.createDataFrame([([10.0, 5.0, 60.0, 20.0],)], "b array<double>").select(layout.edge_signature(F.col("b"), F.lit(100.0), F.lit(1000.0), F.lit("img"))).first()[0]
    assert signature == "top:img:10,0,60,2:33"


def test_ocr_routing(spark):
    first = spark.createDataFrame([("d", 1, "good text", 0.9, False), ("d", 2, "bad", 0.2, False), ("d", 3, "weak", 0.2, False)], "doc_id string, page_no int, text string, confidence double, key_page boolean")
    second = spark.createDataFrame([("d", 2, "better text", 0.8), ("d", 3, "w", 0.9)], "doc_id string, page_no int, text string, confidence double")
    got = {r.page_no: (r.text, r.fallback_used, r.needs_review) for r in layout.ocr_choice(first, second).collect()}
    assert got == {1: ("good text", False, False), 2: ("better text", True, False), 3: ("weak", False, True)}


def test_files_and_chunks(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "chunks.jsonl").write_text('{"chunk_id": "a", "text": "1"}\n{"chunk_id": "", "text": "2"}\n')
    (tmp_path / "x" / "chunks_b.jsonl").write_text('{"chunk_id": "a", "text": "3"}\n')
    (tmp_path / "x" / "chunksX.jsonl").write_text('{"chunk_id": "z"}\n')
    read = files.chunk_files(spark, str(tmp_path))
    assert sorted(r.text for r in read.collect()) == ["1", "2", "3"]
    merged = files.merged_chunks(read.filter("text <> '3'"), read.filter("text = '3'")).collect()
    assert [(r.chunk_id, r.text, r.input_no) for r in merged] == [("a", "3", 0)]
    (tmp_path / "bad.jsonl").write_text('﻿{"a": 1}\n\n[1]\n{oops\n')
    with pytest.raises(Exception, match="bad JSON"):
        files.jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "ok.jsonl").write_text('﻿{"a": 1}\n\n[1]\n', encoding="utf-8")
    assert [r.a for r in files.jsonl(spark, str(tmp_path / "ok.jsonl"), "a int").collect()] == [1]


def test_docx_and_folder(spark, tmp_path):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "My File.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "~$lock.docx").write_text("x")
    (tmp_path / "note.xyz").write_text("x")
    found = files.folder(spark, str(tmp_path))
    rows = found.collect()
    assert [(r.kind, r.doc_id[:8]) for r in rows] == [("docx", "my-file_")]
    assert [r.text for r in files.docx_pages(found).collect()] == ["Hello\nEnd\na | b"]


def test_stores(spark):
    import uuid

    assert one(spark, "abc", sinks.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    fresh = sinks.with_surrogate(spark.createDataFrame([("b",), ("c",)], "name string"), old, "name").collect()
    assert {r.name: r.id for r in fresh}["b"] == 2 and {r.name: r.id for r in fresh}["c"] > 2
    with pytest.raises(Exception, match="more than one document"):
        sinks.guarded(spark.createDataFrame([("a",), ("b",)], "doc string"), "doc").collect()


def test_thresholds_and_percentiles(spark):
    cases = spark.createDataFrame([(0.9, 1), (0.7, 1), (0.6, 0), (0.2, 0)], "score double, label int")
    best = evaluation.best_threshold(evaluation.threshold_sweep(cases, "score", "label")).first()
    assert best.threshold == 0.7 and best.accuracy == 1.0
    values = spark.createDataFrame([("g", float(v)) for v in (5, 1, 4, 2)], "g string, v double")
    got = evaluation.nearest_rank(values, "g", "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (got.p50, got.p95) == (4.0, 5.0)

"""Reports, store tables, claim checks and evidence selection against plain versions and small fixtures."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marginalia.functions import question, redact, text
from marginalia.operators import claims, evaluation, evidence, layout, reports
from marginalia.plans.answer import answers
from marginalia.sources import files, sinks, stores


def test_scorecard_counts_and_fingerprint(spark):
    schema = "case_id string, recall double, ok boolean, status string, misses array<string>, latency_ms double"
    rows = [("a", 0.5, True, "ok", ["ranking", "retrieval"], 1.0), ("b", 1.0, False, "blocked", ["retrieval"], 3.0), ("c", 0.0, None, "ok", ["pass"], 2.0)]
    cards = [reports.scorecard(spark.createDataFrame(r, schema), ["recall"], ["ok"], "status", "misses").first() for r in (rows, rows[::-1], [(*r[:5], 9.0) for r in rows], [("a", 0.6, *rows[0][2:]), *rows[1:]])]
    one = cards[0]
    assert (one.cases, one.recall, one.ok_rate, one.latency_max) == (3, 0.5, 0.5, 3.0)
    assert one.statuses == ["blocked=1", "ok=2"] and one.miss_counts == ["pass=1", "ranking=1", "retrieval=2"] and (one.leading_miss, one.leading_count) == ("retrieval", 2)
    assert cards[1].fingerprint == one.fingerprint == cards[2].fingerprint != cards[3].fingerprint
    none = reports.scorecard(spark.createDataFrame([("a", 1.0, True, "ok", ["pass"], 1.0)], schema), ["recall"], ["ok"], "status", "misses").first()
    assert (none.leading_miss, none.leading_count) == ("none", 0)


def test_retrieval_report_counts_expected_misses(spark):
    cases = spark.createDataFrame([(k,) for k in "abcd"], "case_id string")
    targets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "case_id string, evidence_id int")
    matched = spark.createDataFrame([("a", 2, 7), ("b", 3, 1)], "case_id string, evidence_id int, rank int")
    hits = spark.createDataFrame([("a", 7), ("b", 1), ("c", 2)], "case_id string, rank int")
    by_case = reports.found_by_case(cases, targets, matched, hits, 5, 10)
    r = reports.retrieval_report(by_case, 5, 10).first()
    assert (r.cases, r.evidence_cases, r.expected_misses, r.recall_at_5, r.recall_at_10) == (4, 2, 2, 0.5, 1.0)
    assert (r.missing_cases, r.unexpected_hits, r.replacement_justified) == (1, 1, True)
    whole = reports.retrieval_report(by_case.filter("case_id <> 'a'"), 5, 10).first()
    assert not whole.replacement_justified and whole.missing_cases == 0


def test_modes_need_a_mended_case_and_no_lost_one(spark):
    rows = [("bm25", "a", 0.5), ("bm25", "b", 0.0), ("hybrid", "a", 1.0), ("hybrid", "b", 1.0)]
    modes = spark.createDataFrame(rows, "mode string, case_id string, recall double")
    base = lambda a, b: spark.createDataFrame([("a", a), ("b", b)], "case_id string, recall double")
    good = reports.compare_modes(modes, base(1.0, 0.0)).first()
    assert good.eligible and good.mended == ["b"] and good.lost == [] and good.scores == ["bm25=0.250", "hybrid=1.000"]
    assert not reports.compare_modes(modes, base(1.0, 1.0)).first().eligible
    worse = modes.withColumn("recall", F.when((F.col("mode") == "hybrid") & (F.col("case_id") == "a"), 0.0).otherwise(F.col("recall")))
    assert reports.compare_modes(worse, base(1.0, 0.0)).first().lost == ["a"]


def test_taxonomy_checks_version_and_size(spark, tmp_path):
    def written(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    good = written("a.yaml", "schema_version: v1\nfamilies:\n  - id: x\n    aliases: [one, ' two ', '']\n  - id: y\n    aliases: [p, q]\n    retrieval_aliases: [rr, ss, uu]\n")
    found = stores.families(stores.taxonomy(spark, good, "v1"))
    assert found == {"x": ("one", "two"), "y": ("rr", "ss", "uu")}
    with pytest.raises(ValueError):
        stores.taxonomy(spark, good, "v2")
    with pytest.raises(ValueError):
        stores.taxonomy(spark, written("b.yaml", '{"schema_version": "v1", "families": [{"id": "x", "aliases": ["one"]}]}'), "v1")
    row = spark.createDataFrame([("a TWO b",)], "t string").select(question.detected(F.col("t"), found).alias("d")).first()
    assert row.d == ["x"]


def test_store_rows_take_defaults(spark):
    terms = stores.term_rows(spark.createDataFrame([("damping", None), ("", ["a"])], "term string, aliases array<string>")).collect()
    assert [(r.canonical_term, r.aliases, r.topic) for r in terms] == [("damping", [], None), (None, ["a"], None)]
    symbol = stores.symbol_rows(spark.createDataFrame([("z", "zeta")], "symbol string, canonical_symbol string")).first()
    unit = stores.unit_rows(spark.createDataFrame([("speed", "m/s", "note")], "quantity string, unit string, notes string")).first()
    assert symbol.canonical_symbol == "zeta" and symbol.avoid_confusion_with == [] and (unit.canonical_units, unit.warning_notes) == ("m/s", "note")
    log = stores.qa_log_rows(spark.createDataFrame([("q", ["c1"])], "query string, chunk_refs array<string>")).first()
    assert log.retrieved_chunks == [] and log.meta.logical_retrieved_chunk_ids == ["c1"] and log.chosen_skills == []
    kept = stores.with_added_columns(spark.createDataFrame([(1,)], "a int"), "a int, b string")
    assert kept.columns == ["a", "b"] and kept.first().b is None


def test_redaction_sets_differ(spark):
    rows = [("x-api-key: abcdefgh12", "[REDACTED]"), (r"see C:\work\a.txt now", "[REDACTED_LOCAL_PATH]"), ("in /home/me/a b", "[REDACTED_LOCAL_PATH]")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(redact.for_capture(F.col("t"), 100).alias("c"), redact.for_fixture(F.col("t")).alias("f"), redact.file_paths(F.col("t")).alias("p")).collect()
    assert all(mark in r.c for r, (_, mark) in zip(got, rows))
    assert got[0].f == rows[0][0] == got[0].p and "[REDACTED_PATH]" in got[1].f and got[2].p == "in [REDACTED_LOCAL_PATH] b"
    whole = spark.createDataFrame([(" /home/me/a b ",), ("a Bearer x",), ("y" * 50,)], "t string").select(redact.for_fixture(F.col("t"), 40).alias("f")).collect()
    assert [r.f for r in whole] == [" [REDACTED_PATH] ", "Bearer [REDACTED]", "y" * 40 + "...[TRUNCATED]"]
    fields = spark.createDataFrame([({"api_key": "k", "Token": "t", "tokens": "3"},)], "m map<string,string>").select(redact.fields_for_fixture(F.col("m")).alias("m")).first()
    assert fields.m == {"api_key": "[REDACTED]", "Token": "[REDACTED]", "tokens": "3"}


def plain_items(body):
    found = []
    for pattern in (claims.NUMBER_UNIT, claims.NUMBER, claims.UNIT, claims.SYMBOL):
        found += [re.sub(r"\s+", "", m.group(0)).lower() for m in re.finditer(pattern, body, re.ASCII)]
    return set(x for x in found if x)


def test_missing_items_match_a_plain_version(spark):
    rng = random.Random(5)
    words = ["12", "3.5 Hz", "-7%", "1e5", "a12", "omega_n", "ζ", "rpm", "the", "45 mm/s", "Q", "x-3", "100 kPa", "12.", "speed"]
    rows = [(" ".join(rng.choices(words, k=6)), " ".join(rng.choices(words, k=9))) for _ in range(300)] + [("", ""), ("5", "")]
    got = spark.createDataFrame(rows, "claim string, body string").select("claim", "body", claims.missing_items(F.col("claim"), F.col("body")).alias("m")).collect()
    for r in got:
        compact = re.sub(r"\s+", "", r.body).lower()
        assert r.m == sorted(x for x in plain_items(r.claim) - plain_items(r.body) if x not in compact), r


def test_strict_gate_finds_conflicts(spark):
    made = [
        ("a", 1, "damping ratio reduces the peak response", "c1"),
        ("a", 2, "the peak response rises at 30 Hz shaft speed", "c2"),
        ("b", 1, "the peak response at 40 Hz is shown", "c3"),
        (None, 1, "the peak response at 40 Hz is shown", "c3"),
    ]
    seen = [("a", "c1", "damping ratio increases the peak response amplitude."), ("a", "c2", "the peak response rises at 30 Hz critical speed"), ("b", "c3", "the peak response at 40 Hz is shown"), (None, "c3", "x")]
    got = claims.support_gate(spark.createDataFrame(made, "answer_id string, claim_ix int, claim string, chunk_id string"), spark.createDataFrame(seen, "answer_id string, chunk_id string, text string"), strict=True).collect()
    by = {(r.answer_id, r.claim_ix): r for r in got}
    assert len(got) == 4 and "direction conflict" in by["a", 1].reasons and "quantity conflict" in by["a", 2].reasons
    assert by["b", 1].reasons == [] and not by["b", 1].blocked and by["a", 1].blocked and by["a", 2].blocked and by[None, 1].blocked


def test_likeness_agrees_with_the_plain_ratio():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh") for _ in range(300))
    for changes in (0, 3, 8, 12, 20, 60):
        other = list(base)
        for at in rng.sample(range(300), changes):
            other[at] = "z"
        other = "".join(other)
        assert evidence.repeats(other, [base]) == (SequenceMatcher(None, other, base).ratio() >= 0.94)
    assert evidence.repeats("", []) and evidence.repeats(base[:90], [base]) and not evidence.repeats(base[:70], [base]) and evidence.repeats("ab", ["ab"])


def test_selection_takes_neighbours_after_seeds(spark):
    corpus = [("c1", "d", 1, "A first whole sentence stands here."), ("c2", "d", 2, "The rotor was balanced and"), ("c3", "d", 3, "then it ran without trouble."), ("c4", "d", 4, "Unrelated text.")]
    chunks = spark.createDataFrame(corpus, "chunk_id string, doc_id string, chunk_index int, text string")
    seeds = spark.createDataFrame([("q", "c2", 1), ("q", "c4", 2)], "query_id string, chunk_id string, rank int")
    found = evidence.with_neighbors(seeds, chunks, 1)
    assert {r.chunk_id: (r.kind, r.seed_id) for r in found.collect()} == {"c2": ("seed", None), "c4": ("seed", None), "c3": ("adjacent", "c2")}
    picked = evidence.select_evidence(found, max_chunks=3, token_budget=1000).orderBy("pick").collect()
    assert [r.chunk_id for r in picked] == ["c2", "c4", "c3"]


def test_filters_are_lenient_or_strict(spark):
    rows = [("a", "rotor one"), ("a", "other"), ("b", "other")]
    s = spark.createDataFrame(rows, "query_id string, sentence string")
    holds = F.contains("sentence", F.lit("rotor"))
    kept = lambda strict: sorted((r.query_id, r.sentence) for r in claims.narrowed(s, [(F.lit(True), holds, strict)]).collect())
    assert kept(False) == [("a", "rotor one"), ("b", "other")] and kept(True) == [("a", "rotor one")]
    assert claims.narrowed(s, [(F.lit(False), holds, True)]).count() == 3


def test_step_support_is_strict_where_asked(spark):
    steps = [("a", "s1", "axiomatic", "x", None), ("a", "s2", "evidence", "at 30 Hz", "c"), ("a", "s3", "evidence", "y", None), ("a", "s4", "llm", "y", "c"), ("a", "s5", None, "y", "d")]
    df = spark.createDataFrame(steps, "answer_id string, step_id string, source_type string, text string, chunk_id string")
    visible = spark.createDataFrame([("a", "c", "at 20 Hz")], "answer_id string, chunk_id string, text string")
    got = {r.step_id: r.reasons for r in claims.step_support(df, visible, strict=True).collect()}
    assert got == {"s1": [], "s2": ["missing items"], "s3": ["missing chunk"], "s4": ["source type"], "s5": ["source type", "chunk not visible"]}


def test_slots_by_intent(spark):
    rows = [("what is order analysis", "order analysis refers to x and is used for y", 1.0), ("why does resonance occur", "because it approaches", 0.5), ("tell me", "is used for", 0.0), ("compare unbalance", "compared: unbalance and misalignment", 1.0), ("diagnose it", "phase and axial and harmonic", 1.0), ("formula?", "Q = 1", 0.5)]
    got = spark.createDataFrame([r[:2] for r in rows], "q string, a string").select(question.completeness(F.col("q"), F.col("a")).alias("c")).collect()
    assert [r.c for r in got] == [r[2] for r in rows]
    lines = spark.createDataFrame([("## Head\nWhole one. (evidence: c1)\nhalf [c2]\n",), ("",)], "a string").select(text.complete_sentences(F.col("a")).alias("s")).collect()
    assert [r.s for r in lines] == [0.5, 0.0]


def test_guard_packs_and_numbers(spark):
    one = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, n int")
    assert sinks.guarded(one, "doc_id").count() == 2
    with pytest.raises(Exception, match="more than one document"):
        sinks.guarded(one.union(spark.createDataFrame([("e", 3)], one.schema)), "doc_id").select("doc_id").collect()
    pack = sinks.context_packs(spark.createDataFrame([("d", 2, "b", "t", ["y", "x"]), ("d", 1, "a", "t", ["x"])], "doc_id string, chunk_index int, chunk_id string, text string, assets array<string>")).first()
    assert pack.assets == ["x", "y"] and pack.n_chunks == 2
    numbered = sinks.with_surrogate(spark.createDataFrame([("b",), ("a",), ("zz",), ("k",)], "k string"), spark.createDataFrame([("k", 7)], "k string, id long"), "k", "id").collect()
    assert {r.k: r.id for r in numbered} == {"k": 7, "a": 8, "b": 9, "zz": 10}


def test_percentiles_of_many_equal_and_few_values(spark):
    rng = random.Random(2)
    rows = [("a", float(rng.randrange(5))) for _ in range(3000)] + [("b", rng.random()) for _ in range(2000)] + [("c", 1.0), ("d", None)]
    got = {r.g: (r.p0, r.p50, r.p95) for r in evaluation.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95}, bins=16).collect()}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g)
        assert got[g] == tuple(values[int((len(values) - 1) * p + 0.5)] for p in (0.0, 0.5, 0.95))
    assert "d" not in got


def test_bad_chunk_lines_fail(spark, tmp_path):
    (tmp_path / "chunks.jsonl").write_text('{"chunk_id": "a"}\n')
    assert files.chunk_files(spark, str(tmp_path)).count() == 1
    (tmp_path / "chunks_2.jsonl").write_text('{"chunk_id": \n')
    with pytest.raises(Exception):
        files.chunk_files(spark, str(tmp_path)).collect()


def test_regions_and_assets(spark):
    boxes = spark.createDataFrame([("d", 1, [0.0, 0.0, float(k), 1.0], None) for k in range(1, 7)] + [("d", 1, [0.0, 0.0, 9.0, 9.0], "tiny")], "doc_id string, page_no int, box array<double>, skip string")
    got = layout.regions_to_read(boxes).collect()
    assert sum(r.skip is None for r in got) == 4 and {r.box[2] for r in got if r.skip is None} == {3.0, 4.0, 5.0, 6.0} and sum(r.skip == "tiny" for r in got) == 1
    blocks = layout.enriched_blocks(spark.createDataFrame([("d", 1, 0, "body", "x"), ("d", 1, 1, "table", "t"), ("d", 1, 2, "figure", "f")], "doc_id string, page_no int, block_ix int, kind string, body string"))
    assert [r.asset_id for r in blocks.orderBy("block_ix").collect()] == [None, "d_p0001_table_0001", "d_p0001_figure_0002"]


def test_answers_use_neighbours_and_outcome_filter(spark):
    corpus = [
        ("c1", "d", 1, "Passing the critical speed gives an amplified response of the rotor and", "book"),
        ("c2", "d", 2, "the amplitude of the rotor response then falls again.", "book"),
        ("c3", "e", 1, "Definition of the critical speed and its response.", "note"),
    ]
    chunks = spark.createDataFrame(corpus, "chunk_id string, doc_id string, chunk_index int, body string, source_type string")
    asked = spark.createDataFrame([(1, "what happens to the rotor at the critical speed"), (2, "zzz")], "query_id long, query string")
    got = {r.query_id: r for r in answers(asked, chunks).collect()}
    assert got[1].status == "ok" and "amplified response" in got[1].answer and "Definition" not in got[1].answer
    assert got[2].status == "insufficient"

"""Queries of reports, claim filters, step support, enriched pages and store tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import question, text
from marginalia.operators import chunking, claims, evaluation, evidence, layout, reports, retrieval
from marginalia.plans.claim_queries import SQL_IN_SCOPE, SQL_SENTENCES, _any, _sentences
from marginalia.plans.document_queries import SQL_BLOCKS, blocks_of
from marginalia.plans.retrieval_queries import SQL_BM25, SQL_CHUNKS, chunks_of
from marginalia.plans.text_queries import SQL_TOKENS
from marginalia.session import table, written
from marginalia.sources import files, sinks, stores

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


# Cases are sources by language; good documents (labels) are their evidence, longer texts the better hits.
SQL_CASES = """
d AS (SELECT source || ':' || lang AS case_id, doc_id, length(text) AS n, text FROM documents), cs AS (SELECT DISTINCT case_id FROM d),
t AS (SELECT d.case_id, d.doc_id AS evidence_id, d.doc_id AS chunk_id FROM d JOIN labels USING (doc_id) WHERE quality = 1),
h AS (SELECT case_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS rank FROM d),
m AS (SELECT t.case_id, t.evidence_id, h.rank FROM t JOIN h USING (case_id, chunk_id)),
e AS (SELECT case_id, count(*) AS targets, max(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS hit5, max(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS hit10,
  avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS share5, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS share10 FROM m GROUP BY case_id)"""
SQL_BY_LENGTH = SQL_CASES.format(order="n DESC, doc_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws(":", "source", "lang").alias("case_id"), F.col("doc_id").alias("chunk_id"), F.length("text").alias("n"), "text")


def _targets(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return docs.join(good, "chunk_id").select("case_id", "chunk_id", F.col("chunk_id").alias("evidence_id"))


def _by_case(spark: SparkSession, sf_dir: str, *order) -> DataFrame:
    docs = _documents(spark, sf_dir)
    targets = _targets(spark, sf_dir, docs)
    ranked = Window.partitionBy("case_id").orderBy(*order)
    hits = docs.withColumn("rank", F.row_number().over(ranked)).filter("rank <= 10").select("case_id", "chunk_id", "rank")
    matched = targets.join(hits, ["case_id", "chunk_id"]).select("case_id", "evidence_id", "rank")
    return reports.found_by_case(docs.select("case_id").distinct(), targets, matched, hits, 5, 10)




@query(f"""
WITH {SQL_BY_LENGTH} SELECT CAST(count(*) AS BIGINT) AS cases, CAST(count(e.targets) AS BIGINT) AS evidence_cases, CAST(count(*) - count(e.targets) AS BIGINT) AS expected_misses, round(avg(hit5), 6) AS recall_at_5, round(avg(hit10), 6) AS recall_at_10,
  CAST(count(*) FILTER (hit5 = 0 OR hit10 = 0) AS BIGINT) AS missing_cases, CAST(count(*) FILTER (e.targets IS NULL) AS BIGINT) AS unexpected_hits,
  coalesce(avg(hit10) < 0.8 OR count(*) FILTER (hit5 = 0 OR hit10 = 0) >= 1, false) AS replacement_justified FROM cs LEFT JOIN e USING (case_id)""")
def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit-any recall of the longest documents of a case, cases that expect nothing, and the gate."""
    return reports.retrieval_report(_by_case(spark, sf_dir, F.desc("n"), "chunk_id"), 5, 10)


@query(f"""
WITH {SQL_BY_LENGTH}, c AS (SELECT case_id, coalesce(share5, 0) AS recall_at_5, coalesce(share10, 0) AS recall_at_10, coalesce(hit10 = 1, false) AS faithful FROM cs LEFT JOIN e USING (case_id)),
k AS (SELECT *, CASE WHEN faithful THEN 'ok' ELSE 'insufficient' END AS status,
  list_filter([CASE WHEN recall_at_10 < 1 THEN 'retrieval' END, CASE WHEN recall_at_5 < recall_at_10 THEN 'ranking' END, CASE WHEN NOT faithful THEN 'synthesis' END], lambda x: x IS NOT NULL) AS ms FROM c),
p AS (SELECT *, CASE WHEN len(ms) = 0 THEN ['pass'] ELSE ms END AS misses, round(recall_at_10 * 100, 3) AS latency_ms FROM k),
s AS (SELECT case_id, unnest(misses) AS miss, unnest(range(1, len(misses) + 1)) AS place FROM p), sc AS (SELECT miss, count(*) AS n, min((case_id, place)) AS seen FROM s GROUP BY miss), st AS (SELECT status, count(*) AS n FROM p GROUP BY status),
l AS (SELECT miss, n FROM sc WHERE miss <> 'pass' ORDER BY n DESC, seen LIMIT 1)
SELECT CAST(count(*) AS BIGINT) AS cases, round(avg(recall_at_5), 3) AS recall_at_5, round(avg(recall_at_10), 3) AS recall_at_10, round(avg(CAST(faithful AS INTEGER)), 3) AS faithful_rate,
  round(sum(latency_ms), 3) AS latency_total, round(avg(latency_ms), 3) AS latency_mean, round(max(latency_ms), 3) AS latency_max,
  (SELECT list_sort(list(status || '=' || n)) FROM st) AS statuses, (SELECT list_sort(list(miss || '=' || n)) FROM sc) AS miss_counts,
  coalesce((SELECT miss FROM l), 'none') AS leading_miss, coalesce((SELECT CAST(n AS BIGINT) FROM l), 0) AS leading_count FROM p""")
def evaluation_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecard of the cases; its fingerprint has a test of its own."""
    by_case = _by_case(spark, sf_dir, F.desc("n"), "chunk_id").select("case_id", *[F.coalesce(f"share_at_{k}", F.lit(0.0)).alias(f"recall_at_{k}") for k in (5, 10)], F.coalesce("hit_at_10", F.lit(False)).alias("faithful"))
    r5, r10, ok = F.col("recall_at_5"), F.col("recall_at_10"), F.col("faithful")
    misses = evaluation.miss_categories(r5, r10, F.lit(False), F.lit(False), F.lit(1.0), ok)
    cases = by_case.withColumn("status", F.when(ok, "ok").otherwise("insufficient")).withColumn("misses", misses).withColumn("latency_ms", F.round(r10 * 100, 3))
    return reports.scorecard(cases, ["recall_at_5", "recall_at_10"], ["faithful"], "status", "misses").drop("fingerprint")


def _sql_mode(name: str, order: str) -> str:
    return f"SELECT '{name}' AS mode, case_id, share10 AS recall FROM (WITH {SQL_CASES.format(order=order)} SELECT * FROM e)"


@query(f"""
WITH a AS ({_sql_mode('bm25', 'n DESC, doc_id')} UNION ALL {_sql_mode('dense', 'doc_id')} UNION ALL {_sql_mode('hybrid', 'md5(text), doc_id')}), z AS (SELECT case_id, share10 AS was FROM (WITH {SQL_CASES.format(order='doc_id DESC')} SELECT * FROM e)),
s AS (SELECT mode, round(avg(recall), 3) AS r FROM a GROUP BY mode), x AS (SELECT max(r) FILTER (mode = 'hybrid') AS mine, max(r) FILTER (mode <> 'hybrid') AS best_other FROM s),
c AS (SELECT round(avg(was), 3) AS baseline, coalesce(list_sort(list(case_id) FILTER (was = 0 AND recall > 0)), []) AS mended, coalesce(list_sort(list(case_id) FILTER (was = 1 AND recall = 0)), []) AS lost FROM z JOIN a USING (case_id) WHERE mode = 'hybrid')
SELECT (SELECT list(mode || '=' || printf('%.3f', r) ORDER BY mode) FROM s) AS scores, best_other, baseline, mended, lost, mine >= best_other AND mine >= baseline AND len(mended) > 0 AND len(lost) = 0 AS eligible FROM x, c""")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders of a case's documents as modes against a fourth as the baseline."""
    orders = {"bm25": (F.desc("n"), "chunk_id"), "dense": ("chunk_id",), "hybrid": (F.md5("text"), "chunk_id"), "baseline": (F.desc("chunk_id"),)}
    recalls = [_by_case(spark, sf_dir, *order).filter("targets > 0").select(F.lit(mode).alias("mode"), "case_id", F.col("share_at_10").alias("recall")) for mode, order in orders.items()]
    return reports.compare_modes(recalls[0].unionByName(recalls[1]).unionByName(recalls[2]), recalls[3].drop("mode"))


@query("""
WITH p AS (SELECT role, text, regexp_matches(text, '[0-9]') AS numeric, regexp_matches(text, '[.!?]$') AS whole FROM conversations)
SELECT CAST(count(*) AS BIGINT) AS cases, round(avg(CAST(whole AS INTEGER)), 6) AS pass_rate, round(avg(CASE WHEN numeric THEN CAST(whole AS INTEGER) END), 6) AS numeric_block_rate,
  round(avg(CASE WHEN role = 'assistant' THEN CAST(length(text) > 200 AS INTEGER) END), 6) AS notes_rate, CAST(NULL AS DOUBLE) AS never_asked FROM p""")
def golden_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of recorded turns as pass rates; turns that a check does not ask about are left out."""
    t, whole = F.col("text"), F.col("text").rlike("[.!?]$")
    return reports.pass_rates(
        table(spark, sf_dir, "conversations"), pass_rate=whole, numeric_block_rate=F.when(t.rlike("[0-9]"), whole), notes_rate=F.when(F.col("role") == "assistant", F.length("text") > 200), never_asked=F.lit(None).cast("boolean")
    )


@query(f"""
WITH qs AS (SELECT item_id AS query_id, text FROM benchmark), {SQL_CHUNKS}, {SQL_BM25}, b AS (SELECT query_id, chunk_id FROM bmr WHERE rank = 1),
w AS (SELECT query_id, list_filter({SQL_TOKENS}, lambda x: length(x) >= 8) AS terms FROM qs),
j AS (SELECT w.query_id, terms, lower(coalesce(c.text, '')) AS body, b.chunk_id FROM w LEFT JOIN b USING (query_id) LEFT JOIN chunks c USING (chunk_id))
SELECT CAST(count(*) AS BIGINT) AS questions, round(avg(CAST(chunk_id IS NOT NULL AS INTEGER)), 3) AS citation_coverage, round(avg(CAST(len(list_filter(terms, lambda x: contains(body, x))) > 0 AS INTEGER)), 3) AS term_hit_rate FROM j""")
def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as the question set: how many get a hit, and whether the best hit holds a long word of theirs."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    chunks = chunks_of(spark, sf_dir)
    # One row a question goes to the texts, which stay where they are.
    hits = retrieval.bounded(written(retrieval.bm25(chunks, items, 1).select("query_id", "chunk_id"), "best"))
    best = chunks.select("chunk_id", "body").join(hits, "chunk_id").select("query_id", "body")
    return reports.cold_start(items.select("query_id", F.filter(text.tokens(F.col("query")), lambda x: F.length(x) >= 8).alias("terms")), best)


# Claim filters and steps

SQL_LICENSE, SQL_APPLIES = _any("sentence", ("license", "licence")), _any("sentence", claims.SCOPE_CLAIM)


@query(f"""
WITH {SQL_SENTENCES}, f AS (SELECT query_id, doc_id, i, ({SQL_LICENSE}) AS a, contains(lower(sentence), 'token') AS b FROM s),
x AS (SELECT * FROM (SELECT *, max(CAST(a AS INTEGER)) OVER (PARTITION BY query_id) AS kept FROM f) WHERE a OR kept = 0)
SELECT query_id, doc_id, CAST(i AS INTEGER) AS i FROM x WHERE query_id NOT LIKE '%1' OR b""")
def narrowed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each source after a lenient filter on licences, and a strict one on tokens for some sources."""
    s = F.col("sentence")
    wanted = [(F.lit(True), claims.has_any(s, ("license", "licence")), False), (F.col("query_id").endswith("1"), claims.has_any(s, ("token",)), True)]
    return claims.narrowed(_sentences(spark, sf_dir), wanted).select("query_id", "doc_id", "i")


@query(f"""
SELECT conv_id, turn, {_any('text', claims.SCOPE_CLAIM)} AND NOT contains(text, '引用文件') AND NOT contains(text, '适用于本文件') AS scope_claim,
  {_any('text', claims.CRITICAL_SPEED)} AND {_any('text', claims.OUTCOME_QUESTION)} AS outcome_question,
  NOT {_any('text', claims.DEFINITION)} AND {_any('text', ('token', 'license'))} AND {_any('text', ('the', 'und'))} AS outcome_claim FROM conversations""")
def claim_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker predicates of each turn."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", claims.is_scope_claim(t).alias("scope_claim"), claims.is_outcome_question(t).alias("outcome_question"), claims.is_outcome_claim(t, ("token", "license"), ("the", "und")).alias("outcome_claim")
    )


SQL_STEPS = """
st AS (SELECT conv_id AS answer_id, turn AS step_id, CASE role WHEN 'user' THEN 'axiomatic' WHEN 'assistant' THEN 'evidence' ELSE 'guess' END AS source_type, text,
  CASE WHEN length(text) % 2 = 0 THEN turn - 1 END AS chunk_id FROM conversations),
v AS (SELECT conv_id AS answer_id, turn AS chunk_id, text AS body FROM conversations WHERE role <> 'assistant')"""


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as derivation steps that rest on the turn before them, where their length is even; answers are not visible."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", claims.AXIOMATIC).when(F.col("role") == "assistant", claims.EVIDENCE).otherwise("guess")
    steps = turns.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("step_id"), kind.alias("source_type"), "text", F.when(F.length("text") % 2 == 0, F.col("turn") - 1).alias("chunk_id"))
    return steps, turns.filter("role <> 'assistant'").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("chunk_id"), "text")


@query(f"""
WITH {SQL_STEPS} SELECT answer_id, step_id, CASE WHEN source_type = 'axiomatic' THEN [] ELSE list_filter([CASE WHEN source_type <> 'evidence' THEN 'source type' END, CASE WHEN chunk_id IS NULL THEN 'missing chunk' END,
  CASE WHEN chunk_id IS NOT NULL AND body IS NULL THEN 'chunk not visible' END], lambda x: x IS NOT NULL) END AS reasons FROM st LEFT JOIN v USING (answer_id, chunk_id)""")
def step_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.step_support(*_steps(spark, sf_dir)).select("answer_id", "step_id", "reasons")


@query(f"""
WITH {SQL_STEPS}, c AS (SELECT st.answer_id, step_id, source_type, chunk_id, row_number() OVER (PARTITION BY st.answer_id ORDER BY step_id) AS n FROM st JOIN v USING (answer_id, chunk_id)),
h AS (SELECT *, CASE n WHEN 1 THEN 'basis' WHEN 2 THEN 'effect' ELSE 'limits' END AS heading FROM c)
SELECT answer_id, heading, string_agg('- ' || source_type || ' [' || chunk_id || ']', chr(10) ORDER BY step_id) AS lines, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY answer_id, heading""")
def framed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible steps as claims under three headings."""
    steps, visible = _steps(spark, sf_dir)
    return claims.framed(steps.select("answer_id", F.col("step_id").alias("claim_ix"), F.col("source_type").alias("claim"), "chunk_id"), visible, ("basis", "effect", "limits"))


@query(r"""
WITH r AS (SELECT doc_id, source, split_part(text, e'\n', 1) AS title, lang, trim(regexp_replace(lower(split_part(text, ' ', 1)), '[_\W]+', ' ', 'g')) AS topic FROM documents)
SELECT doc_id FROM r WHERE source <> 'src0' OR (NOT regexp_matches(trim(CASE WHEN title <> '' THEN title ELSE topic END), '(?i)^(?:参考文献|references|bibliography)$') AND (contains(topic, 'the') OR contains('the', topic)) AND lang = 'en')""")
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source asks for a section (here: a language) and a topic; the rest asks for nothing."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n")[0].alias("section_title"), F.col("lang").alias("section_key"), F.split("text", " ")[0].alias("topic"))
    asked = rows.filter("source = 'src0'")
    kept = evidence.filtered(asked, F.lit("section_summary"), F.lit(None), F.lit("en"), F.lit("the"))
    return kept.select("doc_id").unionByName(rows.filter("source <> 'src0'").select("doc_id"))


@query(r"""
WITH c AS (SELECT doc_id, CAST(i AS INTEGER) AS ix, trim(ls[i + 1], e' \t\r') AS unit FROM (SELECT doc_id, string_split_regex(text, '[,\n]') AS ls FROM documents), unnest(range(0, len(ls))) AS r(i)),
g AS (SELECT *, regexp_matches(lower(unit), '^(当|因此|所以|并且|同时|其中|则|而|从而|when |therefore |and |also )') OR regexp_matches(unit, '^[a-z]') AS goes_on, NOT regexp_matches(unit, '[。！？!?；;.…．]["''”’）】》\]]*$') AS open FROM c),
s AS (SELECT doc_id, ix FROM g WHERE ix % 4 = 0), n AS (SELECT s.doc_id, n.ix, s.ix AS seed, n.ix - s.ix AS side FROM s JOIN g a ON a.doc_id = s.doc_id AND a.ix = s.ix JOIN g n ON n.doc_id = s.doc_id AND (n.ix = s.ix + 1 OR n.ix = s.ix - 1)
  WHERE CASE WHEN n.ix < s.ix THEN a.goes_on AND n.open ELSE a.open AND n.goes_on END),
e AS (SELECT doc_id, ix, 0 AS late, ix AS rank, 0 AS side, CAST(NULL AS INTEGER) AS seed FROM s UNION ALL SELECT doc_id, ix, 1, seed, side, seed FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ix ORDER BY late, rank, abs(side), side) AS p FROM e)
SELECT doc_id, ix AS chunk_index, CASE late WHEN 0 THEN 'seed' ELSE 'adjacent' END AS kind, seed AS seed_index FROM o WHERE p = 1""")
def evidence_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth clause of a document as a seed, and the neighbours that run on from one."""
    docs = table(spark, sf_dir, "documents")
    units = docs.select("doc_id", F.posexplode(F.split("text", "[,\n]")).alias("chunk_index", "text")).withColumn("text", text.strip(F.col("text"))).withColumn("chunk_id", F.struct("doc_id", "chunk_index"))
    seeds = units.filter("chunk_index % 4 = 0").select(F.col("doc_id").alias("query_id"), "chunk_id", F.col("chunk_index").alias("rank"))
    found = evidence.with_neighbors(seeds, units, 1)
    return found.select(F.col("query_id").alias("doc_id"), "chunk_id.chunk_index", "kind", F.col("seed_id.chunk_index").alias("seed_index"))


# Pages and stores


@query(rf"""
WITH {SQL_BLOCKS}, k AS (SELECT *, CASE WHEN b = '' THEN 'unknown' WHEN regexp_matches(b, '[0-9]') THEN 'table' WHEN length(b) < 12 THEN 'title' WHEN contains(b, '=') THEN 'formula' ELSE 'body' END AS kind FROM blocks),
a AS (SELECT *, sum(CASE WHEN kind IN ('table', 'formula') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY block_ix) AS n FROM k)
SELECT page_id AS doc_id, CAST(1 AS INTEGER) AS page_no, trim(coalesce(string_agg(b, chr(10) ORDER BY block_ix) FILTER (kind IN ('body', 'title') AND b <> ''), '')) AS body,
  list_sort(coalesce(list(printf('%s_p0001_%s_%04d', CAST(page_id AS VARCHAR), kind, CAST(n AS INTEGER))) FILTER (kind IN ('table', 'formula')), [])) AS assets, CAST(count(*) AS BIGINT) AS n_blocks FROM a GROUP BY page_id""")
def page_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages by a simple kind, numbered assets, and the body joined anew."""
    body = text.squeeze(F.col("body"))
    kind = F.when(body == "", "unknown").when(body.rlike("[0-9]"), "table").when(F.length(body) < 12, "title").when(F.contains(body, F.lit("=")), "formula").otherwise("body")
    blocks = blocks_of(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), "block_ix", kind.alias("kind"), body.alias("body"))
    return layout.enriched_pages(layout.enriched_blocks(blocks))


@query(r"""
WITH a AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS asset FROM conversations)
SELECT conv_id AS doc_id, asset AS asset_id, CASE WHEN length(asset) > 6 THEN 'figure' ELSE 'table' END AS kind, min(turn) AS related_chunk FROM a WHERE length(asset) <> 5 GROUP BY ALL""")
def figure_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in conversations as assets: one row an asset of a document, with the first chunk that holds it."""
    named = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), 0)).alias("asset_id"))
    kind = F.when(F.length("asset_id") == 5, "formula").when(F.length("asset_id") > 6, "figure").otherwise("table")
    return layout.figure_table_rows(named.select(F.col("conv_id").alias("doc_id"), "asset_id", kind.alias("object_type"), F.col("turn").alias("chunk_index"), F.col("turn").alias("chunk_id")))


@query(r"""
WITH b AS (SELECT page_id, k, len(t) AS w FROM (SELECT page_id, string_split(html, '<') AS ts FROM pages), unnest(range(0, len(ts))) AS r(k), (SELECT 1) AS o(x), LATERAL (SELECT ts[k + 1] AS t) AS l),
s AS (SELECT *, CASE WHEN w < 4 THEN 'tiny' END AS skip FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY page_id, skip IS NULL ORDER BY w DESC, k) AS n FROM s)
SELECT page_id, CAST(count(*) FILTER (skip IS NULL AND n <= 4) AS BIGINT) AS taken, CAST(count(*) FILTER (skip = 'tiny') AS BIGINT) AS tiny, CAST(count(*) FILTER (skip IS NULL AND n > 4) AS BIGINT) AS over FROM o GROUP BY page_id""".replace("len(t) AS w", "length(t) AS w"))
def region_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of pages as boxes as wide as their text: how many are read, and why others are not."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<")).alias("k", "tag"))
    wide, at = F.length("tag").cast("double"), F.col("k").cast("double")
    boxes = tags.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), F.array(at, F.lit(0.0), at + wide, F.lit(1.0)).alias("box"), F.when(wide < 4, "tiny").alias("skip"))
    count = lambda c: F.count_if(c)
    return layout.regions_to_read(boxes).groupBy(F.col("doc_id").alias("page_id")).agg(
        count(F.col("skip").isNull()).alias("taken"), count(F.col("skip") == "tiny").alias("tiny"), count(F.col("skip") == "over the limit of regions").alias("over")
    )


@query("""
SELECT text AS value, CAST(count(*) AS BIGINT) AS n, 'external_id is not unique' AS rule FROM (SELECT sha256(text) AS text FROM documents) GROUP BY text HAVING count(*) > 1
UNION ALL SELECT hash, CAST(count(*) AS BIGINT), 'hash is not unique' FROM (SELECT source || ':' || n_chars AS hash FROM documents) WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1
UNION ALL SELECT NULL, CAST(count(*) AS BIGINT), 'file_path is missing' FROM documents HAVING count(*) > 0""")
def store_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the store: values that should be unique and are not, and required ones that are missing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.sha2("text", 256).alias("external_id"), F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("hash"))
    return stores.violations(stores.stored(docs, "documents"), "documents").select("value", "n", "rule")


@query("""
SELECT CAST(conv_id AS VARCHAR) AS answer_id, CAST(NULL AS BIGINT) AS chunk_id, CASE WHEN role = 'assistant' THEN 'inferred' ELSE 'documented' END AS evidence_type,
  CASE WHEN role = 'user' THEN 0.5 ELSE 1.0 END AS confidence, CAST(turn AS VARCHAR) AS logical_chunk_id FROM conversations""")
def citation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as citations of their conversation, with the defaults of the store."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("answer_id"), F.col("turn").cast("string").alias("chunk_id"), F.when(F.col("role") == "assistant", "inferred").alias("evidence_type"), F.when(F.col("role") == "user", F.lit(0.5)).alias("confidence")
    )
    return stores.citation_rows(turns).select("answer_id", "chunk_id", "evidence_type", "confidence", "meta.logical_chunk_id")


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 100")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest events; the limit is the feature."""
    return sinks.newest(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id", 100)


@query("SELECT CAST(item_id AS VARCHAR) AS name, length(text) AS size FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def unapplied_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as migrations, English documents as the ledger of applied ones."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.length("text").alias("size"))
    return sinks.unapplied(items, table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("name")))


@query("""SELECT 'manifest:' || doc_id AS key, '{"doc_id":' || doc_id || ',"source":"' || source || '","n_chars":' || n_chars || '}' AS value, 600 AS ttl_seconds FROM documents""")
def cache_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.cache_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), 600)


@query("SELECT doc_id AS chunk_id, CASE WHEN trim(text) = '' THEN 'blank text' ELSE 'no vector' END AS reason FROM documents WHERE trim(text) = '' OR doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 1)".replace("label <> 1", "vec_id % 3 <> 0"))
def skipped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a point, where two thirds of the vectors are at hand."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return sinks.skipped_points(docs, table(spark, sf_dir, "embeddings").filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("chunk_id")))


@query("""
WITH k AS (SELECT source || ':' || doc_id AS name, CASE WHEN lang = 'en' THEN doc_id END AS id FROM documents)
SELECT name, coalesce(id, (SELECT max(id) FROM k) + row_number() OVER (PARTITION BY id IS NULL ORDER BY name)) AS id FROM k""")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents have a number already; the rest get the next ones in the order of their names."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("name"), "lang", F.col("doc_id").alias("id"))
    return sinks.with_surrogate(docs.select("name"), docs.filter("lang = 'en'").select("name", "id"), "name", "id")


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, '(?i)\.pdf$') THEN 'pdf' WHEN regexp_matches(url, '(?i)\.docx$') THEN 'docx' WHEN regexp_matches(url, '(?i)\.(png|jpg|jpeg|tif|tiff|bmp|webp)$') THEN 'image'
  WHEN regexp_matches(url, '(?i)\.(txt|md)$') THEN 'text' ELSE 'unsupported' END AS kind FROM pages""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.kind_of(F.col("url")).alias("kind"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT m.conv_id AS doc_id, coalesce(n, 0) AS n_chunks, CASE WHEN n IS NULL THEN 'chunks file is missing' END AS warning FROM (SELECT DISTINCT conv_id FROM conversations) m LEFT JOIN c USING (conv_id)""")
def exported_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as manifests, answers as their chunks."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    return files.export_documents(turns.select("doc_id").distinct(), turns.filter("role = 'assistant'"))


@query("""
WITH a AS (SELECT doc_id AS chunk_id, n_chars, source, doc_id % 5 AS i FROM documents) SELECT CAST(chunk_id AS VARCHAR) AS chunk_id, CASE WHEN chunk_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CAST(0 AS INTEGER) AS input_no FROM a
UNION ALL SELECT CAST(doc_id + 10000000 AS VARCHAR), n_chars + 1, 1 FROM documents WHERE doc_id % 3 = 0""")
def merged_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two inputs: rows that come again in the second win, new ones follow."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("n_chars").alias("size"), F.lit(0).alias("chunk_index"))
    first = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "size", "chunk_index")
    again = docs.filter("doc_id % 3 = 0").withColumn("size", F.col("size") + 1)
    second = again.select(F.col("doc_id").cast("string").alias("chunk_id"), "size", "chunk_index").unionByName(again.select((F.col("doc_id") + 10_000_000).cast("string").alias("chunk_id"), "size", "chunk_index"))
    return files.merged_chunks(first, second).select("chunk_id", "size", "input_no")


@query(r"""
SELECT page_id, block_ix, CASE WHEN regexp_matches(b, '(?i)^chapter\s+\d+\b') THEN 1 WHEN regexp_matches(b, '^\d+(?:\.\d+)+\b') THEN len(string_split(regexp_extract(b, '^(\d+(?:\.\d+)+)\b', 1), '.'))
  WHEN regexp_matches(b, '^\d+[\.)]\s+\S+') THEN 2 WHEN starts_with(b, '第') AND contains(b, '章') THEN 1 WHEN starts_with(b, '第') AND contains(b, '节') THEN 2 ELSE 1 END AS level FROM blocks""".replace("SELECT page_id, block_ix", f"WITH {SQL_BLOCKS} SELECT page_id, block_ix", 1))
def title_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of every line of a page, taken as a title."""
    return blocks_of(spark, sf_dir).select("page_id", "block_ix", chunking.title_level(text.squeeze(F.col("body"))).alias("level"))


@query("""
WITH c AS (SELECT quality, least(length(text) / 4000.0, 1.0) AS score FROM documents JOIN labels USING (doc_id)), t AS (SELECT CAST(round(k * 0.05, 2) AS DOUBLE) AS threshold FROM range(0, 21) r(k)),
x AS (SELECT threshold, count(*) FILTER (quality = 1 AND score < threshold) AS fb, count(*) FILTER (quality = 0 AND score >= threshold) AS fa FROM c, t GROUP BY threshold)
SELECT threshold, CAST(fb AS BIGINT) AS false_block, CAST(fa AS BIGINT) AS false_allow FROM x ORDER BY fa, fb, threshold DESC LIMIT 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of text length with the fewest false allows; the single row is the feature."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.least(F.length("text") / 4000.0, F.lit(1.0)).alias("score")).join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluation.best_threshold(evaluation.threshold_sweep(docs, "score", "quality")).select("threshold", "false_block", "false_allow")


@query("""
WITH g AS (SELECT conv_id AS answer_id, CASE role WHEN 'user' THEN 'q' ELSE 'a' || (turn % 3) END AS chunk_id, turn AS seq, role FROM conversations), c AS (SELECT * FROM g WHERE role = 'system' AND answer_id % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY answer_id, chunk_id ORDER BY seq) AS k FROM g WHERE role <> 'system' AND answer_id NOT IN (SELECT answer_id FROM c)), m AS (SELECT *, row_number() OVER (PARTITION BY answer_id, chunk_id ORDER BY seq) AS k FROM c)
SELECT answer_id, chunk_id, seq FROM n WHERE k = 1 UNION ALL SELECT answer_id, chunk_id, seq FROM m WHERE k = 1""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First citation of each chunk; conversations without any take theirs from the turns."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), F.when(F.col("role") == "user", "q").otherwise(F.concat(F.lit("a"), (F.col("turn") % 3).cast("string"))).alias("chunk_id"), F.col("turn").alias("seq"), "role")
    given = rows.filter("role = 'system' AND answer_id % 2 = 0").drop("role")
    return evidence.unique_citations(given, rows.filter("role <> 'system'").drop("role"))


@query(f"SELECT conv_id, turn, coalesce(CASE WHEN role = 'assistant' THEN length(text) > 500 END, {SQL_IN_SCOPE}) AS in_scope, coalesce(nullif(regexp_extract(text, '[A-Z]{{2,}}', 0), ''), nullif(role, 'user'), left(text, 5)) AS label FROM conversations")
def scope_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit decision (here for answers) before the domain gate; the first text that is there as a label."""
    t = F.col("text")
    decided = F.when(F.col("role") == "assistant", F.length("text") > 500)
    label = text.first_text(F.regexp_extract(t, "[A-Z]{2,}", 0), F.nullif(F.col("role"), F.lit("user")), F.left(t, F.lit(5)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", question.in_scope(t, decided).alias("in_scope"), label.alias("label"))

"""Queries of ingestion, formula markup and derivation steps, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import formulas
from marginalia.operators import chunking, claims, mutation, retrieval
from marginalia.plans import ingest, reindex
from marginalia.session import shared_folder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


@query(r"""
WITH f AS (SELECT concat_ws('/', 'docs', source, doc_id || '.txt') AS path, text, lang FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT path, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN regexp_matches(text, '\S') THEN 'ingested' ELSE 'empty' END AS status, CAST(len(string_split(text, chr(12))) AS INTEGER) AS n_pages,
  CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run FROM f""")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a first run over the English ones, a second over all, a third that finds nothing new."""
    store = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    path = F.concat_ws("/", F.lit("docs"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    body = F.encode("text", "UTF-8")
    found = docs.select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit("2020-01-01").cast("timestamp").alias("modified"), body.alias("content"), "lang")
    ingest.ingest(found.filter("lang = 'en'").drop("lang"), store)
    ingest.ingest(found.drop("lang"), store)
    ingest.ingest(found.drop("lang"), store)
    return ingest.manifest(spark, store).select("path", "size", "status", "n_pages", "run")


@query()
def formula_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read as formulas: paragraphs as braces, lists as environments, bold runs as fractions; their navigation as MathML."""
    latex = F.col("html")
    for tag, mark in (("<p>", "{"), ("</p>", "}"), ("<ul>", r"\\begin{ul}"), ("</ul>", r"\\end{ul}"), ("<b>", r"\\frac{b}"), ("<[^>]*>", " ")):
        latex = F.regexp_replace(latex, tag, mark)
    shown = formulas.render(F.col("page_id").cast("string"), F.lit(None).cast("string"), latex, F.regexp_extract("html", "(?s)<nav>.*</article>", 0))
    return table(spark, sf_dir, "pages").select("page_id", shown.alias("f")).select("page_id", "f.status", F.array_join("f.warnings", "\n").alias("warnings"))


@query("""
WITH RECURSIVE s AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn IS NOT NULL),
w AS (SELECT conv_id, turn, unnest(CASE WHEN role = 'assistant' THEN [turn - 1] WHEN role = 'user' THEN [turn - 2, turn - 3] ELSE [] END) AS dep FROM conversations),
e AS (SELECT DISTINCT w.* FROM w JOIN s ON s.conv_id = w.conv_id AND s.turn = w.dep),
l AS (SELECT conv_id, turn, 0 AS level FROM s ANTI JOIN e USING (conv_id, turn) UNION SELECT e.conv_id, e.turn, l.level + 1 FROM l JOIN e ON e.conv_id = l.conv_id AND e.dep = l.turn),
m AS (SELECT conv_id, turn, max(level) AS level FROM l GROUP BY ALL)
SELECT conv_id, turn, level, coalesce(CAST(turn AS VARCHAR), 'None') || ': ' || coalesce(text, 'None') || CASE WHEN role = 'system' THEN ' (axiomatic)' ELSE ' (evidence: c' || conv_id || ')' END AS line
FROM conversations LEFT JOIN m USING (conv_id, turn)""")
def derivation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as steps: an answer rests on the turn before it, a question on those before that; level and line of each."""
    turn, role = F.col("turn"), F.col("role")
    rests_on = F.when(role == "assistant", F.array(turn - 1)).when(role == "user", F.array(turn - 2, turn - 3)).otherwise(F.array().cast("array<int>"))
    steps = table(spark, sf_dir, "conversations").select("conv_id", turn.alias("step_id"), "role", "text", rests_on.alias("depends_on"))
    source = F.when(role == "system", claims.AXIOMATIC).otherwise(claims.EVIDENCE)
    line = claims.step_text(F.col("step_id"), F.col("text"), source, F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    return claims.step_levels(steps, "conv_id").select("conv_id", F.col("step_id").alias("turn"), "level", line.alias("line"))


@query(r"""
WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, k, k // 3 + 1 AS page_no, length(unit) AS n, CASE WHEN unit = upper(unit) THEN 'title' ELSE 'body' END AS kind, coalesce(sum(length(unit) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u),
t AS (SELECT doc_id, sum(n + 2) - 2 AS total FROM g GROUP BY doc_id), s AS (SELECT doc_id, CAST(total * i // 5 AS BIGINT) AS a, CAST(total * i // 5 AS BIGINT) + 60 AS b, i FROM t, range(0, 5) r(i)),
h AS (SELECT s.doc_id, s.i, count(*) AS n_segments, list_sort(list_distinct(list(page_no))) AS pages FROM s JOIN g ON g.doc_id = s.doc_id AND g.a < s.b AND g.a + g.n > s.a GROUP BY ALL),
f AS (SELECT s.doc_id, s.i, s.a, s.b, arg_max(g.kind, g.k) AS kind, arg_max(g.page_no, g.k) AS page_no FROM s JOIN g ON g.doc_id = s.doc_id AND g.a <= s.a GROUP BY ALL)
SELECT f.doc_id AS chunk_id, a AS start, b AS "end", kind AS block_type, CAST(page_no AS INTEGER) AS page_no, coalesce(array_to_string(pages, ','), '') AS pages, CAST(coalesce(n_segments, 0) AS INTEGER) AS n_segments FROM f LEFT JOIN h USING (doc_id, i)""")
def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five spans of each document, as one chunk of its lines, and the pages and blocks they lie on."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    units = docs.select("doc_id", F.split("text", "\n").alias("units"))
    kinds, pages = F.transform("units", lambda u: F.when(u == F.upper(u), "title").otherwise("body")), F.transform("units", lambda u, k: F.floor(k / 3).cast("int") + 1)
    segments = units.select(F.col("doc_id").alias("chunk_id"), "units", kinds.alias("kinds"), pages.alias("pages"))
    segments = segments.select("chunk_id", chunking.text_segments(F.col("units"), F.col("pages"), F.col("kinds")).alias("segments"))
    total = F.element_at("segments", -1)["end"]
    starts = segments.select("chunk_id", F.explode(F.transform(F.array(*map(F.lit, range(5))), lambda i: F.floor(total * i / 5))).alias("start"))
    found = chunking.located_spans(starts.withColumn("end", F.col("start") + 60), segments)
    return found.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("""
WITH r AS (SELECT conv_id, turn, text, CASE WHEN text IS NULL OR contains(text, 'token') THEN NULL ELSE [CAST(length(text) AS DOUBLE), 1.0] END AS v FROM conversations),
f AS (SELECT conv_id, bool_or(v IS NULL) AS failed FROM r GROUP BY conv_id)
SELECT r.conv_id AS request_id, turn, CASE WHEN failed THEN 0 ELSE 2 END AS dimension, CASE WHEN failed THEN 'fallback_token_features' ELSE 'model' END AS provider, CASE WHEN failed THEN NULL ELSE v[1] END AS first_value
FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id""")
def embedding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests: a turn that cannot be embedded sends all turns of its conversation to the fallback."""
    requests = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), "turn", "text")
    texts = requests.filter("text IS NOT NULL").select("text").distinct()
    vector = F.when(~F.contains("text", F.lit("token")), F.array(F.length("text").cast("double"), F.lit(1.0)))
    found = retrieval.embedded_requests(requests, texts.select(F.sha2("text", 256).alias("text_hash"), vector.alias("vector")))
    return found.select("request_id", "turn", "dimension", "provider", F.get("vector", F.lit(0)).alias("first_value"))


@query("""
SELECT lang AS source_type, count(*) AS n_chunks, count(*) AS n_vectors, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS wrong_dimension, CAST(0 AS BIGINT) AS other_origin, true AS ok
FROM documents WHERE trim(text) <> '' GROUP BY lang""")
def reindex_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded by their lengths: a run stopped after its first wave, then brought to its end, held against the table."""
    store = f"{shared_folder(spark)}/reindex-{uuid.uuid4().hex}"
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("lang").alias("source_type"))
    embed = lambda t: F.array(F.length(t).cast("double"), F.octet_length(t).cast("double"))
    settings = {"dimension": 2, "batch_rows": 20_000, "wave": 4}
    reindex.reindex(chunks, embed, store, "lengths", "1", waves=1, **settings)
    run = reindex.reindex(chunks, embed, store, "lengths", "1", **settings)
    return reindex.parity(chunks, reindex.vectors(spark, run), 2, "lengths", "1")


@query(r"""
WITH n AS (SELECT *, regexp_replace(text, '[ \t]+', ' ', 'g') AS t, upper(lang) AS l FROM documents),
c AS (SELECT t IS DISTINCT FROM text AS a, l IS DISTINCT FROM lang AS b, length(t) IS DISTINCT FROM n_chars AS d FROM n)
SELECT count(*) AS n_rows, count(*) FILTER (a OR b) AS n_changed, CAST(coalesce(sum(CAST(a AS INT) + CAST(b AS INT) + CAST((a OR b) AND d AS INT)), 0) AS BIGINT) AS n_changes, CAST(0 AS BIGINT) AS n_left, true AS idempotent, count(*) FILTER (a OR b) > 0 AS differs FROM c""")
def repair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blanks in texts become one, languages upper case, and the lengths of what changed are restamped; the report of it."""
    docs = table(spark, sf_dir, "documents")
    rules = {"text": F.regexp_replace("text", r"[ \t]+", " "), "lang": F.upper("lang")}
    report = mutation.audited(docs, "doc_id", rules, {"n_chars": F.length("text").cast("long")}).report
    return report.select("n_rows", "n_changed", "n_changes", "n_left", "idempotent", (F.col("fingerprint_before") != F.col("fingerprint_after")).alias("differs"))

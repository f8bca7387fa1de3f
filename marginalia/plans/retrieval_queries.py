"""Retrieval queries with their SQL. Documents play the chunks, benchmark items the question set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import reports, retrieval
from marginalia.plans.text_queries import SQL_TOKENS
from marginalia.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
QUESTION = "token for the license and the password or secret key"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("standard", "book", "paper", "note")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("body"), "source", "lang", kinds.alias("source_type"))


def question(spark: SparkSession, wording: str = QUESTION) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(wording).alias("query"))


SQL_CHUNKS = f"""
chunks AS (SELECT doc_id AS chunk_id, text, ['standard', 'book', 'paper', 'note'][doc_id % 4 + 1] AS source_type,
  CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END AS priority FROM documents),
toks AS (SELECT chunk_id, {SQL_TOKENS} AS ts FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS mean_size FROM toks),
posts AS (SELECT chunk_id, len(ts) AS size, unnest(ts) AS term FROM toks),
tf AS (SELECT chunk_id, size, term, count(*) AS tf FROM posts GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
SQL_ONE = f"qs AS (SELECT CAST(0 AS BIGINT) AS query_id, '{QUESTION}' AS text)"
SQL_BM25 = f"""
qt AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({SQL_TOKENS}) AS term FROM qs) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / greatest(mean_size, 1)))) AS score
  FROM tf JOIN qt USING (term) JOIN df USING (term), stats GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm WHERE score > 0)"""
SQL_FEATURES = """SELECT {key}, term, sum(v) AS v FROM (
  SELECT {key}, term, 1.0::DOUBLE AS v FROM {rows} UNION ALL
  SELECT {key}, substr(term, 1, 4), 0.5 FROM {rows} WHERE length(term) >= 5 AND NOT regexp_matches(term, '[^\\x00-\\x7F]') UNION ALL
  SELECT {key}, right(term, 4), 0.5 FROM {rows} WHERE length(term) >= 5 AND NOT regexp_matches(term, '[^\\x00-\\x7F]')) GROUP BY ALL"""
SQL_DENSE = f"""
qposts AS (SELECT query_id, unnest({SQL_TOKENS}) AS term FROM qs),
qf AS ({SQL_FEATURES.format(key='query_id', rows='qposts')}), cf AS ({SQL_FEATURES.format(key='chunk_id', rows='posts')}),
dn AS (SELECT query_id, chunk_id, sum(qf.v * cf.v) / (any_value(qn) * any_value(cn)) AS score FROM qf JOIN cf USING (term)
  JOIN (SELECT query_id, sqrt(sum(v * v)) AS qn FROM qf GROUP BY ALL) USING (query_id) JOIN (SELECT chunk_id, sqrt(sum(v * v)) AS cn FROM cf GROUP BY ALL) USING (chunk_id) GROUP BY ALL),
dnr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM dn WHERE score > 0)"""
SQL_LANES = """
lanes AS (SELECT l.*, priority, max(score) OVER (PARTITION BY query_id, lane) AS lane_max,
    row_number() OVER (PARTITION BY query_id, lane ORDER BY round(score, 6) DESC, priority DESC, chunk_id) AS lane_rank
  FROM (SELECT 'bm25' AS lane, query_id, chunk_id, score FROM bmr WHERE rank <= 50 UNION ALL SELECT 'dense', query_id, chunk_id, score FROM dnr WHERE rank <= 50) l
  JOIN chunks USING (chunk_id)),
fused AS (SELECT query_id, chunk_id, sum({part}) + max(priority) * 0.0001 AS score, string_agg(lane, '+' ORDER BY lane) AS lanes, max(priority) AS priority FROM lanes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM fused)"""
RRF_PART = "1.0 / (60 + lane_rank) + 0.01 * score / lane_max"
WEIGHTED_PART = "CASE lane WHEN 'bm25' THEN 0.9 ELSE 0.1 END * score / lane_max"
SHOWN = "query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank"


def shown(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", *more)


@query(f"WITH {SQL_ONE}, {SQL_CHUNKS}, {SQL_BM25} SELECT {SHOWN} FROM bmr WHERE rank <= 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question against all documents."""
    return shown(retrieval.bm25(chunks_of(spark, sf_dir), question(spark), 50))


@query(f"WITH qs AS (SELECT item_id AS query_id, text FROM benchmark), {SQL_CHUNKS}, {SQL_BM25} SELECT {SHOWN} FROM bmr WHERE rank <= 10")
def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as questions in one job."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return shown(retrieval.bm25(chunks_of(spark, sf_dir), items, 10))


@query(f"WITH {SQL_ONE}, {SQL_CHUNKS}, {SQL_DENSE} SELECT {SHOWN} FROM dnr WHERE rank <= 50")
def token_feature_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(retrieval.token_cosine(chunks_of(spark, sf_dir), question(spark), 50))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(w, embedding::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM s WHERE score > 0)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a query against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return shown(retrieval.vector_top(vectors, vectors.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), 10))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, label, list_cosine_similarity(w, embedding::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM s WHERE score > 0),
h AS (SELECT query_id, list(DISTINCT label) AS labels FROM r WHERE rank <= 10 GROUP BY query_id),
c AS (SELECT vec_id, vec_id // 100 AS intent, CASE WHEN label % 2 = 0 THEN 'zh' ELSE 'en' END AS language, CASE WHEN list_contains(labels, label) THEN 1.0::DOUBLE ELSE 0 END AS recall, value AS latency
  FROM embeddings LEFT JOIN h ON query_id = vec_id LEFT JOIN events ON event_id = vec_id WHERE vec_id % 50 = 0),
l AS (SELECT language, round_even(avg(recall), 3) AS recall FROM c GROUP BY language),
p AS (SELECT intent, CASE WHEN list_sort(list(DISTINCT language)) = ['en', 'zh'] AND min(recall) = 1 THEN 1.0::DOUBLE ELSE 0 END AS met FROM c GROUP BY intent),
t AS (SELECT list_sort(list(latency)) AS v, len(list(latency)) AS n FROM c WHERE latency IS NOT NULL AND vec_id <> (SELECT min(vec_id) FROM c))
SELECT CAST(count(*) AS BIGINT) AS cases, round_even(avg(recall), 3) AS recall, CAST(count(*) FILTER (recall < 1) AS BIGINT) AS missing_cases,
  (SELECT list(language || '=' || printf('%.3f', recall) ORDER BY language) FROM l) AS by_language, (SELECT round_even(avg(met), 3) FROM p) AS pair_recall,
  round_even(arg_min(latency, vec_id), 3) AS cold_start, (SELECT round_even(v[CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1], 3) FROM t) AS steady_p50,
  (SELECT round_even(v[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1], 3) FROM t) AS steady_p95 FROM c""")
def language_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector lane for every fiftieth vector: found is a case with its own label among its hits; recorded values stand for latencies."""
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    hits = retrieval.vector_top(vectors, vectors.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), 10)
    labels = hits.join(rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("hit_label")), "chunk_id").select(F.col("query_id").alias("vec_id"), F.col("hit_label").alias("label")).distinct()
    latencies = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.col("value").alias("latency_ms"))
    asked = rows.filter("vec_id % 50 = 0").select("vec_id", "label").join(labels.withColumn("recall", F.lit(1.0)), ["vec_id", "label"], "left").join(latencies, "vec_id", "left")
    language = F.when(F.col("label") % 2 == 0, "zh").otherwise("en")
    report = reports.language_report(asked.select(F.col("vec_id").alias("case_id"), F.col("vec_id").alias("place"), F.floor(F.col("vec_id") / 100).alias("intent"), language.alias("language"), F.coalesce("recall", F.lit(0.0)).alias("recall"), "latency_ms"))
    return report.withColumn("by_language", F.transform("by_language", lambda x: F.format_string("%s=%.3f", x["language"], x["recall"])))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks, asked = chunks_of(spark, sf_dir), question(spark)
    cut = retrieval.tokenized(chunks)
    return retrieval.bm25(cut, asked, 50), retrieval.token_cosine(cut, asked, 50), chunks


@query(f"WITH {SQL_ONE}, {SQL_CHUNKS}, {SQL_BM25}, {SQL_DENSE}, {SQL_LANES.format(part=RRF_PART)} SELECT {SHOWN}, lanes FROM ranked WHERE rank <= 10")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(retrieval.reciprocal_rank_fusion(*_both(spark, sf_dir)), "lanes")


@query(f"WITH {SQL_ONE}, {SQL_CHUNKS}, {SQL_BM25}, {SQL_DENSE}, {SQL_LANES.format(part=WEIGHTED_PART)} SELECT {SHOWN}, lanes FROM ranked WHERE rank <= 10")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(retrieval.weighted_fusion(*_both(spark, sf_dir)), "lanes")


@query(
    f"WITH {SQL_ONE}, {SQL_CHUNKS}, {SQL_BM25}, {SQL_DENSE}, {SQL_LANES.format(part=RRF_PART)}"
    " SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS confidence FROM ranked WHERE rank <= 10"
)
def citation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.confidence(retrieval.reciprocal_rank_fusion(*_both(spark, sf_dir)))
    return found.select("query_id", "chunk_id", F.round("confidence", 6).alias("confidence"))


@query(
    f"WITH {SQL_ONE}, {SQL_CHUNKS}, {SQL_BM25}, {SQL_DENSE}, {SQL_LANES.format(part=RRF_PART)}"
    " SELECT query_id, chunk_id, chunk_id AS doc_id, source_type, range(CAST(chunk_id % 5 + 1 AS INTEGER), CAST(chunk_id % 5 + chunk_id % 3 + 2 AS INTEGER)) AS pages,"
    " round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, lanes || ' match; source priority ' || r.priority AS reason FROM ranked r JOIN chunks USING (chunk_id) WHERE rank <= 10"
)
def retrieval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with pages from their range and a reason."""
    lexical, dense, chunks = _both(spark, sf_dir)
    start = (F.col("chunk_id") % 5 + 1).cast("int")
    paged = chunks.select("chunk_id", "doc_id", "source_type", F.lit(None).cast("array<int>").alias("pages"), start.alias("page_start"), (start + (F.col("chunk_id") % 3).cast("int")).alias("page_end"))
    return retrieval.hits(retrieval.reciprocal_rank_fusion(lexical, dense, chunks), paged)


@query("""
SELECT user_id AS key_id, min(event_id) AS position, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value
FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user at the position of the first."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key_id"), F.col("event_id").alias("seq"), "event_type", "value")
    return retrieval.keep_last(events, "key_id", "seq").select("key_id", "position", "event_type", "value")


@query("""
SELECT DISTINCT sha256(d.text) AS text_hash FROM documents d
WHERE trim(d.text) <> '' AND sha256(d.text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)""")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts that a cache of every third document does not hold."""
    docs = table(spark, sf_dir, "documents")
    cache = docs.filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("text_hash"), F.lit("local").alias("provider"), F.lit("m").alias("model"), F.lit("1").alias("version"))
    return retrieval.embedding_misses(docs, cache, "local", "m", "1").select("text_hash")


@query()
def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain for four questions over all documents."""
    from marginalia.plans.answer import answers

    wording = ("token for the license and the password", "compare the and of", "standard license of the", "")
    asked = spark.range(len(wording)).select(F.col("id").alias("query_id"), F.array(*[F.lit(w) for w in wording])[F.col("id").cast("int")].alias("query"))
    return answers(asked, chunks_of(spark, sf_dir))

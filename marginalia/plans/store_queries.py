"""Queries of stores, state and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources import files, sinks
from marginalia.streaming import folds, windows
from marginalia.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


SQL_EVENTS = "e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, coalesce(value > 20, false) AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
SQL_RATE_LIMIT = f"""
WITH RECURSIVE {SQL_EVENTS}, r AS (SELECT user_id, event_id, n, s AS last, true AS allowed FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.s - r.last >= 21600 THEN e.s ELSE r.last END, e.s - r.last >= 21600 FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, allowed FROM r"""


@query(SQL_RATE_LIMIT)
def rate_limit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding log a user: one request in six hours, denied ones not counted."""
    return folds.ordered_fold(_events(spark, sf_dir), "user_id", ["seconds", "event_id"], ["user_id", "event_id", "seconds"], folds.rate_limit_step(1, 21600.0), "user_id long, event_id long, allowed boolean")


@query(f"""
WITH RECURSIVE {SQL_EVENTS}, r AS (SELECT user_id, event_id, n, CASE WHEN NOT ok THEN s END AS failed, false AS suppressed FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN coalesce(e.s - r.failed < 7200, false) THEN r.failed WHEN NOT e.ok THEN e.s END, coalesce(e.s - r.failed < 7200, false)
  FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, suppressed FROM r""")
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a user suppressed for two hours after a failed one."""
    events = _events(spark, sf_dir).withColumn("ok", F.col("value") > 20)
    return folds.ordered_fold(events, "user_id", ["seconds", "event_id"], ["user_id", "event_id", "seconds", "ok"], folds.cooldown_step(7200.0), "user_id long, event_id long, suppressed boolean")


SQL_BUDGET = "CASE WHEN {t} > greatest(3000 - {mine}, 0) THEN 'task budget' WHEN {t} > greatest(8000 - {used}, 0) THEN 'session budget' ELSE 'reserved' END"


@query(f"""
WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS p, CAST(round(o_totalprice / 100) AS BIGINT) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
z AS (SELECT c, k, n, p, t, {SQL_BUDGET.format(t='t', mine='0', used='0')} AS reason FROM o WHERE n = 1),
r AS (SELECT c, k, n, reason, CASE WHEN reason = 'reserved' THEN t ELSE 0 END AS used, CASE WHEN reason = 'reserved' THEN map([p], [t]) ELSE map([p], [CAST(0 AS BIGINT)]) END AS tasks FROM z
  UNION ALL SELECT c, k, n, reason, CASE WHEN reason = 'reserved' THEN used + t ELSE used END, CASE WHEN reason = 'reserved' THEN map_concat(tasks, map([p], [mine + t])) ELSE tasks END
  FROM (SELECT o.c, o.k, o.n, o.p, o.t, r.used, r.tasks, coalesce(r.tasks[o.p], 0) AS mine, {SQL_BUDGET.format(t='o.t', mine='coalesce(r.tasks[o.p], 0)', used='r.used')} AS reason FROM r JOIN o ON o.c = r.c AND o.n = r.n + 1))
SELECT c AS session, k AS order_id, reason = 'reserved' AS allowed, reason, greatest(8000 - used, 0) AS remaining FROM r""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token budget of each customer's orders: tasks are priorities, tokens the price."""
    orders = table(spark, sf_dir, "orders").withColumn("tokens", F.round(F.col("o_totalprice") / 100).cast("long"))
    return folds.ordered_fold(orders, "o_custkey", ["o_orderkey"], ["o_custkey", "o_orderkey", "o_orderpriority", "tokens"], folds.budget_step(3000, 8000), "session long, order_id long, allowed boolean, reason string, remaining long")


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'review' WHEN 'assistant' THEN 'correct' ELSE 'note' END AS kind, coalesce(length(text) > 1200, false) AS approved,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS n, '' AS action, 'open' AS status, 0 AS reviews, 0 AS corrections FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, turn, n,
    CASE WHEN reviewed AND approved THEN 'accept' WHEN reviewed AND corrections < 2 AND reviews < 2 THEN 'correct' WHEN reviewed THEN 'fall back' WHEN corrected THEN 'corrected' ELSE 'ignored' END,
    CASE WHEN reviewed AND approved THEN 'approved' WHEN reviewed AND corrections < 2 AND reviews < 2 THEN 'correcting' WHEN reviewed THEN 'fallback' WHEN corrected THEN 'open' ELSE status END,
    reviews + CAST(reviewed AS INTEGER), corrections + CAST(corrected AS INTEGER)
  FROM (SELECT t.conv_id, t.turn, t.n, t.approved, r.status, r.reviews, r.corrections, r.status = 'open' AND t.kind = 'review' AS reviewed, r.status = 'correcting' AND t.kind = 'correct' AS corrected
    FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1))
SELECT conv_id, turn, action, status, reviews, corrections FROM r WHERE n > 0""")
def supervisor_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review loops in conversations: user turns review, assistant turns correct."""
    turns = table(spark, sf_dir, "conversations").withColumn("kind", F.when(F.col("role") == "user", "review").when(F.col("role") == "assistant", "correct").otherwise("note"))
    turns = turns.withColumn("approved", F.length("text") > 1200)
    return folds.ordered_fold(turns, "conv_id", ["turn"], ["conv_id", "turn", "kind", "approved"], folds.review_step(), "conv_id long, turn long, action string, status string, reviews int, corrections int")


@query("""
WITH r AS (SELECT doc_id, sha256('{"doc":' || doc_id || '}') AS h FROM documents), f AS (SELECT sha256('{"doc":' || doc_id || '}') AS h, source AS response FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, response, f.h IS NULL AS missed FROM r LEFT JOIN f USING (h)""")
def replay_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded responses by request hash, and the requests without one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("doc"))).alias("request"), "source")
    fixtures = docs.filter("doc_id % 3 <> 0").select(F.sha2("request", 256).alias("request_hash"), F.col("source").alias("response"))
    found, missed = sinks.replayed(docs.select("doc_id", "request"), fixtures)
    return found.select("doc_id", "response", F.lit(False).alias("missed")).unionByName(missed.select("doc_id", F.lit(None).cast("string").alias("response"), F.lit(True).alias("missed")))


@query("""
WITH n AS (SELECT doc_id, 'new' AS lang, source FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id + 1000000, 'new', source FROM documents WHERE doc_id % 10 = 0)
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changed = docs.filter("doc_id % 4 = 0").unionByName(docs.filter("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)).withColumn("lang", F.lit("new"))
    return sinks.upsert(docs, changed, "doc_id")


@query("""
WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 7 AS n FROM documents), w AS (SELECT doc_id, unnest(range(1, n + 1)) AS page_no FROM b WHERE n > 0)
SELECT doc_id, CAST(page_no AS INTEGER) AS page_no FROM w WHERE NOT ((CAST(doc_id AS BIGINT) + page_no) % 3 = 0)""")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each book that no earlier run has done."""
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 7).alias("n_pages"))
    every = books.filter("n_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page_no"))
    return files.pending_pages(books, every.filter((F.col("doc_id").cast("long") + F.col("page_no")) % 3 == 0))


@query("""
SELECT source, CAST(count(*) AS BIGINT) AS n_rows, list_slice(list_sort(list(doc_id)), 1, 3) AS preview FROM documents GROUP BY source""")
def dry_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dry_run(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("""
WITH h AS (SELECT vec_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST(CAST(vec_id AS VARCHAR) AS BLOB)) AS d FROM embeddings)
SELECT vec_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(d, 17, 1))::INTEGER % 4 AS INTEGER) + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id FROM h""")
def stable_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", sinks.uuid5(F.col("vec_id").cast("string")).alias("point_id"))


@query("""
WITH a AS (SELECT conv_id, turn, role, unnest(range(1, len(ws) + 1)) AS place, unnest(ws) AS asset FROM (SELECT conv_id, turn, role, regexp_extract_all(text, '[A-Z][a-z]+') AS ws FROM conversations)),
f AS (SELECT conv_id, asset, min(turn * 1000000 + place) AS first FROM a GROUP BY ALL), s AS (SELECT conv_id, list(asset ORDER BY first) AS assets FROM f GROUP BY conv_id)
SELECT conv_id AS doc_id, CAST(count(*) AS BIGINT) AS n_chunks, '[' || string_agg('{"chunk_index":' || turn || ',"chunk_id":"' || role || '","text":"' || length(text) || '"}', ',' ORDER BY turn) || ']' AS pack,
  coalesce(any_value(assets), []) AS assets FROM conversations LEFT JOIN s USING (conv_id) GROUP BY conv_id""")
def context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of each conversation: its turns, and the names that it holds (words with a capital) as assets."""
    turns = table(spark, sf_dir, "conversations")
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)
    return sinks.context_packs(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("chunk_id"), F.length("text").cast("string").alias("text"), names.alias("assets")))


@query("""
SELECT event_id, round(((event_id % 5000) - least(event_id % 5000, event_id % 700)) * 2.5 / 1e6 + least(event_id % 5000, event_id % 700) * 0.25 / 1e6 + (event_id % 900) * 10.0 / 1e6, 9) AS usd FROM events""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    usd = sinks.cost(k % 5000, F.least(k % 5000, k % 700), k % 900, (2.5, 0.25, 10.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(usd, 9).alias("usd"))


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of the event stream, run to its end."""
    found = windows.event_windows(_stream(spark, sf_dir))
    done = windows.run_to_end(found, "complete")
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def _budget_rows(orders: DataFrame) -> DataFrame:
    """Each order reserves its price and, once or never, later or before, tells what it used; keys are text, as in JSON."""
    text_key, price = F.col("o_orderkey").cast("string"), F.round(F.col("o_totalprice") / 100).cast("long")
    at, k = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")
    reserve = F.struct((k * 2).alias("id"), at.alias("at"), F.lit("reserve").alias("kind"), text_key.alias("reservation"), price.alias("tokens"))
    usage = F.struct((k * 2 + 1).alias("id"), (at + (k % 200 - 20) * 86400).alias("at"), F.lit("usage").alias("kind"), text_key.alias("reservation"), F.floor(price * (k % 30) / 15).alias("tokens"))
    told = F.when(k % 7 == 0, F.array(reserve)).otherwise(F.array(reserve, usage))
    rows = orders.select(F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("task"), F.explode(told).alias("e"))
    return rows.select("session", "e.id", "e.at", "e.kind", "task", "e.reservation", "e.tokens")


BUDGET_FIELDS = ["session", "id", "at", "kind", "task", "reservation", "tokens"]
BUDGET_RESULT = "session long, id long, outcome string, remaining long, open int"


@query()
def budget_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations of each customer's orders, settled by usage that comes late, early or not at all."""
    rows = _budget_rows(table(spark, sf_dir, "orders"))
    return folds.ordered_fold(rows, "session", ["at", "id"], BUDGET_FIELDS, folds.settled_budget_step(3000, 8000), BUDGET_RESULT)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parq*")


@query(SQL_RATE_LIMIT)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate limit on keyed state of the stream."""
    events = _stream(spark, sf_dir).withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    limited = folds.stream_fold(events, "user_id", ["user_id", "event_id", "seconds"], folds.rate_limit_step(1, 21600.0), "user_id long, event_id long, allowed boolean")
    return windows.run_to_end(limited, "append")

"""Answer expressions and relational forms on the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import answers
from marginalia.operators import retrieval
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


SQL_PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    return turns.withColumnRenamed("text", "q").join(after, ["conv_id", "turn"])


@query(rf"""
WITH {SQL_PAIRS}, s AS (SELECT *, len(regexp_extract_all(q, '[一-鿿]')) / 2 AS qh, len(regexp_extract_all(q, '[A-Za-z]{{2,}}')) AS qw, len(regexp_extract_all(t, '[一-鿿]')) / 2 AS th, len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) AS tw FROM pairs)
SELECT conv_id, turn, CAST(CASE WHEN qh + qw = 0 THEN 1.0 WHEN th + tw = 0 THEN 0.0 WHEN (qh > qw) = (th > tw) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS aligned FROM s""")
def answer_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the next turn keeps the language of a turn."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", answers.language_alignment(F.col("q"), F.col("t")).alias("aligned"))


DATA_ASPECTS = {"secret": ("token", "password"), "license": ("license", "copyright"), "contact": ("@", "phone")}
SQL_ASKED = " + ".join("CASE WHEN " + " OR ".join(f"contains(lower(q), '{t}')" for t in v) + " THEN 1 ELSE 0 END" for v in DATA_ASPECTS.values())
SQL_MET = " + ".join("CASE WHEN (" + " OR ".join(f"contains(lower(q), '{t}')" for t in v) + ") AND (" + " OR ".join(f"contains(lower(t), '{t}')" for t in v) + ") THEN 1 ELSE 0 END" for v in DATA_ASPECTS.values())


@query(f"WITH {SQL_PAIRS} SELECT conv_id, turn, round(CASE WHEN {SQL_ASKED} = 0 THEN CASE WHEN trim(t) <> '' THEN 1.0 ELSE 0.0 END ELSE CAST({SQL_MET} AS DOUBLE) / ({SQL_ASKED}) END, 6) AS coverage FROM pairs")
def aspect_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(answers.aspect_coverage(F.col("q"), F.col("t"), DATA_ASPECTS), 6).alias("coverage"))


@query(f"""
WITH {SQL_PAIRS} SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(q, '[0-9]+(?:\\.[0-9]+)?')), lambda x: NOT contains(t, x)) IS NOT NULL AS checked,
  CAST(len(list_filter(list_distinct(regexp_extract_all(q, '[0-9]+(?:\\.[0-9]+)?')), lambda x: NOT contains(t, x))) AS INTEGER) AS n_missing FROM pairs""")
def omitted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a turn that the next turn leaves out."""
    missing = answers.numbers_missing(F.col("q"), F.col("t"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", missing.isNotNull().alias("checked"), F.size(missing).alias("n_missing"))


@query(f"""
WITH {SQL_PAIRS} SELECT conv_id, turn, list_filter([CASE WHEN NOT regexp_matches(lower(t), 'evidence|证据') THEN 'no evidence section' END, CASE WHEN length(q) % 5 = 0 THEN 'off topic' END,
  CASE WHEN regexp_matches(t, '(?i)\\b(?:always|never|guaranteed?|proves?|certainly)\\b|必然|一定会|证明了') THEN 'overclaim' END], lambda x: x IS NOT NULL) AS notes FROM pairs""")
def advisory_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", answers.notes(F.col("q"), F.col("t"), F.length("q") % 5).alias("notes"))


@query("""
SELECT doc_id, CASE WHEN instr(text, 'the ') > 0 AND instr(substr(text, instr(text, 'the ') + 4), '.') > 0
  THEN substr(text, 1, instr(text, 'the ') + 3) || 'X' || substr(substr(text, instr(text, 'the ') + 4), instr(substr(text, instr(text, 'the ') + 4), '.')) ELSE text END AS repaired FROM documents""")
def span_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span between two markers replaced."""
    return table(spark, sf_dir, "documents").select("doc_id", answers.span_replaced(F.col("text"), F.lit("the "), F.lit("."), F.lit("X")).alias("repaired"))


@query("""
SELECT doc_id, array_to_string(list_filter(['## conclusion' || chr(10) || source, CASE WHEN n_chars > 500 THEN '## evidence' || chr(10) || lang END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS body FROM documents""")
def render_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"evidence": F.when(F.col("n_chars") > 500, F.col("lang")), "conclusion": F.col("source"), "limits": F.lit(" ")}
    return table(spark, sf_dir, "documents").select("doc_id", answers.rendered(parts).alias("body"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, e'\n'), lambda x: trim(x, e' \t\r')), lambda x: x <> '' AND NOT regexp_matches(x, '^#|^\[\d+\]\s')) AS ls FROM documents),
j AS (SELECT doc_id, regexp_replace(array_to_string(ls, e'\n'), '([A-Za-z])-\n([a-z])', '\1\2', 'g') AS t FROM l),
k AS (SELECT doc_id, replace(replace(regexp_replace(t, e'([.!?。！？；;:：])\n', e'\\1\x1e', 'g'), e'\n', ' '), e'\x1e', e'\n') AS t FROM j),
s AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(t, '([.!?])\s+', e'\\1\x1e', 'g'), '([。！？；])\s*', e'\\1\x1e', 'g'), e'\x1e|\n') AS ss FROM k),
f AS (SELECT doc_id, list_filter(list_transform(ss, lambda x: trim(x, e' \t\r\n')), lambda x: x <> '') AS ss FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS sentence_ix, ss[i + 1] AS sentence FROM f, unnest(range(0, len(ss))) AS r(i)""")
def reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents after joining wrapped lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(answers.reflowed(F.col("text"))).alias("sentence_ix", "sentence"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN [] WHEN doc_id % 40 <= 8 THEN range(0, CAST(doc_id % 40 AS INTEGER))
  ELSE list_sort(list_distinct(list_transform(range(0, 8), lambda k: CAST(floor(k * (doc_id % 40 - 1) / 7 + 0.5) AS BIGINT)))) END AS pages FROM documents""")
def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a text profile samples, for documents of doc_id % 40 pages."""
    return table(spark, sf_dir, "documents").select("doc_id", answers.sample_pages(F.col("doc_id") % 40).alias("pages"))


@query("""
WITH v AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 4) AS b, lead(list_slice(embedding::DOUBLE[], 1, 4)) OVER (ORDER BY vec_id) AS n FROM embeddings)
SELECT vec_id, coalesce(list_bool_and(list_transform(list_zip(b, n), lambda x: abs(x[1] - x[2]) <= 0.3)), false) AS close FROM v""")
def box_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first four components of neighbouring vectors agree within a tolerance."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("b"))
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("b").alias("n"))
    return vectors.join(after, "vec_id", "left").select("vec_id", F.coalesce(answers.boxes_match(F.col("b"), F.col("n"), 0.3), F.lit(False)).alias("close"))


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents) SELECT source AS query_id, doc_id AS chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20 AND doc_id % 3 <> 0""")
def ann_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits cut at k first and kept only where the supplied corpus has them, so fewer than k can stay."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.length("text").cast("double").alias("score"))
    corpus = docs.filter("chunk_id % 3 <> 0").select("chunk_id")
    return retrieval.top(docs, 20).join(corpus, "chunk_id", "left_semi").select("query_id", "chunk_id", "rank")


@query("""
SELECT source AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'front' ELSE lang END AS section_key, min(n_chars) AS page_start, max(n_chars) AS page_end, CAST(count(*) AS BIGINT) AS n_chunks
FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL""")
def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and largest page of each section, front matter left out."""
    docs = table(spark, sf_dir, "documents").withColumn("section_key", F.when(F.col("doc_id") % 5 == 0, "front").otherwise(F.col("lang"))).filter("section_key <> 'front'")
    return docs.groupBy(F.col("source").alias("doc_id"), "section_key").agg(F.min("n_chars").alias("page_start"), F.max("n_chars").alias("page_end"), F.count(F.lit(1)).alias("n_chunks"))


@query("""
SELECT n_name, CAST(count(*) AS BIGINT) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name""")
def equi_join_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained equi-joins with a pushed filter and partial aggregation."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def semi_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return customers.join(orders.filter("o_totalprice > 100000"), "c_custkey", "left_semi").join(orders.filter("o_orderstatus = 'P'"), "c_custkey", "left_anti").select("c_custkey")


@query("""
WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(coalesce(a.n, 0) AS BIGINT) AS even_n, CAST(coalesce(b.n, 0) AS BIGINT) AS third_n FROM a FULL JOIN b ON a.user_id = b.user_id""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.filter("event_id % 2 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("even_n"))
    right = events.filter("event_id % 3 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("third_n"))
    return left.join(right, "user_id", "full_outer").na.fill(0, ["even_n", "third_n"])


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the partition's maximum and a running sum."""
    order = Window.partitionBy("l_orderkey")
    running = order.orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.max("l_extendedprice").over(order), 6).alias("share"), F.round(F.sum("l_quantity").over(running), 2).alias("running")
    )

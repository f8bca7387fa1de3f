"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import alignment, ann, bpe, clustering, exact_dedup, extraction, mixing, sharding, simhash, substring_dedup, token_output, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_read(spark, sf_dir, "documents")).drop("text_hash")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"))
    return placed.select(
        "row.doc_id",
        "size",
        F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs.select("doc_id", "text"), lexicon)
    return scored.select(
        "row.doc_id",
        toxicity.held_out("row.doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(_read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, slice_bytes=4 << 20, remembered=300_000)
    return coded.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(_read(spark, sf_dir, "pages"))
    return records.select(
        "page_id",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select(
        "row.doc_id",
        "row.source",
        F.col("copy").alias("copy_no"),
        "position",
        F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("text_bytes"),
    )


OP8_SQL = """
WITH w(label, share) AS (VALUES ('src0', 0.20), ('src1', 0.05), ('src2', 0.05), ('src3', 0.10), ('*', 0.60)),
d AS (
  SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source ELSE '*' END AS label,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents
), n AS (SELECT label, count(*) AS n FROM d GROUP BY label),
r AS (
  SELECT label, CAST(share AS DOUBLE) / (SELECT sum(CAST(share AS DOUBLE)) FROM w JOIN n USING (label)) * (SELECT sum(n) FROM n) / n AS rate
  FROM w JOIN n USING (label)
), p AS (
  SELECT label, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY label ORDER BY k) AS cdf
  FROM r, range(0, 400) t(k) WHERE k <= rate + 40 * sqrt(rate) + 60
), m AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM p WHERE p.label = d.label AND p.cdf <= d.u AND p.cdf < 1) AS copies FROM d
), c AS (
  SELECT doc_id, source, text, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy_no FROM m WHERE copies > 0
)
SELECT doc_id, source, copy_no,
       row_number() OVER (ORDER BY md5('mix-1:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy_no)) - 1 AS position,
       coalesce(strlen(text), 0) AS text_bytes
FROM c
"""


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(_read(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, groups=lambda written: F.sha2(written, 256))
    return aligned.select(F.col("row.doc_id").cast("long").alias("doc_id"), *alignment.MEASURES, F.col("groups").alias("groups_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered, centroids = clustering.cluster(_read(spark, sf_dir, "embeddings"), carried=["vec_id"])
    written = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return clustering.with_inertia(clustered, centroids).select(
        "row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written, 256).alias("centroid_sha256")
    )


def _op12_sql(rounds: int = clustering.ROUNDS, k: int = clustering.CLUSTERS) -> str:
    """The rounds one after another, each two common tables: the nearest centroid of each vector, the new centroids."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(greatest(least(floor(CAST(x AS DOUBLE) * 1024), 67108864), -67108864) AS BIGINT)) AS p
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), p) - 1 AS j, p
  FROM v QUALIFY j < {k}
)"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, min(d) AS d, arg_min(j, (d, j)) AS j FROM (
    SELECT v.r, c.j, list_sum(list_transform(range(1, 65), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i]))) AS d FROM v, c{n} c
  ) GROUP BY r
)"""
        )
        if n < rounds:
            parts.append(
                f"""m{n} AS MATERIALIZED (
  SELECT j, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
    SELECT a.j, t.i, CAST(sum(v.p[t.i]) AS HUGEINT) AS s, count(*) AS n FROM a{n} a JOIN v USING (r), range(1, 65) t(i) GROUP BY a.j, t.i
  )
), c{n + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.p, c.p) AS p FROM c{n} c LEFT JOIN (SELECT j, list(x ORDER BY i) AS p FROM m{n} GROUP BY j) m USING (j)
)"""
            )
    return f"""WITH {', '.join(parts)}
SELECT v.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.j"""


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extraction.extract(_read(spark, sf_dir, "pages"))
    return pages.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_warc": op6_warc,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_mixing": op8_mixing,
    "op9_token_output": op9_token_output,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_cross_alignment": op11_cross_alignment,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_html_extraction": op13_html_extraction,
}
SQL = {"op4_exact_dedup": OP4_SQL, "op8_mixing": OP8_SQL, "op12_centroid_clustering": _op12_sql()}

"""Embedding of a whole corpus as a run of batches that goes on where it was stopped.

A run is named by the fingerprint of its chunks, the model, its version and the dimension: with any
of them changed it is another run. Chunks fall into batches by a hash of their id. A wave of batches
is one Spark job that writes their vectors, one partition a batch; then the ledger gets a row for
each. A run that starts again leaves out the batches of the ledger and overwrites the partitions of
those that were cut off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.mutation import fingerprint

VECTORS = "chunk_id string, source_type string, vector array<double>, model string, version string, batch int"
LEDGER = "n_chunks long, batch int"
BATCH_ROWS, WAVE = 100_000, 64


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def vectors(spark: SparkSession, run: str) -> DataFrame:
    """The vectors of the finished batches of a run."""
    done = _read(spark, f"{run}/ledger", LEDGER).select("batch")
    return _read(spark, f"{run}/vectors", VECTORS).join(done, "batch", "left_semi").drop("batch")


def reindex(chunks: DataFrame, embed: Callable[[Column], Column], store: str, model: str, version: str, dimension: int, batch_rows: int = BATCH_ROWS, wave: int = WAVE, waves: int | None = None) -> str:
    """Embed all chunks (chunk_id, text, source_type) with text; returns the folder of the run. `waves` stops after so many.

    A vector of another dimension is an error, and so is a table without chunks.
    """
    spark = chunks.sparkSession
    usable = chunks.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("chunk_id", "text", "source_type")
    # One row: how many there are and what they are.
    n, digest = usable.agg(F.count(F.lit(1)), fingerprint(usable.columns)).first()
    if not n:
        raise ValueError("there are no chunks to embed")
    run = f"{store}/run={digest[:16]}-{model}-{version}-{dimension}"
    count = -(-n // batch_rows)
    placed = usable.withColumn("batch", F.pmod(F.xxhash64("chunk_id"), F.lit(count)).cast("int"))
    finished = {r["batch"] for r in _read(spark, f"{run}/ledger", LEDGER).select("batch").collect()}  # one number a batch
    waiting = [b for b in range(count) if b not in finished]
    dynamic = {"partitionOverwriteMode": "dynamic"}
    for at in list(range(0, len(waiting), wave))[:waves]:
        some = waiting[at : at + wave]
        made = placed.filter(F.col("batch").isin(some)).withColumn("vector", embed(F.col("text")).cast("array<double>"))
        out = made.select("chunk_id", "source_type", "vector", F.lit(model).alias("model"), F.lit(version).alias("version"), "batch")
        out.write.mode("overwrite").options(**dynamic).partitionBy("batch").parquet(f"{run}/vectors")
        wrote = _read(spark, f"{run}/vectors", VECTORS).filter(F.col("batch").isin(some))
        bad = wrote.filter(F.coalesce(F.size("vector") != dimension, F.lit(True))).limit(1).collect()
        if bad:
            raise ValueError(f"a vector of {bad[0]['chunk_id']} has not the dimension {dimension}")
        every = spark.createDataFrame([(b,) for b in some], "batch int")
        counted = every.join(wrote.groupBy("batch").agg(F.count(F.lit(1)).alias("n_chunks")), "batch", "left").na.fill(0, ["n_chunks"])
        counted.select("n_chunks", "batch").write.mode("overwrite").options(**dynamic).partitionBy("batch").parquet(f"{run}/ledger")
    return run


def parity(chunks: DataFrame, found: DataFrame, dimension: int, model: str, version: str) -> DataFrame:
    """For each source type how chunks with text and vectors agree: missing, extra, of another dimension, of another origin; ok where all is well."""
    usable = chunks.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("chunk_id", F.col("source_type").alias("_type"), F.lit(True).alias("_chunk"))
    both = usable.join(found.withColumn("_vector", F.lit(True)), "chunk_id", "full_outer")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = both.groupBy(F.coalesce("_type", "source_type").alias("source_type")).agg(
        F.count_if(has("_chunk")).alias("n_chunks"),
        F.count_if(has("_vector")).alias("n_vectors"),
        F.count_if(has("_chunk") & ~has("_vector")).alias("missing"),
        F.count_if(~has("_chunk")).alias("extra"),
        F.count_if(has("_vector") & (F.size("vector") != dimension)).alias("wrong_dimension"),
        F.count_if(has("_vector") & ((F.col("model") != model) | (F.col("version") != version) | ~F.col("_type").eqNullSafe(F.col("source_type")))).alias("other_origin"),
    )
    return rows.withColumn("ok", (F.col("missing") + F.col("extra") + F.col("wrong_dimension") + F.col("other_origin")) == 0)

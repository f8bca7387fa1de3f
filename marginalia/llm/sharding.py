"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets by a seeded hash; the number of buckets follows the
bytes of all columns, so that a bucket fits a task's memory however large the table is. The hash
takes in where a record stands in the input beside what it holds, so that equal records part too. Pass two
orders each bucket by its records, permutes it with the Fisher-Yates shuffle of Spark's `shuffle`
function and writes it. A record's place in the concatenated buckets (base of its bucket plus rank
inside it) is dealt out in turn, so the row counts of any two shards differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import materialize, packed, prefix_sums

SHARDS = 8
SEED = 20240607
BUCKET_BYTES = 16 << 20
#: One number a bucket is broadcast up to so many buckets; beyond them the bases are joined by shuffle.
BROADCAST_BUCKETS = 1 << 16


def record_bytes(docs: DataFrame) -> Column:
    """About how many bytes a record takes: strings and binaries by their length, nested values by their JSON."""
    total = F.lit(0).cast("long")
    for field in docs.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return total + 16 * len(docs.columns)


def shuffle_records(docs: DataFrame, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every record as (row, size, position): row holds all input columns, position is gapless from 0.

    Nulls, empty texts, ties and repeated rows are ordinary records. Columns must be sortable
    (no maps). An empty table stays empty. The same files read alike give the same order.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    total = docs.agg(F.sum(record_bytes(docs))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = packed(docs, size=size).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "row", F.monotonically_increasing_id()), F.lit(buckets)))
    gathered = (
        scattered.repartition(buckets, "bucket")
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("row", "size"))).alias("records"))
        .sortWithinPartitions("bucket")
    )
    permuted = gathered.select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("rank", "record"))
    written = materialize(permuted.select("bucket", "rank", "record.row", "record.size"), "shard-buckets")
    bases = prefix_sums(written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "n", "base").drop("n")
    if buckets <= BROADCAST_BUCKETS:
        bases = F.broadcast(bases)
    return written.join(bases, "bucket").select("row", "size", (F.col("base") + F.col("rank")).alias("position"))


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every record as (row, size, shard from 0 to shards - 1, slot gapless from 0 in its shard)."""
    placed = shuffle_records(docs, text, seed, bucket_bytes)
    return placed.select(
        "row",
        "size",
        (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a folder a shard, rows in slot order."""
    (
        sharded.repartition("shard", F.floor(F.col("slot") / 100_000))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )

"""Shared pieces of the corpus operators: written intermediate tables and distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of one block of a prefix sum; only one row a block meets in the second level.
PREFIX_BLOCK = 4096
#: Bytes of texts that a Python function holds as objects at a time, about.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may have none (tests): it gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends at files every executor sees."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterable[pa.Array], size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Arrow batches (Spark bounds their bytes) in slices of about `size` bytes, a row at least, in order."""
    for batch in batches:
        length = pc.list_value_length(batch) if pa.types.is_list(batch.type) else pc.binary_length(batch)
        at, taken = 0, np.cumsum(np.asarray(pc.fill_null(length, 0), dtype=np.int64) + 1)
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(taken, (taken[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def sliced_udf(function: Callable[[pa.Array], pa.Array], kind: T.DataType, size: int = SLICE_BYTES):
    """An Arrow function of one column, called with slices of about `size` bytes; no session setting is touched."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in text_slices(batches, size):
            yield function(some)
            # Workers outlive a stage: what a slice took goes back to the system.
            pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, kind)


def packed(docs: DataFrame, **columns) -> DataFrame:
    """All columns of a table in the struct `row`, beside columns under names of our own: no names can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, *[(F.col(f"`{v}`") if isinstance(v, str) else v).alias(k) for k, v in columns.items()])


def prefix_sums(counts: DataFrame, key: str, n: str, out: str) -> DataFrame:
    """Add `out`, the sum of `n` over all smaller keys (key: integer, distinct, not negative).

    Two levels: within blocks of PREFIX_BLOCK keys, then over one total a block.
    """
    blocked = counts.withColumn("_block", F.floor(F.col(key) / PREFIX_BLOCK))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy("_block")
        .agg(F.sum(n).alias("_sum"))
        .select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_block_base"))
    )
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_within", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(blocks, "_block")
        .withColumn(out, (F.col("_block_base") + F.col("_within")).cast("long"))
        .drop("_block", "_block_base", "_within")
    )

"""Exact deduplication by a tree merge of sorted digest runs.

Every row falls into one of `leaves` runs by a hash of its identifier, so the copies of one text,
however many, are spread over all runs, and each run holds a digest once. Then rounds follow: in
each, `fan_in` neighbouring partners exchange runs. A run is cut into segments by the first bits of
the digest, `fan_in` times as many a round, and each partner receives one segment of all partners:
runs become fewer and segments more, so that no task ever holds more than its share. A task sorts
what it received by digest and identifier and merges it: the first row of a digest stays, with the
sum of the counts. At every level the length and a second hash of the texts behind a digest must
agree, else the identifier that stays is an error. After the last round one row a digest is left;
it travels back to the rows through the leaf runs, so no join key holds more than a leaf's share of
a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, packed

LEAVES = 256
FAN_IN = 4
#: Segments of a leaf run; the first 16 bits of a digest name its segment.
SEGMENTS = 16
PREFIXES = 1 << 16
#: ASCII white space as the equality of texts reads it.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalized(text: str | Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _verified(keep: Column, least: Column, most: Column) -> Column:
    """The identifier, if length and second hash of all texts agree; it cannot be read without the test."""
    return F.when(least == most, keep).otherwise(F.raise_error(F.lit("two texts share a digest")))


def _leaf_runs(keyed: DataFrame) -> DataFrame:
    """One row a run and digest; equal digests are combined before the shuffle."""
    proof = F.struct("_len", "_check")
    found = keyed.groupBy("_run", "text_sha256").agg(
        F.min("_key").alias("_keep"), F.count(F.lit(1)).alias("_n"), F.min(proof).alias("_least"), F.max(proof).alias("_most")
    )
    return found.select("_run", "text_sha256", _verified(F.col("_keep"), F.col("_least"), F.col("_most")).alias("_keep"), "_n", F.col("_least").alias("_proof"))


def _round(runs: DataFrame, fan_in: int, segments: int) -> DataFrame:
    """One exchange between partners, and the merge of what each received. A digest has `fan_in` rows at most."""
    prefix = F.conv(F.substring("text_sha256", 1, 4), 16, 10).cast("long")
    received = (
        runs.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        .withColumn("_segment", F.floor(prefix * segments / PREFIXES).cast("int"))
        .repartition("_run", "_segment")
    )
    in_order = Window.partitionBy("_run", "_segment", "text_sha256").orderBy(F.asc_nulls_last("_keep"))
    all_of_it = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = received.select(
        "_run",
        "text_sha256",
        "_keep",
        F.row_number().over(in_order).alias("_at"),
        F.sum("_n").over(all_of_it).alias("_n"),
        F.min("_proof").over(all_of_it).alias("_proof"),
        F.max("_proof").over(all_of_it).alias("_most"),
    ).filter("_at = 1")
    return merged.select("_run", "text_sha256", _verified(F.col("_keep"), F.col("_proof"), F.col("_most")).alias("_keep"), "_n", "_proof")


def merge_runs(leaf_runs: DataFrame, leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """One row a digest (text_sha256, _keep, _n) after all rounds."""
    runs, left, segments = leaf_runs, leaves, SEGMENTS
    while left > 1:
        left, segments = -(-left // fan_in), min(segments * fan_in, PREFIXES)
        runs = _round(runs, fan_in, segments)
    return runs.select("text_sha256", "_keep", "_n")


def dedup_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Null and empty texts form a group of their own. A null key comes after all others. Of rows
    that share key and text exactly one is kept. An empty table stays empty.
    """
    body = normalized(text)
    keyed = docs.select(
        F.col(key).alias("_key"),
        F.sha2(body, 256).alias("text_sha256"),
        F.octet_length(body).cast("long").alias("_len"),
        F.xxhash64(body).alias("_check"),
        F.pmod(F.xxhash64(F.lit(leaves), key), F.lit(leaves)).cast("int").alias("_run"),
    )
    keyed = materialize(keyed, "dedup-keys")
    leaf_runs = materialize(_leaf_runs(keyed), "dedup-runs")
    winners = merge_runs(leaf_runs, leaves, fan_in).select("text_sha256", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"))
    by_leaf = leaf_runs.select("_run", "text_sha256").join(winners, "text_sha256")
    twin = Window.partitionBy("_run", "text_sha256", "_key").orderBy("_check")
    return (
        keyed.join(by_leaf, ["_run", "text_sha256"])
        .withColumn("_twin", F.row_number().over(twin))
        .select(
            F.col("_key").alias(key),
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_twin") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = dedup_groups(docs, key, text).filter("kept").select(F.col(key).alias("kept_key"), F.col("text_sha256").alias("kept_sha"))
    marked = packed(docs, key=key, sha=F.sha2(normalized(text), 256))
    matched = marked.join(kept, F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    twin = Window.partitionBy("key", "sha").orderBy(F.xxhash64("row"))
    return matched.withColumn("twin", F.row_number().over(twin)).filter("twin = 1").select("row.*")

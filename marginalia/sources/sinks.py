"""Sinks: exports, context packs, keyed upserts, logs, ledgers, dry runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import redact, text

#: Name-space bytes of version-5 identifiers (the URL name space of RFC 4122), a fixed value.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def export_json(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder a source type and document."""
    rows.write.mode("overwrite").partitionBy("source_type", "doc_id").json(path)


def context_packs(chunks: DataFrame) -> DataFrame:
    """One row a document: its chunks in order as one JSON array, and its distinct assets in order of their first chunk."""
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text")))
    packs = chunks.groupBy("doc_id").agg(F.to_json(listed).alias("pack"), F.count(F.lit(1)).alias("n_chunks"))
    if "assets" not in chunks.columns:
        return packs
    # An asset counts where it comes first; its place in that chunk decides between assets of one chunk.
    each = chunks.select("doc_id", "chunk_index", F.posexplode("assets").alias("at", "asset"))
    firsts = each.groupBy("doc_id", "asset").agg(F.min(F.struct("chunk_index", "at")).alias("first"))
    named = firsts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "asset"))), lambda x: x["asset"]).alias("assets"))
    return packs.join(named, "doc_id", "left").withColumn("assets", F.coalesce("assets", F.array().cast("array<string>")))


#: Blocks of keys that are numbered at most, and keys sampled for each.
BLOCKS, KEYS_A_BLOCK = 256, 16


def upsert(target: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """The target without the keys of the new rows, and the new rows."""
    return target.join(rows.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def with_surrogate(rows: DataFrame, existing: DataFrame, key: str, out: str = "id") -> DataFrame:
    """Identifiers of known keys, and for the rest the next numbers after the largest, in key order and without gaps.

    Keys are distinct and ordered as strings. A sample of the keys, the smallest by a hash, parts them
    into blocks of about one size, whatever they begin with: a key's number is its rank in its block
    after the sizes of the blocks before. Any sample gives the same numbers.
    """
    known = rows.join(existing.select(key, out), key, "left")
    fresh = known.filter(F.col(out).isNull()).drop(out)
    text_order = F.col(key).cast("string")
    sample = fresh.select(text_order.alias("k")).orderBy(F.xxhash64("k"), "k").limit(BLOCKS * KEYS_A_BLOCK).collect()
    cuts = sorted((r["k"] for r in sample if r["k"] is not None), key=lambda k: k.encode())[KEYS_A_BLOCK::KEYS_A_BLOCK]
    block = F.size(F.filter(F.lit(cuts).cast("array<string>"), lambda c: c <= text_order))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = fresh.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(text_order))
    top = existing.agg(F.coalesce(F.max(out), F.lit(0)).alias("_top"))
    numbered = fresh.withColumn("_block", block).withColumn("_at", inside).join(F.broadcast(bases), "_block").crossJoin(F.broadcast(top))
    return known.filter(F.col(out).isNotNull()).unionByName(numbered.withColumn(out, F.col("_top") + F.col("_base") + F.col("_at")).drop("_top", "_base", "_at", "_block"))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 identifier of a name: SHA-1 of name space and name with version and variant bits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def vector_points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Points of chunks that have text and a vector: stable id, payload as JSON, vector."""
    usable = chunks.filter(F.trim("text") != "").join(vectors, "chunk_id")
    payload = F.to_json(F.struct("chunk_id", "doc_id", "source_type", "text"))
    return usable.select(uuid5(F.col("chunk_id").cast("string")).alias("point_id"), "chunk_id", payload.alias("payload"), "vector")


def skipped_points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_id, reason) of the chunks that give no point: their text is blank, or they have no vector."""
    joined = chunks.select("chunk_id", "text").join(vectors.select("chunk_id", F.lit(True).alias("_has")), "chunk_id", "left")
    reason = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank text").when(F.col("_has").isNull(), "no vector")
    return joined.select("chunk_id", reason.alias("reason")).filter("reason IS NOT NULL")


def log_rows(answers: DataFrame) -> DataFrame:
    """Log rows of answers: secrets masked, texts cut at 2,000 characters, only references that can be found."""
    short = lambda c: text.truncated(redact.secrets(F.col(c)), 2000)
    return answers.select("id", short("query").alias("query"), short("summary").alias("summary"), F.filter("citations", lambda c: F.trim(c) != "").alias("citations"), "latency_ms", "token_cost")


def newest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n newest rows."""
    return rows.orderBy(F.desc(order)).limit(n)


def unapplied(migrations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Migrations that the ledger does not hold, in name order."""
    return migrations.join(ledger.select("name"), "name", "left_anti").orderBy("name")


def dry_run(rows: DataFrame, group: str, order: str, preview: int = 3) -> DataFrame:
    """Rows a group and the first few keys. Tasks rank their own rows first, so a group sends few rows on."""
    ranked = rows.select(group, order, F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("_n")).filter(F.col("_n") <= preview)
    firsts = ranked.groupBy(F.col(group).alias("_group")).agg(F.array_sort(F.collect_list(order)).alias("preview"))
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def guarded(rows: DataFrame, key: str) -> DataFrame:
    """The rows, or an error where they belong to more than one document."""
    ends = rows.agg(F.min(key).alias("_least"), F.max(key).alias("_most"))
    one = F.when(F.col("_least") == F.col("_most"), F.col(key)).otherwise(F.raise_error(F.lit("rows of more than one document")))
    return rows.crossJoin(F.broadcast(ends)).withColumn(key, one).drop("_least", "_most")


def cache_plan(manifests: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Key, value and lifetime of cached manifests; nothing is written."""
    return manifests.select(F.concat(F.lit("manifest:"), F.col("doc_id").cast("string")).alias("key"), F.to_json(F.struct("*")).alias("value"), F.lit(ttl_seconds).alias("ttl_seconds"))


def replayed(requests: DataFrame, fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, misses): recorded responses by the SHA-256 of the canonical request."""
    hashed = requests.withColumn("request_hash", F.sha2("request", 256))
    return hashed.join(fixtures, "request_hash"), hashed.join(fixtures.select("request_hash"), "request_hash", "left_anti")


def cost(input_tokens: Column, cached_tokens: Column, output_tokens: Column, rates: tuple[float, float | None, float]) -> Column:
    """Cost by a million tokens; cached ones at their own rate, or the input rate where there is none."""
    plain, cached, out = rates
    return ((input_tokens - cached_tokens) * plain + cached_tokens * (plain if cached is None else cached) + output_tokens * out) / 1e6

"""Mixing sources to target weights by Poisson replication.

A source of n rows with the target share w of `total` output rows has the mean repetition rate
w * total / n. Each row draws its number of copies by inverting that Poisson distribution at a
uniform number made from a hash of the seed and the row's identifier, so a retried task draws the
same. Copies are exploded and put into a global random order by a second hash. Rows that share an
identifier, or have none, draw alike but are told apart in the order by their place in the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, packed, prefix_sums

SEED = "mix-1"
#: Target shares; sources that are not named share REST together.
WEIGHTS = {"src0": 0.20, "src1": 0.05, "src2": 0.05, "src3": 0.10}
REST = 0.60
REST_LABEL = "*"
#: Buckets of the global order.
BUCKETS = 65536
#: Repeated keys up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 65536


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until the tail is below double precision."""
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        if k > rate and (total >= 1.0 - 2**-53 or k > rate + 40 * math.sqrt(rate) + 60):
            return out
        k += 1


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def repetition_rates(docs: DataFrame, weights: dict[str, float], rest: float, source: str, total: int | None = None) -> dict[str, float]:
    """Mean copies a row for each configured source; the groups counted are as many as the weights name, plus one."""
    counts = {r["_label"]: r["n"] for r in docs.groupBy(_label(weights, source).alias("_label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: ({**weights, REST_LABEL: rest})[k] for k in counts}
    whole = sum(share.values())
    rows = sum(counts.values()) if total is None else total
    return {k: share[k] / whole * rows / counts[k] for k in counts if share[k] > 0}


def _label(weights: dict[str, float], source: str) -> Column:
    return F.when(F.col(source).isin(list(weights)), F.col(source)).otherwise(F.lit(REST_LABEL))


def _named(docs: DataFrame, key: str, **columns: Column) -> DataFrame:
    """Packed rows with `name`: the key as text; where rows share it (null too) with the row's place in the input.

    Only the key column is read and counted for this, combined before its shuffle. The place repeats
    where the input is read alike, as files are.
    """
    text = F.col(f"`{key}`").cast("string")
    repeated = materialize(docs.groupBy(text.alias("shared")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shared", F.lit(True).alias("again")), "mix-repeated")
    if repeated.count() <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    placed = packed(docs, **columns, own=text, place=F.monotonically_increasing_id())
    joined = placed.join(repeated, F.col("own").eqNullSafe(F.col("shared")), "left")
    own = F.coalesce("own", F.lit("null"))
    return joined.select("row", *columns, F.when(F.col("again"), F.concat_ws("#", own, "place")).otherwise(own).alias("name"))


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, rest: float = REST, key: str = "doc_id", source: str = "source", seed: str = SEED, total: int | None = None) -> DataFrame:
    """Copies of rows in the target mixture: row (all input columns), copy (from 1), position (global order, gapless from 0).

    A null source counts among the rest; a source of weight 0 yields nothing. Rows that share a key,
    null or not, draw the same number of copies: where one key holds much of a source, the share of that
    source is met on average over seeds only. In the order such rows, equal ones too, lie apart, so
    that no bucket takes them all. An empty table stays empty.
    """
    rates = repetition_rates(docs, weights, rest, source, total)
    drawn = _named(docs, key, label=_label(weights, source), draw=uniform(F.lit(seed), F.col(key)))
    copies = F.lit(0)
    for label, rate in sorted(rates.items()):
        cdf = F.array(*[F.lit(x) for x in poisson_cdf(rate)])
        copies = F.when(F.col("label") == label, F.size(F.filter(cdf, lambda x: x <= F.col("draw")))).otherwise(copies)
    copied = (
        drawn.withColumn("copies", copies)
        .filter("copies > 0")
        .select("row", "name", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "name", "copy")))
        .withColumn("bucket", F.conv(F.substring("order", 1, 4), 16, 10).cast("long"))
    )
    # Dealt here and sorted at the end, not by the window alone: a caller may drop the position, but not the order.
    shuffled = copied.repartition("bucket")
    sizes = copied.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    bases = prefix_sums(sizes, "bucket", "n", "base").drop("n")
    inside = Window.partitionBy("bucket").orderBy("order")
    return (
        shuffled.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(bases), "bucket")  # BUCKETS rows at most
        .sortWithinPartitions("bucket", "order")
        .select("row", "copy", (F.col("base") + F.col("rank") - 1).cast("long").alias("position"))
    )

"""Evaluation: recall, evidence matching, thresholds, percentiles, parity, backfill, corpus profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import written

# Order in which miss categories decide, sweep steps.
MISS_PRIORITY = ("corpus-quality", "terminology", "retrieval", "ranking", "cross-doc", "synthesis", "pass")
THRESHOLDS = [round(k * 0.05, 2) for k in range(21)]


def match_evidence(targets: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, evidence_id, rank): a hit with the target's chunk, or with its document and a shared page.

    The either-or is two equi-joins, so neither compares all pairs.
    """
    by_chunk = targets.join(hits, ["case_id", "chunk_id"]).select("case_id", "evidence_id", "rank")
    t = targets.select("case_id", "evidence_id", "doc_id", F.explode("pages").alias("page"))
    h = hits.select("case_id", "doc_id", "rank", F.explode("pages").alias("page"))
    by_page = t.join(h, ["case_id", "doc_id", "page"]).select("case_id", "evidence_id", "rank")
    return by_chunk.union(by_page).groupBy("case_id", "evidence_id").agg(F.min("rank").alias("rank"))


def recall_at(targets: DataFrame, matched: DataFrame, *ks: int) -> DataFrame:
    """Mean over cases of the share of targets found within each k."""
    joined = targets.select("case_id", "evidence_id").distinct().join(matched, ["case_id", "evidence_id"], "left")
    found = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in ks]
    per_case = joined.groupBy("case_id").agg(*found)
    return per_case.agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(f"recall_at_{k}"), 6).alias(f"recall_at_{k}") for k in ks])


def nearest_rank(values: DataFrame, group: str, value: str, shares: dict[str, float], bins: int = 256) -> DataFrame:
    """Percentiles at the zero-based place floor((n - 1) * share + 0.5) of the sorted values.

    Equal values are counted first. Approximate quantiles cut a group into bins, sums over the bins
    name the one that holds a place, and only its distinct values are sorted; the result is exact.
    The cuts depend on the order in which a shuffle delivers, so they are written once: the sums and
    the bin that is sorted must have the same ones.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counted.groupBy(group).agg(F.percentile_approx("_v", [k / bins for k in range(1, bins)], 4096).alias("_cuts"), F.sum("_n").alias("_all"))
    binned = counted.join(written(cuts, "cuts"), group).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    before = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = binned.groupBy(group, "_bin", "_all").agg(F.sum("_n").alias("_in")).withColumn("_base", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor((F.col("_all") - 1) * p + 0.5).alias("at")) for name, p in shares.items()]))
    places = bases.withColumn("_w", wanted).filter((F.col("_w.at") >= F.col("_base")) & (F.col("_w.at") < F.col("_base") + F.col("_in"))).select(group, "_bin", "_base", "_w.name", "_w.at")
    upto = F.sum("_n").over(Window.partitionBy(group, "_bin", "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = binned.join(places, [group, "_bin"]).withColumn("_upto", F.col("_base") + upto)
    found = inside.filter((F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("_n")))
    return found.groupBy(group).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in shares])


def threshold_sweep(cases: DataFrame, score: str, label: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Confusion counts, accuracy, recall and block rate at each threshold, from one pass over score bins.

    Scores are binned by the number of thresholds they reach, so the sweep joins nothing.
    """
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(score) >= t))
    bins = cases.groupBy(reached.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ladder = bins.select(F.explode(F.array(*[F.struct(F.lit(k + 1).alias("need"), F.lit(t).alias("threshold")) for k, t in enumerate(thresholds)])).alias("t"), "reached", "pos", "neg")
    passed = F.col("reached") >= F.col("t.need")
    counted = ladder.groupBy(F.col("t.threshold").alias("threshold")).agg(
        F.sum(F.when(passed, F.col("pos")).otherwise(0)).alias("true_usable"),
        F.sum(F.when(passed, 0).otherwise(F.col("pos"))).alias("false_block"),
        F.sum(F.when(passed, 0).otherwise(F.col("neg"))).alias("true_unusable"),
        F.sum(F.when(passed, F.col("neg")).otherwise(0)).alias("false_allow"),
    )
    total = F.col("true_usable") + F.col("false_block") + F.col("true_unusable") + F.col("false_allow")
    return (
        counted.withColumn("accuracy", F.round((F.col("true_usable") + F.col("true_unusable")) / total, 3))
        .withColumn("usable_recall", F.round(F.try_divide(F.col("true_usable"), F.col("true_usable") + F.col("false_block")), 3))
        .withColumn("unusable_block_rate", F.round(F.try_divide(F.col("true_unusable"), F.col("true_unusable") + F.col("false_allow")), 3))
    )


def best_threshold(swept: DataFrame) -> DataFrame:
    """Fewest false allows, then fewest false blocks, then the larger threshold."""
    return swept.orderBy("false_allow", "false_block", F.desc("threshold")).limit(1)


def confusion(cases: DataFrame, expected: Column, predicted: Column, *groups: str) -> DataFrame:
    """Confusion counts, precision, recall and block rate a group; null where nothing divides."""
    counted = cases.groupBy(*groups).agg(
        F.count_if(expected & predicted).alias("tp"), F.count_if(~expected & predicted).alias("fp"), F.count_if(expected & ~predicted).alias("fn"), F.count_if(~expected & ~predicted).alias("tn")
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return counted.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn")).withColumn("block_rate", share("tn", "fp"))


def miss_categories(recall_5: Column, recall_10: Column, corpus_risk: Column, many_docs: Column, complete: Column, faithful: Column) -> Column:
    """Categories of a case's misses in their order; pass where there are none."""
    found = F.array_compact(
        F.array(
            F.when((recall_10 < 1) & corpus_risk, "corpus-quality").when(recall_10 < 1, "retrieval"),
            F.when(recall_5 < recall_10, "ranking"),
            F.when(many_docs & (complete < 1), "cross-doc"),
            F.when((complete < 1) | ~faithful, "synthesis"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("pass"))).otherwise(found)


def primary_miss(categories: Column) -> Column:
    """The category that comes first in priority."""
    return F.filter(F.array(*[F.lit(x) for x in MISS_PRIORITY]), lambda x: F.array_contains(categories, x))[0]


def paired_relabel(cases: DataFrame, pair: str, language: str, recall: str, category: str) -> DataFrame:
    """A retrieval miss becomes a terminology miss where the other language of the pair has full recall."""
    peers = cases.groupBy(pair, language).agg(F.min(recall).alias("_peer"))
    joined = cases.alias("c").join(
        peers.select(F.col(pair).alias("_pair"), F.col(language).alias("_language"), "_peer").alias("p"),
        (F.col(f"c.{pair}") == F.col("_pair")) & (F.col(f"c.{language}") != F.col("_language")),
        "left",
    )
    best = joined.groupBy(*[F.col(f"c.{c}") for c in cases.columns]).agg(F.max("_peer").alias("_peer"))
    relabelled = F.when((F.col(category) == "retrieval") & (F.col(recall) < 1) & (F.col("_peer") == 1), "terminology").otherwise(F.col(category))
    return best.withColumn(category, relabelled).drop("_peer")


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many rows each side has that the other has not, as bags: counts a side of grouped rows."""
    columns = left.columns
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*columns).withColumn("_side", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("_side").alias("_net"))
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("_net") > 0, F.col("_net"))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.when(F.col("_net") < 0, -F.col("_net"))), F.lit(0)).alias("only_right")
    )


def backfill(rows: DataFrame, manifest: DataFrame, key: str, *fields: str) -> DataFrame:
    """Null or empty fields filled from the manifest, with a count of changed fields a row."""
    named = manifest.select(F.col(key), *[F.col(f).alias(f"_m_{f}") for f in fields])
    joined = rows.join(named, key, "left")
    new = {f: F.coalesce(F.when(F.col(f) != "", F.col(f)), F.col(f"_m_{f}"), F.col(f)) for f in fields}
    changed = sum(((~F.col(f).eqNullSafe(v)).cast("int") for f, v in new.items()), F.lit(0))
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns], changed.alias("n_changed"))


def gates(row: DataFrame, **named: Column) -> DataFrame:
    """Named boolean gates and their conjunction."""
    checked = row.select(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in named.items()])
    everything = F.lit(True)
    for k in named:
        everything = everything & F.col(k)
    return checked.withColumn("eligible", everything)


def coverage_profile(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows, distinct documents, and the share of rows with each field, to four places."""
    present = [F.round(F.avg((F.col(f).isNotNull() & (F.col(f).cast("string") != "")).cast("double")), 4).alias(f"{f}_coverage") for f in fields]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *present)


def first_samples(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    ranked = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("sample_no", F.row_number().over(ranked)).filter(F.col("sample_no") <= n)

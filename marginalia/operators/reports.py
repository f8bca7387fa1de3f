"""Reports over evaluated cases: retrieval reports with a replacement gate, scorecards, comparisons of modes, pass rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.evaluation import nearest_rank


# Where the gate of a retrieval report stands.
LEAST_RECALL, MOST_MISSING = 0.8, 1


def found_by_case(cases: DataFrame, targets: DataFrame, matched: DataFrame, hits: DataFrame, *ks: int) -> DataFrame:
    """One row a case: number of targets, whether any target is found within each k, share found within each k, whether it has hits at all.

    cases: case_id; targets: case_id, evidence_id; matched: case_id, evidence_id, rank; hits: case_id, rank.
    """
    ranked = targets.select("case_id", "evidence_id").distinct().join(matched, ["case_id", "evidence_id"], "left")
    within = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    each = ranked.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("targets"), *[F.max(within(k)).alias(f"hit_at_{k}") for k in ks], *[F.avg(within(k).cast("double")).alias(f"share_at_{k}") for k in ks]
    )
    any_hit = hits.filter(F.col("rank") <= max(ks)).select("case_id").distinct().withColumn("has_hits", F.lit(True))
    joined = cases.select("case_id").join(each, "case_id", "left").join(any_hit, "case_id", "left")
    return joined.withColumn("targets", F.coalesce("targets", F.lit(0))).withColumn("has_hits", F.coalesce("has_hits", F.lit(False)))


def retrieval_report(by_case: DataFrame, *ks: int) -> DataFrame:
    """One row: counts of cases, hit-any recall at each k over cases with targets, incomplete cases, hits where a miss is expected, the gate.

    Another retrieval is justified where recall at 10 (or the largest k) is below 0.8, or a case misses at any k.
    """
    wants = F.col("targets") > 0
    all_ks = F.col(f"hit_at_{ks[0]}")
    for k in ks[1:]:
        all_ks = all_ks & F.col(f"hit_at_{k}")
    decision = 10 if 10 in ks else max(ks)
    counted = by_case.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(wants).alias("evidence_cases"),
        F.count_if(~wants).alias("expected_misses"),
        *[F.avg(F.when(wants, F.col(f"hit_at_{k}").cast("double"))).alias(f"recall_at_{k}") for k in ks],
        F.count_if(wants & ~all_ks).alias("missing_cases"),
        F.count_if(~wants & F.col("has_hits")).alias("unexpected_hits"),
    )
    justified = F.coalesce((F.col(f"recall_at_{decision}") < LEAST_RECALL) | (F.col("missing_cases") >= MOST_MISSING), F.lit(False))
    rounded = [F.round(c, 6).alias(c) if c.startswith("recall") else F.col(c) for c in counted.columns]
    return counted.select(*rounded, justified.alias("replacement_justified"))


def language_report(cases: DataFrame, languages: tuple[str, str] = ("en", "zh")) -> DataFrame:
    """One row: mean recall, recall of each language, share of intents that all their languages meet, incomplete cases, latency.

    cases: case_id, place (order of the run), intent, language, recall, latency_ms. An intent passes
    where its cases have exactly the given languages and none misses anything. The first case of the
    run is the cold start, and the percentiles are over the others.
    """
    each = cases.withColumn("recall", F.bround("recall", 3))
    mean = lambda c: F.bround(F.sum(c) / F.count(c), 3)
    first = each.agg(F.min_by("latency_ms", "place").alias("cold_start"), F.min("place").alias("place"))
    whole = each.agg(F.count(F.lit(1)).alias("cases"), mean("recall").alias("recall"), F.count_if(F.col("recall") < 1).alias("missing_cases"))
    one = each.groupBy("language").agg(mean("recall").alias("recall"))
    by_language = one.agg(F.array_sort(F.collect_list(F.struct("language", "recall"))).alias("by_language"))
    met = (F.array_sort(F.collect_set("language")) == F.lit(sorted(languages))) & (F.min("recall") == 1)
    pairs = each.groupBy("intent").agg(met.cast("double").alias("met")).agg(mean("met").alias("pair_recall"))
    steady = each.join(first.select("place"), "place", "left_anti").withColumn("run", F.lit(0))
    ranks = nearest_rank(steady, "run", "latency_ms", {"steady_p50": 0.5, "steady_p95": 0.95})
    # Five tables of one row (the last may have none) become one.
    report = whole.withColumn("run", F.lit(0))
    for part in (by_language, pairs, first.select(F.bround("cold_start", 3).alias("cold_start"))):
        report = report.join(part.withColumn("run", F.lit(0)), "run", "left")
    return report.join(ranks.select("run", F.bround("steady_p50", 3).alias("steady_p50"), F.bround("steady_p95", 3).alias("steady_p95")), "run", "left").drop("run")


def scorecard(cases: DataFrame, means: list[str], flags: list[str], status: str, misses: str) -> DataFrame:
    """One row of an evaluation run: means and rates to three places, latency, counts a status and a miss, the leading miss, a fingerprint.

    `misses` holds all miss categories of a case. The fingerprint is over all columns but the
    latency, in case order, so that it tells two runs apart by what they found. Cases are a question
    set, so one row may hold a digest of each.
    """
    rest = [c for c in sorted(cases.columns) if c != "latency_ms"]
    digest = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("case_id", digest.alias("d")))), lambda x: x["d"])
    one = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.round(F.avg(m), 3).alias(m) for m in means],
        *[F.round(F.avg(F.col(f).cast("double")), 3).alias(f"{f}_rate") for f in flags],
        F.round(F.sum("latency_ms"), 3).alias("latency_total"),
        F.round(F.avg("latency_ms"), 3).alias("latency_mean"),
        F.round(F.max("latency_ms"), 3).alias("latency_max"),
        F.sha2(F.array_join(in_order, "\n"), 256).alias("fingerprint"),
    )
    listed = lambda df, key, out: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws("=", key, F.col("n").cast("string")))).alias(out))
    signals = cases.select("case_id", F.posexplode(misses).alias("at", "miss"))
    failed = signals.filter("miss <> 'pass'").groupBy("miss").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("case_id", "at")).alias("seen"))
    # The most frequent one; of equal ones that which is seen first.
    leading = failed.agg(F.min_by(F.struct("miss", "n"), F.struct(-F.col("n"), F.col("seen"))).alias("lead")).select(F.coalesce("lead.miss", F.lit("none")).alias("leading_miss"), F.coalesce("lead.n", F.lit(0)).alias("leading_count"))
    parts = [listed(cases, status, "statuses"), listed(signals, "miss", "miss_counts"), leading]
    for part in parts:
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one


def compare_modes(by_mode: DataFrame, baseline: DataFrame, candidate: str = "hybrid") -> DataFrame:
    """One row: mean recall of each mode, and whether the candidate may replace the baseline.

    by_mode: mode, case_id, recall; baseline: case_id, recall. The candidate must reach the best
    other mode and the baseline, mend a case that the baseline misses, and lose none that it finds whole.
    """
    modes = by_mode.groupBy("mode").agg(F.round(F.avg("recall"), 3).alias("recall"))
    scores = modes.agg(
        F.array_sort(F.collect_list(F.struct("mode", "recall"))).alias("scores"),
        F.max(F.when(F.col("mode") == candidate, F.col("recall"))).alias("mine"),
        F.max(F.when(F.col("mode") != candidate, F.col("recall"))).alias("best_other"),
    )
    both = baseline.withColumnRenamed("recall", "was").join(by_mode.filter(F.col("mode") == candidate), "case_id")
    changes = both.agg(
        F.round(F.avg("was"), 3).alias("baseline"),
        F.array_sort(F.collect_list(F.when((F.col("was") == 0) & (F.col("recall") > 0), F.col("case_id")))).alias("mended"),
        F.array_sort(F.collect_list(F.when((F.col("was") == 1) & (F.col("recall") == 0), F.col("case_id")))).alias("lost"),
    )
    joined = scores.crossJoin(F.broadcast(changes))
    eligible = (F.col("mine") >= F.col("best_other")) & (F.col("mine") >= F.col("baseline")) & (F.size("mended") > 0) & (F.size("lost") == 0)
    return joined.select(F.transform("scores", lambda s: F.concat_ws("=", s["mode"], F.format_string("%.3f", s["recall"]))).alias("scores"), "best_other", "baseline", "mended", "lost", eligible.alias("eligible"))


def pass_rates(checks: DataFrame, **rates: Column) -> DataFrame:
    """One row: the share of true among the values of each check that are not null; null where there are none."""
    return checks.agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(c.cast("double")), 6).alias(name) for name, c in rates.items()])


def cold_start(questions: DataFrame, top: DataFrame) -> DataFrame:
    """One row: how many questions, the share that has a cited hit, and the share whose best hit holds an expected term.

    questions: query_id, terms; top: query_id, body of the best hit.
    """
    joined = questions.join(top, "query_id", "left")
    lowered = F.lower(F.coalesce("body", F.lit("")))
    holds = F.exists("terms", lambda t: F.contains(lowered, F.lower(t)))
    return joined.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("body").isNotNull().cast("double")), 3).alias("citation_coverage"), F.round(F.avg(holds.cast("double")), 3).alias("term_hit_rate"))

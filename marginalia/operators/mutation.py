"""Audited changes of a corpus: a log of every changed field, fingerprints before and after, proof that a second run changes nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Audit:
    """The changed rows, the log (key, field, before, after), and one row that sums them up."""

    rows: DataFrame
    log: DataFrame
    report: DataFrame


def fingerprint(columns: list[str]) -> Column:
    """An aggregate that tells two bags of rows apart, whatever their order: count, sum and exclusive or of two hashes a row. Partial ones merge."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})
    digest = F.sha2(row, 256)
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    parts = [F.count(F.lit(1)), F.sum(number(1).cast("decimal(38,0)")), F.sum(number(16).cast("decimal(38,0)")), F.bit_xor(number(31))]
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("0")) for p in parts]), 256)


def changed(rows: DataFrame, rules: dict[str, Column], stamps: dict[str, Column]) -> DataFrame:
    """The columns with the rules applied, those before in the struct `_before`; stamps follow where a rule has changed something."""
    before = rows.withColumn("_before", F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    applied = before.select(*[rules.get(c, F.col(f"`{c}`")).alias(c) for c in rows.columns], "_before")
    differs = F.exists(F.array(*[~F.col(f"`{c}`").eqNullSafe(F.col("_before").getField(c)) for c in rules]), lambda x: x)
    return applied.select(*[F.when(differs, stamps[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in stamps else F.col(f"`{c}`") for c in rows.columns], "_before")


def audited(rows: DataFrame, key: str, rules: dict[str, Column], stamps: dict[str, Column] | None = None) -> Audit:
    """Apply `rules` (new values of columns) and restamp counts of the rows they change by `stamps`, computed on the new values.

    The report has the number of rows, of changed rows and of changes, how many changes a second run
    would make (`n_left`), whether it would make none (`idempotent`), and both fingerprints.
    """
    stamps = stamps or {}
    both = changed(rows, rules, stamps)
    watched = [*rules, *[s for s in stamps if s not in rules]]
    field = lambda c: F.when(~F.col(f"`{c}`").eqNullSafe(F.col("_before").getField(c)), F.struct(F.lit(c).alias("field"), F.col("_before").getField(c).cast("string").alias("before"), F.col(f"`{c}`").cast("string").alias("after")))
    marked = both.withColumn("_changes", F.array_compact(F.array(*[field(c) for c in watched])))
    after = both.select(*rows.columns)
    log = marked.select(F.col("_before").getField(key).alias(key), F.explode("_changes").alias("_c")).select(key, "_c.*")
    twice = changed(after, rules, stamps)
    left = F.size(F.array_compact(F.array(*[F.when(~F.col(f"`{c}`").eqNullSafe(F.col("_before").getField(c)), F.lit(1)) for c in watched])))
    sums = marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("_changes") > 0).alias("n_changed"), F.coalesce(F.sum(F.size("_changes")), F.lit(0)).alias("n_changes"), fingerprint(rows.columns).alias("fingerprint_after"))
    again = twice.agg(F.coalesce(F.sum(left), F.lit(0)).alias("n_left"))
    first = rows.agg(fingerprint(rows.columns).alias("fingerprint_before"))
    # One row each.
    report = sums.crossJoin(F.broadcast(again)).crossJoin(F.broadcast(first)).withColumn("idempotent", F.col("n_left") == 0)
    return Audit(after, log, report)

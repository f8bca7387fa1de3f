"""Deletion over the references between the tables of the store, and rows that refer to nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.session import written


def deleted(tables: dict[str, DataFrame], start: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ids that go from each table when those of `start` go, by the references that cascade.

    `tables` holds tables of the store by name; those that are not given have no rows. A table that
    refers to itself takes a round a level, each a semi join with the last level only. Ids that no
    row has, and null ids, delete nothing.
    """
    gone: dict[str, DataFrame] = {}
    for name in (n for n in schemas.TABLES if n in tables):
        rows = tables[name]
        cascading = [(r.column, r.target) for r in schemas.REFERENCES if r.table == name and r.action == schemas.CASCADE]
        found = [rows.join(start[name].select("id").distinct(), "id", "left_semi").select("id")] if name in start else []
        found += [_referring(rows, column, gone[target]) for column, target in cascading if target in gone and target != name]
        ids = reduce(DataFrame.union, found).distinct() if found else rows.filter("false").select("id")
        inner = [column for column, target in cascading if target == name]
        gone[name] = _descendants(rows, inner, written(ids, "gone")) if inner and found else written(ids, "gone")
    return gone


def _referring(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_semi").select("id")


def _descendants(rows: DataFrame, columns: list[str], seen: DataFrame) -> DataFrame:
    """`seen` and all that refers to it at any distance; a cycle ends where nothing is new."""
    links = rows.select("id", *columns)
    level = seen
    while not level.isEmpty():
        below = reduce(DataFrame.union, [_referring(links, c, level) for c in columns])
        level = written(below.distinct().join(seen, "id", "left_anti"), "gone-level")
        seen = seen.union(level)
    return seen


def without(tables: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a deletion: rows whose id went are left out, references that do not cascade become null."""
    kept = {}
    for name, rows in tables.items():
        left = rows.join(gone[name], "id", "left_anti") if name in gone else rows
        for r in schemas.REFERENCES:
            if r.table == name and r.action == schemas.SET_NULL and r.target in gone:
                went = gone[r.target].select(F.col("id").alias("_went"))
                left = left.join(went, left[r.column] == went["_went"], "left").withColumn(r.column, F.when(F.col("_went").isNull(), F.col(r.column))).drop("_went")
        kept[name] = left.select(*rows.columns)
    return kept


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, value, n): references to rows that do not exist. Null refers to nothing and is none."""
    found = []
    for r in schemas.REFERENCES:
        if r.table in tables and r.target in tables:
            values = tables[r.table].filter(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            lost = values.join(tables[r.target].select(F.col("id").alias("value")), "value", "left_anti")
            found.append(lost.select(F.lit(r.table).alias("table_name"), F.lit(r.column).alias("column_name"), F.col("value").cast("long").alias("value"), "n"))
    return reduce(DataFrame.unionByName, found)

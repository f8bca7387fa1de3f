"""Audit of a corpus by its schema: coverage and garbled values of every text at any depth, kinds, aliases of facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text
from marginalia.operators.evaluation import first_samples

Values = Callable[[Column], Column]


def text_paths(kind: T.DataType) -> list[tuple[str, Values]]:
    """The places of a type that hold strings, each with the expression for all values there as one array.

    `.name` is a field, `[]` the elements of an array, `{key}` and `{}` the keys and values of a map.
    """
    if isinstance(kind, T.StringType):
        return [("", lambda c: F.array(c))]
    if isinstance(kind, T.StructType):
        return [(f".{f.name}{path}", _field(f.name, get)) for f in kind.fields for path, get in text_paths(f.dataType)]
    if isinstance(kind, T.ArrayType):
        return [(f"[]{path}", _elements(get)) for path, get in text_paths(kind.elementType)]
    if isinstance(kind, T.MapType):
        keys = [("{key}" + path, _after(F.map_keys, _elements(get))) for path, get in text_paths(kind.keyType)]
        return keys + [("{}" + path, _after(F.map_values, _elements(get))) for path, get in text_paths(kind.valueType)]
    return []


def _field(name: str, get: Values) -> Values:
    return lambda c: get(c.getField(name))


def _elements(get: Values) -> Values:
    return lambda c: F.flatten(F.transform(c, get))


def _after(first: Values, get: Values) -> Values:
    return lambda c: get(first(c))


def field_audit(rows: DataFrame, key: str, garbled: Values = text.garbled_strict, samples: int = 3) -> DataFrame:
    """(path, n_rows, n_values, n_filled, coverage, n_garbled, garbled_rows, first_garbled) for each place of a string.

    n_filled counts values that are neither null nor blank; coverage is the share of rows with one, to
    four places. first_garbled are the smallest keys of rows with a garbled value there. Only counts
    leave a row, no text does. A table without strings, or without rows, gives no row.
    """
    places = [(f.name + path, get(F.col(f"`{f.name}`"))) for f in rows.schema.fields for path, get in text_paths(f.dataType)]

    def counted(path: str, values: Column) -> Column:
        filled = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v) != "")
        bad = F.filter(filled, lambda v: garbled(v))
        return F.struct(F.lit(path).alias("path"), F.size(F.coalesce(values, F.array().cast("array<string>"))).alias("n"), F.size(filled).alias("filled"), F.size(bad).alias("bad"))

    if not places:
        return rows.sparkSession.createDataFrame([], "path string, n_rows long, n_values long, n_filled long, coverage double, n_garbled long, garbled_rows long, first_garbled array<string>")
    each = rows.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(*[counted(*p) for p in places])).alias("c")).select("key", "c.*")
    totals = each.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n").alias("n_values"),
        F.sum("filled").alias("n_filled"),
        F.round(F.avg((F.col("filled") > 0).cast("double")), 4).alias("coverage"),
        F.sum("bad").alias("n_garbled"),
        F.count_if(F.col("bad") > 0).alias("garbled_rows"),
    )
    first = first_samples(each.filter("bad > 0").select("path", "key"), "path", "key", samples)
    listed = first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list("key")), lambda k: k.cast("string")).alias("first_garbled"))
    return totals.join(listed, "path", "left").withColumn("first_garbled", F.coalesce("first_garbled", F.array().cast("array<string>")))


def kind_counts(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n): rows of each kind; null and empty count as unknown."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def alias_key(alias: Column) -> Column:
    return F.lower(text.squeeze(alias))


def alias_coverage(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: n_aliases, n_covered, rate (four places, 0 without aliases), n_missing.

    `facts` are (case_id, fact_id, alias), `aliases` have the column alias. Two that differ in case or
    white space are one; blank and null ones do not count. Facts are counted a distinct alias before
    they meet the aliases.
    """
    distinct = _named(facts).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    judged = distinct.join(_known(aliases).withColumn("known", F.lit(True)), "name", "left")
    n, covered = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    total = judged.agg(n.alias("n_aliases"), covered.alias("n_covered"))
    rate = F.when(F.col("n_aliases") > 0, F.round(F.col("n_covered") / F.col("n_aliases"), 4)).otherwise(0.0)
    return total.select("*", rate.alias("rate"), (F.col("n_aliases") - F.col("n_covered")).alias("n_missing"))


def missing_aliases(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """The (case_id, fact_id, alias) whose alias is not among the aliases; order and limit are the caller's."""
    return _named(facts).join(_known(aliases), "name", "left_anti").select("case_id", "fact_id", "alias")


def _named(facts: DataFrame) -> DataFrame:
    return facts.select("case_id", "fact_id", text.strip(F.col("alias")).alias("alias"), alias_key(F.col("alias")).alias("name")).filter("name <> ''")


def _known(aliases: DataFrame) -> DataFrame:
    return aliases.select(alias_key(F.col("alias")).alias("name")).filter("name <> ''").distinct()

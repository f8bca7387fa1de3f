"""Tables of the store: columns that were added later, checks of uniqueness, rows of taxonomies and answers."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import schemas

ALIASES_VERSION = "phase5.retrieval_aliases.v1"


def with_added_columns(rows: DataFrame, ddl: str) -> DataFrame:
    """The rows with the columns of a DDL string that they lack, as nulls; columns that are there stay as they are."""
    new = [f for f in T._parse_datatype_string(ddl).fields if f.name not in rows.columns]
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the form of a table of the store, in its order of columns. Columns that it does not have are an error."""
    ddl = ", ".join(x for x in (schemas.TABLES[name], schemas.ADDED.get(name)) if x)
    fields = T._parse_datatype_string(ddl).fields
    if unknown := sorted(set(rows.columns) - {f.name for f in fields}):
        raise ValueError(f"the table {name} has no columns {', '.join(unknown)}")
    return with_added_columns(rows, ddl).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def violations(rows: DataFrame, name: str) -> DataFrame:
    """(rule, value, n): values of unique columns that come more than once, and nulls of required columns."""
    found = []
    for c in schemas.UNIQUE.get(name, ()):
        twice = rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found.append(twice.select(F.lit(f"{c} is not unique").alias("rule"), "value", "n"))
    for c in schemas.REQUIRED.get(name, ()):
        none = rows.filter(F.col(c).isNull()).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        found.append(none.select(F.lit(f"{c} is missing").alias("rule"), F.lit(None).cast("string").alias("value"), "n"))
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], "rule string, value string, n long")


def taxonomy(spark: SparkSession, path: str, version: str = ALIASES_VERSION) -> DataFrame:
    """(family, place, alias) of an alias taxonomy in YAML or JSON. Another version, or a family of fewer than two aliases, is an error.

    Aliases for retrieval come before the general ones where a family has both. The file is read by
    Spark, as one small row.
    """
    body = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml

        data = yaml.safe_load(body)
    except ImportError:
        data = json.loads(body)
    if not isinstance(data, dict) or data.get("schema_version") != version:
        raise ValueError(f"{path} is not of version {version}")
    rows = []
    for family in data.get("families", []):
        listed = family.get("retrieval_aliases") or family.get("aliases") or []
        aliases = [str(a).strip() for a in listed if str(a).strip()]
        if not family.get("id") or len(aliases) < 2:
            raise ValueError(f"{path}: a family needs a name and two aliases: {family.get('id')}")
        rows += [(str(family["id"]), k, a) for k, a in enumerate(aliases)]
    return spark.createDataFrame(rows, "family string, place int, alias string")


def families(rows: DataFrame) -> dict[str, tuple[str, ...]]:
    """A taxonomy (a few hundred rows) as the mapping that the question functions take."""
    out: dict[str, tuple[str, ...]] = {}
    for r in rows.orderBy("family", "place").collect():
        out[r.family] = (*out.get(r.family, ()), r.alias)
    return out


def _first(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)


def term_rows(items: DataFrame) -> DataFrame:
    """Rows of the terms table; `term` stands in for a missing canonical term."""
    full = with_added_columns(items, "canonical_term STRING, term STRING, zh_name STRING, en_name STRING, aliases ARRAY<STRING>, notes STRING, topic STRING")
    return full.select(_first("canonical_term", "term").alias("canonical_term"), "zh_name", "en_name", _listed("aliases"), "notes", "topic")


def symbol_rows(items: DataFrame) -> DataFrame:
    """Rows of the symbols table; `symbol` stands in for a missing canonical symbol."""
    full = with_added_columns(items, "canonical_symbol STRING, symbol STRING, latex STRING, meaning STRING, unit STRING, notes STRING, avoid_confusion_with ARRAY<STRING>")
    return full.select(_first("canonical_symbol", "symbol").alias("canonical_symbol"), "latex", "meaning", "unit", "notes", _listed("avoid_confusion_with"))


def unit_rows(items: DataFrame) -> DataFrame:
    """Rows of the units table; `unit` and `notes` stand in for missing canonical units and warnings."""
    full = with_added_columns(items, "quantity STRING, canonical_units STRING, unit STRING, aliases ARRAY<STRING>, warning_notes STRING, notes STRING")
    return full.select("quantity", _first("canonical_units", "unit").alias("canonical_units"), _listed("aliases"), _first("warning_notes", "notes").alias("warning_notes"))


def citation_rows(citations: DataFrame) -> DataFrame:
    """Rows of the citations table before chunks have numbers: documented and of full confidence unless they say otherwise."""
    full = with_added_columns(citations, "answer_id STRING, evidence_type STRING, confidence DOUBLE, chunk_id STRING, doc_id STRING, pages ARRAY<INT>")
    meta = F.struct(F.col("chunk_id").alias("logical_chunk_id"), F.col("doc_id").alias("logical_doc_id"), "pages")
    kind, sure = F.coalesce("evidence_type", F.lit("documented")), F.coalesce("confidence", F.lit(1.0))
    return full.select("answer_id", F.lit(None).cast("long").alias("chunk_id"), kind.alias("evidence_type"), sure.alias("confidence"), meta.alias("meta"))


def qa_log_rows(answers: DataFrame) -> DataFrame:
    """Rows of the log table: chunk references stay logical until a writer knows their numbers."""
    ddl = ", ".join((schemas.TABLES["qa_logs"], schemas.ADDED["qa_logs"], "chunk_refs ARRAY<STRING>"))
    full = with_added_columns(answers, ddl)
    none = F.array().cast("array<long>").alias("retrieved_chunks")
    names = ("final_verdict", "status", "citations", "latency_ms", "token_cost", "supervisor_invocations")
    return full.select("query", "intent", _listed("chosen_skills"), none, *names, F.struct(_listed("chunk_refs").alias("logical_retrieved_chunk_ids")).alias("meta"))

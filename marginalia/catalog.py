"""Registry of the queries of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans import claim_queries, corpus_queries, document_queries, ingest_queries, relational_queries, report_queries, retrieval_queries, store_queries, text_queries

MODULES = (text_queries, retrieval_queries, document_queries, claim_queries, store_queries, relational_queries, report_queries, ingest_queries, corpus_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rrf_fusion"](spark, sf_dir)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}

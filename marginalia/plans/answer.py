"""Answers to many questions in one plan: scope, retrieval, fusion by intent, evidence, claims, support gate, rendering."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import question, text
from marginalia.session import attach, written
from marginalia.operators import claims, evidence, retrieval


def fused_hits(questions: DataFrame, chunks: DataFrame, k: int = 10, lane: int = 50) -> DataFrame:
    """Hits of every question: weighted fusion for standard lookups, reciprocal ranks for the rest.

    The lexical lane sees the question with its aliases, the dense lane as it was asked. Garbled
    chunks go before the cut.
    """
    readable = chunks.filter((F.trim("body") != "") & ~text.garbled(F.col("body")))
    wide = questions.select("query_id", question.expanded(F.col("query")).alias("query"))
    cut = retrieval.tokenized(readable)
    # Two small tables (`lane` hits a question) that both fusions read.
    lexical = written(retrieval.bm25(cut, wide, lane), "lexical")
    dense = written(retrieval.token_cosine(cut, questions.select("query_id", text.squeeze(F.col("query")).alias("query")), lane), "dense")
    # Priorities of the hits only, so that no body is read for them.
    shown = retrieval.bounded(lexical.select("chunk_id").union(dense.select("chunk_id")).distinct())
    kinds = chunks.select("chunk_id", "source_type").join(shown, "chunk_id", "left_semi")
    intents = questions.select("query_id", question.intent(F.col("query")).alias("intent"))
    plain = retrieval.reciprocal_rank_fusion(lexical, dense, kinds, k).join(intents, "query_id").filter("intent <> 'standard_lookup'")
    lookup = retrieval.weighted_fusion(lexical, dense, kinds, k).join(intents, "query_id").filter("intent = 'standard_lookup'")
    return retrieval.confidence(plain.unionByName(lookup))


def relevant(sentences: DataFrame, questions: DataFrame) -> DataFrame:
    """Sentences of the question's focus, then scope statements for scope questions, where there are any; outcomes only for outcome questions."""
    named = sentences.join(questions.select("query_id", "query", question.focus(F.col("query")).alias("focus")), "query_id")
    sentence, query = F.col("sentence"), F.col("query")
    scope = question.has_any(query, question.STANDARD_MARKERS) & question.has_any(query, question.SCOPE_MARKERS)
    wanted = [
        (F.col("focus").isNotNull(), F.array_contains(question.detected(sentence, question.FAMILIES), F.col("focus")), False),
        (scope, claims.is_scope_claim(sentence), False),
        (claims.is_outcome_question(query), claims.is_outcome_claim(sentence), True),
    ]
    return claims.narrowed(named, wanted).drop("query", "focus")


def answers(questions: DataFrame, chunks: DataFrame, k: int = 10, limit: int = 4, gate: bool = False) -> DataFrame:
    """One row a question: status, intent, answer with cited chunks, number of claims.

    status: out_of_scope (with gate), insufficient without hits or claims, blocked where a claim
    is not supported, else ok.
    """
    asked = questions.filter(question.in_scope(F.col("query"))) if gate else questions
    found = written(fused_hits(asked, chunks, k), "hits")
    # A few rows a question go to the texts, which stay where they are.
    rows = written(chunks.select("chunk_id", "body").join(retrieval.bounded(found), "chunk_id"), "bodies")
    tokens = text.evidence_tokens(F.col("body"))
    if {"doc_id", "chunk_index"} <= set(chunks.columns):
        # Chunks of whole documents: neighbours that run on from a hit stand as evidence too.
        corpus = chunks.select("chunk_id", "doc_id", "chunk_index", F.col("body").alias("text"))
        candidates = evidence.with_neighbors(rows.select("query_id", "chunk_id", "rank"), corpus)
    else:
        candidates = rows.select("query_id", "chunk_id", F.col("body").alias("text"), tokens.alias("tokens"), "rank")
    picked = written(evidence.select_evidence(candidates).select("query_id", "chunk_id", "pick"), "picked")
    bodies = written(chunks.select("chunk_id", "body").join(retrieval.bounded(picked), "chunk_id"), "evidence")
    seen = bodies.join(found.select("query_id", "chunk_id", "confidence"), ["query_id", "chunk_id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    lines = F.filter(F.transform(F.split("body", "\n"), text.squeeze), lambda x: x != "")
    sentences = seen.select("query_id", "chunk_id", "confidence", "pick", F.posexplode(lines).alias("i", "sentence")).withColumn("order", F.struct("pick", "i"))
    sentences = relevant(sentences, asked)
    places = seen.select("query_id", "pick", "chunk_id")
    best = claims.rank_sentences(sentences, asked, limit).withColumn("pick", F.col("order.pick")).join(places, ["query_id", "pick"])
    cited = best.select(F.col("query_id").alias("answer_id"), F.col("rank").alias("claim_ix"), F.col("sentence").alias("claim"), "chunk_id")
    visible = seen.select(F.col("query_id").alias("answer_id"), "chunk_id", F.col("body").alias("text"))
    judged = claims.support_gate(cited, visible, strict=False)
    line = F.format_string("%d. %s (evidence: %s)", "claim_ix", "claim", F.col("chunk_id").cast("string"))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_ix", line.alias("line")))), lambda x: x["line"]), "\n")
    rendered = judged.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_claims"), F.max("blocked").alias("blocked"), text_of.alias("answer"))
    joined = questions.join(rendered, questions["query_id"] == rendered["answer_id"], "left")
    status = F.when(F.lit(gate) & ~question.in_scope(F.col("query")), "out_of_scope").when(F.col("answer").isNull(), "insufficient").when(F.col("blocked"), "blocked").otherwise("ok")
    return joined.select(
        "query_id",
        status.alias("status"),
        question.intent(F.col("query")).alias("intent"),
        F.when(status == "ok", F.col("answer")).alias("answer"),
        F.coalesce("n_claims", F.lit(0)).alias("n_claims"),
    )


def main(argv: list[str] | None = None) -> int:
    """Command line: ask a question of a Parquet table (chunk_id, body, source_type). 0: answered, 1: not, 2: wrong use."""
    parser = argparse.ArgumentParser(prog="python -m marginalia.plans.answer")
    parser.add_argument("chunks", help="Parquet folder")
    parser.add_argument("question")
    parser.add_argument("--scope-gate", action="store_true")
    args = parser.parse_args(argv)
    if not args.question.strip():
        return 2
    spark = attach(SparkSession.builder.getOrCreate())
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(args.question).alias("query"))
    row = answers(asked, spark.read.parquet(args.chunks), gate=args.scope_gate).first()
    print(row.answer or row.status)
    return 0 if row.status == "ok" else 1


if __name__ == "__main__":
    sys.exit(main())

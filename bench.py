"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from marginalia import catalog  # noqa: E402
from marginalia.session import build_session  # noqa: E402

HEADLINE = (
    "tokenize_tf",
    "token_estimate",
    "bm25_topk",
    "token_feature_cosine",
    "rrf_fusion",
    "vector_cosine_topk",
    "chunk_pack",
    "section_spans",
    "repeated_edge_lines",
    "claim_rank",
    "claim_support_gate",
    "recall_at_k",
    "threshold_sweep",
    "rate_limit_log",
    "redact_log",
    "corpus_profile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(cpus, int(cpus), **{"spark.ui.showConsoleProgress": "false"})
    queries, took = catalog.queries(), {}
    queries["corpus_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executor threads
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

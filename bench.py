"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from docloom.bindings import load_catalog
from docloom.session import build_session

HEADLINE = [
    "vector_search", "lexical_search", "postings", "embed_chunks", "chunk_sections", "text_duplicate_flags",
    "duplicate_groups", "content_dedup", "match_terms", "match_terms_by_words", "annotations", "gap_mining", "quoted_mining",
    "refinement_pairs", "tenant_overview", "user_engagement", "weekly_activity", "transcript", "document_report", "golden_scores",
    "golden_drops", "amendment_chain", "resolution_chain", "chain_candidates", "reconcile_pairs", "link_versions", "feedback_queries",
    "reference_binding", "cache_lookup", "ingest_chunks", "stream_weekly_activity", "hybrid_retrieve",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("docloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_catalog()
    names = sys.argv[1:] or HEADLINE
    names = list(queries) if names == ["all"] else names
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the JVM's readers before timing
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if sys.argv[1:]:
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

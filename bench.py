"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "s02_source_profile", "s12_chunk_status", "m02_fixed_chunks", "m01_recursive_chunks", "s16_embedding_slot",
    "f05_search_tokens", "w03_sentence_windows", "j09_t01_nearest", "m04_a14_t02_lexical_candidates",
    "m05_t04_hybrid_retrieval", "m12_t06_grounded_answers", "p01_bad_extraction", "a04_running_headers",
    "f31_section_pages", "m20_policy_documents", "m20_a13_policy_decisions", "w14_j19_w13_selected_history",
    "p12_m28_truncation_audit", "j17_f48_similar_questions", "m15_m18_j15_graded_answers", "j07_document_cascade",
    "a11_latest_attempts", "r03_streamed_throughput", "r04_assembled_answers",
]


def main() -> None:
    from checks import registry
    from foliant.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = sys.argv[1:] or HEADLINES
    spent = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
        print(name, spent[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

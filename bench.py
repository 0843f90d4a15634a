"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from answerlake.catalog.registry import all_entries  # noqa: E402
from answerlake.session import Tables, get_session  # noqa: E402

HEADLINE = (
    "daily_trends", "conversation_rollup", "ledger_summary", "apply_outcomes", "payment_states",
    "chunks", "postings", "bm25_top_k", "hybrid_search", "composed_answers", "evaluated_answers",
    "groundedness", "style_features", "tf_idf_weights", "masked_texts", "imported_messages", "retention_sweep",
    "rate_limit", "session_memory", "hashed_embedding", "corpus_fingerprint", "stratified_split",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", int(cpus))
    entries, tables = all_entries(), Tables(spark, path)
    entries["label_distribution"].build(tables).collect()  # start the session's workers
    times = {}
    for name in names:
        start = time.perf_counter()
        entries[name].build(tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", path)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()

"""Headline queries at one data scale; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cardloom.registry import QUERIES  # noqa: E402
from cardloom.session import local_session  # noqa: E402

HEADLINE = [
    "collection_browse",
    "catalog_search_topk",
    "facet_counts",
    "collection_upsert",
    "deck_sizes",
    "owned_missing_split",
    "addable_cards",
    "role_columns",
    "deck_validate",
    "card_cooccurrence",
    "edit_log_replay",
    "deck_upsert_lww",
    "deck_generate",
    "vector_topk",
    "candidate_mix",
    "knowledge_docs",
    "response_check",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "cardloom-bench")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM paths
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline queries, one run each", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()

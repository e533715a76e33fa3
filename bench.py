"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palaver.plans import catalog  # noqa: E402
from palaver.session import local_session  # noqa: E402

HEADLINE = [
    "R12_hybrid_search",
    "R05_bm25_rank",
    "J14_dense_scan",
    "D05_retriever_parameters",
    "A39_recall_overall",
    "A44_threshold_sweep",
    "J01_reply_chain_topic",
    "J04_link_enrich",
    "R01_chunk_text",
    "R03_web_chunks",
    "R04_chat_chunks",
    "R18_link_frontier",
    "F03_lang_ratio",
    "F11_strip_html",
    "A13_word_frequency",
    "A35_health_summary",
    "A36_user_stats",
    "J09_feedback_per_turn",
    "J19_pending_report_asof",
    "J20_history_asof",
    "W08_streaks",
    "R19_badges",
    "X01_cooldown_filter",
    "X02_feedback_toggle",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    queries = catalog.queries()
    wanted = sys.argv[1:] or [q for q in HEADLINE if q in queries]
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()

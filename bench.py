"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "t1_normalize_text", "t9_token_set", "t11_unique_lines", "c2_keyword_score_documents", "c8_classify_text", "c9_classify_frame", "c16_confidence",
    "f2_dense_window_sample", "f6_sample_frames", "k7_top_k_per_group", "k8_gap_groups", "k11_select_transition", "k12_select_bigwin",
    "k15_basegame_pool", "k17_greedy_dedup", "k18_jaccard", "k21_farthest_first_kmeans", "p2_is_paytable_page", "p3_select_pages", "p7_suppress_boxes",
    "p19_near_dup_groups", "p22_round_robin", "r4_apply_corrections", "a2_infer_title", "a9_motion_map", "io7_even_sample", "io21_html_asset_refs", "st2_event_groups",
]


def main() -> None:
    from framelens.plans import catalog
    from framelens.session import build_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        # small local inputs: keep shuffle partitions apart so that all cores work
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds over the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

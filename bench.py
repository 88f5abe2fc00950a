"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS (default 8) the threads.
"""

from __future__ import annotations

import json
import os
import time

from cuesheet.plans import PLANS
from cuesheet.session import build_session

HEADLINE = (
    "w1_topic_boundaries", "f1_cosine_distance", "j15_boundary_membership", "w2_near_duplicate_runs",
    "a1_collapse_runs", "w3_time_even_cut", "w4_coverage_repair", "w5_downsample",
    "w5_downsample_with_section", "g1_scene_samples", "u6_missing_deciles", "j2_best_overlap",
    "j3_containing_section", "j4_topic_alignment", "j5_nearest_frame", "j6_frames_in_windows",
    "j8_midpoint_sections", "j9_attach_figures", "p4_frame_content", "p5_gate_frames", "p6_crop_gate",
    "l2_strongest_boxes", "a3_failure_families", "a12_job_state", "a10_type_scores", "a11_pick_type",
    "a8_bundle_items", "g5_body_pages", "g6_recipe_outlines", "g8_figure_slides", "v4_deck_verdicts",
    "v7_manifest_figures", "r1_routing_rows", "r3_salvage_truncated", "r4_overgenerated",
    "a20_common_and_distinctive", "k1_upsert_decks", "f13_subject_text",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
        },
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

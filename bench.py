"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

from loometry.plans import catalog
from loometry.session import local_session

HEADLINE = [
    # usage reports
    "a1_overview", "a2_media_per_day", "a3_top_workspaces", "a4_active_roles", "a5_generation_health",
    "a6_monthly_active_users",
    # gallery
    "u1_unified_base", "j1_unified_view", "j2_item_tags", "f6_multi_field_search", "f7_has_all_tags", "l1_gallery_page",
    "s18_download_manifest", "w17_time_buckets",
    # sheets
    "s1_read_sheet_csv", "s5_coerce_numeric",
    # localization
    "s12_glossary_from_grid", "s13_segments_from_grid", "s14_export_grid", "j9_glossary_containment",
    "j16_review_overview", "case_drift_flag",
    # runs and lineage
    "j10_parent_links", "j11_asset_links", "j13_resolve_inputs", "j17_media_of_runs", "m10_batch_args", "w8_clip_gaps",
    # table changes
    "m1_soft_delete", "m5_insert_ignore", "m8_assign_tags", "m9_bulk_copy", "w7_resolve_uploads",
    # research text
    "w12_list_items", "w15_merge_findings",
    # SQL families
    "q4_asof_join", "q6_aggregates", "q7_quantiles", "q8_window_functions", "q14_unnest",
    # streams
    "st2_stuck_jobs", "st3_media_per_day",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    # One pass over the tables and one untimed query: file caches and the JVM are
    # warm for everyone.
    for table in ("orders", "lineitem", "events", "customer", "part", "documents", "conversations"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.format("noop").mode("overwrite").save()
    run(catalog.QUERIES["j1_unified_view"](spark, sf_dir))
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        run(catalog.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries, timed one after the other; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from regionloom import catalog
from regionloom.session import local_session

HEADLINE = [
    "a01_merge", "a05_count_matrix", "a06_pool_replicates", "a09_coverage_summary", "o01_subtract", "o02_complement",
    "j01_overlap_semi", "j02_overlap_pairs", "j06_count_hits", "j07_k_nearest", "j08_nearest_first", "j13_reconcile_union",
    "j30_regions_to_genes", "j33_promoter_table", "j48_region_summary", "a12_ternary_code", "a15_histone_overlaps",
    "a21_profile_summary", "a27_cluster_stats", "a32_quantile_normalise", "a42_size_factors", "a52_dose_response",
    "a58_area_under_curve", "a63_signed_rank", "a67_enrichment_score", "a68_benjamini_hochberg", "p12_row_zscore",
    "p34_percentile_clip", "w10_sequential_ids", "a60_average_signal",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # a full evaluation of every column, without moving the rows to the driver
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

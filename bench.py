"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera.bindings import all_queries
from tessera.session import ensure_checkpoint_dir, local_session

HEADLINE = (
    "flagship_split_balance",
    "s6_manifest_discovery",
    "s11_waveform_qc",
    "s14_window_plan",
    "p14_exclusion_waterfall",
    "p24_vocabulary_encoding",
    "j3_membership_status",
    "j7_matched_pairs",
    "j9_strict_negative_counts",
    "j15_once_per_distinct",
    "a5_profile_diversity",
    "a8_recording_totals",
    "a10_exact_quantiles_by_range",
    "a16_balance_summary",
    "a17_removal_objectives",
    "a22_pooled_vectors",
    "w1_large_split_counts",
    "w5_derangement_global",
    "w9_keep_one_owner",
    "m1_auroc_large_cells",
    "m4_calibration_slope",
    "m8_macro_auroc",
    "m14_absolute_results",
    "b2_hierarchical_auroc_interval",
    "b6_patient_win_interval",
    "r2_cosine_ranks",
    "r10_linear_cka",
    "k4_content_digest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    queries = all_queries()
    # session warm-up, outside the timed part
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

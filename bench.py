"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from barcloud.plans import catalog, reference_catalog  # noqa: F401 (registers its queries)
from barcloud.session import local_session

HEADLINE = [
    "barcode_count", "quality_key_count", "read_totals", "barcode_prior", "barcode_correct_h1", "barcode_correct_h2",
    "bucket_assign_cumulative", "bucket_route", "trim_and_format", "haplotag_count", "alignment_score", "candidate_filter",
    "cloud_build", "cloud_summary", "softmax_init", "em_full", "best_alignment", "duplicate_mark", "sam_lines",
    "density_bins", "barcode_runs", "session_clouds_events",
    # the plans for heavy keys, large whitelists and colliding clouds
    "barcode_correct_h1_shuffle", "cloud_build_spread", "em_full_spread", "em_full_spread_reads", "duplicate_mark_spread",
    "density_anneal", "best_alignment_density", "haplotag_route",
    # reference sequences and components
    "fasta_tiles", "seed_chains", "base_alignments", "mate_rescue", "cloud_components",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("barcloud-bench", cores=cpus)
    catalog.lens.candidates(spark, sf_dir).limit(1).collect()  # start the JVM's scan path once
    seconds = {}
    for name in names:
        started = time.perf_counter()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()

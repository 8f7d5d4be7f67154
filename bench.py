"""Headline queries: seconds per query on one JSON line."""

from __future__ import annotations

import json
import os
import time

from grantloom.plans.registry import REGISTRY
from grantloom.session import build_session

HEADLINE = (
    "temporal_trends_comprehensive",
    "ic_cards_comprehensive",
    "ic_temporal_trends",
    "ic_cards_complete",
    "pi_cards_cleaned_names",
    "pi_institutional_history",
    "pi_cards_complete",
    "institution_cards_comprehensive",
    "institution_temporal_trends",
    "institution_cards_complete",
    "portfolio_by_agency",
    "sample_proportional_strata",
    "sample_equal_eras",
    "grant_text_by_year",
    "merged_cards_existing_first",
    "portfolio_cluster_summary",
    "assignments_by_neighbors",
    "cluster_summary",
    "cluster_title_labels",
    "document_term_weights",
    "validate_projects_by_year",
    "slice_totals",
    "vector_separation",
    "vector_k_means",
    "density_topics",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{root}/lineitem.parquet").count()  # starts the executors
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    seconds = {}
    for name in chosen:
        start = time.time()
        REGISTRY[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(root.rstrip("/")),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

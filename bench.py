"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from talentlake.catalog import load  # noqa: E402
from talentlake.session import local_session  # noqa: E402

HEADLINE = [
    "t01_normalize_text", "t06_clean_text", "t13_richness", "k06_match_skills_exact_documents", "k08_extract_skills",
    "k10_tech_skills", "j12_top_k_similar", "m02_weighted_cosine", "m16_rank_all", "m16_rank_top_10", "f03_tfidf_transform",
    "f07_rank_by_text", "v02_roc_auc", "v04_best_f1_threshold", "q16_dedupe_candidates", "e09a_label_sections",
    "e26_build_profiles", "r13_export_rows", "r17_tag_intents", "u01_upsert_profiles", "x02_stream_latest",
]


def run(spark, query, folder: str) -> float:
    started = time.time()
    query.run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.time() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", partitions=cores)
    registry = load()
    small = "/root/testdata/sf0.001"
    run(spark, registry["t01_normalize_text"], small if Path(small).exists() else folder)  # starts the JVM paths
    times = {name: round(run(spark, registry[name], folder), 3) for name in HEADLINE}
    cvs = spark.read.parquet(f"{folder}/customer.parquet").count()
    per_cv = times["e26_build_profiles"] / cvs
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cores),
        "extraction": {"cvs": cvs, "ms_per_cv": round(per_cv * 1000, 3), "cvs_per_minute": round(60 / per_cv)},
    }))


if __name__ == "__main__":
    main()

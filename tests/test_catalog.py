"""Registered queries against their SQL on the smallest data; all of them with ALL_QUERIES=1 in the environment."""

import os

import pytest
from compare import compare, duck, fetch

from talentlake.catalog import load

FOLDER = "/root/testdata/sf0.001"
# A spread over all families; ``python tests/compare.py`` checks every query at a larger scale.
SAMPLE = [
    "t01_normalize_text", "t07_fold", "t11_candidate_and_job_text", "t15_stitch_pages", "k02_normalize_skill", "k06_match_skills_exact", "k12_merge_skills",
    "e03_person_name", "e10_job_titles", "e12_education", "e24_merge_bio", "q04_clean_list", "q16_dedupe_candidates", "q17_merge_near_duplicates",
    "j05_missing_skills", "j12_top_k_similar", "m02_weighted_cosine", "m13_fallback_top", "m16_rank_all", "m16_rank_top_10", "m24_explanation_round_trip",
    "d05_explain", "f02_tfidf_fit", "f07_rank_by_text", "f14_stratified_split", "v02_roc_auc", "v07_calibrate", "r12_adjust_weights", "r19_resolve_candidate",
    "u01_upsert_profiles", "s03_read_pairs", "s11_write_match_results", "x02_stream_latest", "x03_stream_dedupe",
]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


CHECKED = [name for name, q in load().items() if q.sql is not None]


@pytest.mark.parametrize("name", CHECKED if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_matches_sql(spark, con, name):
    q = load()[name]
    assert compare(q.run(spark, FOLDER).toArrow(), fetch(con, q.sql)) is None


def test_entry_points():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and entry.FLAGSHIP in names and len(names) > 180


def test_entry_points_without_the_optional_package():
    import subprocess
    import sys
    from pathlib import Path

    code = ("import sys; sys.modules['talentlake.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "assert len(e.queries()) > 180 and not any(k.startswith('op') or k == 'pipeline' for k in {**e.queries(), **e.oracle_sql()})")
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)

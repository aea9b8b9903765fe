"""Queries next to their SQL on the smallest tables; compare.py runs all of them at any scale."""

import os

import pytest

import __spark_entry__ as entry_points
import compare

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "s1_read_news", "s9_fetch_plan", "p1_prices_wide_to_long", "p2_clean_title", "p4_clean_title_legacy", "p8_parse_published",
    "d1_dedup_news", "d4_latest_n_per_symbol", "j1_join_news_prices", "j2_join_articles_labels", "j4_dashboard", "a7_confusion_matrix",
    "a9_roc_auc", "a10_roc_curve", "w1_label_open_direction", "w3_sliding_sequences", "t6_tfidf_daily_dataset", "e1_cosine_intra_inter",
    "e3_l2_intra_inter", "e6_silhouette", "e8_knn_scaled", "e9_score_card_unprobed", "p12_vector_columns", "s3_read_dataset", "x1_news_stream",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare.compare(spark, con, FOLDER, name)
    assert ok, note


@pytest.mark.parametrize("name", ["m2_pca_reduce", "d7_top_k_features", "m8_cross_validate", "m11_score_batch", "x5_daily_scoring_job"])
def test_model_queries_stand_symbols_without_enough_rows(spark, name):
    assert entry_points.queries()[name](spark, FOLDER).count() == (5 if name == "x5_daily_scoring_job" else 0)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_plans_push_down_and_limit_early(spark):
    q = entry_points.queries()
    plan = lambda name: q[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan("d4_latest_n_per_symbol")
    assert "partial_min" in plan("d1_dedup_news")
    slice_plan = plan("j1_join_news_prices")
    assert "CartesianProduct" not in slice_plan and "NestedLoop" not in slice_plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in slice_plan

"""A sample of registered queries against their SQL; tools/check_oracle.py runs all of them."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "drift_scores", "drift_temporal_tied", "profile_overview", "profile_histogram", "filter_expr_not",
    "confusion_matrix", "arena_metrics", "stratified_split", "knn_all_cosine", "tfidf_weights",
    "quality_curves", "shap_exact", "counterfactual_flip", "annotation_state", "stream_class_counts",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["feature", "ks_statistic", "ks_pvalue", "psi", "drift"] and df.count() == 4


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"create view {file[:-8]} as select * from read_parquet('{FOLDER}/{file}')")
    df = entry.queries()[name](spark, FOLDER)
    result = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())

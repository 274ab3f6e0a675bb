"""Readers, named tables, sinks and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from mldiag.operators import shap, transforms
from mldiag.operators.annotate import current_labels
from mldiag.operators.profile import normalise_nulls as clean_nulls
from mldiag.plans.annotate_queries import _LOG, annotation_log
from mldiag.plans.explain_queries import _LONG
from mldiag.plans.model_queries import (
    LINE_FEATURES,
    LINE_SQL,
    N_DIMS,
    line_rows,
    line_scorer,
    scored_vectors,
)
from mldiag.plans.registry import query, table
from mldiag.session import shared_folder
from mldiag.sources import catalog, readers, sinks


_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("read_csv", _CUSTOMERS)
def read_csv(spark, folder):
    path = shared_folder(spark, "customer") + ".csv"
    table(spark, folder, "customer").write.option("header", True).csv(path)
    return readers.read_table(spark, path, _SCHEMA)


@query("read_tsv", _CUSTOMERS)
def read_tsv(spark, folder):
    path = shared_folder(spark, "customer") + ".TSV"
    table(spark, folder, "customer").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_table(spark, path, _SCHEMA)


@query("read_json_lines", _CUSTOMERS)
def read_json_lines(spark, folder):
    path = shared_folder(spark, "customer") + ".jsonl"
    table(spark, folder, "customer").write.json(path)
    return readers.read_table(spark, path, _SCHEMA)


@query("read_json", _CUSTOMERS)
def read_json(spark, folder):
    """Array documents of up to 500 customers."""
    path = shared_folder(spark, "customer") + ".json"
    rows = table(spark, folder, "customer")
    documents = rows.groupBy(F.expr("c_custkey div 500").alias("document")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")
    )
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_table(spark, path, _SCHEMA)


@query("read_parquet_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def read_parquet_columns(spark, folder):
    return readers.read_table(spark, f"{folder}/orders.parquet?v=1", columns=["o_orderkey", "o_totalprice"])


def _catalog(spark, folder):
    names = ["orders", "customer", "part"]
    return catalog.TableCatalog(spark, {n: f"{folder}/{n}.parquet" for n in names})


@query(
    "source_filter",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def source_filter(spark, folder):
    return _catalog(spark, folder).get(
        "orders", o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], unknown=1
    )


@query(
    "embedding_columns",
    "SELECT " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS dim_{i}" for i in range(64)) + " FROM embeddings",
)
def embedding_columns(spark, folder):
    rows = table(spark, folder, "embeddings")
    return catalog.embedding_catalog(spark, rows, "embedding", N_DIMS).get("embeddings")


@query(
    "normalise_nulls",
    "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS l_discount FROM lineitem",
)
def normalise_nulls(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_discount")).alias("l_discount"),
    )
    return clean_nulls(rows)


@query(
    "decode_target",
    "SELECT c_custkey, c_nationkey, n_name AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
)
def decode_target(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    names = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return transforms.decode_target(rows, "c_nationkey", names)


@query(
    "decode_target_list",
    """SELECT doc_id, quality, CASE quality WHEN 0 THEN 'poor' WHEN 1 THEN 'good' END AS label FROM labels""",
)
def decode_target_list(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "quality")
    return transforms.decode_target(rows, "quality", ["poor", "good"])


@query(
    "snapshot",
    _LOG
    + """ SELECT 'embeddings' AS dataset_name, count(*) AS n_samples, CAST(2 AS BIGINT) AS n_features, 'x,y' AS feature_columns,
'label' AS label_column, '' AS class_names, 'centroid' AS model_name, 'given' AS embedding_method, 'axes' AS reduction_method,
count(DISTINCT cluster) AS n_clusters, (SELECT count(*) FROM labels_) AS n_annotations, count(*) FILTER (label <> prediction) AS n_selected,
round(count(*) FILTER (label = prediction) / count(*), 6) AS accuracy, 'centroid' AS models_trained FROM scored""",
)
def snapshot(spark, folder):
    """Written as JSON and read back."""
    scored = scored_vectors(spark, folder)
    row = sinks.snapshot(
        scored,
        "embeddings",
        ["x", "y"],
        "label",
        "prediction",
        model_name="centroid",
        embedding_method="given",
        reduction_method="axes",
        cluster_col="cluster",
        annotations=current_labels(annotation_log(scored)),
        selected=scored.where(F.col("label") != F.col("prediction")),
        models_trained=["centroid"],
    )
    path = shared_folder(spark, "snapshot") + ".jsonl"
    sinks.write_snapshot(row, path)
    return readers.read_table(spark, path, row.schema)


def _stat_rows() -> str:
    rows = []
    for f in LINE_FEATURES:
        for s, e in (
            ("count", f"count({f})"), ("mean", f"avg({f})"), ("std", f"stddev_samp({f})"), ("min", f"min({f})"),
            ("p25", f"quantile_cont({f}, 0.25)"), ("p50", f"quantile_cont({f}, 0.5)"),
            ("p75", f"quantile_cont({f}, 0.75)"), ("max", f"max({f})"),
        ):
            rows.append(f"SELECT 'selection', '{f}.{s}', round(CAST({e} AS DOUBLE), 3) FROM sel")
    return " UNION ALL ".join(rows)


@query(
    "summary_rows",
    "WITH "
    + LINE_SQL
    + ","
    + _LONG
    + """, sel AS (SELECT * FROM line_scored WHERE label <> prediction),
d AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT label) AS DOUBLE) AS c,
  round(count(*) FILTER (label = prediction) / count(*), 6) AS a FROM line_scored),
top AS (SELECT feature, round(avg(abs(phi)), 6) AS v FROM long GROUP BY feature ORDER BY v DESC, feature LIMIT 5),
r(section, key, value) AS (SELECT 'dataset', 'samples', n FROM d UNION ALL SELECT 'dataset', 'features', 4.0 FROM d
  UNION ALL SELECT 'dataset', 'classes', c FROM d UNION ALL SELECT 'dataset', 'accuracy', a FROM d
  UNION ALL SELECT 'selection', 'selected', CAST(count(*) AS DOUBLE) FROM sel
  UNION ALL SELECT 'top_shap', feature, v FROM top UNION ALL """
    + _stat_rows()
    + ") SELECT section, key, value FROM r",
)
def summary_rows(spark, folder):
    scored = line_scorer().transform(line_rows(spark, folder))
    wrong = scored.where(F.col("label") != F.col("prediction"))
    long = shap.linear_shap(line_rows(spark, folder), "row_key", line_scorer())
    return sinks.analysis_summary(scored, LINE_FEATURES, "label", "prediction", wrong, long)


@query("labels_csv", _LOG + " SELECT row_id, label FROM labels_")
def labels_csv(spark, folder):
    path = shared_folder(spark, "labels") + ".csv"
    sinks.write_labels_csv(current_labels(annotation_log(scored_vectors(spark, folder))), path)
    return readers.read_table(spark, path, "row_id bigint, label string")


@query("labels_json", _LOG + " SELECT row_id, label FROM labels_")
def labels_json(spark, folder):
    path = shared_folder(spark, "labels") + ".jsonl"
    sinks.write_labels_json(current_labels(annotation_log(scored_vectors(spark, folder))), path)
    return readers.read_table(spark, path, "row_id bigint, label string")

"""Annotation queries over a log built from the scored embeddings.

The log: batch 1 labels the misread 3s, batch 2 the misread 5s, batch 3 relabels all misread rows of the
north-east quadrant and is undone, batch 4 labels the misread 7s.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mldiag.operators import annotate
from mldiag.plans.model_queries import scored_sql, scored_vectors
from mldiag.plans.registry import query
from mldiag.session import cut_lineage

_AT = "2024-01-01 00:00:00"
_LOG = "WITH " + scored_sql() + """,
wrong AS (SELECT * FROM scored WHERE label <> prediction),
assigned AS (
  SELECT 1 AS seq, 1 AS batch, vec_id AS row_id, 'three' AS label FROM wrong WHERE label = '3'
  UNION ALL SELECT 2, 2, vec_id, 'five' FROM wrong WHERE label = '5'
  UNION ALL SELECT 3, 3, vec_id, 'corner' FROM wrong WHERE cluster = 'NE'
  UNION ALL SELECT 5, 5, vec_id, 'seven' FROM wrong WHERE label = '7'),
ev AS (SELECT row_id, seq, label FROM assigned UNION ALL SELECT row_id, 4, NULL FROM assigned WHERE batch = 3),
last AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY seq DESC) AS rk FROM ev),
labels_ AS (SELECT row_id, label FROM last WHERE rk = 1 AND label IS NOT NULL),
ent AS (SELECT *, -list_sum(list_transform(probability, lambda p: least(1.0, greatest(1e-12, p)) * log2(least(1.0, greatest(1e-12, p))))) AS h
  FROM scored)"""


def _at(batch):
    """A minute after the other."""
    return F.lit(_AT).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(batch))


def annotation_log(scored):
    wrong = cut_lineage(scored.where(F.col("label") != F.col("prediction")))  # read by each action below
    log = annotate.assign_events(wrong.where("label = '3'"), "vec_id", "three", 1, _at(1))
    log = log.unionByName(annotate.assign_events(wrong.where("label = '5'"), "vec_id", "five", 2, _at(2)))
    log = log.unionByName(annotate.assign_events(wrong.where("cluster = 'NE'"), "vec_id", "corner", 3, _at(3)))
    log = log.unionByName(annotate.undo_event(log, 4, _at(4)))
    return log.unionByName(annotate.assign_events(wrong.where("label = '7'"), "vec_id", " seven ", 5, _at(5)))


def _state(spark, folder):
    scored = scored_vectors(spark, folder)
    return scored, annotate.current_labels(annotation_log(scored))


@query("annotation_state", _LOG + " SELECT row_id, label FROM labels_")
def annotation_state(spark, folder):
    return _state(spark, folder)[1]


@query(
    "annotation_history",
    _LOG
    + """, o AS (SELECT * FROM assigned WHERE batch <> 3)
SELECT CAST(row_number() OVER (ORDER BY batch) AS INTEGER) AS number,
  array_to_string(list(row_id ORDER BY row_id)[1:5], ',') AS first_ids, any_value(label) AS label, count(*) AS n,
  strftime(TIMESTAMP '"""
    + _AT
    + """' + INTERVAL 1 MINUTE * CAST(batch AS INTEGER), '%Y-%m-%d %H:%M:%S') AS at FROM o GROUP BY batch""",
)
def annotation_history(spark, folder):
    found = annotate.history(annotation_log(scored_vectors(spark, folder)))
    return found.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "uncertainty",
    _LOG
    + """ SELECT vec_id AS id, x, y, round(h, 6) AS entropy, coalesce(l.label, '') AS annotated
FROM ent LEFT JOIN labels_ l ON l.row_id = vec_id""",
)
def uncertainty(spark, folder):
    scored, labels = _state(spark, folder)
    return annotate.uncertainty(scored, "vec_id", labels)


@query(
    "suggest_queue",
    _LOG
    + """, todo AS (SELECT vec_id AS id, round(h, 6) AS entropy, label FROM ent
  WHERE vec_id NOT IN (SELECT row_id FROM labels_))
SELECT CAST(row_number() OVER (ORDER BY entropy DESC, id) AS INTEGER) AS rank, id, entropy,
  round(entropy / log2(10) * 100, 2) AS pct_of_max, label AS true_label FROM todo ORDER BY entropy DESC, id LIMIT 20""",
)
def suggest_queue(spark, folder):
    scored, labels = _state(spark, folder)
    return annotate.suggest(scored, "vec_id", labels)


@query(
    "annotation_progress",
    _LOG
    + """, j AS (SELECT h > 0.5 * log2(10) AS u, l.row_id IS NOT NULL AS done FROM ent LEFT JOIN labels_ l ON l.row_id = vec_id)
SELECT count(*) FILTER (done) AS labeled, count(*) AS total, count(*) FILTER (u) AS uncertain,
  count(*) FILTER (u AND done) AS labeled_uncertain,
  round(CASE WHEN count(*) FILTER (u) > 0 THEN count(*) FILTER (u AND done) * 5.0 / count(*) FILTER (u) ELSE 0.0 END, 6) AS est_gain_pct,
  CAST(floor(count(*) FILTER (done) * 100.0 / count(*)) AS BIGINT) AS progress_pct FROM j""",
)
def annotation_progress(spark, folder):
    scored, labels = _state(spark, folder)
    return annotate.progress(scored, "vec_id", labels)


@query(
    "annotation_export",
    _LOG
    + """ SELECT l.row_id AS "index", l.label, x AS emb_x, y AS emb_y, s.label AS original_label
FROM labels_ l LEFT JOIN scored s ON s.vec_id = l.row_id""",
)
def annotation_export(spark, folder):
    scored, labels = _state(spark, folder)
    return annotate.export_labels(labels, scored, "vec_id", "label")

"""Classifier evaluation, comparison and training queries.

Models with an exact SQL twin: nearest class centroids on `embeddings` (Euclidean as model A, cosine as
model B), and a logistic score with fixed weights on `lineitem`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mldiag.operators import compare, evaluate, scoring, train
from mldiag.plans.registry import query, table

N_DIMS = 64
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_WEIGHTS = [0.05, -0.00002, 3.0, -4.0]
LINE_BIAS = -0.2


def vectors(spark, folder):
    """Embeddings with text labels, two coordinates and a quadrant as cluster."""
    rows = table(spark, folder, "embeddings")
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    quadrant = F.concat(F.when(y >= 0, "N").otherwise("S"), F.when(x >= 0, "E").otherwise("W"))
    return rows.select(
        "vec_id",
        "embedding",
        F.col("label").cast("string").alias("label"),
        x.alias("x"),
        y.alias("y"),
        quadrant.alias("cluster"),
    )


def centroid_scorer(rows, metric="euclidean"):
    return scoring.CentroidScorer.fit(rows, "embedding", "label", N_DIMS, metric, digits=6)


def scored_vectors(spark, folder, metric="euclidean"):
    rows = vectors(spark, folder)
    return centroid_scorer(rows, metric).transform(rows)


def scored_sql(name: str = "scored", metric: str = "list_distance") -> str:
    """CTEs ending in (vec_id, label, x, y, cluster, probability, prediction)."""
    return f"""
cell_{name} AS (SELECT CAST(label AS VARCHAR) AS class, generate_subscripts(embedding, 1) AS i,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
mean_{name} AS (SELECT class, i, avg(v) AS m FROM cell_{name} GROUP BY class, i),
cen_{name} AS (SELECT class, list(m ORDER BY i) AS c FROM mean_{name} GROUP BY class),
dist_{name} AS (SELECT vec_id, class, {metric}(CAST(embedding AS DOUBLE[]), c) AS d FROM embeddings, cen_{name}),
prob_{name} AS (SELECT vec_id, class, d, round(exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id), 6) AS p
  FROM dist_{name}),
fold_{name} AS (SELECT vec_id, list(p ORDER BY class) AS probability, arg_min(class, d) AS prediction
  FROM prob_{name} GROUP BY vec_id),
{name} AS (SELECT e.vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(embedding[2] AS DOUBLE) AS y,
  (CASE WHEN embedding[2] >= 0 THEN 'N' ELSE 'S' END) || (CASE WHEN embedding[1] >= 0 THEN 'E' ELSE 'W' END) AS cluster,
  probability, prediction FROM embeddings e JOIN fold_{name} USING (vec_id))"""


def line_scorer():
    return scoring.LinearScorer(LINE_FEATURES, LINE_WEIGHTS, LINE_BIAS)


def line_rows(spark, folder):
    """Line items with a text id and the label "was returned"."""
    items = table(spark, folder, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    label = F.when(F.col("l_returnflag") == "R", "1").otherwise("0")
    return items.select(key.alias("row_key"), label.alias("label"), *LINE_FEATURES)


LINE_MARGIN = "(" + " + ".join(
    [str(LINE_BIAS)] + [f"CAST({w} AS DOUBLE) * {f}" for f, w in zip(LINE_FEATURES, LINE_WEIGHTS)]
) + ")"
LINE_KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
LINE_SQL = f"""
lines AS (SELECT {LINE_KEY} AS row_key, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS label,
  {LINE_MARGIN} AS margin, {', '.join(LINE_FEATURES)} FROM lineitem),
line_scored AS (SELECT *, 1.0 / (1.0 + exp(-margin)) AS p1,
  CASE WHEN 1.0 / (1.0 + exp(-margin)) > 1.0 - 1.0 / (1.0 + exp(-margin)) THEN '1' ELSE '0' END AS prediction
  FROM lines)"""

A = "WITH " + scored_sql()


def metrics_sql(source: str, prediction: str = "prediction") -> str:
    """CTE per_class (class, support, tp, precision, recall, f1)."""
    return f"""
classes AS (SELECT label AS class FROM {source} UNION SELECT {prediction} FROM {source}),
raw AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER ({prediction} = class) AS predicted,
  count(*) FILTER (label = class AND {prediction} = class) AS tp FROM classes, {source} GROUP BY class),
per_class AS (SELECT class, support, tp, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM raw)"""


@query("scored_rows", A + " SELECT vec_id, label, prediction, probability FROM scored")
def scored_rows(spark, folder):
    return scored_vectors(spark, folder).select("vec_id", "label", "prediction", "probability")


@query("class_list", A + " SELECT label AS class FROM scored UNION SELECT prediction FROM scored")
def class_list(spark, folder):
    return evaluate.class_list(scored_vectors(spark, folder))


@query(
    "confusion_matrix",
    A
    + """, classes AS (SELECT label AS class FROM scored UNION SELECT prediction FROM scored)
SELECT t.class AS "true", p.class AS predicted,
  (SELECT count(*) FROM scored WHERE label = t.class AND prediction = p.class) AS n
FROM classes t, classes p""",
)
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(scored_vectors(spark, folder))


@query(
    "confusion_pairs",
    A
    + """ SELECT label AS "true", prediction AS predicted, count(*) AS n FROM scored WHERE label <> prediction
GROUP BY ALL ORDER BY n DESC, label, prediction LIMIT 10""",
)
def confusion_pairs(spark, folder):
    return evaluate.confusion_pairs(scored_vectors(spark, folder))


@query(
    "confusion_cell",
    A
    + """ SELECT vec_id, label, prediction, 'misclassified' AS kind FROM scored
WHERE label = '3' AND prediction = '5'""",
)
def confusion_cell(spark, folder):
    cell = evaluate.confusion_cell(scored_vectors(spark, folder), "3", "5")
    return cell.select("vec_id", "label", "prediction", "kind")


@query(
    "accuracy",
    A
    + """ SELECT count(*) AS n, count(*) FILTER (label = prediction) AS correct,
round(count(*) FILTER (label = prediction) / count(*), 6) AS accuracy FROM scored""",
)
def accuracy(spark, folder):
    return evaluate.accuracy(scored_vectors(spark, folder))


@query(
    "class_metrics",
    A
    + ","
    + metrics_sql("scored")
    + """ SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM per_class""",
)
def class_metrics(spark, folder):
    return evaluate.class_metrics(scored_vectors(spark, folder))


@query(
    "metrics_weighted",
    A
    + ","
    + metrics_sql("scored")
    + """ SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(sum(support * precision) / sum(support), 6) AS precision,
  round(sum(support * recall) / sum(support), 6) AS recall,
  round(sum(support * f1) / sum(support), 6) AS f1 FROM per_class""",
)
def metrics_weighted(spark, folder):
    return evaluate.weighted_metrics(scored_vectors(spark, folder))


_BINARY = """
b AS (SELECT CAST(quality AS VARCHAR) AS label, CAST(1 - toxic AS VARCHAR) AS prediction FROM labels),
m AS (SELECT count(*) AS n, count(*) FILTER (label = prediction) AS ok,
  count(*) FILTER (label = '1' AND prediction = '1') AS tp, count(*) FILTER (label = '1') AS s,
  count(*) FILTER (prediction = '1') AS p FROM b)"""


@query(
    "metrics_binary",
    "WITH "
    + _BINARY
    + """ SELECT round(ok / n, 6) AS accuracy, round(tp / p, 6) AS precision, round(tp / s, 6) AS recall,
round(2 * tp / (s + p), 6) AS f1 FROM m""",
)
def metrics_binary(spark, folder):
    rows = table(spark, folder, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction")
    )
    return evaluate.binary_metrics(rows, "1")


_ROC = """
classes AS (SELECT unnest(['0', '1']) AS class),
sc AS (SELECT class, round(CASE WHEN class = '1' THEN p1 ELSE 1.0 - p1 END, 6) AS score,
  CAST(label = class AS INTEGER) AS hit FROM line_scored, classes),
cnt AS (SELECT class, score, sum(hit) AS pos, sum(1 - hit) AS neg FROM sc GROUP BY class, score),
cum AS (SELECT class, score, pos, neg, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(neg) OVER u - neg AS below,
  sum(pos) OVER (PARTITION BY class) AS np, sum(neg) OVER (PARTITION BY class) AS nn FROM cnt
  WINDOW d AS (PARTITION BY class ORDER BY score DESC), u AS (PARTITION BY class ORDER BY score))"""


def _rounded_line_scores(spark, folder):
    scored = line_scorer().transform(line_rows(spark, folder))
    return scored.withColumn(
        "probability", F.transform("probability", lambda p: F.round(p, 6))
    )


@query(
    "roc_points",
    "WITH "
    + LINE_SQL
    + ","
    + _ROC
    + """ SELECT class, score AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM cum
UNION ALL SELECT class, NULL, 0.0, 0.0 FROM classes""",
)
def roc_points(spark, folder):
    return evaluate.roc_points(_rounded_line_scores(spark, folder), ["0", "1"])


@query(
    "roc_auc",
    "WITH "
    + LINE_SQL
    + ","
    + _ROC
    + " SELECT class, round(sum(pos * (below + 0.5 * neg)) / max(np * nn), 6) AS auc FROM cum GROUP BY class",
)
def roc_auc(spark, folder):
    return evaluate.roc_auc(_rounded_line_scores(spark, folder), ["0", "1"])


@query(
    "roc_auc_multiclass",
    A
    + """, sc AS (SELECT CAST(i - 1 AS VARCHAR) AS class, probability[i] AS score, label = CAST(i - 1 AS VARCHAR) AS hit
  FROM scored, generate_series(1, 10) AS s(i)),
pairs AS (SELECT p.class, p.score AS ps, n.score AS ns FROM sc p JOIN sc n ON p.class = n.class AND p.hit AND NOT n.hit)
SELECT class, round(avg(CASE WHEN ps > ns THEN 1.0 WHEN ps = ns THEN 0.5 ELSE 0.0 END), 6) AS auc FROM pairs GROUP BY class""",
)
def roc_auc_multiclass(spark, folder):
    scored = scored_vectors(spark, folder)
    return evaluate.roc_auc(scored, [str(i) for i in range(10)])


@query(
    "hardest_samples",
    A
    + """, o AS (SELECT *, list_reverse_sort(probability) AS s FROM scored)
SELECT vec_id, label AS true_label, prediction AS predicted_label, round(s[1], 4) AS confidence,
  round(s[1] - s[2], 4) AS margin, label = prediction AS correct FROM o
ORDER BY margin, vec_id LIMIT 50""",
)
def hardest_samples(spark, folder):
    return evaluate.hardest_samples(scored_vectors(spark, folder), "vec_id", limit=50)


@query(
    "misclassification_status",
    A + " SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN label = prediction THEN 'Correct' ELSE 'Error' END AS status FROM scored",
)
def misclassification_status(spark, folder):
    rows = evaluate.status(scored_vectors(spark, folder))
    return rows.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "status")


@query(
    "error_by_cluster",
    A
    + """ SELECT cluster, count(*) AS total, count(*) FILTER (label <> prediction) AS errors,
round(count(*) FILTER (label <> prediction) / count(*), 4) AS error_rate FROM scored GROUP BY cluster""",
)
def error_by_cluster(spark, folder):
    return evaluate.error_rate_by_cluster(scored_vectors(spark, folder))


@query(
    "cluster_summary",
    A
    + """ SELECT cluster, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM scored), 2) AS pct,
round(count(*) FILTER (label = prediction) / count(*), 4) AS accuracy FROM scored GROUP BY cluster""",
)
def cluster_summary(spark, folder):
    return evaluate.cluster_summary(scored_vectors(spark, folder))


@query(
    "plot_frame",
    A
    + """ SELECT vec_id, x, y, label, prediction, round(list_max(probability), 6) AS confidence, cluster,
CAST(label <> prediction AS INTEGER) AS error FROM scored""",
)
def plot_frame(spark, folder):
    return evaluate.plot_frame(scored_vectors(spark, folder), "vec_id")


@query(
    "density_by_correctness",
    "WITH "
    + LINE_SQL
    + """, flagged AS (SELECT *, CASE WHEN label = prediction THEN 'Correct' ELSE 'Error' END AS side FROM line_scored),
long AS (SELECT 'l_quantity' AS feature, side, l_quantity AS value FROM flagged
  UNION ALL SELECT 'l_tax', side, l_tax FROM flagged),
sp AS (SELECT feature, side, count(*) AS total, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi
  FROM long GROUP BY feature, side),
st AS (SELECT *, sd * pow(total::DOUBLE, -0.2) AS h, (hi - lo) / 1024 AS w FROM sp),
bins AS (SELECT feature, side, least(1023, floor((value - lo) / w)) AS bin, count(*) AS n
  FROM long JOIN st USING (feature, side) GROUP BY ALL),
grid AS (SELECT *, lo + g * ((hi - lo) / 99) AS x FROM st, generate_series(0, 99) AS s(g))
SELECT feature, side, CAST(g AS INTEGER) AS grid, round(max(x), 6) AS x,
  round(sum(n * exp(-0.5 * pow((x - (lo + (bin + 0.5) * w)) / h, 2))) / max(total * h * sqrt(2.0 * pi())), 9) AS density
FROM grid JOIN bins USING (feature, side) GROUP BY feature, side, g""",
)
def density_by_correctness(spark, folder):
    scored = line_scorer().transform(line_rows(spark, folder))
    return evaluate.correctness_densities(scored, ["l_quantity", "l_tax"])


# -- selections: the user's pick is a confusion cell ------------------------------------------------
_SEL = A + ", sel AS (SELECT * FROM scored WHERE label = '3' AND prediction <> '3')"


def _selection(spark, folder):
    scored = scored_vectors(spark, folder)
    picked = scored.where((F.col("label") == "3") & (F.col("prediction") != "3"))
    return scored, evaluate.select_rows(scored, picked, "vec_id")


@query("selection_rows", _SEL + " SELECT vec_id, label, prediction FROM sel")
def selection_rows(spark, folder):
    return _selection(spark, folder)[1].select("vec_id", "label", "prediction")


@query(
    "selection_classes",
    _SEL + " SELECT cluster AS label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM sel), 1) AS pct FROM sel GROUP BY cluster",
)
def selection_classes(spark, folder):
    return evaluate.selection_classes(_selection(spark, folder)[1], "cluster")


@query(
    "selection_stats",
    _SEL
    + """, long AS (SELECT 'x' AS feature, x AS value FROM sel UNION ALL SELECT 'y', y FROM sel)
SELECT feature, count(*) AS count, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std,
  round(min(value), 3) AS min, round(quantile_cont(value, 0.25), 3) AS p25, round(quantile_cont(value, 0.5), 3) AS p50,
  round(quantile_cont(value, 0.75), 3) AS p75, round(max(value), 3) AS max FROM long GROUP BY feature""",
)
def selection_stats(spark, folder):
    return evaluate.selection_statistics(_selection(spark, folder)[1], ["x", "y"])


@query(
    "selection_detail",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM (SELECT *, concat(lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS k
  FROM lineitem) WHERE l_quantity > 49 ORDER BY k LIMIT 50""",
)
def selection_detail(spark, folder):
    items = table(spark, folder, "lineitem")
    parts = [F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_partkey", "l_suppkey", "l_linenumber"]
    key = F.concat_ws("-", *parts)
    picked = items.where("l_quantity > 49").withColumn("row_key", key)
    return evaluate.detail_table(picked, "row_key")


# -- two models ------------------------------------------------------------------------------------
_ARENA = "WITH " + scored_sql("a") + "," + scored_sql("b", "list_cosine_distance") + """,
both_ AS (SELECT a.vec_id, a.label, a.prediction AS pred_a, b.prediction AS pred_b FROM a JOIN b USING (vec_id)),
zoned AS (SELECT *, CASE WHEN label = pred_a AND label = pred_b THEN 'both_correct' WHEN label = pred_a THEN 'only_a_correct'
  WHEN label = pred_b THEN 'only_b_correct' ELSE 'both_wrong' END AS zone FROM both_)"""


def _arena(spark, folder):
    rows = vectors(spark, folder)
    a = centroid_scorer(rows).transform(rows).select("vec_id", "label", "prediction")
    b = centroid_scorer(rows, "cosine").transform(rows)
    return compare.join_predictions(a, b, "vec_id")


def _chained(spark, folder):
    """Both scorers over one scan."""
    rows = vectors(spark, folder)
    names = {"prediction": "pred_a", "probability": "probability_a"}
    first = centroid_scorer(rows).transform(rows).withColumnsRenamed(names)
    both = centroid_scorer(rows, "cosine").transform(first).withColumnRenamed("prediction", "pred_b")
    return both.select("vec_id", "label", "pred_a", "pred_b")


@query("agreement_zones", _ARENA + " SELECT vec_id, label, pred_a, pred_b, zone FROM zoned")
def agreement_zones(spark, folder):
    return compare.agreement_zones(_arena(spark, folder))


@query(
    "zone_summary",
    _ARENA
    + """ SELECT z AS zone, count(zone) AS n, round(count(zone) * 100.0 / (SELECT count(*) FROM zoned), 1) AS pct
FROM (SELECT unnest(['both_correct', 'both_wrong', 'only_a_correct', 'only_b_correct']) AS z)
LEFT JOIN zoned ON zone = z GROUP BY z""",
)
def zone_summary(spark, folder):
    return compare.zone_summary(compare.agreement_zones(_chained(spark, folder)))


@query(
    "complementarity",
    _ARENA
    + """, c AS (SELECT count(*) AS n, count(*) FILTER (label = pred_a) AS a, count(*) FILTER (label = pred_b) AS b,
  count(*) FILTER (label = pred_a OR label = pred_b) AS u FROM zoned)
SELECT round(u / n, 6) AS union_accuracy, round(greatest(a, b) / n, 6) AS best_single,
  round((u - greatest(a, b)) / n, 6) AS gain FROM c""",
)
def complementarity(spark, folder):
    return compare.complementarity(_chained(spark, folder))


def _metric_rows(name: str) -> str:
    return f"""SELECT unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric,
  unnest([round(sum(tp) / sum(support), 4), round(sum(support * precision) / sum(support), 4),
  round(sum(support * recall) / sum(support), 4), round(sum(support * f1) / sum(support), 4)]) AS {name} FROM"""


@query(
    "arena_metrics",
    _ARENA
    + f""", ma AS (WITH {metrics_sql("zoned", "pred_a")} {_metric_rows("model_a")} per_class),
mb AS (WITH {metrics_sql("zoned", "pred_b")} {_metric_rows("model_b")} per_class)
SELECT metric, model_a, model_b FROM ma JOIN mb USING (metric)""",
)
def arena_metrics(spark, folder):
    return compare.arena_metrics(_chained(spark, folder))


@query(
    "arena_metrics_binary",
    """
WITH b AS (SELECT CAST(quality AS VARCHAR) AS label, CAST(1 - toxic AS VARCHAR) AS pa, '1' AS pb FROM labels),
m AS (SELECT count(*) AS n, count(*) FILTER (label = '1') AS s,
  count(*) FILTER (label = pa) AS oka, count(*) FILTER (pa = '1') AS na, count(*) FILTER (label = '1' AND pa = '1') AS ta,
  count(*) FILTER (label = pb) AS okb, count(*) FILTER (pb = '1') AS nb, count(*) FILTER (label = '1' AND pb = '1') AS tb
  FROM b)
SELECT unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric,
  unnest([round(oka / n, 4), round(ta / na, 4), round(ta / s, 4), round(2 * ta / (s + na), 4)]) AS model_a,
  unnest([round(okb / n, 4), round(tb / nb, 4), round(tb / s, 4), round(2 * tb / (s + nb), 4)]) AS model_b FROM m""",
)
def arena_metrics_binary(spark, folder):
    rows = table(spark, folder, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred_a"), F.lit(1).alias("pred_b")
    )
    return compare.arena_metrics(rows, positive="1")


# -- training --------------------------------------------------------------------------------------
@query(
    "stratified_split",
    """
WITH k AS (SELECT vec_id, label, CAST('0x' || substr(md5(vec_id || ':42'), 1, 15) AS BIGINT) AS h FROM embeddings),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY h) AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM k)
SELECT vec_id, label, CASE WHEN rk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    return train.stratified_split(rows, "vec_id", "label", 0.2)


_BINARY = "CASE WHEN label >= 5 THEN 'high' ELSE 'low' END"


def _counts_sql(source: str, label: str) -> str:
    """Rows of a stratified split, and what the metrics of a useful model must show."""
    return f"""
WITH k AS (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY 1)
SELECT CAST(sum(n) - sum(round(n * 0.2)) AS BIGINT) AS n_train, CAST(sum(round(n * 0.2)) AS BIGINT) AS n_test,
  true AS learnt, true AS in_range FROM k"""


def _checked(fitted, least):
    """Counts, whether the model has learnt its training rows, and whether both measures are shares."""
    own = fitted.scored.where("split = 'train'").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")))
    ranged = F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)
    return fitted.metrics.select("n_train", "n_test", (own.scalar() >= least).alias("learnt"), ranged.alias("in_range"))


def embedded_features(spark, folder, n=N_DIMS, binary=False):
    """Embeddings as n feature columns, some of them missing, with a text id."""
    label = F.when(F.col("label") >= 5, "high").otherwise("low") if binary else F.col("label").cast("string")
    rows = table(spark, folder, "embeddings")
    values = [
        F.when(F.col("vec_id") % 17 != i % 17, F.col("embedding")[i].cast("double")).alias(f"f{i}") for i in range(n)
    ]
    key = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    return rows.select(key.alias("key"), label.alias("label"), *values), [f"f{i}" for i in range(n)]


def _train(spark, folder, model, binary=False, **options):
    rows, features = embedded_features(spark, folder, binary=binary)
    return train.train(rows, "key", features, "label", model, **options)


@query("train_logistic", _counts_sql("embeddings", "label"))
def train_logistic(spark, folder):
    return _checked(_train(spark, folder, "LogisticRegression"), 0.3)


@query("train_forest", _counts_sql("embeddings", "label"))
def train_forest(spark, folder):
    return _checked(_train(spark, folder, "RandomForest"), 0.9)


@query("train_boosting", _counts_sql("embeddings", _BINARY))
def train_boosting(spark, folder):
    return _checked(_train(spark, folder, "GradientBoosting", binary=True), 0.9)


@query("train_svm", _counts_sql("embeddings", _BINARY))
def train_svm(spark, folder):
    return _checked(_train(spark, folder, "SVM", binary=True), 0.6)


@query(
    "train_knn",
    """
WITH k AS (SELECT 'v' || vec_id AS key, CAST(label AS VARCHAR) AS label, vec_id, embedding,
  CAST('0x' || substr(md5('v' || vec_id || ':42'), 1, 15) AS BIGINT) AS h FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rk, count(*) OVER (PARTITION BY label) AS n FROM k),
sp AS (SELECT key, label, rk <= round(n * 0.2) AS test, list_transform(generate_series(0, 63),
  lambda i: CASE WHEN vec_id % 17 <> i % 17 THEN CAST(embedding[i + 1] AS DOUBLE) END) AS raw FROM r),
mean AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(v) AS m FROM (SELECT generate_subscripts(raw, 1) AS i, unnest(raw) AS v FROM sp) GROUP BY i)),
e AS (SELECT key, label, test, list_transform(generate_series(1, 64), lambda i: coalesce(raw[i], m[i])) AS e FROM sp, mean),
p AS (SELECT q.key, t.label AS class, row_number() OVER (PARTITION BY q.key ORDER BY list_distance(q.e, t.e), t.key) AS nn
  FROM e q JOIN e t ON q.test AND NOT t.test),
votes AS (SELECT key, class, count(*) AS votes FROM p WHERE nn <= 5 GROUP BY key, class),
best AS (SELECT key, class AS prediction, row_number() OVER (PARTITION BY key ORDER BY votes DESC, class) AS rk FROM votes),
test AS (SELECT e.key, e.label, prediction FROM e JOIN best USING (key) WHERE rk = 1),"""
    + metrics_sql("test")
    + """
SELECT (SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 4) FROM test) AS accuracy,
  round(sum(support * f1) / sum(support), 4) AS f1, (SELECT count(*) FROM sp WHERE NOT test) AS n_train,
  (SELECT count(*) FROM sp WHERE test) AS n_test FROM per_class""",
)
def train_knn(spark, folder):
    return _train(spark, folder, "KNN").metrics


@query(
    "train_log_odds",
    """
WITH k AS (SELECT """
    + LINE_KEY
    + """ AS key, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS label, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS big FROM lineitem),
h AS (SELECT *, CAST('0x' || substr(md5(key || ':42'), 1, 15) AS BIGINT) AS h FROM k),
r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY h) AS rk, count(*) OVER (PARTITION BY label) AS n FROM h)
SELECT CAST(big AS DOUBLE) AS big, round(count(*) FILTER (label = '1') / count(*), 4) AS probability FROM r WHERE rk > round(n * 0.2) GROUP BY big""",
)
def train_log_odds(spark, folder):
    """On one binary feature an unpenalised logistic model is the share of the label at each value."""
    rows = line_rows(spark, folder).withColumn("big", F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0))
    fitted = train.train(rows, "row_key", ["big"], "label", "LogisticRegression", reg_param=0.0)
    values = spark.createDataFrame([(0.0,), (1.0,)], "big double")
    return fitted.scorer.transform(values).select("big", F.round(F.col("probability")[1], 4).alias("probability"))


@query(
    "decision_surface",
    f"""
WITH s AS (SELECT min(l_quantity) - (max(l_quantity) - min(l_quantity)) * 0.1 AS x0,
  max(l_quantity) + (max(l_quantity) - min(l_quantity)) * 0.1 AS x1,
  min(l_tax) - (max(l_tax) - min(l_tax)) * 0.1 AS y0, max(l_tax) + (max(l_tax) - min(l_tax)) * 0.1 AS y1 FROM lineitem),
m AS (SELECT i, j, x0 + j * (x1 - x0) / 199 AS x, y0 + i * (y1 - y0) / 199 AS y
  FROM s, generate_series(0, 199) AS a(i), generate_series(0, 199) AS b(j))
SELECT i, CAST(j AS INTEGER) AS j, round(x, 6) AS x, round(y, 6) AS y,
  round(greatest(1.0 / (1.0 + exp(-(-1.0 + 0.05 * x - 9.0 * y))), 1.0 - 1.0 / (1.0 + exp(-(-1.0 + 0.05 * x - 9.0 * y)))), 6) AS value
FROM m""",
)
def decision_surface(spark, folder):
    scorer = scoring.LinearScorer(["l_quantity", "l_tax"], [0.05, -9.0], -1.0)
    return scoring.decision_surface(table(spark, folder, "lineitem"), scorer)

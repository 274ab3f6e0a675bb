"""Classifier evaluation from label, prediction and probability columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mldiag.functions.columns import ratio, ref, same, share, top_probability
from mldiag.operators.drift import density_curves
from mldiag.operators.profile import class_balance, describe
from mldiag.operators.scale import global_cumsum, unpivot_features


def class_list(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Distinct class names over labels and predictions, as strings."""
    names = F.explode(F.array(ref(label).cast("string"), ref(prediction).cast("string")))
    return df.select(names.alias("class")).where(F.col("class").isNotNull()).distinct()


def confusion_counts(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(true, predicted, n) of the occupied cells."""
    return df.groupBy(
        ref(label).cast("string").alias("true"), ref(prediction).cast("string").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    class_names: Sequence[str] | None = None,
) -> DataFrame:
    """(true, predicted, n) for every pair of classes, empty cells included."""
    counts = confusion_counts(df, label, prediction)
    if class_names is not None:
        base = df.sparkSession.range(1).select(
            F.array(*[F.lit(c) for c in class_names]).alias("classes")
        )
    else:
        # the class names only; the result has their number squared rows anyway
        base = class_list(counts, "true", "predicted").agg(F.collect_set("class").alias("classes"))
    cells = base.select(F.explode("classes").alias("true"), "classes").select(
        "true", F.explode("classes").alias("predicted")
    )
    return cells.join(counts, ["true", "predicted"], "left").select(
        "true", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_pairs(
    df: DataFrame, label: str = "label", prediction: str = "prediction", top: int = 10
) -> DataFrame:
    """The most frequent misclassified (true, predicted) pairs."""
    return (
        confusion_counts(df, label, prediction)
        .where(F.col("true") != F.col("predicted"))
        .orderBy(F.desc("n"), "true", "predicted")
        .limit(top)
    )


def confusion_cell(
    df: DataFrame, true: str, predicted: str, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows of one confusion cell, with `kind` = correct or misclassified."""
    kind = "correct" if str(true) == str(predicted) else "misclassified"
    return df.where(
        (ref(label).cast("string") == str(true)) & (ref(prediction).cast("string") == str(predicted))
    ).withColumn("kind", F.lit(kind))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(same(ref(label), ref(prediction))).alias("correct"),
    ).select("n", "correct", F.round(share(F.col("correct"), F.col("n")), 6).alias("accuracy"))


def _class_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, support, predicted, tp) from the confusion cells."""
    cells = confusion_counts(df, label, prediction)
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("true") == F.col("predicted"), n).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("true").alias("class"), n.alias("support"), zero.alias("predicted"), hit.alias("tp")
        ),
        F.struct(
            F.col("predicted").alias("class"),
            zero.alias("support"),
            n.alias("predicted"),
            zero.alias("tp"),
        ),
    )
    return (
        cells.select(F.inline(sides))
        .where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.sum("tp").alias("tp"),
        )
    )


def _metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return _class_counts(df, label, prediction).select(
        "class",
        "support",
        "tp",
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + predicted).alias("f1"),
    )


def class_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(class, support, precision, recall, f1); undefined ratios are 0."""
    return _metrics(df, label, prediction).select(
        "class", "support", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")]
    )


def weighted_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 6
) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1."""
    n = F.sum("support")
    return _metrics(df, label, prediction).agg(
        F.round(share(F.sum("tp"), n), digits).alias("accuracy"),
        *[
            F.round(share(F.sum(F.col("support") * F.col(m)), n), digits).alias(m)
            for m in ("precision", "recall", "f1")
        ],
    )


def binary_metrics(
    df: DataFrame, positive: str, label: str = "label", prediction: str = "prediction", digits: int = 6
) -> DataFrame:
    """One row: accuracy and precision, recall, F1 of the positive class."""
    true, pred = ref(label).cast("string") == positive, ref(prediction).cast("string") == positive
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(same(ref(label), ref(prediction))).alias("ok"),
        F.count_if(true & pred).alias("tp"),
        F.count_if(true).alias("support"),
        F.count_if(pred).alias("predicted"),
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return counts.select(
        F.round(share(F.col("ok"), F.col("n")), digits).alias("accuracy"),
        F.round(ratio(tp, predicted), digits).alias("precision"),
        F.round(ratio(tp, support), digits).alias("recall"),
        F.round(ratio(2 * tp, support + predicted), digits).alias("f1"),
    )


def metric_table(
    df: DataFrame, label: str, prediction: str, positive: str | None = None
) -> DataFrame:
    """(metric, value) rows with 4 decimals."""
    row = (
        binary_metrics(df, positive, label, prediction, digits=4)
        if positive is not None
        else weighted_metrics(df, label, prediction, digits=4)
    )
    names = ["accuracy", "f1", "precision", "recall"]
    return row.unpivot([], names, "metric", "value")


def _score_counts(
    df: DataFrame, classes: Sequence[str], label: str, probability: str
) -> DataFrame:
    """One-vs-rest (class, score, pos, neg) over distinct scores."""
    names = F.array(*[F.lit(c) for c in classes])
    # the outer form: a plain explode would first test the array, computing it twice
    long = df.select(
        ref(label).cast("string").alias("_label"),
        F.posexplode_outer(ref(probability)).alias("_i", "score"),
    ).select("_label", F.get(names, F.col("_i")).alias("class"), "score")
    hit = F.col("_label").eqNullSafe(F.col("class")).cast("bigint")
    return (
        long.where(F.col("class").isNotNull() & F.col("score").isNotNull())
        .groupBy("class", "score")
        .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    )


def _roc_running(
    df: DataFrame, classes: Sequence[str], label: str, probability: str
) -> DataFrame:
    counts = _score_counts(df, classes, label, probability)
    running = global_cumsum(counts, ["class"], "score", ["pos", "neg"])
    return running.where((F.col("total_pos") > 0) & (F.col("total_neg") > 0))


def roc_points(
    df: DataFrame, classes: Sequence[str], label: str = "label", probability: str = "probability"
) -> DataFrame:
    """(class, threshold, fpr, tpr) at every distinct score, from (0, 0) with no threshold.

    Classes without both outcomes are left out.
    """
    running = _roc_running(df, classes, label, probability)
    at_or_above = lambda v: F.col(f"total_{v}") - F.col(f"cum_{v}") + F.col(v)
    point = F.struct(
        F.col("score").alias("threshold"),
        F.round(at_or_above("neg") / F.col("total_neg"), 6).alias("fpr"),
        F.round(at_or_above("pos") / F.col("total_pos"), 6).alias("tpr"),
    )
    origin = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    # the largest score also yields the start of the curve
    is_top = (F.col("cum_pos") == F.col("total_pos")) & (F.col("cum_neg") == F.col("total_neg"))
    return running.select("class", F.inline(F.when(is_top, F.array(point, origin)).otherwise(F.array(point))))


def roc_auc(
    df: DataFrame, classes: Sequence[str], label: str = "label", probability: str = "probability"
) -> DataFrame:
    """(class, auc): share of (positive, negative) pairs ranked right, ties counting one half."""
    running = _roc_running(df, classes, label, probability)
    # each pair is met from both sides, so that both running sums are read and share one shuffle
    below = (F.col("cum_neg") - F.col("neg")).cast("double")
    above = (F.col("total_pos") - F.col("cum_pos")).cast("double")
    won = 0.5 * (
        F.col("pos") * (below + 0.5 * F.col("neg")) + F.col("neg") * (above + 0.5 * F.col("pos"))
    )
    pairs = F.max(F.col("total_pos").cast("double") * F.col("total_neg"))
    return running.groupBy("class").agg(F.round(F.sum(won) / pairs, 6).alias("auc"))


def status(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Append `status` = Correct or Error."""
    ok = same(ref(label), ref(prediction))
    return df.withColumn("status", F.when(ok, "Correct").otherwise("Error"))


def hardest_samples(
    df: DataFrame,
    id_col: str,
    label: str = "label",
    prediction: str = "prediction",
    probability: str | None = "probability",
    limit: int | None = None,
) -> DataFrame:
    """Rows by ascending margin between the two largest probabilities (1.0 without probabilities)."""
    if probability is not None and probability in df.columns:
        best = top_probability(ref(probability), 0)
        margin = best - top_probability(ref(probability), 1)
    else:
        best = margin = F.lit(1.0)
    rows = df.select(
        ref(id_col),
        ref(label).cast("string").alias("true_label"),
        ref(prediction).cast("string").alias("predicted_label"),
        F.round(best, 4).alias("confidence"),
        F.round(margin, 4).alias("margin"),
        same(ref(label), ref(prediction)).alias("correct"),
    ).orderBy("margin", ref(id_col))
    return rows if limit is None else rows.limit(limit)


def error_rate_by_cluster(
    df: DataFrame, cluster: str = "cluster", label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    return (
        df.groupBy(ref(cluster).cast("string").alias("cluster"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(~same(ref(label), ref(prediction))).alias("errors"),
        )
        .select(
            "cluster", "total", "errors", F.round(F.col("errors") / F.col("total"), 4).alias("error_rate")
        )
    )


def cluster_summary(
    df: DataFrame, cluster: str = "cluster", label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(cluster, n, pct, accuracy)."""
    counts = df.groupBy(ref(cluster).cast("string").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same(ref(label), ref(prediction))).alias("ok")
    )
    total = F.sum("n").over(Window.partitionBy())  # over one row a cluster
    return counts.withColumn("total", total).select(
        "cluster",
        "n",
        F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"),
        F.round(F.col("ok") / F.col("n"), 4).alias("accuracy"),
    )


def plot_frame(
    df: DataFrame,
    id_col: str,
    x: str = "x",
    y: str = "y",
    label: str | None = "label",
    prediction: str | None = "prediction",
    probability: str | None = "probability",
    cluster: str | None = "cluster",
) -> DataFrame:
    """Coordinates with label, prediction, confidence, cluster and a 0/1 error flag, as available."""
    has = lambda c: c is not None and c in df.columns
    columns = [ref(id_col), ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y")]
    if has(label):
        columns.append(ref(label).cast("string").alias("label"))
    if has(prediction):
        columns.append(ref(prediction).cast("string").alias("prediction"))
    if has(probability):
        columns.append(F.round(F.array_max(ref(probability)), 6).alias("confidence"))
    if has(cluster):
        columns.append(ref(cluster).cast("string").alias("cluster"))
    if has(label) and has(prediction):
        columns.append((~same(ref(label), ref(prediction))).cast("int").alias("error"))
    return df.select(*columns)


def correctness_densities(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    prediction: str = "prediction",
    **grid,
) -> DataFrame:
    """Density of each feature among correct and among wrong predictions.

    Features with fewer than two rows on either side are left out.
    """
    flagged = status(df, label, prediction)
    long = unpivot_features(flagged, features, keep=["status"]).withColumnRenamed("status", "side")
    curves = density_curves(long, **grid)
    complete = long.groupBy("feature").agg(
        F.count_if(F.col("side") == "Correct").alias("a"),
        F.count_if(F.col("side") == "Error").alias("b"),
    )
    usable = complete.where((F.col("a") > 1) & (F.col("b") > 1)).select("feature")
    return curves.join(F.broadcast(usable), "feature", "left_semi")


def select_rows(df: DataFrame, selection: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is in the selection table."""
    return df.join(selection.select(ref(id_col)).distinct(), id_col, "left_semi")


def detail_table(df: DataFrame, id_col: str, columns: int = 8, rows: int = 50) -> DataFrame:
    """First rows by id with the first columns, without `target`."""
    shown = [ref(c) for c in df.columns if c != "target"][:columns]
    return df.orderBy(ref(id_col)).select(*shown).limit(rows)


def selection_classes(selected: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, pct) of the selected rows."""
    total = F.sum("n").over(Window.partitionBy())  # over one row a class
    counts = class_balance(selected, label).withColumn("total", total)
    return counts.select("label", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


def selection_statistics(selected: DataFrame, features: Sequence[str]) -> DataFrame:
    return describe(selected, features)


def low_cardinality(df: DataFrame, columns: Sequence[str], limit: int = 20) -> dict[str, bool]:
    """Which numeric columns have few enough distinct values to be shown as categories."""
    seen = df.agg(*[F.approx_count_distinct(ref(c)) for c in columns]).first()
    near = [c for c, n in zip(columns, seen) if n <= 2 * limit]
    exact = df.agg(*[F.count_distinct(ref(c)) for c in near]).first() if near else ()
    few = {c for c, n in zip(near, exact) if n <= limit}
    return {c: c in few for c in columns}


def as_category(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """Cast a numeric column with few distinct values to string; leave others unchanged."""
    if low_cardinality(df, [column], limit)[column]:
        return df.withColumn(column, ref(column).cast("string"))
    return df


def raster(
    df: DataFrame,
    x: str = "x",
    y: str = "y",
    width: int = 300,
    height: int = 300,
    category: str | None = None,
) -> DataFrame:
    """(px, py, n) counts per pixel over the data's extent; with `category` one count per category."""
    span = df.agg(
        F.struct(
            F.min(ref(x)).cast("double").alias("x0"),
            F.max(ref(x)).cast("double").alias("x1"),
            F.min(ref(y)).cast("double").alias("y0"),
            F.max(ref(y)).cast("double").alias("y1"),
        )
    ).scalar()

    def pixel(column: str, lo: str, hi: str, n: int) -> Column:
        width_ = F.col(f"_s.{hi}") - F.col(f"_s.{lo}")
        share = F.when(width_ > 0, (ref(column).cast("double") - F.col(f"_s.{lo}")) / width_).otherwise(0.0)
        return F.least(F.lit(n - 1), F.floor(share * n).cast("int"))

    keys = [pixel(x, "x0", "x1", width).alias("px"), pixel(y, "y0", "y1", height).alias("py")]
    if category:
        keys.append(ref(category).cast("string").alias("category"))
    inside = df.withColumn("_s", span).where(ref(x).isNotNull() & ref(y).isNotNull())
    return inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

"""Uncertainty-driven annotation on an append-only event log.

The log holds (seq, batch, action, target, row_id, pos, label, at). An `assign` event labels one row;
an `undo` event removes the labels of batch `target`. State and history are folds over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mldiag.functions.columns import entropy_bits, max_entropy, ref

LOG_SCHEMA = (
    "seq bigint, batch bigint, action string, target bigint, row_id bigint, pos bigint, "
    "label string, at timestamp"
)


def assign_events(
    selection: DataFrame, id_col: str, label: str, batch: int, at: Column | None = None
) -> DataFrame:
    """Events that give one label to all selected rows, as batch number `batch`."""
    label = label.strip()
    if not label:
        raise ValueError("a label is required")
    return selection.select(
        F.lit(batch).cast("bigint").alias("seq"),
        F.lit(batch).cast("bigint").alias("batch"),
        F.lit("assign").alias("action"),
        F.lit(None).cast("bigint").alias("target"),
        ref(id_col).cast("bigint").alias("row_id"),
        ref(id_col).cast("bigint").alias("pos"),
        F.lit(label).alias("label"),
        (at if at is not None else F.current_timestamp()).cast("timestamp").alias("at"),
    )


def open_batches(log: DataFrame) -> DataFrame:
    """Assigned batches that were not undone."""
    assigned = log.where(F.col("action") == "assign").select("batch").distinct()
    undone = log.where(F.col("action") == "undo").select(F.col("target").alias("batch"))
    return assigned.join(undone, "batch", "left_anti")


def undo_event(log: DataFrame, seq: int, at: Column | None = None) -> DataFrame:
    """The event that undoes the last open batch; empty when there is nothing to undo."""
    last = open_batches(log).agg(F.max("batch").alias("target")).where(F.col("target").isNotNull())
    number, blank = F.lit(seq).cast("bigint"), F.lit(None)
    return last.select(
        number.alias("seq"),
        number.alias("batch"),
        F.lit("undo").alias("action"),
        "target",
        blank.cast("bigint").alias("row_id"),
        blank.cast("bigint").alias("pos"),
        blank.cast("string").alias("label"),
        (at if at is not None else F.current_timestamp()).cast("timestamp").alias("at"),
    )


def current_labels(log: DataFrame) -> DataFrame:
    """(row_id, label): the last event of each row wins.

    Undoing a batch removes its rows' labels; labels they had before that batch do not come back.
    """
    assigned = log.where(F.col("action") == "assign").select("row_id", "seq", "batch", "label")
    undone = log.where(F.col("action") == "undo").select(
        F.col("target").alias("batch"), F.col("seq").alias("undo_seq")
    )
    removed = assigned.join(undone, "batch").select(
        "row_id", F.col("undo_seq").alias("seq"), F.lit(None).cast("string").alias("label")
    )
    events = assigned.select("row_id", "seq", "label").unionByName(removed)
    return (
        events.groupBy("row_id")
        .agg(F.max_by("label", "seq").alias("label"))
        .where(F.col("label").isNotNull())
    )


def history(log: DataFrame) -> DataFrame:
    """(number, first_ids, label, n, at) of the open batches, oldest first."""
    events = log.where(F.col("action") == "assign").join(open_batches(log), "batch", "left_semi")
    sizes = events.groupBy("batch").agg(
        F.max("label").alias("label"), F.count(F.lit(1)).alias("n"), F.max("at").alias("at")
    )
    place = F.row_number().over(Window.partitionBy("batch").orderBy("pos", "row_id"))
    first = (
        events.withColumn("_r", place)
        .where(F.col("_r") <= 5)
        .groupBy("batch")
        .agg(F.sort_array(F.collect_list(F.struct("_r", "row_id"))).alias("_f"))
        .select("batch", F.array_join(F.col("_f.row_id").cast("array<string>"), ",").alias("first_ids"))
    )
    # one row per user action
    number = F.row_number().over(Window.orderBy("batch"))
    return sizes.join(first, "batch").select(number.alias("number"), "first_ids", "label", "n", "at")


def uncertainty(
    df: DataFrame, id_col: str, labels: DataFrame, probability: str = "probability"
) -> DataFrame:
    """(id, x, y, entropy, annotated): 0.0 without probabilities, empty text without annotation."""
    entropy = entropy_bits(ref(probability)) if probability in df.columns else F.lit(0.0)
    points = df.select(ref(id_col).alias("id"), "x", "y", F.round(entropy, 6).alias("entropy"))
    marks = labels.select(F.col("row_id").alias("id"), F.col("label").alias("annotated"))
    return points.join(marks, "id", "left").withColumn(
        "annotated", F.coalesce("annotated", F.lit(""))
    )


def suggest(
    df: DataFrame,
    id_col: str,
    labels: DataFrame,
    queue_size: int = 20,
    probability: str = "probability",
    label: str | None = "label",
) -> DataFrame:
    """(rank, id, entropy, pct_of_max, true_label): the most uncertain rows without annotation."""
    todo = df.join(labels.select(F.col("row_id").alias(id_col)), id_col, "left_anti")
    top = (
        todo.select(
            ref(id_col).alias("id"),
            F.round(entropy_bits(ref(probability)), 6).alias("entropy"),
            max_entropy(F.size(ref(probability))).alias("_max"),
            (ref(label).cast("string") if label else F.lit(None).cast("string")).alias("true_label"),
        )
        .orderBy(F.desc("entropy"), "id")
        .limit(queue_size)
    )
    place = F.row_number().over(Window.orderBy(F.desc("entropy"), "id"))  # over the queue only
    return top.select(
        place.alias("rank"),
        "id",
        "entropy",
        F.round(F.col("entropy") / F.col("_max") * 100, 2).alias("pct_of_max"),
        "true_label",
    )


def progress(
    df: DataFrame, id_col: str, labels: DataFrame, probability: str = "probability"
) -> DataFrame:
    """One row: labeled, total, uncertain, labeled_uncertain, est_gain_pct, progress_pct."""
    uncertain = (
        entropy_bits(ref(probability)) > 0.5 * max_entropy(F.size(ref(probability)))
        if probability in df.columns
        else F.lit(False)
    )
    rows = df.select(ref(id_col).alias("row_id"), uncertain.alias("u")).join(
        labels.select("row_id", F.lit(True).alias("done")), "row_id", "full"
    )
    counts = rows.agg(
        F.count_if("done").alias("labeled"),
        F.count_if(F.col("u").isNotNull()).alias("total"),
        F.count_if("u").alias("uncertain"),
        F.count_if(F.col("u") & F.coalesce("done", F.lit(False))).alias("labeled_uncertain"),
    )
    return counts.select(
        "*",
        F.round(
            F.when(F.col("uncertain") > 0, F.try_divide(F.col("labeled_uncertain") * 5.0, F.col("uncertain"))).otherwise(0.0), 6
        ).alias("est_gain_pct"),
        F.coalesce(F.floor(F.try_divide(F.col("labeled") * 100.0, F.col("total"))), F.lit(0))
        .cast("bigint")
        .alias("progress_pct"),
    )


def export_labels(
    labels: DataFrame, df: DataFrame | None = None, id_col: str = "id", label: str | None = None
) -> DataFrame:
    """(index, label[, emb_x, emb_y][, original_label]) by index; missing rows leave NULLs."""
    marks = labels.select(F.col("row_id").alias("index"), "label")
    if df is None:
        return marks.orderBy("index")
    extra = []
    if {"x", "y"} <= set(df.columns):
        extra += [F.col("x").alias("emb_x"), F.col("y").alias("emb_y")]
    if label is not None:
        extra.append(ref(label).cast("string").alias("original_label"))
    rows = df.select(ref(id_col).alias("index"), *extra)
    return marks.join(rows, "index", "left").orderBy("index")

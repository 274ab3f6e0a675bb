"""Column-role inference and training readiness checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mldiag.functions.columns import numeric_columns, ref

# The recognised column names, in order of preference.
LABEL_NAMES = (
    "label", "target", "class", "y", "category", "survived",
    "species", "diagnosis", "outcome", "sentiment", "type",
)
IMAGE_NAMES = ("path", "image_path", "image", "file")
TEXT_MEAN_LENGTH = 50
MIN_SAMPLES = 10


@dataclass(frozen=True)
class Roles:
    label: str | None = None
    text: str | None = None
    image: str | None = None
    features: list[str] = field(default_factory=list)


def _named_label(columns: Sequence[str]) -> str | None:
    exact = next((n for n in LABEL_NAMES if n in columns), None)
    if exact:
        return exact
    folded = {c.lower(): c for c in columns}
    return next((folded[n] for n in LABEL_NAMES if n in folded), None)


def _label_candidates(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
        or (isinstance(f.dataType, T.IntegralType) and f.name not in ("id", "index"))
    ]


def infer_columns(df: DataFrame) -> Roles:
    """Guess label, text, image and feature columns.

    Names decide where they can. Otherwise one scan sketches distinct counts and text lengths, and
    only columns whose sketch is near the 2..20 window are counted exactly.
    """
    label = _named_label(df.columns)
    candidates = [] if label else _label_candidates(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    measures = [F.approx_count_distinct(ref(c)).alias(f"d{i}") for i, c in enumerate(candidates)]
    measures += [
        F.avg(F.length(F.coalesce(ref(c), F.lit("nan")))).alias(f"t{i}")
        for i, c in enumerate(texts)
    ]
    text = None
    if measures:
        seen = df.agg(*measures).first()
        text = next(
            (c for i, c in enumerate(texts) if (seen[f"t{i}"] or 0) > TEXT_MEAN_LENGTH), None
        )
        near = [c for i, c in enumerate(candidates) if 1 <= seen[f"d{i}"] <= 40]
        if near:
            counts = df.agg(*[F.count_distinct(ref(c)) for c in near]).first()
            label = next((c for c, n in zip(near, counts) if 2 <= n <= 20), None)
    return Roles(
        label=label,
        text=text,
        image=next((c for c in IMAGE_NAMES if c in df.columns), None),
        features=[c for c in numeric_columns(df) if c not in (label, "target")],
    )


def roles_frame(df: DataFrame) -> DataFrame:
    """`infer_columns` as (role, column) rows."""
    roles = infer_columns(df)
    rows = [(r, c) for r in ("label", "text", "image") if (c := getattr(roles, r)) is not None]
    rows += [("feature", c) for c in roles.features]
    return df.sparkSession.createDataFrame(rows, "role string, column string")


def training_check(
    df: DataFrame, features: Sequence[str], label: str | None, test_size: float = 0.2
) -> DataFrame:
    """(seq, check, ok, detail) of every precondition for training, in the order they are reported."""
    checks = [
        ("features", bool(features), "the list of features is empty"),
        ("label", bool(label), "no label was named"),
        ("label_present", label in df.columns, f"the table lacks the label {label!r}"),
    ]
    missing = [c for c in features if c not in df.columns]
    checks.append(("features_present", not missing, f"the table lacks the features {', '.join(missing)}"))
    classes = F.count_distinct(ref(label)) if label in df.columns else F.lit(0)
    sizes = df.agg(F.count(F.lit(1)).alias("n"), classes.alias("classes"))
    test_n = F.floor(F.col("n") * F.lit(float(test_size)))
    static = [
        F.struct(
            F.lit(i).alias("seq"),
            F.lit(name).alias("check"),
            F.lit(bool(ok)).alias("ok"),
            F.lit("" if ok else text).alias("detail"),
        )
        for i, (name, ok, text) in enumerate(checks, 1)
    ]
    counted = [
        ("rows", F.col("n") > 0, F.concat(F.lit("rows="), F.col("n"))),
        ("min_samples", F.col("n") >= MIN_SAMPLES, F.lit(f"min={MIN_SAMPLES}")),
        ("classes", F.col("classes") >= 2, F.concat(F.lit("classes="), F.col("classes"))),
        (
            "split",
            (F.col("n") - test_n >= 2) & (test_n >= 1),
            F.concat(F.lit("train="), F.col("n") - test_n, F.lit(" test="), test_n),
        ),
    ]
    dynamic = [
        F.struct(
            F.lit(i).alias("seq"), F.lit(name).alias("check"), ok.alias("ok"), text.alias("detail")
        )
        for i, (name, ok, text) in enumerate(counted, len(static) + 1)
    ]
    return sizes.select(F.inline(F.array(*static, *dynamic)))

"""Attribution, counterfactual and what-if queries."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import functions as F

from mldiag.operators import counterfactual, scoring, shap, train, tree_shap
from mldiag.plans.model_queries import (
    LINE_BIAS,
    LINE_FEATURES,
    LINE_KEY,
    LINE_WEIGHTS,
    line_rows,
    line_scorer,
)
from mldiag.plans.registry import query, table

# -- linear scorer on line items --------------------------------------------------------------------
_LONG = f"""
long AS (""" + " UNION ALL ".join(
    f"SELECT {LINE_KEY} AS id, '{f}' AS feature, CAST({w} AS DOUBLE) * ({f} - (SELECT avg({f}) FROM lineitem)) AS phi,"
    f" CAST({f} AS DOUBLE) AS value FROM lineitem"
    for f, w in zip(LINE_FEATURES, LINE_WEIGHTS)
) + ")"


def _rounded(rows):
    """Attributions to 8 decimals, everything else numeric to 6; no negative zeros."""
    digits = {"phi": 8, "value": 6, "normalised": 6, "interaction": 6}
    return rows.select(
        *[(F.round(c, digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c) for c in rows.columns]
    )


def _linear(spark, folder):
    return shap.linear_shap(line_rows(spark, folder), "row_key", line_scorer())


@query(
    "shap_linear",
    f"WITH {_LONG} SELECT id, '1' AS class, feature, round(phi, 8) + 0.0 AS phi, round(value, 6) AS value FROM long",
)
def shap_linear(spark, folder):
    return _rounded(_linear(spark, folder))


@query(
    "shap_linear_base",
    f"""SELECT '1' AS class, round({LINE_BIAS} + """
    + " + ".join(f"CAST({w} AS DOUBLE) * avg({f})" for f, w in zip(LINE_FEATURES, LINE_WEIGHTS))
    + ", 6) AS base FROM lineitem",
)
def shap_linear_base(spark, folder):
    base = shap.linear_base(line_rows(spark, folder), line_scorer())
    return base.withColumn("base", F.round("base", 6))


@query(
    "shap_importance",
    f"""WITH {_LONG} SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM long GROUP BY feature""",
)
def shap_importance(spark, folder):
    return shap.importance(_linear(spark, folder))


@query(
    "shap_distribution",
    f"""WITH {_LONG}, st AS (SELECT feature, avg(abs(phi)) AS s, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
rk AS (SELECT *, row_number() OVER (ORDER BY s DESC, feature) - 1 AS rank FROM st)
SELECT id, feature, CAST(rank AS INTEGER) AS rank, round(phi, 8) + 0.0 AS phi,
  round((value - lo) / (hi - lo + 1e-10), 6) AS normalised, round(value, 6) AS value
FROM long JOIN rk USING (feature)""",
)
def shap_distribution(spark, folder):
    return _rounded(shap.distribution(_linear(spark, folder)))


# -- two-feature parts: ids are unique here ---------------------------------------------------------
PART_FEATURES = ["p_size", "p_retailprice", "name_length"]
PART_WEIGHTS = [0.08, 0.02, -0.3]
PART_BIAS = -18.0


def part_rows(spark, folder):
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey",
        F.col("p_size").cast("double").alias("p_size"),
        "p_retailprice",
        F.length("p_name").cast("double").alias("name_length"),
    )


def part_scorer():
    """A logistic score with an interaction, so that attributions are not just weight times shift."""

    def probability(values):
        size, price, length = values
        margin = (
            F.lit(PART_BIAS)
            + F.lit(PART_WEIGHTS[0]) * size
            + F.lit(PART_WEIGHTS[1]) * price
            + F.lit(PART_WEIGHTS[2]) * length
            + F.lit(0.01) * size * length
        )
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return F.array(F.lit(1.0) - p, p)

    return scoring.ExprScorer(PART_FEATURES, ["0", "1"], probability)


def _part_function(x: np.ndarray) -> np.ndarray:
    size, price, length = x[:, 0], x[:, 1], x[:, 2]
    margin = -18.0 + 0.08 * size + 0.02 * price - 0.3 * length + 0.01 * size * length
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.stack([1.0 - p, p], axis=1)


_PARTS = """
parts AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(length(p_name) AS DOUBLE) AS c FROM part),
bg AS (SELECT a AS ba, b AS bb, c AS bc FROM parts ORDER BY md5(p_partkey || ':42'), p_partkey LIMIT 100)"""


def _p1(a: str, b: str, c: str) -> str:
    m = f"(-18.0::DOUBLE + 0.08::DOUBLE * {a} + 0.02::DOUBLE * {b} + -0.3::DOUBLE * {c} + 0.01::DOUBLE * {a} * {c})"
    return f"(1.0 / (1.0 + exp(-{m})))"


def _coalition(mask: int) -> str:
    picks = [own if mask >> i & 1 else other for i, (own, other) in enumerate(zip("abc", ("ba", "bb", "bc")))]
    return f"avg({_p1(*picks)}) AS v{mask}"


_VALUES = (
    _PARTS
    + ", v AS (SELECT p_partkey, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, "
    + ", ".join(_coalition(m) for m in range(8))
    + " FROM parts, bg GROUP BY p_partkey)"
)


def _phi(i: int) -> str:
    terms = [f"({float(w)!r}::DOUBLE * v{m})" for m, w in enumerate(shap.coalition_weights(3)[i])]
    return " + ".join(terms)


_EXACT = "WITH " + _VALUES + ", long AS (" + " UNION ALL ".join(
    f"SELECT p_partkey AS id, '1' AS class, '{f}' AS feature, {_phi(i)} AS phi, {'abc'[i]} AS value FROM v"
    for i, f in enumerate(PART_FEATURES)
) + ")"
_BOTH = """, both_ AS (SELECT * FROM long UNION ALL SELECT id, '0', feature, -phi, value FROM long)"""


def _exact(spark, folder):
    rows = part_rows(spark, folder)
    background = shap.background(rows, "p_partkey", PART_FEATURES)
    return shap.exact_shap(rows, "p_partkey", part_scorer(), background)


_EXACT_ROWS = _EXACT + _BOTH + " SELECT id, class, feature, round(phi, 8) + 0.0 AS phi, round(value, 6) AS value FROM both_"


@query("shap_exact", _EXACT_ROWS)
def shap_exact(spark, folder):
    return _rounded(_exact(spark, folder))


@query("shap_batch", _EXACT_ROWS)
def shap_batch(spark, folder):
    """The same attributions from a model given as a matrix function."""
    rows = part_rows(spark, folder)
    scorer = scoring.BatchScorer(PART_FEATURES, ["0", "1"], _part_function)
    background = shap.background(rows, "p_partkey", PART_FEATURES)
    return _rounded(shap.batch_shap(rows, "p_partkey", scorer, background))


#: Two small trees over the part features: (feature, threshold, left, right, [output]).
HAND_TREES = [
    [
        (0, 25.0, 1, 2, [0.0]), (1, 1000.0, 3, 4, [0.0]), (2, 30.0, 5, 6, [0.0]), (-1, 0.0, -1, -1, [0.1]), (-1, 0.0, -1, -1, [0.4]),
        (0, 40.0, 7, 8, [0.0]), (-1, 0.0, -1, -1, [0.9]), (-1, 0.0, -1, -1, [0.6]), (-1, 0.0, -1, -1, [0.75]),
    ],
    [(1, 950.0, 1, 2, [0.0]), (-1, 0.0, -1, -1, [0.25]), (1, 1200.0, 3, 4, [0.0]), (0, 10.0, 5, 6, [0.0]), (-1, 0.0, -1, -1, [-0.5]), (-1, 0.0, -1, -1, [1.0]), (-1, 0.0, -1, -1, [2.0])],
]


def _trees_sql(a: str, b: str, c: str) -> str:
    one = f"CASE WHEN {a} <= 25 THEN CASE WHEN {b} <= 1000 THEN 0.1 ELSE 0.4 END WHEN {c} <= 30 THEN CASE WHEN {a} <= 40 THEN 0.6 ELSE 0.75 END ELSE 0.9 END"
    two = f"CASE WHEN {b} <= 950 THEN 0.25 WHEN {b} <= 1200 THEN CASE WHEN {a} <= 10 THEN 1.0 ELSE 2.0 END ELSE -0.5 END"
    return f"CAST({one} AS DOUBLE) + CAST({two} AS DOUBLE)"


def _tree_coalition(mask: int) -> str:
    picks = [own if mask >> i & 1 else other for i, (own, other) in enumerate(zip("abc", ("ba", "bb", "bc")))]
    return f"avg({_trees_sql(*picks)}) AS v{mask}"


@query(
    "shap_tree",
    "WITH " + _PARTS + ", v AS (SELECT p_partkey, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, "
    + ", ".join(_tree_coalition(m) for m in range(8)) + " FROM parts, bg GROUP BY p_partkey), long AS ("
    + " UNION ALL ".join(
        f"SELECT p_partkey AS id, 'score' AS class, '{f}' AS feature, {_phi(i)} AS phi, {'abc'[i]} AS value FROM v" for i, f in enumerate(PART_FEATURES)
    )
    + ") SELECT id, class, feature, round(phi, 8) + 0.0 AS phi, round(value, 6) AS value FROM long",
)
def shap_tree(spark, folder):
    """Path-wise attributions of two trees, held against all coalitions in SQL."""
    rows = part_rows(spark, folder)
    background = shap.background(rows, "p_partkey", PART_FEATURES)
    points = rows.select(F.col("p_partkey").alias("id"), F.array(*PART_FEATURES).alias("x"))
    return _rounded(tree_shap.path_shap(points, PART_FEATURES, ["score"], tree_shap.paths_of(HAND_TREES, 1), background))


@query(
    "shap_forest",
    """SELECT vec_id AS id, c AS class, CAST(30 AS BIGINT) AS features, true AS adds_up
FROM embeddings, (SELECT DISTINCT CAST(label AS VARCHAR) AS c FROM embeddings)""",
)
def shap_forest(spark, folder):
    """A fitted forest of thirty features: the attributions of every row and class add up to its probability less the base."""
    features = [f"f{i}" for i in range(30)]
    values = [F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(features)]
    rows = table(spark, folder, "embeddings").select("vec_id", "label", *values)
    fitted = train.train(rows, "vec_id", features, "label", "RandomForest", n_trees=20, max_depth=8)
    background = shap.background(rows, "vec_id", features)
    long = shap.shap_values(rows, "vec_id", fitted.scorer, background)
    base = F.create_map(*[F.lit(v) for r in shap.base_values(fitted.scorer, spark, background).collect() for v in r])  # one entry a class
    names = F.array(*[F.lit(c) for c in fitted.scorer.classes])
    scored = fitted.scored.select(F.col("vec_id").alias("id"), F.posexplode("probability").alias("i", "p"))
    scored = scored.select("id", F.get(names, F.col("i")).alias("class"), "p")
    scored = scored.select("id", "class", (base[F.col("class")] - F.col("p")).alias("part"), F.lit(0).alias("feature"))
    parts = long.select("id", "class", F.col("phi").alias("part"), F.lit(1).alias("feature")).unionByName(scored)
    total = parts.groupBy("id", "class").agg(F.sum("part").alias("gap"), F.sum("feature").alias("features"))
    return total.select("id", "class", "features", (F.abs("gap") < 1e-9).alias("adds_up"))


N_ORDERS = 200


def _sampled_sql() -> str:
    ranks = np.random.RandomState(42)
    draws = ", ".join(f"({d}, {', '.join(str(r) for r in ranks.permutation(3))})" for d in range(N_ORDERS))
    own, other = ("a", "b", "c"), ("ba", "bb", "bc")

    def gain(i: int) -> str:
        def at(mine: bool) -> str:
            picks = []
            for j in range(3):
                if j == i:
                    picks.append(own[j] if mine else other[j])
                else:
                    picks.append(f"(CASE WHEN r{j} < r{i} THEN {own[j]} ELSE {other[j]} END)")
            return _p1(*picks)

        return f"avg({at(True)} - {at(False)}) AS g{i}"

    return (
        "WITH "
        + _PARTS.replace("bg AS (SELECT", "bg AS (SELECT row_number() OVER (ORDER BY md5(p_partkey || ':42'), p_partkey) - 1 AS pos,")
        + f", draws(d, r0, r1, r2) AS (VALUES {draws}), nb AS (SELECT count(*) AS nb FROM bg),"
        + " dr AS (SELECT draws.*, ba, bb, bc FROM draws, nb JOIN bg ON pos = d % nb),"
        + " g AS (SELECT p_partkey, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, "
        + ", ".join(gain(i) for i in range(3))
        + " FROM parts, dr GROUP BY p_partkey), long AS ("
        + " UNION ALL ".join(
            f"SELECT p_partkey AS id, '1' AS class, '{f}' AS feature, g{i} AS phi, {'abc'[i]} AS value FROM g"
            for i, f in enumerate(PART_FEATURES)
        )
        + ")"
        + _BOTH
        + " SELECT id, class, feature, round(phi, 8) + 0.0 AS phi, round(value, 6) AS value FROM both_"
    )


@query("shap_sampled", _sampled_sql())
def shap_sampled(spark, folder):
    rows = part_rows(spark, folder)
    background = shap.background(rows, "p_partkey", PART_FEATURES)
    return _rounded(shap.shap_values(rows, "p_partkey", part_scorer(), background, "sampled", n_orders=N_ORDERS))


@query(
    "shap_pipeline_sums",
    """SELECT vec_id AS id, CAST(label AS VARCHAR) AS class, CAST(12 AS BIGINT) AS features, true AS adds_up
FROM embeddings, (SELECT DISTINCT label FROM embeddings)""".replace("CAST(label AS VARCHAR)", "c").replace(
        "(SELECT DISTINCT label FROM embeddings)", "(SELECT DISTINCT CAST(label AS VARCHAR) AS c FROM embeddings)"
    ),
)
def shap_pipeline_sums(spark, folder):
    """A fitted pipeline on twelve features: sampled attributions add up to the prediction less the base."""
    features = [f"f{i}" for i in range(12)]
    rows = table(spark, folder, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(features)]
    )
    fitted = train.train(rows, "vec_id", features, "label", "LogisticRegression", max_iter=20)
    background = shap.background(rows, "vec_id", features, 20)
    long = shap.shap_values(rows, "vec_id", fitted.scorer, background, "sampled", n_orders=20)
    total = long.groupBy("id", "class").agg(F.sum("phi").alias("phi"), F.count("*").alias("features"))
    base = shap.base_values(fitted.scorer, spark, background)
    names = F.array(*[F.lit(c) for c in fitted.scorer.classes])
    scored = fitted.scored.select(F.col("vec_id").alias("id"), F.posexplode("probability").alias("i", "p"))
    scored = scored.select("id", F.get(names, F.col("i")).alias("class"), "p")
    both = total.join(scored, ["id", "class"]).join(F.broadcast(base), "class")  # one row per class
    return both.select("id", "class", "features", (F.abs(F.col("p") - F.col("base") - F.col("phi")) < 1e-9).alias("adds_up"))


@query(
    "shap_base",
    "WITH " + _PARTS + f", p AS (SELECT avg({_p1('ba', 'bb', 'bc')}) AS p FROM bg) SELECT '1' AS class, round(p, 6) AS base FROM p UNION ALL SELECT '0', round(1 - p, 6) FROM p",
)
def shap_base(spark, folder):
    rows = part_rows(spark, folder)
    background = shap.background(rows, "p_partkey", PART_FEATURES)
    return shap.base_values(part_scorer(), spark, background).withColumn("base", F.round("base", 6))


def _first(spark, folder):
    return shap.reduce_classes(_exact(spark, folder), "first", "1")


@query(
    "shap_waterfall",
    _EXACT
    + f""", base AS (SELECT avg({_p1('ba', 'bb', 'bc')}) AS base FROM bg)
SELECT id, CAST(rk AS INTEGER) AS rank, feature, round(phi, 8) + 0.0 AS phi,
CASE WHEN phi > 0 THEN 'positive' ELSE 'negative' END AS sign, round(base, 6) AS base
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(phi) DESC, feature) AS rk FROM long), base""",
)
def shap_waterfall(spark, folder):
    rows = part_rows(spark, folder)
    background = shap.background(rows, "p_partkey", PART_FEATURES)
    base = shap.base_values(part_scorer(), spark, background).where("class = '1'")
    falls = shap.waterfall(_first(spark, folder), base=base)
    return _rounded(falls).withColumn("base", F.round("base", 6))


@query(
    "shap_dependence",
    _EXACT
    + """ SELECT s.id, round(s.value, 6) AS value, round(s.phi, 8) + 0.0 AS phi, round(o.value, 6) AS interaction
FROM long s JOIN long o ON s.id = o.id AND s.feature = 'p_size' AND o.feature = 'name_length'""",
)
def shap_dependence(spark, folder):
    return _rounded(shap.dependence(_first(spark, folder), "p_size", "name_length"))


@query(
    "shap_columns",
    "WITH "
    + _VALUES
    + ", "
    + "w AS (SELECT p_partkey, "
    + ", ".join(f"round({_phi(i)}, 6) + 0.0 AS shap_{f}" for i, f in enumerate(PART_FEATURES))
    + " FROM v) SELECT * FROM w",
)
def shap_columns(spark, folder):
    wide = shap.append_shap(
        part_rows(spark, folder).select("p_partkey"), "p_partkey", _first(spark, folder), PART_FEATURES
    )
    return wide.select(
        "p_partkey", *[(F.round(f"shap_{f}", 6) + F.lit(0.0)).alias(f"shap_{f}") for f in PART_FEATURES]
    )


# three one-against-rest scores that need not add up to 1, so that the mean over classes is not 0
_SCORES = ["-18.0 + 0.02 * {b} + 0.08 * {a}", "2.0 - 0.1 * {a}", "-1.0 + 0.05 * {c} + 0.001 * {a} * {c}"]


def _score_sql(k: int, picks: Sequence[str]) -> str:
    margin = _SCORES[k].format(a=picks[0], b=picks[1], c=picks[2])
    for number in ("18.0", "0.02", "0.08", "2.0", "0.1", "1.0", "0.05", "0.001"):
        margin = re.sub(rf"(?<![\d.]){re.escape(number)}(?![\d.])", f"{number}::DOUBLE", margin)
    return f"(1.0 / (1.0 + exp(-({margin}))))"


def _three_sql() -> str:
    own, other = ("a", "b", "c"), ("ba", "bb", "bc")
    values = ", ".join(
        f"avg({_score_sql(k, [o if mask >> i & 1 else x for i, (o, x) in enumerate(zip(own, other))])}) AS v{k}_{mask}"
        for k in range(3)
        for mask in range(8)
    )
    weights = shap.coalition_weights(3)
    phi = lambda k, i: " + ".join(f"({float(w)!r}::DOUBLE * v{k}_{m})" for m, w in enumerate(weights[i]))
    return (
        "WITH " + _PARTS + f", v AS (SELECT p_partkey, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, {values}"
        " FROM parts, bg GROUP BY p_partkey) "
        + " UNION ALL ".join(
            f"SELECT p_partkey AS id, '{f}' AS feature, round(({' + '.join(phi(k, i) for k in range(3))}) / 3, 6) + 0.0 AS phi,"
            f" round({'abc'[i]}, 6) AS value FROM v"
            for i, f in enumerate(PART_FEATURES)
        )
    )


def _three_scores(values):
    size, price, length = values
    margins = [
        F.lit(-18.0) + F.lit(0.02) * price + F.lit(0.08) * size,
        F.lit(2.0) - F.lit(0.1) * size,
        F.lit(-1.0) + F.lit(0.05) * length + F.lit(0.001) * size * length,
    ]
    return F.array(*[F.lit(1.0) / (F.lit(1.0) + F.exp(-m)) for m in margins])


@query("shap_mean_over_classes", _three_sql())
def shap_mean_over_classes(spark, folder):
    rows = part_rows(spark, folder)
    background = shap.background(rows, "p_partkey", PART_FEATURES)
    scorer = scoring.ExprScorer(PART_FEATURES, ["0", "1", "2"], _three_scores)
    mean = shap.reduce_classes(shap.exact_shap(rows, "p_partkey", scorer, background), "mean")
    return mean.select(
        "id", "feature", (F.round("phi", 6) + F.lit(0.0)).alias("phi"), F.round("value", 6).alias("value")
    )


# -- counterfactuals -------------------------------------------------------------------------------
_SWEEP = (
    "WITH parts AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(length(p_name) AS DOUBLE) AS c FROM part),"
    + f" own AS (SELECT *, {_p1('a', 'b', 'c')} > 1.0 - {_p1('a', 'b', 'c')} AS own FROM parts),"
    + " st AS (SELECT "
    + ", ".join(
        f"min({c}) - (max({c}) - min({c})) * 0.1 AS lo_{c}, max({c}) + (max({c}) - min({c})) * 0.1 AS hi_{c}"
        for c in "abc"
    )
    + " FROM parts), moves AS ("
    + " UNION ALL ".join(
        f"SELECT p_partkey AS id, '{PART_FEATURES[i]}' AS feature, {i} AS pos, '{d}' AS direction, {int(d == 'min')} AS down,"
        f" {c} AS original, own, {c} + t * (({('hi_' if d == 'max' else 'lo_') + c} - {c}) / 49) AS moved, t, a, b, c FROM own, st,"
        f" generate_series(0, 49) AS s(t)"
        for i, c in enumerate("abc")
        for d in ("max", "min")
    )
    + "), tried AS (SELECT *, CASE pos WHEN 0 THEN "
    + f"{_p1('moved', 'b', 'c')} WHEN 1 THEN {_p1('a', 'moved', 'c')} ELSE {_p1('a', 'b', 'moved')} END AS p FROM moves),"
    + " flips AS (SELECT id, feature, pos, direction, down, min(t) AS t, arg_min(moved, t) AS flip_value, any_value(original) AS original"
    + " FROM tried WHERE (p > 1.0 - p) <> own GROUP BY ALL)"
)


@query(
    "counterfactual_sweep",
    _SWEEP
    + """ SELECT id, feature, direction, round(original, 6) AS original, round(flip_value, 6) AS flip_value,
round(abs(flip_value - original), 6) AS change FROM flips""",
)
def counterfactual_sweep(spark, folder):
    found = counterfactual.sweep(part_rows(spark, folder), "p_partkey", part_scorer())
    return found.select(
        "id", "feature", "direction", *[F.round(c, 6).alias(c) for c in ("original", "flip_value", "change")]
    )


@query(
    "counterfactual_flip",
    _SWEEP
    + """, best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(flip_value - original), 9), pos, down) AS rk FROM flips)
SELECT id, feature, direction, round(original, 6) AS original, round(flip_value, 6) AS flip_value,
round(abs(flip_value - original), 6) AS change FROM best WHERE rk = 1""",
)
def counterfactual_flip(spark, folder):
    return counterfactual.minimum_flip(part_rows(spark, folder), "p_partkey", part_scorer())


@query(
    "what_if",
    "WITH parts AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(length(p_name) AS DOUBLE) AS c FROM part),"
    + f" s AS (SELECT p_partkey AS id, {_p1('a', 'b', 'c')} AS o, {_p1('greatest(a, 25.0::DOUBLE)', 'b * 1.1', 'c')} AS m, a FROM parts)"
    + """ SELECT id, class, round(CASE WHEN class = '1' THEN o ELSE 1.0 - o END, 6) AS original,
  round(CASE WHEN class = '1' THEN m ELSE 1.0 - m END, 6) AS modified,
  round(CASE WHEN class = '1' THEN m - o ELSE (1.0 - m) - (1.0 - o) END, 6) + 0.0 AS delta,
  (o > 1.0 - o) <> (m > 1.0 - m) AS flipped,
  CASE WHEN a < 25 THEN 'p_size,p_retailprice' ELSE 'p_retailprice' END AS changed
FROM s, (SELECT unnest(['0', '1']) AS class)""",
)
def what_if(spark, folder):
    changes = {
        "p_size": F.greatest(F.col("p_size"), F.lit(25.0)),
        "p_retailprice": F.col("p_retailprice") * 1.1,
    }
    rows = counterfactual.what_if(part_rows(spark, folder), "p_partkey", part_scorer(), changes)
    return rows.withColumn("delta", F.col("delta") + F.lit(0.0))


@query(
    "shap_first_rows",
    _EXACT
    + """, f AS (SELECT p_partkey FROM parts ORDER BY p_partkey LIMIT 50)
SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM long WHERE id IN (SELECT p_partkey FROM f) GROUP BY feature""",
)
def shap_first_rows(spark, folder):
    """Importance of the first 50 rows, as asked for."""
    rows = part_rows(spark, folder)
    background = shap.background(rows, "p_partkey", PART_FEATURES)
    first = shap.explained_rows(rows, "p_partkey", n=50)
    long = shap.exact_shap(first, "p_partkey", part_scorer(), background)
    return shap.importance(shap.reduce_classes(long, "first", "1"))

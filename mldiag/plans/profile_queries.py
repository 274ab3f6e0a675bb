"""Dataset profile, column roles, scaling and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mldiag.functions.predicate import filter_expr, filter_summary
from mldiag.operators import evaluate, profile, roles, transforms
from mldiag.plans.registry import query, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_HOLES = "nullif(l_discount, 0.0)"


def line_items(spark, folder):
    """Line items with a derived hole: no discount counts as missing."""
    items = table(spark, folder, "lineitem")
    return items.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))


_ITEMS = f"(SELECT * REPLACE ({_HOLES} AS l_discount) FROM lineitem)"
_LONG = f"""(UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM {_ITEMS})
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)"""


@query(
    "profile_overview",
    f"""
WITH g AS (SELECT *, count(*) AS n FROM {_ITEMS} GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS samples, CAST(8 AS BIGINT) AS features,
  round(sum(n * CAST(l_discount IS NULL AS INTEGER)) * 100.0 / (sum(n) * 11), 2) AS missing_pct,
  CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g""",
)
def profile_overview(spark, folder):
    return profile.overview(line_items(spark, folder))


@query(
    "profile_duplicates",
    """
WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity, nullif(l_tax, 0.0) AS l_tax, count(*) AS n
  FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS samples, CAST(2 AS BIGINT) AS features,
  round(sum(n * CAST(l_tax IS NULL AS INTEGER)) * 100.0 / (sum(n) * 4), 2) AS missing_pct,
  CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g""",
)
def profile_duplicates(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
        F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax")).alias("l_tax"),
    )
    return profile.overview(rows)


_COLUMNS = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]


@query(
    "profile_missing",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS missing_pct"
        f" FROM {_ITEMS}"
        for c, _ in _COLUMNS
    ),
)
def profile_missing(spark, folder):
    return profile.missing_percent(line_items(spark, folder))


@query(
    "profile_dtypes",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype,"
        f" count(DISTINCT {c}) + max(CAST({c} IS NULL AS BIGINT)) AS unique_values,"
        f" count(*) FILTER ({c} IS NULL) AS missing_count,"
        f" round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS missing_pct FROM {_ITEMS}"
        for c, t in _COLUMNS
    ),
)
def profile_dtypes(spark, folder):
    return profile.dtype_summary(line_items(spark, folder))


@query(
    "profile_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 3) AS corr FROM {_ITEMS}"
        for a in LINE
        for b in LINE
    ),
)
def profile_correlation(spark, folder):
    return profile.correlation(line_items(spark, folder), LINE)


@query(
    "profile_correlation_wide",
    """
WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS e FROM embeddings),
w AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 11 <> 0 THEN CAST(e AS DOUBLE) END AS e FROM v)
SELECT 'd' || a.i AS x, 'd' || b.i AS y, round(corr(a.e, b.e), 3) AS corr FROM w a JOIN w b USING (vec_id) GROUP BY a.i, b.i""",
)
def profile_correlation_wide(spark, folder):
    """Every pair of the embeddings' dimensions, each with a value missing in every eleventh row."""
    dims = range(64)
    there = [F.when((F.col("vec_id") + i) % 11 != 0, F.col("embedding")[i]).alias(f"d{i}") for i in dims]
    return profile.correlation(table(spark, folder, "embeddings").select(*there), [f"d{i}" for i in dims])


@query(
    "profile_class_balance",
    "SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
)
def profile_class_balance(spark, folder):
    return profile.class_balance(table(spark, folder, "documents"), "lang")


@query(
    "profile_histogram",
    f"""
WITH sp AS (SELECT feature, min(value) AS a, max(value) AS b FROM {_LONG} GROUP BY feature),
ed AS (SELECT feature, a AS first, (b - a) / 20 AS step FROM sp),
g AS (SELECT feature, value, first, step, CAST(least(19, floor((value - first) / step)) AS INTEGER) AS g
  FROM {_LONG} JOIN ed USING (feature)),
b AS (SELECT feature, CASE WHEN value < first + g * step THEN g - 1
  WHEN value >= first + (g + 1) * step AND g < 19 THEN g + 1 ELSE g END AS bin FROM g),
c AS (SELECT feature, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT ed.feature, CAST(s.bin AS INTEGER) AS bin, round(first + s.bin * step, 6) AS lo,
  round(first + (s.bin + 1) * step, 6) AS hi, coalesce(n, 0) AS n
FROM ed CROSS JOIN generate_series(0, 19) AS s(bin) LEFT JOIN c ON c.feature = ed.feature AND c.bin = s.bin""",
)
def profile_histogram(spark, folder):
    return profile.histogram(line_items(spark, folder), LINE)


@query(
    "profile_outliers",
    """
WITH long AS (SELECT 'value' AS feature, value FROM events
  UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n
  FROM long GROUP BY feature),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.feature, round(max(q1), 4) AS q1, round(max(q3), 4) AS q3, round(max(iqr), 4) AS iqr,
  round(max(lo), 4) AS lower_fence, round(max(hi), 4) AS upper_fence,
  count(*) FILTER (value < lo OR value > hi) AS outlier_count,
  round(count(*) FILTER (value < lo OR value > hi) * 100.0 / max(n), 2) AS outlier_pct
FROM f JOIN long USING (feature) GROUP BY f.feature""",
)
def profile_outliers(spark, folder):
    return profile.outliers(table(spark, folder, "events"), ["value", "user_id"])


@query(
    "profile_describe",
    f"""
SELECT feature, count(value) AS count, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std,
  round(min(value), 3) AS min, round(quantile_cont(value, 0.25), 3) AS p25,
  round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.75), 3) AS p75,
  round(max(value), 3) AS max FROM {_LONG} GROUP BY feature""",
)
def profile_describe(spark, folder):
    return profile.describe(line_items(spark, folder), LINE)


@query(
    "profile_indicators",
    """SELECT count(*) AS samples, CAST(4 AS BIGINT) AS features, count(DISTINCT l_returnflag) AS classes
FROM lineitem""",
)
def profile_indicators(spark, folder):
    return profile.indicators(table(spark, folder, "lineitem"), LINE, "l_returnflag")


@query(
    "feature_ranges",
    """
WITH long AS (SELECT 'p_size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part
  UNION ALL SELECT 'p_retailprice', p_retailprice FROM part UNION ALL SELECT 'constant', 7.0 FROM part),
sp AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
wide AS (SELECT feature, CASE WHEN lo = hi THEN lo - 1 ELSE lo END AS lo,
  CASE WHEN lo = hi THEN hi + 1 ELSE hi END AS hi FROM sp),
ends AS (SELECT feature, lo - (hi - lo) * 0.1 AS s, hi + (hi - lo) * 0.1 AS e FROM wide)
SELECT feature, round(s, 6) AS start, round(e, 6) AS "end", round(greatest((e - s) / 200, 1e-6), 6) AS step
FROM ends""",
)
def feature_ranges(spark, folder):
    part = table(spark, folder, "part").withColumn("constant", F.lit(7.0))
    ranges = profile.feature_ranges(part, ["p_size", "p_retailprice", "constant"])
    return ranges.select("feature", *[F.round(c, 6).alias(c) for c in ("start", "end", "step")])


@query(
    "infer_roles",
    """
WITH m AS (SELECT avg(length(coalesce(text, 'nan'))) AS t, avg(length(coalesce(lang, 'nan'))) AS l,
  avg(length(coalesce(source, 'nan'))) AS s, count(DISTINCT doc_id) AS d, count(DISTINCT text) AS dt,
  count(DISTINCT lang) AS dl, count(DISTINCT source) AS ds FROM documents)
SELECT 'label' AS role, CASE WHEN d BETWEEN 2 AND 20 THEN 'doc_id' WHEN dt BETWEEN 2 AND 20 THEN 'text'
  WHEN dl BETWEEN 2 AND 20 THEN 'lang' WHEN ds BETWEEN 2 AND 20 THEN 'source' END AS "column" FROM m
UNION ALL SELECT 'text', CASE WHEN t > 50 THEN 'text' WHEN l > 50 THEN 'lang' WHEN s > 50 THEN 'source' END FROM m
UNION ALL SELECT 'feature', unnest(['doc_id', 'n_chars'])""",
)
def infer_roles(spark, folder):
    return roles.roles_frame(table(spark, folder, "documents"))


@query(
    "training_check",
    """
WITH m AS (SELECT count(*) AS n, count(DISTINCT label) AS c FROM embeddings),
r AS (SELECT 1 AS seq, 'features' AS "check", true AS ok, '' AS detail FROM m
UNION ALL SELECT 2, 'label', true, '' FROM m UNION ALL SELECT 3, 'label_present', true, '' FROM m
UNION ALL SELECT 4, 'features_present', true, '' FROM m
UNION ALL SELECT 5, 'rows', n > 0, 'rows=' || n FROM m
UNION ALL SELECT 6, 'min_samples', n >= 10, 'min=10' FROM m
UNION ALL SELECT 7, 'classes', c >= 2, 'classes=' || c FROM m
UNION ALL SELECT 8, 'split', n - floor(n * 0.2) >= 2 AND floor(n * 0.2) >= 1,
  'train=' || CAST(n - floor(n * 0.2) AS BIGINT) || ' test=' || CAST(floor(n * 0.2) AS BIGINT) FROM m)
SELECT * FROM r""",
)
def training_check(spark, folder):
    return roles.training_check(table(spark, folder, "embeddings"), ["vec_id"], "label")


# -- transforms ------------------------------------------------------------------------------------
_STATS = "(SELECT avg(p_size) AS a1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS a2, stddev_pop(p_retailprice) AS s2, min(p_size) AS lo1, max(p_size) AS hi1, min(p_retailprice) AS lo2, max(p_retailprice) AS hi2 FROM part)"


@query(
    "scale_standard",
    f"""SELECT p_partkey, round((p_size - a1) / s1, 6) + 0.0 AS p_size, round((p_retailprice - a2) / s2, 6) + 0.0 AS p_retailprice,
  0.0::DOUBLE AS constant FROM part, {_STATS}""",
)
def scale_standard(spark, folder):
    return _scaled(spark, folder, "standard")


@query(
    "scale_minmax",
    f"""SELECT p_partkey, round((p_size - lo1) / (hi1 - lo1), 6) AS p_size,
  round((p_retailprice - lo2) / (hi2 - lo2), 6) AS p_retailprice, 0.0::DOUBLE AS constant FROM part, {_STATS}""",
)
def scale_minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


def _scaled(spark, folder, method):
    part = table(spark, folder, "part").withColumn("constant", F.lit(7.0))
    columns = ["p_size", "p_retailprice", "constant"]
    scaled = transforms.normalize(part, method, columns)
    return scaled.select("p_partkey", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns])


@query(
    "impute_mean",
    f"""
WITH i AS {_ITEMS}, m AS (SELECT avg(l_discount) AS a FROM i)
SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, a), 6) AS l_discount, 0.0::DOUBLE AS empty FROM i, m""",
)
def impute_mean(spark, folder):
    rows = line_items(spark, folder).withColumn("empty", F.lit(None).cast("double"))
    filled = transforms.impute_mean(rows, ["l_discount", "empty"])
    return filled.select(
        "l_orderkey", "l_linenumber", F.round("l_discount", 6).alias("l_discount"), "empty"
    )


@query(
    "feature_embedding",
    """WITH m AS (SELECT avg(nullif(p_size, 1)) AS a FROM part)
SELECT p_partkey, round(CAST(CAST(coalesce(nullif(p_size, 1), a) AS FLOAT) AS DOUBLE), 4) AS e0,
  round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 4) AS e1 FROM part, m""",
)
def feature_embedding(spark, folder):
    part = table(spark, folder, "part").withColumn("p_size", F.nullif("p_size", F.lit(1)))
    rows = transforms.feature_embedding(part, ["p_size", "p_retailprice"])
    return rows.select(
        "p_partkey",
        *[F.round(F.col("embedding")[i].cast("double"), 4).alias(f"e{i}") for i in range(2)],
    )


# -- predicates ------------------------------------------------------------------------------------
_FILTERS = {
    "filter_expr_compare": (
        "l_quantity > 45 and l_discount <= 0.02 & l_returnflag == 'R'",
        f"FROM {_ITEMS} WHERE l_quantity > 45 AND l_discount <= 0.02 AND l_returnflag = 'R'",
    ),
    "filter_expr_not_equal": (
        "l_discount != 0.05",
        f"FROM {_ITEMS} WHERE l_discount IS DISTINCT FROM 0.05",
    ),
    "filter_expr_not": (
        "not (l_discount > 0.02) and l_tax >= 0.07",
        f"FROM {_ITEMS} WHERE (l_discount IS NULL OR l_discount <= 0.02) AND l_tax >= 0.07",
    ),
    "filter_expr_in": (
        "l_returnflag in ('A', 'N') | ~(l_linestatus == 'O')",
        f"FROM {_ITEMS} WHERE l_returnflag IN ('A', 'N') OR l_linestatus <> 'O'",
    ),
    "filter_expr_not_in": (
        "l_discount not in (0.01, 0.02, 0.03)",
        f"FROM {_ITEMS} WHERE l_discount IS NULL OR l_discount NOT IN (0.01, 0.02, 0.03)",
    ),
    "filter_expr_modulo": (
        "l_linenumber % -3 == -2 or l_partkey % 4 == 1",
        f"FROM {_ITEMS} WHERE (l_linenumber % 3 = 1) OR l_partkey % 4 = 1",
    ),
    "filter_expr_chained": (
        "10 < l_quantity <= 12.5 and l_extendedprice / l_quantity > 1500",
        f"FROM {_ITEMS} WHERE 10 < l_quantity AND l_quantity <= 12.5 AND l_extendedprice / l_quantity > 1500",
    ),
}


def _register_filter(name, text, tail):
    keys = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount"

    @query(name, f"SELECT {keys} {tail}")
    def run(spark, folder):
        return filter_expr(line_items(spark, folder), text).select(*keys.split(", "))


for _name, (_text, _tail) in _FILTERS.items():
    _register_filter(_name, _text, _tail)


@query(
    "filter_summary",
    """SELECT 'event_type == ''click'' and value > 100' AS expression,
  count(*) FILTER (event_type = 'click' AND value > 100) AS matches, count(*) AS total FROM events""",
)
def filter_matches(spark, folder):
    return filter_summary(table(spark, folder, "events"), "event_type == 'click' and value > 100")


@query(
    "raster2d",
    """
WITH s AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1
  FROM lineitem)
SELECT CAST(least(99, floor((l_quantity - x0) / (x1 - x0) * 100)) AS INTEGER) AS px,
  CAST(least(99, floor((l_extendedprice - y0) / (y1 - y0) * 100)) AS INTEGER) AS py,
  l_returnflag AS category, count(*) AS n FROM lineitem, s GROUP BY ALL""",
)
def raster2d(spark, folder):
    return evaluate.raster(
        table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", 100, 100, "l_returnflag"
    )

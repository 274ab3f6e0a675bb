"""Drift between line items, orders and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from mldiag.operators import drift
from mldiag.plans.registry import query, table
from mldiag.session import shared_folder
from mldiag.streaming import drift_stream

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
BOUNDARY = "1998-05-24"


def _long(features: Sequence[str], tab: str, where: str, side: str, scale: dict[str, str] = {}) -> str:
    parts = [
        f"SELECT '{f}' AS feature, CAST({scale.get(f, f)} AS DOUBLE) AS value, '{side}' AS side"
        f" FROM {tab} WHERE {where}"
        for f in features
    ]
    return " UNION ALL ".join(f"({p})" for p in parts)


def scores_sql(long: str) -> str:
    """KS statistic and p-value, PSI over reference deciles, for a long (feature, value, side) query."""
    edges = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"""
WITH long AS ({long}),
clean AS (SELECT * FROM long WHERE value IS NOT NULL),
tot AS (SELECT feature, count(*) FILTER (side = 'ref') AS nr, count(*) FILTER (side = 'prod') AS np
  FROM clean GROUP BY feature),
cnt AS (SELECT feature, value, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'prod') AS p
  FROM clean GROUP BY feature, value),
cum AS (SELECT feature, value, sum(r) OVER w AS cr, sum(p) OVER w AS cp FROM cnt
  WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT c.feature, max(abs(cr::DOUBLE * np - cp::DOUBLE * nr) / (nr::DOUBLE * np)) AS d,
  max(nr) AS nr, max(np) AS np FROM cum c JOIN tot USING (feature) GROUP BY c.feature),
arg AS (SELECT feature, d, nr, np, round(nr::DOUBLE * np / (nr + np)) AS n FROM ks),
lam AS (SELECT *, sqrt(n) * d + 1 / (6 * sqrt(n)) + (sqrt(n) * d - 1) / (4 * n) AS l FROM arg),
pv AS (SELECT feature, d, nr, np, CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * (
  SELECT sum((CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * l * l))
  FROM generate_series(1, 100) AS g(j)))) END AS p FROM lam),
edge AS (SELECT feature, list_distinct(quantile_cont(value, [{edges}])) AS e
  FROM clean WHERE side = 'ref' GROUP BY feature),
binned AS (SELECT c.feature, side, len(list_filter(e, lambda x: x <= value)) AS bin
  FROM clean c JOIN edge USING (feature)),
slots AS (SELECT feature, unnest(generate_series(0, 9)) AS bin FROM edge),
shares AS (SELECT s.feature, s.bin,
  greatest(count(*) FILTER (side = 'ref') / max(nr), 1e-6) AS r,
  greatest(count(*) FILTER (side = 'prod') / max(np), 1e-6) AS p
  FROM slots s JOIN tot USING (feature) LEFT JOIN binned b ON b.feature = s.feature AND b.bin = s.bin
  GROUP BY s.feature, s.bin),
psi AS (SELECT feature, greatest(0.0, sum((p - r) * ln(p / r))) AS psi FROM shares GROUP BY feature)
SELECT pv.feature AS feature, round(d, 4) AS ks_statistic, round(p, 4) AS ks_pvalue,
  round(psi, 4) AS psi, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS drift
FROM pv JOIN psi USING (feature)"""


def _boundary():
    return F.lit(BOUNDARY).cast("timestamp_ntz")


_BEFORE = f"l_shipdate < TIMESTAMP '{BOUNDARY}'"
_AFTER = f"l_shipdate >= TIMESTAMP '{BOUNDARY}'"


@query(
    "drift_scores",
    scores_sql(
        _long(FEATURES, "lineitem", _BEFORE, "ref") + " UNION ALL " + _long(FEATURES, "lineitem", _AFTER, "prod")
    ),
)
def drift_scores(spark, folder):
    before, after = drift.split_at(table(spark, folder, "lineitem"), "l_shipdate", _boundary())
    return drift.drift_scores(before, after, FEATURES)


_SHIFT = {"l_extendedprice": "l_extendedprice * 1.2", "l_discount": "nullif(l_discount, 0.0)"}


@query(
    "drift_scores_shifted",
    scores_sql(
        _long(FEATURES, "lineitem", _BEFORE, "ref")
        + " UNION ALL "
        + _long(FEATURES, "lineitem", _AFTER, "prod", _SHIFT)
    ),
)
def drift_scores_shifted(spark, folder):
    before, after = drift.split_at(table(spark, folder, "lineitem"), "l_shipdate", _boundary())
    after = after.withColumns(
        {
            "l_extendedprice": F.col("l_extendedprice") * 1.2,
            "l_discount": F.nullif("l_discount", F.lit(0.0)),
        }
    )
    return drift.drift_scores(before, after, FEATURES)


_ORDERED = """(SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rk,
  count(*) OVER () AS n FROM orders)"""


@query(
    "drift_half_split",
    scores_sql(
        _long(["o_totalprice"], _ORDERED, "rk < n // 2", "ref")
        + " UNION ALL "
        + _long(["o_totalprice"], _ORDERED, "rk >= n // 2", "prod")
    ),
)
def drift_half_split(spark, folder):
    first, rest = drift.half_split(table(spark, folder, "orders"), "o_orderdate", "o_orderkey")
    return drift.drift_scores(first, rest, ["o_totalprice"])


def temporal_sql(tab: str, features: Sequence[str], time: str, key: str) -> str:
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in features)
    return f"""
WITH ranked AS (SELECT {cols}, row_number() OVER (ORDER BY {time}, {key}) - 1 AS rk, count(*) OVER () AS n
  FROM {tab}),
sized AS (SELECT *, least(20, n // 10) AS k FROM ranked),
win AS (SELECT *, CASE WHEN rk < (n % k) * (n // k + 1) THEN rk // (n // k + 1)
  ELSE (n % k) + (rk - (n % k) * (n // k + 1)) // (n // k) END AS w FROM sized),
long AS (UNPIVOT (SELECT w, {', '.join(features)} FROM win) ON {', '.join(features)} INTO NAME feature VALUE value),
ref_cnt AS (SELECT feature, value, count(*) AS r FROM long GROUP BY feature, value),
refc AS (SELECT feature, value, sum(r) OVER (PARTITION BY feature ORDER BY value) AS cr, r,
  sum(r) OVER (PARTITION BY feature) AS nr FROM ref_cnt),
wc AS (SELECT w, feature, value, count(*) AS c FROM long GROUP BY w, feature, value),
wcum AS (SELECT *, sum(c) OVER (PARTITION BY w, feature ORDER BY value) AS cw,
  sum(c) OVER (PARTITION BY w, feature) AS nw FROM wc),
ks AS (SELECT w, feature, max(greatest(abs(cr / nr - cw / nw), abs((cr - r) / nr - (cw - c) / nw))) AS ks
  FROM wcum JOIN refc USING (feature, value) WHERE nw > 1 GROUP BY w, feature)
SELECT CAST(w AS INTEGER) AS "window", round(avg(ks), 4) AS mean_ks, round(max(ks), 4) AS max_ks
FROM ks GROUP BY w"""


@query("drift_temporal", temporal_sql("events", ["value", "user_id"], "ts", "event_id"))
def drift_temporal(spark, folder):
    events = table(spark, folder, "events")
    return drift.temporal_drift(events, events, "ts", "event_id", ["value", "user_id"])


SIX = {
    "value": "value",
    "user_id": "user_id",
    "half": "value / 2",
    "late": "event_id % 7",
    "double": "user_id * 2",
    "steady": "event_id",
}
_SIX_EVENTS = "(SELECT event_id AS key, ts, " + ", ".join(f"{e} AS {n}" for n, e in SIX.items()) + " FROM events)"


@query("drift_temporal_six", temporal_sql(_SIX_EVENTS, list(SIX), "ts", "key"))
def drift_temporal_six(spark, folder):
    """Six features, of which only the sixth moves with time."""
    events = table(spark, folder, "events")
    rows = events.select(F.col("event_id").alias("key"), "ts", *[F.expr(e).alias(n) for n, e in SIX.items()])
    return drift.temporal_drift(rows, rows, "ts", "key", list(SIX))


@query("drift_temporal_tied", temporal_sql("orders", ["o_totalprice"], "o_orderstatus", "o_orderkey"))
def drift_temporal_tied(spark, folder):
    """Windows over a column where a third of all rows share one value."""
    orders = table(spark, folder, "orders")
    return drift.temporal_drift(orders, orders, "o_orderstatus", "o_orderkey", ["o_totalprice"])


def density_sql(long: str) -> str:
    return f"""
WITH long AS ({long}),
sp AS (SELECT feature, side, count(*) AS total, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi
  FROM long WHERE value IS NOT NULL GROUP BY feature, side HAVING count(*) > 1 AND max(value) > min(value)),
st AS (SELECT *, sd * pow(total::DOUBLE, -0.2) AS h, (hi - lo) / 1024 AS w FROM sp),
bins AS (SELECT feature, side, least(1023, floor((value - lo) / w)) AS bin, count(*) AS n
  FROM long JOIN st USING (feature, side) GROUP BY ALL),
grid AS (SELECT *, lo + g * ((hi - lo) / 99) AS x FROM st, generate_series(0, 99) AS s(g))
SELECT feature, side, CAST(g AS INTEGER) AS grid, round(max(x), 6) AS x,
  round(sum(n * exp(-0.5 * ((x - (lo + (bin + 0.5) * w)) / h) * ((x - (lo + (bin + 0.5) * w)) / h)))
    / max(total * h * sqrt(2.0 * pi())), 9) AS density
FROM grid JOIN bins USING (feature, side) GROUP BY feature, side, g"""


@query(
    "density_by_side",
    density_sql(
        _long(FEATURES, "lineitem", _BEFORE, "reference")
        + " UNION ALL "
        + _long(FEATURES, "lineitem", _AFTER, "production")
    ),
)
def density_by_side(spark, folder):
    before, after = drift.split_at(table(spark, folder, "lineitem"), "l_shipdate", _boundary())
    return drift.side_densities(before, after, FEATURES)


@query(
    "reference_bins",
    """
WITH long AS (UNPIVOT (SELECT o_totalprice FROM orders) ON o_totalprice INTO NAME feature VALUE value),
edge AS (SELECT feature, count(*) AS total,
  list_sort(list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS e FROM long GROUP BY feature),
slots AS (SELECT feature, total, e, unnest(generate_series(0, len(e))) AS bin FROM edge),
got AS (SELECT l.feature, len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS n
  FROM long l JOIN edge USING (feature) GROUP BY ALL)
SELECT s.feature, CAST(s.bin AS INTEGER) AS bin, round(coalesce(n, 0) / total, 6) AS share,
  round(CASE WHEN s.bin = 0 THEN NULL ELSE e[s.bin] END, 6) AS lower_edge
FROM slots s LEFT JOIN got g ON g.feature = s.feature AND g.bin = s.bin""",
)
def reference_bins(spark, folder):
    bins = drift.reference_bins(table(spark, folder, "orders"), ["o_totalprice"])
    return bins.select(
        "feature",
        "bin",
        F.round("share", 6).alias("share"),
        F.round(F.get("edges", F.col("bin") - 1), 6).alias("lower_edge"),
    )


# -- streams -------------------------------------------------------------------------------------
# Folders are written and drained one after the other, each a micro-batch of as many files as the table has parts: all events but the
# last day's, half of the last day's, the other half with one row that is years late (rows are late by the watermark of the batch
# before), and a row that moves the watermark past every window, so that all of them are emitted.
_LATE = "2001-01-01 00:00:00"


def _event_parts(spark, folder):
    events = table(spark, folder, "events")
    last = F.date_trunc("day", events.agg(F.max("ts").alias("t")).scalar())
    late = events.where("event_id = 0").withColumn("ts", F.lit(_LATE).cast(events.schema["ts"].dataType))
    end = events.where("event_id = 0").withColumn(
        "ts", F.lit("2100-01-01 00:00:00").cast(events.schema["ts"].dataType)
    )
    final, even = F.col("ts") >= last, F.col("event_id") % 2 == 0
    return (
        events.where(~final),
        events.where(final & even),
        events.where(final & ~even).unionByName(late),
        end,
    )


def _run(spark, folder, name, counted):
    """Drain a stream of events, whose closed windows are appended to a table in the shared folder."""
    base, source = shared_folder(spark, name), shared_folder(spark, "events")
    parts = _event_parts(spark, folder)
    files = None
    for number, rows in enumerate(parts):
        rows.write.parquet(f"{source}/{number}")
        if files is None:
            reader = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
            files = counted(reader.parquet(source))
        run = (
            files.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{base}/counts")
            .option("checkpointLocation", f"{base}/progress")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return spark.read.schema(files.schema).parquet(f"{base}/counts")


def _stream_psi(spark, folder, size, slide, name):
    events = table(spark, folder, "events")
    bins = drift.reference_bins(events, ["value"])
    edges = {r["feature"]: r["edges"] for r in bins.select("feature", "edges").distinct().collect()}
    counts = _run(spark, folder, name, lambda events: drift_stream.bin_counts(events, "ts", edges, size, slide))
    psi = drift_stream.window_psi(counts, bins)
    return psi.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def stream_psi_sql(windows: str) -> str:
    return f"""
WITH edge AS (SELECT list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e,
  count(*) AS total FROM events WHERE value IS NOT NULL),
rows_ AS (SELECT w, len(list_filter(e, lambda x: x <= value)) AS bin
  FROM (SELECT value, unnest({windows}) AS w FROM events WHERE value IS NOT NULL), edge),
refs AS (SELECT len(list_filter(e, lambda x: x <= value)) AS bin, count(*) / max(total) AS share
  FROM events, edge WHERE value IS NOT NULL GROUP BY 1),
tot AS (SELECT w, count(*) AS n FROM rows_ GROUP BY w),
cnt AS (SELECT w, bin, count(*) AS c FROM rows_ GROUP BY w, bin),
sh AS (SELECT t.w, t.n, greatest(r.share, 1e-6) AS r, greatest(coalesce(c, 0) / t.n, 1e-6) AS p
  FROM tot t CROSS JOIN refs r LEFT JOIN cnt ON cnt.w = t.w AND cnt.bin = r.bin)
SELECT 'value' AS feature, strftime(w, '%Y-%m-%d %H:%M:%S') AS start, max(n) AS n,
  round(greatest(0.0, sum((p - r) * ln(p / r))), 4) AS psi FROM sh GROUP BY w"""


@query("stream_psi", stream_psi_sql("[date_trunc('day', ts)]"))
def stream_psi(spark, folder):
    return _stream_psi(spark, folder, "1 day", None, "stream_psi_counts")


@query(
    "stream_psi_sliding",
    stream_psi_sql("[date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]"),
)
def stream_psi_sliding(spark, folder):
    return _stream_psi(spark, folder, "2 days", "1 day", "stream_psi_sliding_counts")


@query(
    "stream_class_counts",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n
FROM events GROUP BY ALL""",
)
def stream_class_counts(spark, folder):
    counts = _run(spark, folder, "stream_class_counts", lambda events: drift_stream.class_counts(events, "ts", ["event_type"]))
    return counts.withColumn(
        "start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")
    )


@query(
    "stream_confusion_counts",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS label,
CASE WHEN value > 10 THEN 'purchase' ELSE 'click' END AS prediction, count(*) AS n FROM events GROUP BY ALL""",
)
def stream_confusion_counts(spark, folder):
    predicted = F.when(F.col("value") > 10, "purchase").otherwise("click")
    names = {"label": F.col("event_type"), "prediction": predicted}
    counts = _run(
        spark, folder, "stream_confusion_counts", lambda events: drift_stream.class_counts(events.withColumns(names), "ts", ["label", "prediction"])
    )
    return counts.withColumn(
        "start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")
    )


@query(
    "stream_ks",
    """
WITH long AS (SELECT date_trunc('day', ts) AS w, 'value' AS feature, CAST(value AS DOUBLE) AS value FROM events WHERE value IS NOT NULL
  UNION ALL SELECT date_trunc('day', ts), 'user_id', CAST(user_id AS DOUBLE) FROM events WHERE user_id IS NOT NULL),
refc AS (SELECT feature, value, count(*) AS r, sum(count(*)) OVER (PARTITION BY feature ORDER BY value) AS cr,
  sum(count(*)) OVER (PARTITION BY feature) AS nr FROM long GROUP BY feature, value),
wc AS (SELECT w, feature, value, count(*) AS c, sum(count(*)) OVER (PARTITION BY w, feature ORDER BY value) AS cw,
  sum(count(*)) OVER (PARTITION BY w, feature) AS nw FROM long GROUP BY w, feature, value),
ks AS (SELECT w, feature, max(nr) AS nr, max(nw) AS nw, max(greatest(abs(cr / nr - cw / nw), abs((cr - r) / nr - (cw - c) / nw))) AS d
  FROM wc JOIN refc USING (feature, value) WHERE nw > 1 GROUP BY w, feature),
arg AS (SELECT *, round(nr::DOUBLE * nw / (nr + nw)) AS m FROM ks),
lam AS (SELECT *, sqrt(m) * d + 1 / (6 * sqrt(m)) + (sqrt(m) * d - 1) / (4 * m) AS l FROM arg),
pv AS (SELECT *, CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * (
  SELECT sum((CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * l * l)) FROM generate_series(1, 100) AS g(j)))) END AS p FROM lam)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, feature, CAST(nw AS BIGINT) AS n, round(d, 4) AS ks_statistic,
  round(p, 4) AS ks_pvalue, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS drift FROM pv""",
)
def stream_ks(spark, folder):
    """Every closed day of the stream against all events, by exact distances."""
    features = ["value", "user_id"]
    reference = drift.reference_counts(table(spark, folder, "events"), features)
    counts = _run(spark, folder, "stream_ks_counts", lambda events: drift_stream.value_counts(events, "ts", features))
    return drift_stream.window_ks(counts, reference).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))

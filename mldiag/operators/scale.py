"""Building blocks that keep ranks, cumulative sums and quantiles distributed.

A window without a partition, or one partitioned only by a feature or a class, would send all rows of
a feature to one task, and an exact percentile aggregate would hold all its distinct values in one
buffer. Here rows are first collapsed to distinct values (with map-side combine), then cut into value
ranges; each range is one small window and a tiny table of range totals supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mldiag.functions.columns import as_double, hash_fraction_key, hash_number, ref

_FANOUT = 32
MAX_RANGES = 4096
BROADCAST_ROWS = 500_000


def range_count(spark: SparkSession, most: int = MAX_RANGES) -> int:
    """Value ranges per group: twice the shuffle partitions, so that hashing them fills every task.

    `most` bounds the sketch of cut points; pass `n_ranges` to go beyond it.
    """
    return max(4, min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), most))


def unpivot_features(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Wide numeric columns to long (keep..., feature, value); missing values are left out."""
    cast = df.select(*[ref(k) for k in keep], *[as_double(f).alias(f) for f in features])
    long = cast.unpivot([ref(k) for k in keep], [ref(f) for f in features], "feature", "value")
    return long.where(F.col("value").isNotNull())


def sort_key(df: DataFrame, name: str) -> Column:
    """What a sort column is cut by: itself, or a number for a boolean."""
    return ref(name).cast("int") if isinstance(df.schema[name].dataType, T.BooleanType) else ref(name)


def _cut_points(df: DataFrame, parts: Sequence[str], order: str, n: int) -> Column:
    """Aggregate: about n - 1 sorted cut points of `order`, from a quantile sketch.

    Text has no sketch: its cut points are every so-manieth of a hashed sample, compared as whole texts, so
    that ids with a long common start are cut like any others.
    """
    if not isinstance(df.schema[order].dataType, T.StringType):
        probabilities = [i / n for i in range(1, n)]
        return F.array_sort(F.percentile_approx(sort_key(df, order), probabilities, max(1000, 20 * n)))
    total = max(df.count(), 1)
    draw = F.pmod(F.xxhash64(ref(order)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = F.sort_array(F.collect_set(F.when(draw < min(1.0, 20 * n / total), ref(order))))  # about 20 n values
    every = F.transform(
        F.sequence(F.lit(1), F.lit(n - 1)),
        lambda i: F.get(sample, F.floor(i * F.size(sample) / F.lit(n)).cast("int")),
    )
    return F.array_distinct(F.filter(every, lambda c: c.isNotNull()))


def _few(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast a table only if its size is known and small; else the optimiser decides by what it measures."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def _range_of(key: Column, cuts: Column, coarse: Column) -> Column:
    """How many cut points lie below the key: a two-level search over the sorted cut array."""
    block = F.size(F.filter(coarse, lambda c: c < key))
    inner = F.slice(cuts, block * _FANOUT + 1, F.lit(_FANOUT))
    return block * _FANOUT + F.size(F.filter(inner, lambda c: c < key))


def global_cumsum(
    df: DataFrame,
    parts: Sequence[str],
    order: str,
    values: Sequence[str],
    n_ranges: int | None = None,
    n_parts: int | None = None,
) -> DataFrame:
    """Running sums of `values` by `order` inside each part.

    Adds `cum_<value>` (inclusive) and `total_<value>` (the part's sum). `order` must be distinct
    inside a part: collapse duplicates first. Parts without weight are left out.

    Rows are shuffled once, by (part, value range); the range totals and the running sums both read
    that shuffle. To keep it shareable every branch reads every column, which is why range totals
    also look at `order` and the cut points at `values`. Callers should use all running sums.
    """
    n = n_ranges or range_count(df.sparkSession)
    probabilities = [i / n for i in range(1, n)]
    key = sort_key(df, order)
    weight = reduce(or_, [F.col(f"_w{i}") > 0 for i in range(len(values))])
    cuts = (
        df.groupBy(*[ref(p) for p in parts])
        .agg(
            _cut_points(df, parts, order, n).alias("_cuts"),
            *[F.sum(ref(v)).alias(f"_w{i}") for i, v in enumerate(values)],
        )
        .where(weight)
        .select(
            *[ref(p) for p in parts],
            "_cuts",
            F.filter("_cuts", lambda _, i: (i + 1) % _FANOUT == 0).alias("_coarse"),
        )
    )
    if parts:
        # one row of n cut points per part
        keyed = df.join(_few(cuts, n_parts and n_parts * n // 8), list(parts))
    else:
        one = cuts.select(F.struct("_cuts", "_coarse").alias("s")).scalar()
        keyed = df.withColumn("_s", one).select(
            "*", F.col("_s._cuts").alias("_cuts"), F.col("_s._coarse").alias("_coarse")
        ).drop("_s")
    keys = [*[ref(p) for p in parts], F.col("_range")]
    ranged = (
        keyed.withColumn(
            # never NULL: a null check inferred for one branch only would split the shared shuffle
            "_range", F.coalesce(_range_of(key, F.col("_cuts"), F.col("_coarse")), F.lit(0))
        )
        .drop("_cuts", "_coarse")
        .repartition(*keys)
    )
    sums = (
        ranged.groupBy(*keys)
        .agg(F.max(ref(order)).alias("_last"), *[F.sum(ref(v)).alias(f"_sum_{v}") for v in values])
        .where(F.col("_last").isNotNull())
    )
    whole = Window.partitionBy(*[ref(p) for p in parts])
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most (parts x ranges) rows, whatever the data size
    offsets = sums.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(whole).alias(f"total_{v}") for v in values],
    )
    inside = Window.partitionBy(*keys).orderBy(ref(order)).rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.join(_few(offsets, (n_parts or (None if parts else 1)) and (n_parts or 1) * n), [*parts, "_range"])
    return running.withColumns(
        {f"cum_{v}": F.col(f"_off_{v}") + F.sum(ref(v)).over(inside) for v in values}
    ).drop("_range", *[f"_off_{v}" for v in values])


def spread(df: DataFrame, id_col: str) -> DataFrame:
    """Cut rows into as many partitions as the session shuffles into, for work that costs far more
    per row than moving it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, ref(id_col))


def global_rank(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """1-based position by `order`, a column with distinct values (a key)."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = global_cumsum(counted, [], order, ["_one"])
    return ranked.withColumnRenamed("cum__one", name).drop("_one", "total__one")


def rank_picks(
    running: DataFrame,
    part: str,
    weight: str,
    probabilities: Sequence[float],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact linear-interpolation quantiles per part from a running-sum table.

    `running` holds (part, value, weight, cum_weight, total_weight). `extra` aggregates ride along
    in the same pass. Returns (part, total, quantiles, extra...).
    """
    picks = []
    for i, p in enumerate(probabilities):
        for side, rounding in (("lo", "floor"), ("hi", "ceil")):
            rank = f"{rounding}((total_{weight} - 1) * {float(p)}D)"
            hit = f"cum_{weight} - {weight} <= {rank} and {rank} < cum_{weight}"
            picks.append(F.expr(f"max(case when {hit} then value end) as _{side}_{i}"))
    wide = running.groupBy(ref(part)).agg(
        F.expr(f"max(total_{weight}) as total"), *picks, *extra
    )
    between = ", ".join(
        f"_lo_{i} + (_hi_{i} - _lo_{i})"
        f" * ((total - 1) * {float(p)}D - floor((total - 1) * {float(p)}D))"
        for i, p in enumerate(probabilities)
    )
    spent = [f"_{side}_{i}" for i in range(len(probabilities)) for side in ("lo", "hi")]
    return wide.withColumn("quantiles", F.expr(f"array({between})")).drop(*spent)


def exact_quantiles(
    long: DataFrame,
    probabilities: Sequence[float],
    part: str = "feature",
    extra: Sequence[Column] = (),
    n_parts: int | None = None,
) -> DataFrame:
    """(part, total, quantiles, extra...) of a long (part, value) table, by numpy's linear rule.

    `extra` aggregates see one row per distinct `value` with its count `n`.
    """
    counts = long.groupBy(ref(part), F.col("value")).agg(F.count(F.lit(1)).alias("n"))
    running = global_cumsum(counts, [part], "value", ["n"], n_parts=n_parts)
    return rank_picks(running, part, "n", probabilities, extra)


def window_starts(total: int, n_windows: int) -> list[int]:
    """0-based first positions of equal-count windows 1.. (the first windows take the remainder)."""
    if n_windows < 2:
        return []
    size, rest = divmod(total, n_windows)
    return [w * size + min(w, rest) for w in range(1, n_windows)]


def _portable(column: Column, dtype: T.DataType) -> Column:
    """A collected boundary value that survives the round trip into a literal unchanged."""
    return F.unix_micros(column) if isinstance(dtype, T.TimestampType) else column.cast("string")


def _literal(value, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(dtype)


def assign_windows(
    df: DataFrame,
    time_col: str,
    id_col: str,
    starts: Callable[[int], Sequence[int]],
    name: str = "window",
) -> DataFrame:
    """Cut rows ordered by (time, id) into consecutive windows and add the window number.

    `starts(total)` lists the 0-based start positions of windows 1, 2, .... Only these few boundary
    rows are located, by job, and become literals; a third of all rows may share one time stamp, and
    are then split by id. The rows themselves are compared with the boundaries and never shuffled.
    """
    time_type, id_type = df.schema[time_col].dataType, df.schema[id_col].dataType
    known = df.where(ref(time_col).isNotNull())
    times = known.groupBy(ref(time_col).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    total = times.agg(F.sum("n")).first()[0] or 0
    positions = [s for s in starts(total) if 0 <= s < total]
    number = F.lit(0)
    if positions:
        inside = F.filter(
            F.array(*[F.lit(s).cast("bigint") for s in positions]),
            lambda s: (s >= F.col("cum_n") - F.col("n")) & (s < F.col("cum_n")),
        )
        hits = (
            global_cumsum(times, [], "t", ["n"])
            .select("t", "n", F.transform(inside, lambda s: s - F.col("cum_n") + F.col("n")).alias("at"))
            .where(F.size("at") > 0)
            .select(_portable(F.col("t"), time_type).alias("t"), "n", "at")
            .collect()  # no more rows than boundaries
        )
        stamps = {hit["t"]: [offset for offset in hit["at"] if offset > 0] for hit in hits}
        first = _ids_at(known, time_col, id_col, {t: at for t, at in stamps.items() if at})
        for hit in hits:
            stamp = _literal(hit["t"], time_type)
            later, now = ref(time_col) > stamp, ref(time_col) == stamp
            for offset in hit["at"]:
                here = now & (ref(id_col) >= _literal(first[hit["t"], offset], id_type)) if offset else now
                number = number + F.coalesce(later | here, F.lit(False)).cast("int")
    return df.withColumn(name, number)


def _ids_at(rows: DataFrame, time_col: str, id_col: str, wanted: dict) -> dict:
    """The ids at some 0-based positions in id order among the rows of each time stamp, by one job for all stamps."""
    if not wanted:
        return {}
    time_type, id_type = rows.schema[time_col].dataType, rows.schema[id_col].dataType
    here = F.lit(False)
    for stamp in wanted:
        here = here | (ref(time_col) == _literal(stamp, time_type))
    tied = rows.where(here).select(
        ref(time_col).alias("t"), ref(id_col).alias("i"), F.lit(1).cast("bigint").alias("n")
    )
    ranked = global_cumsum(tied, ["t"], "i", ["n"], n_parts=len(wanted))
    pick = F.lit(False)
    for stamp, offsets in wanted.items():
        ranks = F.col("cum_n").isin([offset + 1 for offset in offsets])
        pick = pick | ((F.col("t") == _literal(stamp, time_type)) & ranks)
    found = ranked.where(pick).select(
        _portable(F.col("t"), time_type).alias("t"), "cum_n", _portable(F.col("i"), id_type).alias("i")
    )
    return {(r["t"], r["cum_n"] - 1): r["i"] for r in found.collect()}  # no more rows than boundaries


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Reproducible sample of n rows: the n smallest md5(id:seed).

    Of large tables only the rows below a hash threshold, about twice as many as asked for, enter the top-k, so that
    its one merging task does not grow with the number of partitions.
    """
    key = hash_fraction_key(ref(id_col), seed)
    rows = df
    total = df.count()
    if total > 4 * n:
        limit = F.lit(f"{int(16**8 * min(1.0, (2 * n + 64) / total)):08x}")
        below = df.where(F.substring(key, 1, 8) < limit)
        rows = below if below.count() >= n else df
    return rows.orderBy(key, ref(id_col)).limit(n)


def hash_pairs(spark: SparkSession, n_pairs: int, n: Column, seed: int = 42) -> DataFrame:
    """`n_pairs` pseudo-random ordered pairs (i, j), i <> j, of positions below `n`.

    Never more pairs than there are unordered ones. `n` is a scalar column.
    """
    draws = spark.range(n_pairs).withColumn("n", n.cast("bigint"))
    draws = draws.where((F.col("n") > 1) & (F.col("id") < F.floor(F.col("n") * (F.col("n") - 1) / 2)))
    key = F.col("id").cast("string")
    i = hash_number(F.concat(key, F.lit(f":i:{seed}"))) % F.col("n")
    j = hash_number(F.concat(key, F.lit(f":j:{seed}"))) % (F.col("n") - 1)
    drawn = draws.select(F.col("id").alias("pair_id"), i.alias("i"), j.alias("j"))
    return drawn.withColumn("j", F.when(F.col("j") >= F.col("i"), F.col("j") + 1).otherwise(F.col("j")))

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mldiag.operators import scale


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_running_sums_match_numpy(spark):
    rng = np.random.RandomState(0)
    values = {p: np.unique(rng.randint(0, 5000, 800)) for p in "ab"}
    rows = pd.concat([pd.DataFrame({"p": p, "v": v, "n": rng.randint(1, 9, len(v))}) for p, v in values.items()])
    out = scale.global_cumsum(spark.createDataFrame(rows), ["p"], "v", ["n"], n_ranges=70).toPandas()
    want = rows.sort_values(["p", "v"]).assign(c=lambda d: d.groupby("p")["n"].cumsum())
    got = out.sort_values(["p", "v"])
    assert got["cum_n"].tolist() == want["c"].tolist()
    assert (got["total_n"] == got.groupby("p")["n"].transform("sum")).all()


def test_no_window_over_a_whole_feature(spark):
    df = frame(spark, p=["a"] * 50, v=np.arange(50.0), n=[1] * 50)
    plan = scale.global_cumsum(df, ["p"], "v", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "currentrow" in line]
    assert sums and all("_range" in line for line in sums)


def test_rank_by_text_and_number(spark):
    keys = [f"k{i:04d}" for i in np.random.RandomState(1).permutation(300)]
    ranked = scale.global_rank(frame(spark, k=keys), "k").toPandas().sort_values("rank")
    assert ranked["k"].tolist() == sorted(keys)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_quantiles_equal_numpy(spark, size):
    values = np.random.RandomState(size).randint(0, 50, size).astype(float)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    long = frame(spark, feature=["x"] * size, value=values)
    got = scale.exact_quantiles(long, probabilities).first()["quantiles"]
    assert np.allclose(got, np.percentile(values, [p * 100 for p in probabilities]))


def test_windows_split_ties_by_id(spark):
    df = frame(spark, t=[5] * 60 + list(range(6, 46)), i=list(range(100)))
    cut = scale.assign_windows(df, "t", "i", lambda n: scale.window_starts(n, 7))
    sizes = cut.groupBy("window").count().toPandas().sort_values("window")["count"].tolist()
    assert sizes == [len(a) for a in np.array_split(range(100), 7)]
    spans = cut.groupBy("window").agg(F.min("i").alias("a"), F.max("i").alias("b")).toPandas().sort_values("window")
    assert (spans["b"].to_numpy()[:-1] < spans["a"].to_numpy()[1:]).all()


def test_pairs_are_distinct_positions(spark):
    pairs = scale.hash_pairs(spark, 200, F.lit(9)).toPandas()
    assert len(pairs) == 36 and (pairs["i"] != pairs["j"]).all()
    assert pairs[["i", "j"]].to_numpy().max() <= 8 and pairs[["i", "j"]].to_numpy().min() >= 0


def test_sample_is_reproducible(spark):
    df = frame(spark, i=list(range(100)))
    one = {r["i"] for r in scale.hash_sample(df, "i", 10).collect()}
    two = {r["i"] for r in scale.hash_sample(df.repartition(7), "i", 10).collect()}
    assert one == two and len(one) == 10


def test_text_ids_with_a_long_common_start_are_spread(spark):
    rows = spark.range(20_000).select(F.format_string("customer-%030d", F.col("id")).alias("id"))
    ranked = scale.global_rank(rows, "id")
    got = ranked.select("id", "rank", F.spark_partition_id().alias("p")).collect()
    assert sorted((r["id"], r["rank"]) for r in got) == [(f"customer-{i:030d}", i + 1) for i in range(20_000)]
    counted = rows.withColumn("_one", F.lit(1).cast("bigint"))
    cuts = counted.agg(scale._cut_points(counted, [], "id", 8).alias("c")).first()["c"]
    assert len(cuts) == 7
    sizes = [0] * 8
    for i in range(20_000):
        sizes[sum(c < f"customer-{i:030d}" for c in cuts)] += 1
    assert max(sizes) < 3 * 20_000 / 8


def test_samples_of_large_tables(spark):
    rows = spark.range(5_000)
    from hashlib import md5

    wanted = sorted(range(5_000), key=lambda i: (md5(f"{i}:42".encode()).hexdigest(), i))[:100]
    assert [r["id"] for r in scale.hash_sample(rows, "id", 100).collect()] == wanted

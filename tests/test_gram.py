import numpy as np
import pandas as pd
import pytest

from mldiag.operators import gram, profile
from mldiag.streaming import drift_stream


def _table(columns=500, rows=300):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(rows, columns)) + rng.normal(size=(rows, 1)) * np.linspace(0, 2, columns) + 1e6 * (np.arange(columns) % 3)
    x[rng.random(x.shape) < 0.1] = np.nan
    return pd.DataFrame(x, columns=[f"c {i}" for i in range(columns)])


def _matrix(got, names):
    return got.toPandas().pivot(index="x", columns="y", values="corr").astype(float).loc[names, names].to_numpy()


def test_many_columns_as_pairwise_complete(spark):
    rows = _table()
    names = list(rows.columns)
    df = spark.createDataFrame(rows)
    got = _matrix(profile.correlation(df, names), names)
    assert np.allclose(got, rows.corr().to_numpy(), atol=1e-3)
    few = names[:60]
    assert np.allclose(_matrix(gram.wide_correlation(df, few, strip=17), few), got[:60, :60])


def test_constant_empty_and_missing_columns(spark):
    names = [f"c{i}" for i in range(5)]
    data = pd.DataFrame({"c0": [0.1] * 6, "c1": [1.0, 2, 3, 4, 5, 6], "c2": [np.nan] * 6, "c3": [1.0, np.nan] * 3, "c4": [7e8, 7e8 + 1, 7e8, 7e8, 7e8, 7e8 + 1]})
    df = spark.createDataFrame(data).repartition(3)
    got = _matrix(gram.wide_correlation(df, names, strip=2), names)
    want = _matrix(profile.correlation(df, names), names)
    assert np.isnan(got[0]).all() and np.isnan(got[2]).all()
    assert np.allclose(got[1:, 1:], want[1:, 1:], equal_nan=True)
    none = gram.wide_correlation(df.where("false"), names).collect()
    assert len(none) == 25 and all(r["corr"] is None for r in none)
    with pytest.raises(ValueError):
        gram.wide_correlation(df, ["c0"])


def test_window_distances_against_other_values(spark):
    """Windows whose values the reference lacks; a window of one row and a feature without reference have no distance."""
    from mldiag.operators import drift

    rng = np.random.default_rng(2)
    ref = rng.normal(size=400)
    days = {f"2024-01-0{d}": rng.normal(0.3 * d, 1, 50 * d) for d in (1, 2, 3)} | {"2024-01-09": np.array([0.0])}
    rows = pd.DataFrame([(pd.Timestamp(day), v, 1.0) for day, values in days.items() for v in [*values, None]], columns=["ts", "a", "b"])
    counts = drift_stream.value_counts(spark.createDataFrame(rows), "ts", ["a", "b"])
    reference = drift.reference_counts(spark.createDataFrame(pd.DataFrame({"a": ref})), ["a"])
    got = {(str(r["start"])[:10], r["feature"]): r for r in drift_stream.window_ks(counts, reference).collect()}
    assert set(got) == {(f"2024-01-0{d}", "a") for d in (1, 2, 3)}
    for (day, _), row in got.items():
        values = days[day]
        grid = np.concatenate([ref, values])
        steps = [np.searchsorted(np.sort(x), grid, side="right") / len(x) for x in (ref, values)]
        assert row["n"] == len(values) and row["ks_statistic"] == pytest.approx(np.abs(steps[0] - steps[1]).max(), abs=6e-5)
    assert got["2024-01-03", "a"]["drift"] == "Yes"

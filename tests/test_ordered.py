"""The plans for hot keys give what the plain windows give, with a third of all rows on one key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumewalk.operators import ordered as od
from plumewalk.operators import series as se
from plumewalk.operators.quantile import average_ranks, quantiles


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        key = 0 if i % 3 == 0 else int(rng.integers(1, 12))
        rows.append((key, int(rng.integers(0, 40)), i, None if i % 4 == 1 else float(rng.integers(0, 9))))
    return spark.createDataFrame(rows, "k int, t int, id int, v double").repartition(5)


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.mark.parametrize("limit", [4, 17])
def test_prefix_sums(hot, limit):
    make = lambda n: od.prefix_sums(hot, ["k"], ["t", "id"], {"s": F.col("v"), "c": F.lit(1)}, limit=n)
    assert rows(make(limit), ["id", "s", "c"]) == rows(make(10_000), ["id", "s", "c"])


@pytest.mark.parametrize("limit", [4, 17])
def test_fill_gaps(hot, limit):
    make = lambda n: od.fill_gaps(hot, ["k"], ["t", "id"], ["v"], limit=n)
    assert rows(make(limit), ["id", "v"]) == rows(make(10_000), ["id", "v"])


@pytest.mark.parametrize("limit", [6, 17])
def test_sliding(hot, limit):
    def make(n):
        d, w, finish = od.sliding(hot, ["k"], ["t", "id"], before=4, after=2, limit=n)
        new = {"a": F.lag("id", 4).over(w), "b": F.lead("id", 2).over(w), "m": F.sum("id").over(w.rowsBetween(-3, 2))}
        return finish(d.withColumns(new))

    assert make(limit).count() == 300
    assert rows(make(limit).na.fill(-1), ["id", "a", "b", "m"]) == rows(make(10_000).na.fill(-1), ["id", "a", "b", "m"])


def test_quantiles(hot):
    make = lambda n: {r["k"]: r["q"] for r in quantiles(hot, ["k"], "v", [0.0, 0.1, 0.5, 0.99, 1.0], limit=n).collect()}
    pdf = hot.toPandas()
    want = pdf.dropna().groupby("k")["v"].quantile([0.0, 0.1, 0.5, 0.99, 1.0]).unstack()
    for n in (2, 10_000):
        got = make(n)
        for k, q in got.items():
            np.testing.assert_allclose(q, want.loc[k].to_numpy())


def test_global_quantile_without_keys(hot):
    q = quantiles(hot, [], "v", [0.25, 0.5], limit=2).first()["q"]
    np.testing.assert_allclose(q, hot.toPandas()["v"].dropna().quantile([0.25, 0.5]))


def test_average_ranks(hot):
    pdf = hot.toPandas().dropna()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank())
    want = {(k, v): r for k, v, r in zip(want["k"], want["v"], want["r"])}
    got = average_ranks(hot.where("v is not null").select("k", "v"), ["k"], "v", limit=2)
    assert {(r["k"], r["v"]): r["rank"] for r in got.collect()} == want


def test_no_window_over_a_hot_key(hot, few_rows):
    plan = se.lag_features(hot, ["k"], ["t", "id"], "v", lags=[1, 2], windows=[3])
    text = plan._jdf.queryExecution().executedPlan().toString()
    for line in text.splitlines():
        if "Window [" in line:
            assert "_block" in line or "_chunk" in line, line

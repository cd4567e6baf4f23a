"""Scaling, encoding and feature selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewalk.operators.aggregate import correlation_matrix, unpivot
from plumewalk.operators.model import fit_linear, linear_inference, moments, _square
from plumewalk.operators.quantile import quantiles


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard", passthrough: Sequence[str] = ("x", "y")) -> DataFrame:
    """Standard (population std), min-max or robust (median / IQR) scaling; a flat column becomes 0. Coordinates pass through."""
    cols = [c for c in columns if c not in passthrough]
    if method == "robust":
        q = quantiles(unpivot(df, cols), ["column"], "value", [0.25, 0.5, 0.75])
        got = {r["column"]: r["q"] for r in q.collect()}  # three numbers per column
        centre = {c: F.lit(got[c][1]) for c in cols}
        width = {c: F.lit(got[c][2] - got[c][0]) for c in cols}
    else:
        parts = []
        for i, c in enumerate(cols):
            a, b = (F.avg(c), F.stddev_pop(c)) if method == "standard" else (F.min(c), F.max(c) - F.min(c))
            parts += [a.cast("double").alias(f"a{i}"), b.cast("double").alias(f"b{i}")]
        row = df.agg(F.struct(*parts)).scalar()
        df = df.withColumn("_s", row)
        centre = {c: F.col("_s")[f"a{i}"] for i, c in enumerate(cols)}
        width = {c: F.col("_s")[f"b{i}"] for i, c in enumerate(cols)}
    if method not in ("standard", "minmax", "robust"):
        raise ValueError(f"unknown method {method!r}")
    step = lambda c: (F.col(c) - centre[c]) / F.when(width[c] != 0, width[c]).otherwise(1.0)
    return df.withColumns({c: step(c) for c in cols}).drop("_s")


def principal_components(df: DataFrame, columns: Sequence[str], share: float = 0.8) -> tuple[DataFrame, int]:
    """Loadings (component, column, loading, explained) of the covariance, and the fewest components reaching ``share``.

    The covariance comes from one distributed pass; only its columns x columns
    matrix is decomposed on the driver.
    """
    p = len(columns)
    head = df.select(*columns).withColumn("_one", F.lit(0.0))
    m = moments(head, [], columns, "_one").first()
    cov = _square(m["sxx"], p) / (m["n"] - 1)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1]
    val, vec = np.maximum(val[order], 0.0), vec[:, order]
    vec = vec * np.where(vec[np.abs(vec).argmax(0), range(p)] < 0, -1.0, 1.0)
    explained = val / val.sum()
    needed = int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)
    rows = [(k, c, float(vec[i, k]), float(explained[k])) for k in range(p) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "component int, column string, loading double, explained double"), needed


def project_components(df: DataFrame, columns: Sequence[str], share: float = 0.8) -> DataFrame:
    """Scores pc1 .. pck for the components that reach ``share``."""
    loadings, k = principal_components(df, columns, share)
    table = {(r["component"], r["column"]): r["loading"] for r in loadings.collect()}  # columns squared
    means = df.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)])).scalar()
    base = df.withColumn("_m", means)
    new = {}
    for j in range(k):
        total = F.lit(0.0)
        for i, c in enumerate(columns):
            total = total + (F.col(c) - F.col("_m")[f"m{i}"]) * table[(j, c)]
        new[f"pc{j + 1}"] = total
    return base.withColumns(new).drop("_m")


def variance_filter(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Columns whose population variance exceeds the threshold."""
    return unpivot(df, columns).groupBy("column").agg(F.var_pop("value").alias("variance")).where(F.col("variance") > threshold)


def correlation_filter(df: DataFrame, columns: Sequence[str], threshold: float = 0.75) -> DataFrame:
    """Columns to drop: those correlated above the threshold with any earlier column."""
    return correlation_matrix(df, columns).where(F.abs("corr") > threshold).select(F.col("b").alias("column")).distinct()


def k_best_features(df: DataFrame, columns: Sequence[str], y: str, k: int) -> DataFrame:
    """The k columns with the highest univariate F = r^2 / (1 - r^2) * (n - 2)."""
    row = df.agg(F.count(y).cast("double").alias("_n"), *[F.corr(c, y).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r"), F.col("_n").alias("n")) for c in columns])
    long = row.select(F.inline(cells))
    r2 = F.col("r") * F.col("r")
    return long.select("column", F.try_divide(r2 * (F.col("n") - 2), 1 - r2).alias("f")).orderBy(F.desc_nulls_last("f"), "column").limit(k)


def lasso_selection(df: DataFrame, columns: Sequence[str], y: str, alpha: float) -> DataFrame:
    """Columns whose lasso coefficient is at least the mean size of all coefficients."""
    fit = fit_linear(df, [], columns, y, "lasso", alpha)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("coef")[i].alias("coef")) for i, c in enumerate(columns)])
    long = fit.select(F.inline(cells))
    mean = long.agg(F.avg(F.abs("coef"))).scalar()
    return long.withColumn("_m", mean).where(F.abs("coef") >= F.col("_m")).drop("_m")


def recursive_elimination(df: DataFrame, columns: Sequence[str], y: str, keep: int = 20) -> list[str]:
    """Drops the smallest coefficient in size, refits, and repeats until ``keep`` columns are left.

    All fits use one set of moment sums, so the rows are read once.
    """
    m = moments(df, [], columns, y).first()
    sxx, sxy = _square(m["sxx"], len(columns)), np.asarray(m["sxy"])
    alive = list(range(len(columns)))
    while len(alive) > keep:
        w = np.linalg.lstsq(sxx[np.ix_(alive, alive)], sxy[alive], rcond=1e-12)[0]
        alive.pop(int(np.abs(w).argmin()))
    return [columns[i] for i in alive]


def lasso_path_cv(df: DataFrame, columns: Sequence[str], y: str, fold: str, alphas: Sequence[float]) -> DataFrame:
    """Cross-validated lasso: alpha and score over the folds of column ``fold``, all from moments per fold."""
    from plumewalk.operators.model import block_search

    tagged = df.withColumn("_all", F.lit(1))
    return block_search(tagged, ["_all"], fold, columns, y, alphas, "lasso").select("alpha", "score")


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


__all__ = [
    "correlation_filter", "k_best_features", "lasso_path_cv", "lasso_selection", "linear_inference", "one_hot",
    "principal_components", "project_components", "recursive_elimination", "scale", "variance_filter",
]

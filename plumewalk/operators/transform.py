"""Fitted transforms and composed spatial models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewalk.functions.scalar import yeo_johnson
from plumewalk.operators.geostat import local_kriging
from plumewalk.operators.model import fit_linear, predict_linear

LAMBDAS = tuple(round(-2 + 0.1 * i, 1) for i in range(41))


def yeo_johnson_likelihood(df: DataFrame, column: str, lambdas: Sequence[float] = LAMBDAS) -> DataFrame:
    """lam, loglik for every lambda, all from one pass over the column."""
    c = F.col(column)
    jac = F.sum(F.signum(c) * F.log1p(F.abs(c))).alias("_j")
    row = df.where(c.isNotNull()).agg(F.count(F.lit(1)).alias("_n"), jac, *[F.var_pop(yeo_johnson(c, m)).alias(f"_v{i}") for i, m in enumerate(lambdas)])
    cells = [
        F.struct(F.lit(float(m)).alias("lam"), (-F.col("_n") / 2 * F.log(f"_v{i}") + (m - 1) * F.col("_j")).alias("loglik"))
        for i, m in enumerate(lambdas)
    ]
    return row.select(F.inline(F.array(*cells)))


def power_transform(df: DataFrame, columns: Sequence[str], lambdas: Sequence[float] = LAMBDAS) -> DataFrame:
    """Each column by its own likeliest lambda, then standardised."""
    from plumewalk.operators.select import scale

    new = {}
    for c in columns:
        best = yeo_johnson_likelihood(df, c, lambdas).agg(F.max_by("lam", F.struct("loglik", "lam"))).first()[0]
        new[c] = yeo_johnson(c, best)
    return scale(df.withColumns(new), columns)


def regression_kriging(targets: DataFrame, samples: DataFrame, target_id: str, sample_id: str, value: str, trend: str, model: str, fit: dict[str, float], k: int = 16) -> DataFrame:
    """Linear trend on one column plus kriged residuals: target_id, estimate, variance."""
    line = fit_linear(samples, [], [trend], value, min_rows=3)
    left = predict_linear(samples, line, [], [trend], "_fit").withColumn("_e", F.col(value) - F.col("_fit"))
    kriged = local_kriging(targets, left, target_id, sample_id, "_e", model, fit, k)
    drift = predict_linear(targets, line, [], [trend], "_fit").select(target_id, "_fit")
    return kriged.join(drift, target_id).select(target_id, (F.col("estimate") + F.col("_fit")).alias("estimate"), "variance")

"""Error metrics, residual summaries and statistical tests, each from a few aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewalk.functions.tails import chi2_p, normal_cdf, normal_p, normal_quantile
from plumewalk.operators.ordered import prefix_sums, sliding, with_position
from plumewalk.operators.quantile import average_ranks, value_counts
from plumewalk.operators.series import acf, group_bounds

INF = float("inf")


def regression_metrics(df: DataFrame, y: str, pred: str, keys: Sequence[str] = (), p: int = 1) -> DataFrame:
    """mse, rmse, mae, r2, adj_r2 (minus infinity when n <= p + 1), mape, bias per key, in two combined passes."""
    err = F.col(y) - F.col(pred)
    known = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    eps = F.lit(2.220446049250313e-16)
    m = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop(y).alias("_v"),
        (F.avg(F.abs(err) / F.greatest(F.abs(F.col(y)), eps)) * 100).alias("mape"), F.avg(err).alias("bias"),
    )
    r2 = 1 - F.try_divide(F.col("mse"), F.col("_v"))
    dof = F.col("n") - p - 1
    return m.select(
        *keys, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"),
        F.when(dof <= 0, -INF).otherwise(1 - (1 - r2) * F.try_divide(F.col("n") - 1, dof)).alias("adj_r2"), "mape", "bias",
    )


def residual_summary(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Residual mean, population std, bias-corrected skewness and excess kurtosis."""
    r = df.select(*keys, (F.col(y) - F.col(pred)).alias("_e")).where(F.col("_e").isNotNull())
    m = r.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_e").alias("mean"), F.stddev_pop("_e").alias("std"), F.skewness("_e").alias("_g1"), F.kurtosis("_e").alias("_g2")
    )
    n = F.col("_n")
    skew = F.col("_g1") * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(((n + 1) * F.col("_g2") + 6) * (n - 1), (n - 2) * (n - 3))
    return m.select(*keys, n.cast("long").alias("n"), "mean", "std", F.when(n > 2, skew).alias("skew"), F.when(n > 3, kurt).alias("kurtosis"))


def guarded_mse(df: DataFrame, y: str, pred: str, keys: Sequence[str] = (), cap: float | None = 1e10) -> DataFrame:
    """Mean squared error that is infinite when any value is null, NaN or infinite, or when it exceeds ``cap``."""
    fine = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < INF), F.lit(False))
    ok = fine(y) & fine(pred)
    err = F.when(ok, F.pow(F.col(y) - F.col(pred), 2))
    m = df.groupBy(*keys).agg(F.count_if(~ok).alias("_bad"), F.avg(err).alias("_mse"))
    bad = (F.col("_bad") > 0) | F.col("_mse").isNull()
    if cap is not None:
        bad = bad | (F.col("_mse") > cap)
    return m.select(*keys, F.when(bad, INF).otherwise(F.col("_mse")).alias("mse"))


def residuals(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds residual and its value over the population std of its key."""
    r = df.withColumn("residual", F.col(y) - F.col(pred))
    if keys:
        wide = group_bounds(r, keys, {"_s": F.stddev_pop("residual")})
    else:
        wide = r.withColumn("_s", r.agg(F.stddev_pop("residual")).scalar())
    return wide.withColumn("standardised", F.try_divide("residual", "_s")).drop("_s")


def ljung_box(df: DataFrame, keys, order, value: str, lags: int) -> DataFrame:
    """Q statistic over the first ``lags`` autocorrelations and its chi-square tail."""
    r = acf(df, keys, order, value, lags)
    n = F.col("n").cast("double")
    term = F.col("acf") * F.col("acf") / (n - F.col("lag"))
    q = r.groupBy(*keys).agg((F.max(n * (n + 2)) * F.sum(term)).alias("q"), F.count(F.lit(1)).cast("double").alias("dof"))
    return q.withColumn("p", chi2_p("q", "dof"))


def durbin_watson(df: DataFrame, keys, order, value: str) -> DataFrame:
    rows, w, finish = sliding(df, keys, order, before=1)
    step = finish(rows.withColumn("_d", F.col(value) - F.lag(value, 1).over(w)))
    return step.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col(value) * F.col(value))).alias("dw"))


def jarque_bera(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("_s"), F.kurtosis(value).alias("_k"))
    jb = F.col("n") / 6 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4)
    return m.select(*keys, "n", jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def normality_distances(df: DataFrame, value: str) -> DataFrame:
    """Kolmogorov-Smirnov D and Anderson-Darling A2 against the normal with the sample mean and std.

    Both are sums or maxima over the counted distinct values in order, so ties
    and copies cost nothing and no task holds the column.
    """
    counts = value_counts(df, [], value)
    run = prefix_sums(counts, [], ["_v"], {"_cum": F.col("_n")})
    m = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).cast("double").alias("n"))).scalar()
    z = run.withColumn("_m", m).withColumn("_f", normal_cdf((F.col("_v") - F.col("_m.m")) / F.col("_m.s")))
    n, f, k, hi = F.col("_m.n"), F.col("_f"), F.col("_n").cast("double"), F.col("_cum").cast("double")
    lo = hi - k
    inside = F.least(F.greatest(f, F.lit(1e-300)), F.lit(1 - 1e-16))
    # Over a run of ties (2i - 1) sums to hi^2 - lo^2 and its mirror to (n - lo)^2 - (n - hi)^2.
    ad = (hi * hi - lo * lo) * F.log(inside) + ((n - lo) * (n - lo) - (n - hi) * (n - hi)) * F.log(1 - inside)
    return z.agg(
        F.max(F.greatest(hi / n - f, f - lo / n)).alias("ks_d"), (-F.max(n) - F.sum(ad) / F.max(n)).alias("anderson_a2"), F.max(n).cast("long").alias("n")
    )


def heteroscedasticity(df: DataFrame, residual: str, fitted: str) -> DataFrame:
    """Breusch-Pagan and White LM = n R2 of the squared residuals on the fitted values (and their square)."""
    shift = df.agg(F.struct(F.avg(fitted).alias("m"), F.stddev_pop(fitted).alias("s"))).scalar()
    d = df.select((F.col(residual) * F.col(residual)).alias("e"), ((F.col(fitted) - shift.m) / shift.s).alias("f"))
    d = d.where("e is not null and f is not null").withColumn("g", F.col("f") * F.col("f"))
    c = d.agg(F.count(F.lit(1)).cast("double").alias("n"), F.corr("e", "f").alias("a"), F.corr("e", "g").alias("b"), F.corr("f", "g").alias("c"))
    a, b, r, n = F.col("a"), F.col("b"), F.col("c"), F.col("n")
    white = F.try_divide(a * a + b * b - 2 * a * b * r, 1 - r * r)
    out = c.select(n.cast("long").alias("n"), (n * a * a).alias("bp_lm"), (n * white).alias("white_lm"))
    return out.withColumns({"bp_p": chi2_p("bp_lm", F.lit(1.0)), "white_p": chi2_p("white_lm", F.lit(2.0))})


def hurst(df: DataFrame, keys, order, value: str, max_lag: int = 20) -> DataFrame:
    """Twice the slope of log sqrt(std(y[t+k] - y[t])) on log k for k = 2 .. max_lag - 1."""
    lags = range(2, max_lag)
    rows, w, finish = sliding(df, keys, order, before=max_lag)
    moved = finish(rows.select(*keys, *[c for c in rows.columns if c.startswith("_")], *[(F.col(value) - F.lag(value, k).over(w)).alias(f"_d{k}") for k in lags]))
    wide = moved.groupBy(*keys).agg(*[F.stddev_pop(f"_d{k}").alias(f"_s{k}") for k in lags])
    pairs = F.array(*[F.struct(F.lit(math.log(k)).alias("x"), F.when(F.col(f"_s{k}") > 0, F.log(F.sqrt(f"_s{k}"))).alias("y")) for k in lags])
    return wide.select(*keys, F.inline(pairs)).groupBy(*keys).agg((F.regr_slope("y", "x") * 2).alias("hurst"))


def kruskal_wallis(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """H corrected for ties, degrees of freedom and p, per key; joins run on counted values, never on rows."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = average_ranks(df.where(F.col(value).isNotNull()).select(*keys, value), keys, value, "_rank")
    placed = cells.join(ranks, [*keys, value])
    sums = placed.groupBy(*keys, group).agg(F.sum("_c").cast("double").alias("_n"), F.sum(F.col("_c") * F.col("_rank")).alias("_r"))
    t = F.col("ties").cast("double")
    tie = ranks.groupBy(*keys).agg(F.sum(t * t * t - t).alias("_t"))
    m = sums.groupBy(*keys).agg(
        F.sum("_n").alias("_N"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_q")
    )
    both = m.join(tie, list(keys)) if keys else m.withColumn("_t", tie.scalar())
    n = F.col("_N")
    h = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / F.when(n > 1, 1 - F.col("_t") / (n * n * n - n))
    out = both.select(*keys, "groups", h.alias("h"), (F.col("groups") - 1).cast("double").alias("dof"))
    return out.withColumn("p", chi2_p("h", "dof"))


def mann_whitney_pairs(df: DataFrame, group: str, value: str, labels: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Every pair of ``labels``: U of the first, z, two-sided p, Bonferroni p, reject flag.

    Each counted value is sent to the pairs its group is part of and ranked
    within the pair.
    """
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    cells = df.where(F.col(value).isNotNull() & F.col(group).isin(list(labels))).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    made = F.array(*[F.struct(F.lit(a).alias("group1"), F.lit(b).alias("group2")) for a, b in pairs])
    mine = F.filter(made, lambda p: (p.group1 == F.col(group)) | (p.group2 == F.col(group)))
    each = cells.select("*", F.inline(mine))
    first = F.when(F.col(group) == F.col("group1"), F.col("_c")).otherwise(0)
    by_value = each.groupBy("group1", "group2", value).agg(F.sum("_c").alias("_k"), F.sum(first).alias("_k1"))
    run = prefix_sums(by_value, ["group1", "group2"], [value], {"_cum": F.col("_k")})
    k = F.col("_k").cast("double")
    rank = F.col("_cum") - (k - 1) / 2
    m = run.groupBy("group1", "group2").agg(
        F.sum(F.col("_k1") * rank).alias("_r1"), F.sum("_k1").cast("double").alias("_n1"), F.sum("_k").cast("double").alias("_n"), F.sum(k * k * k - k).alias("_t")
    )
    n1, n = F.col("_n1"), F.col("_n")
    n2 = n - n1
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_t"), n * (n - 1)))
    out = m.select("group1", "group2", u.alias("u"), F.try_divide(u - n1 * n2 / 2, F.sqrt(F.when(var > 0, var))).alias("z"))
    out = out.withColumn("p", normal_p("z")).withColumn("p_corrected", F.least(F.col("p") * len(pairs), F.lit(1.0)))
    return out.withColumn("reject", F.col("p_corrected") < alpha)


def kpss(df: DataFrame, keys, order, value: str, lags: int) -> DataFrame:
    """Level-stationarity statistic with a Bartlett long-run variance over ``lags``, its table p and the 5 % decision."""
    centred = group_bounds(df.select(*keys, *order, value), keys, {"_m": F.avg(value)}).withColumn("_e", F.col(value) - F.col("_m"))
    partial = prefix_sums(centred, keys, order, {"_s": F.col("_e")})
    eta = partial.groupBy(*keys).agg(
        F.sum(F.col("_s") * F.col("_s")).alias("_eta"), F.sum(F.col("_e") * F.col("_e")).alias("_e2"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    r = acf(df, keys, order, value, lags).withColumn("_w", (1 - F.col("lag") / (lags + 1)) * F.col("acf"))
    tail = r.groupBy(*keys).agg(F.sum("_w").alias("_w"))
    both = eta.join(tail, list(keys), "left")
    long_run = F.col("_e2") * (1 + 2 * F.coalesce("_w", F.lit(0.0))) / F.col("_n")
    stat = F.try_divide(F.col("_eta") / (F.col("_n") * F.col("_n")), long_run)
    return both.select(*keys, stat.alias("kpss"), table_p(stat, KPSS_LEVELS).alias("p"), (stat <= 0.463).alias("stationary"))


# Critical values of the level KPSS test and their significance.
KPSS_LEVELS = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]


def table_p(stat: Column, table: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation in a short table of (critical value, p), clamped at its ends."""
    out = F.when(stat <= table[0][0], table[0][1])
    for (a, pa), (b, pb) in zip(table, table[1:]):
        out = out.when(stat <= b, pa + (stat - a) / (b - a) * (pb - pa))
    return out.otherwise(table[-1][1])


# Large-sample critical values of the Dickey-Fuller t with a constant.
ADF_LEVELS = [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)]


def adf(df: DataFrame, keys, order, value: str, lags: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller t of the lagged level, constant included, with the 5 % decision."""
    from plumewalk.operators.model import linear_inference

    rows, w, finish = sliding(df, keys, order, before=lags + 2)
    diff = lambda k: F.lag(value, k).over(w) - F.lag(value, k + 1).over(w) if k else F.col(value) - F.lag(value, 1).over(w)
    made = finish(rows.withColumns({"_level": F.lag(value, 1).over(w), "_dy": diff(0)} | {f"_dl{k}": diff(k) for k in range(1, lags + 1)}))
    names = ["_level", *[f"_dl{k}" for k in range(1, lags + 1)]]
    fit = linear_inference(made.na.drop(subset=["_dy", *names]), keys, names, "_dy")
    t = F.col("t_values")[1]
    return fit.select(*keys, t.alias("adf"), table_p(t, ADF_LEVELS).alias("p"), (t < -2.86).alias("stationary"))


def arch_lm(df: DataFrame, keys, order, value: str, ar_lags: int = 5, arch_lags: int = 5) -> DataFrame:
    """LM = n R2 of the squared AR residuals on their own lags."""
    from plumewalk.operators.model import ar_residuals, linear_inference

    e = ar_residuals(df, keys, order, value, ar_lags).withColumn("_e2", F.col("residual") * F.col("residual"))
    rows, w, finish = sliding(e, keys, order, before=arch_lags)
    names = [f"_q{k}" for k in range(1, arch_lags + 1)]
    made = finish(rows.withColumns({n: F.lag("_e2", k).over(w) for k, n in enumerate(names, start=1)}))
    fit = linear_inference(made.na.drop(subset=["_e2", *names]), keys, names, "_e2")
    out = fit.select(*keys, (F.col("n") * F.col("r2")).alias("lm"), F.lit(float(arch_lags)).alias("dof"))
    return out.withColumn("p", chi2_p("lm", "dof"))


def diagnostic_points(df: DataFrame, order: Sequence[str], residual: str, uncertainty: str) -> DataFrame:
    """Per row: standardised residual, its normal quantile by rank, root of its size, and leverage 1 / (u + 1e-8)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    s = df.agg(F.struct(F.avg(residual).alias("m"), F.stddev_pop(residual).alias("s"))).scalar()
    placed = with_position(df, [], [residual, *order], "_pos").withColumns({"_n": n, "_s": s})
    std = (F.col(residual) - F.col("_s.m")) / F.col("_s.s")
    return placed.withColumns(
        {
            "standardised": std,
            "normal_quantile": normal_quantile((F.col("_pos") + 0.5) / F.col("_n")),
            "root_size": F.sqrt(F.abs(std)),
            "leverage": 1 / (F.col(uncertainty) + 1e-8),
        }
    ).drop("_pos", "_n", "_s")


def error_uncertainty(df: DataFrame, residual: str, uncertainty: str) -> DataFrame:
    return df.agg(F.corr(F.col(uncertainty), F.abs(F.col(residual))).alias("corr"))


def information_criteria(metrics: DataFrame, parameters: Column | int) -> DataFrame:
    """Adds aic and bic of a Gaussian model from n and mse."""
    k = F.lit(parameters) if isinstance(parameters, int) else parameters
    base = F.col("n") * F.log("mse")
    return metrics.withColumns({"aic": base + 2 * k, "bic": base + F.log(F.col("n").cast("double")) * k})


def compare_models(scores: DataFrame, criterion: str = "mse", model: str = "model") -> DataFrame:
    """All models with a flag on the one with the lowest criterion; ties go to the first name."""
    best = scores.agg(F.min_by(model, F.struct(criterion, model))).scalar()
    return scores.withColumn("best", F.col(model) == best)


def evaluation_report(df: DataFrame, y: str, pred: str, role: str) -> DataFrame:
    """One row: error and fit on the 'development' and 'holdout' rows and their ratio."""
    m = regression_metrics(df, y, pred, [role])
    of = lambda r, c: F.max(F.when(F.col(role) == r, F.col(c)))
    return m.agg(
        of("development", "mse").alias("dev_mse"), of("holdout", "mse").alias("holdout_mse"),
        of("development", "r2").alias("dev_r2"), of("holdout", "r2").alias("holdout_r2"),
        F.try_divide(of("holdout", "mse"), of("development", "mse")).alias("ratio"),
    )

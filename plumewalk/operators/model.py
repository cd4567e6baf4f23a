"""Linear models from moment sums, ensembles and similarity weights.

A fit per subject (or fold, or parameter row) never gathers the subject's
rows: the rows are reduced to the sums a linear solve needs, and the solve
runs on one small row per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumewalk.functions.scalar import clip, feature_similarity, finite
from plumewalk.operators.nearest import best_of_block, nearest
from plumewalk.operators.ordered import sliding, with_position
from plumewalk.operators.quantile import quantiles

MIN_ROWS = 10


def moments(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Per key: n, means mx (array) and my, centred sums sxx (row-major upper triangle), sxy, syy.

    The sums are taken around one common shift, so large offsets do not cancel.
    """
    clean = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*xs, y])]).na.drop()
    shift = clean.agg(F.struct(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate([*xs, y])])).scalar()
    base = clean.withColumn("_s", shift)
    cols = [(F.col(c) - F.col("_s")[f"s{i}"]).alias(f"_x{i}") for i, c in enumerate([*xs, y])]
    d = base.select(*keys, "_s", *cols)
    p = len(xs)
    sums = [F.sum(f"_x{i}").alias(f"t{i}") for i in range(p + 1)]
    cross = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"q{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
    agg = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("_s").alias("_s"), *sums, *cross)
    n = F.col("n").cast("double")

    def centred(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return F.col(f"q{i}_{j}") - F.col(f"t{i}") * F.col(f"t{j}") / n

    return agg.select(
        *keys, "n",
        F.array(*[F.col("_s")[f"s{i}"] + F.col(f"t{i}") / n for i in range(p)]).alias("mx"),
        (F.col("_s")[f"s{p}"] + F.col(f"t{p}") / n).alias("my"),
        F.array(*[centred(i, j) for i in range(p) for j in range(i, p)]).alias("sxx"),
        F.array(*[centred(i, p) for i in range(p)]).alias("sxy"),
        centred(p, p).alias("syy"),
    )


def _square(upper, p: int) -> np.ndarray:
    a = np.zeros((p, p))
    a[np.triu_indices(p)] = upper
    return a + np.triu(a, 1).T


def solve_linear(sxx: np.ndarray, sxy: np.ndarray, n: float, kind: str, alpha: float) -> np.ndarray:
    """Coefficients from centred moments: 'ols', 'ridge' (alpha on the coefficients) or 'lasso' (1/2n loss)."""
    p = len(sxy)
    if kind == "lasso":
        b, a = np.zeros(p), sxx / n
        c = sxy / n
        for _ in range(2000):
            old = b.copy()
            for j in range(p):
                if a[j, j] <= 0:
                    continue
                rho = c[j] - a[j] @ b + a[j, j] * b[j]
                b[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / a[j, j]
            if np.abs(b - old).max() < 1e-12 * max(1.0, np.abs(b).max()):
                break
        return b
    if kind == "ridge":
        return np.linalg.solve(sxx + alpha * np.eye(p), sxy)
    if kind == "ols":
        scale = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
        return np.linalg.lstsq(sxx / np.outer(scale, scale), sxy / scale, rcond=1e-12)[0] / scale
    raise ValueError(f"unknown kind {kind!r}")


def fit_linear(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, kind: str = "ols", alpha: Column | float = 1.0, min_rows: int = MIN_ROWS) -> DataFrame:
    """Model registry: keys, n, intercept, coef (array in the order of ``xs``), train_mse, error.

    A key with too few rows stays in the registry with its reason in ``error``.
    """
    m = moments(df, keys, xs, y)
    return solve_moments(m, keys, len(xs), kind, alpha, min_rows)


def solve_moments(m: DataFrame, keys: Sequence[str], p: int, kind: str = "ols", alpha: Column | float = 1.0, min_rows: int = MIN_ROWS) -> DataFrame:
    out = T.StructType([T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("train_mse", T.DoubleType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(out)
    def solve(n: pd.Series, mx: pd.Series, my: pd.Series, sxx: pd.Series, sxy: pd.Series, syy: pd.Series, al: pd.Series) -> pd.DataFrame:
        rows = []
        for ni, mxi, myi, a, b, c, ali in zip(n, mx, my, sxx, sxy, syy, al):
            if ni < min_rows:
                rows.append((None, None, None, f"only {ni} rows"))
                continue
            try:
                sq, sv = _square(a, p), np.asarray(b, dtype=float)
                w = solve_linear(sq, sv, float(ni), kind, float(ali))
                sse = c - 2 * w @ sv + w @ sq @ w
                rows.append((float(myi - w @ np.asarray(mxi)), [float(v) for v in w], max(float(sse), 0.0) / ni, None))
            except np.linalg.LinAlgError as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["intercept", "coef", "train_mse", "error"])

    al = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha
    return m.withColumn("_f", solve("n", "mx", "my", "sxx", "sxy", "syy", al)).select(*keys, "n", "_f.*")


def predict_linear(df: DataFrame, registry: DataFrame, keys: Sequence[str], xs: Sequence[str], name: str = "prediction") -> DataFrame:
    """Adds the prediction of the model of each row's key; a key without a model gives null."""
    fitted = registry.where("error is null").select(*keys, F.col("intercept").alias("_b0"), F.col("coef").alias("_b"))
    joined = df.join(fitted, list(keys), "left") if keys else df.withColumns({"_b0": fitted.select("_b0").scalar(), "_b": fitted.select("_b").scalar()})
    total = F.col("_b0")
    for i, c in enumerate(xs):
        total = total + F.col("_b")[i] * F.col(c)
    return joined.withColumn(name, total).drop("_b0", "_b")


def linear_inference(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """n, coef and t_values (intercept first) and r2 of the least-squares fit per key."""
    p = len(xs)
    out = T.StructType([T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("t_values", T.ArrayType(T.DoubleType())), T.StructField("r2", T.DoubleType())])

    @F.pandas_udf(out)
    def solve(n: pd.Series, mx: pd.Series, my: pd.Series, sxx: pd.Series, sxy: pd.Series, syy: pd.Series) -> pd.DataFrame:
        rows = []
        for ni, mxi, myi, a, b, c in zip(n, mx, my, sxx, sxy, syy):
            if ni <= p + 1:
                rows.append((None, None, None))
                continue
            sq, sv, mean = _square(a, p), np.asarray(b, dtype=float), np.asarray(mxi, dtype=float)
            inv = np.linalg.pinv(sq)
            w = inv @ sv
            sse = max(float(c - w @ sv), 0.0)
            s2 = sse / (ni - p - 1)
            b0 = myi - w @ mean
            se = np.sqrt(np.concatenate([[s2 * (1 / ni + mean @ inv @ mean)], s2 * np.diag(inv)]))
            full = np.concatenate([[b0], w])
            t = np.divide(full, se, out=np.zeros_like(full), where=se > 0)
            rows.append((full.tolist(), t.tolist(), float(1 - sse / c) if c > 0 else None))
        return pd.DataFrame(rows, columns=["coef", "t_values", "r2"])

    m = moments(df, keys, xs, y)
    return m.withColumn("_f", solve("n", "mx", "my", "sxx", "sxy", "syy")).select(*keys, "n", "_f.*")


def autoregression(df: DataFrame, keys, order, value: str, p: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(registry, rows with lag columns, lag names) of an AR(p) with intercept."""
    rows, w, finish = sliding(df, keys, order, before=p)
    names = [f"_ar{k}" for k in range(1, p + 1)]
    made = finish(rows.withColumns({n: F.lag(value, k).over(w) for k, n in enumerate(names, start=1)})).na.drop(subset=[value, *names])
    return fit_linear(made, keys, names, value, min_rows=p + 2), made, names


def ar_residuals(df: DataFrame, keys, order, value: str, p: int) -> DataFrame:
    registry, made, names = autoregression(df, keys, order, value, p)
    fitted = predict_linear(made, registry, keys, names, "_fit")
    return fitted.where("_fit is not null").withColumn("residual", F.col(value) - F.col("_fit")).drop("_fit", *names)


def block_search(df: DataFrame, keys: Sequence[str], block: str, xs: Sequence[str], y: str, alphas: Sequence[float], kind: str = "ridge") -> DataFrame:
    """Leave-one-block-out search: keys, alpha, score (mean block MSE; infinite when a block fails).

    One pass reduces the rows to moments per key and block. Training moments
    of a fold are all blocks less one, and the test error of a block follows
    from its own moments, so no fold or parameter reads the rows again.
    """
    p = len(xs)
    per = moments(df, [*keys, block], xs, y)
    packed = per.groupBy(*keys).agg(F.collect_list(F.struct("n", "mx", "my", "sxx", "sxy", "syy")).alias("blocks"))
    tries = packed.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))

    def combine(items):
        n = sum(i["n"] for i in items)
        mx = sum(np.asarray(i["mx"]) * i["n"] for i in items) / n
        my = sum(i["my"] * i["n"] for i in items) / n
        sxx = sum(_square(i["sxx"], p) + i["n"] * np.outer(np.asarray(i["mx"]) - mx, np.asarray(i["mx"]) - mx) for i in items)
        sxy = sum(np.asarray(i["sxy"]) + i["n"] * (np.asarray(i["mx"]) - mx) * (i["my"] - my) for i in items)
        return n, mx, my, sxx, sxy

    @F.pandas_udf(T.DoubleType())
    def score(blocks: pd.Series, alpha: pd.Series) -> pd.Series:
        out = []
        for items, a in zip(blocks, alpha):
            items = list(items)
            try:
                errs = []
                for k, test in enumerate(items):
                    n, mx, my, sxx, sxy = combine(items[:k] + items[k + 1 :])
                    w = solve_linear(sxx, sxy, float(n), kind, float(a))
                    off = test["my"] - my - w @ (np.asarray(test["mx"]) - mx)
                    sse = test["syy"] - 2 * w @ np.asarray(test["sxy"]) + w @ _square(test["sxx"], p) @ w
                    errs.append(sse / test["n"] + off**2)
                out.append(float(np.mean(errs)) if len(items) > 1 else float("inf"))
            except (np.linalg.LinAlgError, ZeroDivisionError):
                out.append(float("inf"))
        return pd.Series([v if np.isfinite(v) else float("inf") for v in out])

    return tries.withColumn("score", score("blocks", "alpha")).drop("blocks")


def tune_per_key(df: DataFrame, keys: Sequence[str], block: str, xs: Sequence[str], y: str, alphas: Sequence[float], kind: str = "ridge") -> DataFrame:
    """Registry of one model per key, each with its own best alpha, refitted on all its rows."""
    scores = block_search(df, keys, block, xs, y, alphas, kind)
    best = scores.groupBy(*keys).agg(F.min_by("alpha", F.struct("score", "alpha")).alias("alpha"), F.min("score").alias("score"))
    m = moments(df, keys, xs, y).join(best, list(keys))
    fitted = solve_moments(m, [*keys, "alpha", "score"], len(xs), kind, F.col("alpha"))
    return fitted


def environment_similarity(test_env: Mapping[str, Column] | DataFrame, train: DataFrame, subject: str, features: Sequence[str], method: str = "euclidean", circular: Sequence[str] = ("wind_direction",), weights: Mapping[str, float] | None = None) -> DataFrame:
    """Similarity of each subject's mean environment to the mean test environment: subject, similarity in 0..1.

    ``weights`` gives the weighted variant (features without a weight count
    1); method 'plain' is 1 / (1 + weighted euclidean distance of the raw means).
    """
    means = train.groupBy(subject).agg(*[F.avg(f).alias(f) for f in features])
    target = test_env.agg(F.struct(*[F.avg(f).alias(f) for f in features])).scalar()
    wide = means.withColumn("_t", target)
    w = {f: float((weights or {}).get(f, 1.0)) for f in features}
    total = sum(w.values())
    if not features:
        return means.select(subject, F.lit(1.0).alias("similarity"))
    sims = {f: feature_similarity(F.col("_t")[f], F.col(f), circular=f in circular or any(c in f for c in circular)) for f in features}

    def added(parts):
        out = None
        for part in parts:
            out = part if out is None else out + part
        return out

    rms = F.sqrt(added(F.lit(w[f]) * F.pow(1 - sims[f], 2) for f in features) / total)
    euclidean = 1 / (1 + rms)
    dot = added(F.lit(w[f]) * F.col("_t")[f] * F.col(f) for f in features)
    na = F.sqrt(added(F.lit(w[f]) * F.pow(F.col("_t")[f], 2) for f in features))
    nb = F.sqrt(added(F.lit(w[f]) * F.pow(F.col(f), 2) for f in features))
    same = added(F.when(F.col("_t")[f] == F.col(f), 0).otherwise(1) for f in features) == 0
    zero = (na == 0) | (nb == 0)
    if len(features) < 2:
        cosine = F.lit(1.0)
    else:
        cosine = F.when(zero, F.when(same, 1.0).otherwise(0.0)).otherwise((F.try_divide(dot, na * nb) + 1) / 2)
    mean_sim = added(F.lit(w[f]) * sims[f] for f in features) / total
    plain = 1 / (1 + F.sqrt(added(F.lit(w[f]) * F.pow(F.col("_t")[f] - F.col(f), 2) for f in features)))
    choice = {"euclidean": euclidean, "cosine": cosine, "combined": 0.4 * euclidean + 0.3 * cosine + 0.3 * mean_sim, "plain": plain}
    sim = choice.get(method, euclidean)
    return wide.select(subject, clip(sim, 0.0, 1.0).alias("similarity"))


# Weights of the environment features in the weighted variant.
FEATURE_WEIGHTS = {
    "temperature": 1.0, "humidity": 0.8, "pressure": 0.6, "wind_speed_mean": 0.9,
    "wind_direction_mean": 0.7, "solar_radiation": 0.5, "precipitation": 0.4,
}


def drop_outlying_predictions(preds: DataFrame, row: str, pred: str = "pred", threshold: float = 10.0) -> DataFrame:
    """Predictions farther than ``threshold`` scaled MADs from the median of their row become null (off by default)."""
    med = quantiles(preds.withColumn("_p", finite(pred)), [row], "_p", [0.5], name="_med")
    dev = preds.join(med, row, "left").withColumn("_d", F.abs(finite(pred) - F.col("_med")[0]))
    mad = quantiles(dev, [row], "_d", [0.5], name="_mad")
    far = F.col("_d") > threshold * 1.4826 * F.col("_mad")[0]
    joined = dev.join(mad, row, "left")
    return joined.withColumn(pred, F.when(far & (F.col("_mad")[0] > 0), None).otherwise(F.col(pred))).drop("_med", "_d", "_mad")


def combine_ensemble(preds: DataFrame, similarities: DataFrame | None, row: str = "row_id", subject: str = "subject_id", pred: str = "pred") -> DataFrame:
    """Weighted mean of the finite predictions per row: row, prediction, n_models.

    A subject without a weight counts 1; when the weights sum to 0 the mean is
    plain; a row without a finite prediction takes the mean of all finite
    predictions, else 0.
    """
    p = preds.select(row, subject, finite(pred).alias("_p"))
    if similarities is None:
        weighted = p.withColumn("_w", F.lit(1.0))
    else:
        weighted = p.join(similarities.select(subject, F.col("similarity").alias("_w")), subject, "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    w = F.when(F.col("_p").isNotNull(), F.col("_w"))
    sums = weighted.groupBy(row).agg(F.sum(w * F.col("_p")).alias("_wp"), F.sum(w).alias("_sw"), F.avg("_p").alias("_mean"), F.count("_p").alias("n_models"))
    overall = p.agg(F.avg("_p")).scalar()
    value = F.when(F.col("_sw") > 0, F.col("_wp") / F.col("_sw")).otherwise(F.col("_mean"))
    return sums.select(row, F.coalesce(value, overall, F.lit(0.0)).alias("prediction"), "n_models")


def average_ensemble(preds: DataFrame, row: str = "row_id", pred: str = "pred") -> DataFrame:
    return preds.groupBy(row).agg(F.avg(finite(pred)).alias("prediction"))


def weighted_grid_ensemble(preds: DataFrame, grid_env: DataFrame, train: DataFrame, features: Sequence[str], subject: str = "subject_id", row: str = "row_id", method: str = "euclidean") -> DataFrame:
    """One weight per subject from the mean grid conditions, the plain mean where no feature is shared."""
    shared = [f for f in features if f in grid_env.columns and f in train.columns]
    if not shared:
        return average_ensemble(preds, row)
    return combine_ensemble(preds, environment_similarity(grid_env, train, subject, shared, method), row, subject).drop("n_models")


def predict_all(df: DataFrame, registry: DataFrame, row: str, xs: Sequence[str], subject: str = "subject_id", block: int = 10_000) -> DataFrame:
    """Long predictions (row, subject, pred, variance): every row by every model.

    Models are packed into arrays of at most ``block`` entries. One array
    travels with the plan as a value and needs no join; more of them are a
    small table, and each row meets each of them by number.
    """
    models = registry.where("error is null").select(subject, F.struct(subject, "intercept", "coef", F.col("train_mse").alias("variance")).alias("_one"))
    blocks = -(-models.count() // block)
    if blocks <= 1:
        packed = models.agg(F.collect_list("_one")).scalar()
        each = df.select(row, *xs, packed.alias("_m"))
    else:
        packed = models.groupBy(F.pmod(F.xxhash64(subject), F.lit(2 * blocks)).cast("long").alias("_block")).agg(F.collect_list("_one").alias("_m"))
        each = df.select(row, *xs, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * blocks - 1).cast("long"))).alias("_block")).join(packed, "_block")
    each = each.select(row, *xs, F.inline("_m"))
    total = F.col("intercept")
    for i, c in enumerate(xs):
        total = total + F.col("coef")[i] * F.col(c)
    return each.select(row, subject, total.alias("pred"), "variance")


def best_model_prediction(df: DataFrame, registry: DataFrame, row: str, xs: Sequence[str], similarities: DataFrame | None, subject: str = "subject_id") -> DataFrame:
    """row, co2_prediction and prediction_uncertainty (weighted mean of the model variances, 1 when absent)."""
    long = predict_all(df, registry, row, xs, subject)
    both = combine_ensemble(long, similarities, row, subject)
    var = combine_ensemble(long.withColumn("variance", F.coalesce("variance", F.lit(1.0))), similarities, row, subject, "variance")
    return both.select(row, F.col("prediction").alias("co2_prediction")).join(var.select(row, F.col("prediction").alias("prediction_uncertainty")), row)


def compatible_models(registry: DataFrame, columns: Sequence[str], features: str = "features") -> DataFrame:
    """Models all of whose features are among ``columns``."""
    return registry.where(F.size(F.array_except(features, F.array(*map(F.lit, columns)))) == 0)


def trend_with_residual(df: DataFrame, target: str, fitted: str, residual: str, train: DataFrame, name: str = "prediction") -> DataFrame:
    """Drift plus spatial residual, clipped to five population std around the training mean."""
    s = train.agg(F.struct(F.avg(target).alias("m"), F.stddev_pop(target).alias("s"))).scalar()
    both = df.withColumn("_s", s)
    low, high = F.col("_s.m") - 5 * F.col("_s.s"), F.col("_s.m") + 5 * F.col("_s.s")
    return both.withColumn(name, clip(F.col(fitted) + F.col(residual), low, high)).drop("_s")


def knn_predict(targets: DataFrame, samples: DataFrame, target_id: str, sample_id: str, value: str, k: int, metric: str = "euclidean", skip_self: bool = False) -> DataFrame:
    """Mean of the k nearest samples in the plane, ``uniform`` and ``weighted`` by inverse distance (an exact hit decides alone)."""
    near = nearest(targets, samples, target_id, sample_id, k=k, metric=metric, skip_self=skip_self)
    w = F.try_divide(F.lit(1.0), F.col("dist"))
    sums = near.groupBy(target_id).agg(
        F.avg(value).alias("uniform"), F.sum(w * F.col(value)).alias("_wv"), F.sum(w).alias("_w"), F.avg(F.when(F.col("dist") == 0, F.col(value))).alias("_exact")
    )
    return sums.select(target_id, "uniform", F.coalesce("_exact", F.col("_wv") / F.col("_w")).alias("weighted"))


def distances(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of rows of ``a`` and ``b`` that broadcast; the last axis holds the features, added in their order."""
    d = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        step = np.abs(a[..., i] - b[..., i])
        d = np.maximum(d, step) if metric == "chebyshev" else d + step ** {"euclidean": 2.0, "manhattan": 1.0}.get(metric, p)
    return d if metric in ("chebyshev", "manhattan") else d ** (1 / (2.0 if metric == "euclidean" else p))


def nearest_rows(a: np.ndarray, b: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, metric: str, p: float, skip_self: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance) of the k nearest rows of ``b``, ties to the smaller id; all features are finite.

    Euclidean distances come from one matrix product first, with a bound on
    its rounding; only rows that may be among the k best by that bound are
    measured, so the answer is that of measuring all.
    """
    found = []
    middle = b.mean(axis=0) if len(b) else 0.0
    with np.errstate(over="ignore", invalid="ignore"):
        left, right = a - middle, b - middle
        na, nb = (left**2).sum(axis=1), (right**2).sum(axis=1)
    slack = 16 * (a.shape[1] + 4) * np.finfo(float).eps
    quick = metric == "euclidean" and len(b) > k and max(na.max(initial=0.0), nb.max(initial=0.0)) < 1e300
    for lo in range(0, len(a), step):
        own_a, same = a[lo : lo + step], own[lo : lo + step, None] == ids[None, :] if skip_self else None
        if quick:
            size = na[lo : lo + step, None] + nb[None, :]
            least = size - 2.0 * (left[lo : lo + step] @ right.T) - slack * size
            if skip_self:
                least[same] = np.inf
            first = np.argpartition(least, k - 1, axis=1)[:, :k]
            # the k best are no farther than the farthest of these k
            most = (np.take_along_axis(least, first, axis=1) + 2.0 * slack * np.take_along_axis(size, first, axis=1)).max(axis=1)
            rows, cols = np.nonzero((least <= most[:, None]) & (least < np.inf))
            d = np.concatenate([distances(own_a[r], b[c], metric, p) for r, c in ((rows[i : i + (1 << 20)], cols[i : i + (1 << 20)]) for i in range(0, len(rows), 1 << 20))] or [np.zeros(0)])
            order = np.lexsort((ids[cols], d, rows))
            rows, cols, d = rows[order], cols[order], d[order]
            keep = (np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k) & (d < np.inf)
            rows, cols, d = rows[keep], cols[keep], d[keep]
        else:
            every = distances(own_a[:, None, :], b[None, :, :], metric, p)
            if skip_self:
                every[same] = np.inf
            rows, cols = best_of_block(every, ids, k)
            d = every[rows, cols]
        found.append((lo + rows, cols, d))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, (int, int, float)[i]) for i in range(3))


def knn_features(
    targets: DataFrame, samples: DataFrame, keys: Sequence[str], target_id: str, sample_id: str, xs: Sequence[str], value: str, k: int,
    metric: str = "euclidean", p: float = 2.0, block: int = 4096, skip_self: bool = False,
) -> DataFrame:
    """Exact k nearest neighbours on any number of features within each key: keys, target_id, uniform, weighted.

    Both sides are cut into blocks of bounded size; a kernel keeps the k best
    of each block pair and the k best of those are merged. The plan of block
    pairs is a table of its own, so the blocks of a hot key spread over all tasks.
    All pairs of a key are looked at: the work grows with the square of its rows,
    what travels with the square divided by ``block``. Rows with a feature that is
    null or not finite have no neighbours and are none.
    ``skip_self`` leaves out the sample whose id is the target's.
    """
    types = dict(targets.dtypes) | dict(samples.dtypes)
    # In a block a sample keeps its id for ties, a target its own.
    def blocks(df: DataFrame, row_id: str, cols: Sequence[str], tag: str) -> DataFrame:
        placed = with_position(df.select(*keys, row_id, *cols), keys, [row_id], "_pos")
        packed = placed.groupBy(*keys, F.floor(F.col("_pos") / block).alias(f"_{tag}")).agg(F.array_sort(F.collect_list(F.struct(row_id, *cols))).alias("_r"))
        return packed.select(*keys, f"_{tag}", *[F.col(f"_r.{c}").alias(f"{tag}_{c}") for c in (row_id, *cols)])

    a, b = blocks(targets, target_id, xs, "a"), blocks(samples, sample_id, [*xs, value], "b")
    many = lambda df, tag: df.groupBy(*keys).agg(F.max(f"_{tag}").alias(f"_n{tag}"))
    grid = many(a, "a").join(many(b, "b"), list(keys))
    zero = F.lit(0).cast("long")
    grid = grid.withColumn("_a", F.explode(F.sequence(zero, F.col("_na")))).withColumn("_b", F.explode(F.sequence(zero, F.col("_nb")))).drop("_na", "_nb")
    pairs = grid.join(a, [*keys, "_a"]).join(b, [*keys, "_b"]).drop("_a", "_b")
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, target_id)) + f", _s {types[sample_id]}, _d double, _v double"

    def run(batches):
        for batch in batches:
            for t in batch.to_dict("records"):
                own, ids = np.asarray(t[f"a_{target_id}"]), np.asarray(t[f"b_{sample_id}"])
                left, right = (np.stack([np.asarray(t[f"{tag}_{x}"], dtype=float) for x in xs], axis=1) for tag in "ab")
                valid = [np.nonzero(np.isfinite(m).all(axis=1))[0] for m in (left, right)]
                near = nearest_rows(left[valid[0]], right[valid[1]], own[valid[0]], ids[valid[1]], k, metric, p, skip_self)
                rows, width, d = valid[0][near[0]], valid[1][near[1]], near[2]
                out = {c: t[c] for c in keys} | {target_id: own[rows], "_s": ids[width]}
                yield pd.DataFrame(out | {"_d": d, "_v": np.asarray(t[f"b_{value}"], dtype=float)[width]})

    order = Window.partitionBy(*keys, target_id).orderBy("_d", "_s")
    near = pairs.mapInPandas(run, schema).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    w = F.try_divide(F.lit(1.0), F.col("_d"))
    sums = near.groupBy(*keys, target_id).agg(
        F.avg("_v").alias("uniform"), F.sum(w * F.col("_v")).alias("_wv"), F.sum(w).alias("_w"), F.avg(F.when(F.col("_d") == 0, F.col("_v"))).alias("_exact")
    )
    return sums.select(*keys, target_id, "uniform", F.coalesce("_exact", F.col("_wv") / F.col("_w")).alias("weighted"))


#: Rows of a fit by ``pyspark.ml`` that one task holds in memory, at most.
FIT_ROWS = 1_000_000


def forest_registry(df: DataFrame, xs: Sequence[str], y: str, kind: str = "forest", **params):
    """A fitted ``pyspark.ml`` pipeline: 'forest', 'boosted' or 'robust' (Huber linear).

    A fit keeps its rows unpacked and reads them again in every step, so files whose
    parts hold more than ``FIT_ROWS`` rows are dealt out to more tasks.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    made = {
        "forest": lambda: RandomForestRegressor(featuresCol="_v", labelCol=y, seed=42, **params),
        "boosted": lambda: GBTRegressor(featuresCol="_v", labelCol=y, seed=42, **params),
        "robust": lambda: LinearRegression(featuresCol="_v", labelCol=y, loss="huber", **params),
    }
    if kind not in made:
        raise ValueError(f"unknown kind {kind!r}")
    rows = df.na.drop(subset=[*xs, y])
    largest, total = rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) > FIT_ROWS:
        rows = rows.select(*xs, y).repartition(-(-total // (FIT_ROWS // 2)))
    return Pipeline(stages=[VectorAssembler(inputCols=list(xs), outputCol="_v"), made[kind]()]).fit(rows)


STEPS: dict[str, object] = {}


def register_step(name: str):
    """Registers a function params -> pyspark.ml stage under a unique name."""
    def add(fn):
        if name in STEPS:
            raise ValueError(f"step {name} is registered twice")
        STEPS[name] = fn
        return fn

    return add


def build_pipeline(steps: Sequence[tuple[str, Mapping]]):
    from pyspark.ml import Pipeline

    return Pipeline(stages=[STEPS[name](dict(params)) for name, params in steps])


def series_model(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, k_best: int | None = None, kind: str = "ridge", alpha: float = 1.0) -> tuple[DataFrame, list[str]]:
    """Optional k-best selection, then a linear registry; a failed key is a row with its error."""
    from plumewalk.operators.select import k_best_features

    names = list(xs)
    if k_best and len(names) > k_best:
        names = [r["column"] for r in k_best_features(df, names, y, k_best).collect()]  # at most k names
    return fit_linear(df, keys, names, y, kind, alpha), names



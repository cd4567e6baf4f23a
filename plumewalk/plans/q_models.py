"""Queries over scaling, selection, model fits, ensembles and imputation."""

from pyspark.sql import functions as F

from plumewalk.operators import impute as im
from plumewalk.operators import model as mo
from plumewalk.operators import select as sel
from plumewalk.operators.geostat import idw
from plumewalk.plans import views as v
from plumewalk.plans.q_geostat import _IDW, _sides
from plumewalk.plans.registry import query
from plumewalk.plans.views import sql_with

XS = ["x1", "x2", "x3"]


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("k01_scale_standard", sql_with("reg", "SELECT subject_id, y, round((x1 - (SELECT avg(x1) FROM reg)) / (SELECT stddev_pop(x1) FROM reg), 6) AS x1, round((x2 - (SELECT min(x2) FROM reg)) / (SELECT max(x2) - min(x2) FROM reg), 6) AS x2, round((x3 - (SELECT quantile_cont(x3, 0.5) FROM reg)) / (SELECT quantile_cont(x3, 0.75) - quantile_cont(x3, 0.25) FROM reg), 6) AS x3 FROM reg"))
def k01_scale_standard(spark, sf_dir):
    r = sel.scale(v.reg(spark, sf_dir), ["x1"], "standard")
    r = sel.scale(sel.scale(r, ["x2"], "minmax"), ["x3"], "robust")
    return _rounded(r, x1=6, x2=6, x3=6)


@query("k02_principal_components")
def k02_principal_components(spark, sf_dir):
    """Rows only: checked against a dense decomposition in the tests."""
    scaled = sel.scale(v.reg(spark, sf_dir).select("y", *XS), ["y", *XS])
    return sel.principal_components(scaled, ["y", *XS], 0.8)[0]


@query("k03_lasso_selection")
def k03_lasso_selection(spark, sf_dir):
    """Rows only: an iterative solve, checked against its optimality conditions in the tests."""
    return sel.lasso_selection(sel.scale(v.reg(spark, sf_dir), [*XS, "y"]), XS, "y", 0.001)


@query("k04_variance_filter", sql_with("reg", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(var_pop({c}), 0) AS variance FROM reg HAVING var_pop({c}) > 0.01" for c in ("x1", "x2", "x3", "y"))))
def k04_variance_filter(spark, sf_dir):
    return _rounded(sel.variance_filter(v.reg(spark, sf_dir), [*XS, "y"]), variance=0)


@query("k05_correlation_filter", sql_with("reg", "SELECT 'y' AS \"column\" FROM reg HAVING abs(corr(y, x1)) > 0.75 OR abs(corr(y, x2)) > 0.75 OR abs(corr(y, x3)) > 0.75"))
def k05_correlation_filter(spark, sf_dir):
    return sel.correlation_filter(v.reg(spark, sf_dir), [*XS, "y"])


@query("k06_k_best", sql_with("reg", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr({c}, y) AS r, count(*) AS n FROM reg" for c in XS) + ") SELECT \"column\", round(r * r * (n - 2) / (1 - r * r), 3) AS f FROM c ORDER BY f DESC LIMIT 2"))
def k06_k_best(spark, sf_dir):
    return _rounded(sel.k_best_features(v.reg(spark, sf_dir), XS, "y", 2), f=3)


@query("k07_recursive_elimination")
def k07_recursive_elimination(spark, sf_dir):
    """Rows only: one row per surviving column with its coefficient in the final fit."""
    r = sel.scale(v.reg(spark, sf_dir), [*XS, "y"])
    kept = sel.recursive_elimination(r, XS, "y", keep=2)
    fit = mo.fit_linear(r, [], kept, "y")
    return fit.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("coef")[i].alias("coef")) for i, c in enumerate(kept)])))


@query("k08_lasso_cv")
def k08_lasso_cv(spark, sf_dir):
    """Rows only: every alpha with its cross-validated error."""
    r = sel.scale(v.reg(spark, sf_dir), [*XS, "y"]).withColumn("fold", F.col("subject_id") % 5)
    return sel.lasso_path_cv(r, XS, "y", "fold", [0.001, 0.01, 0.1, 1.0])


@query("k09_one_hot", "SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'A')::INT AS l_returnflag_A, (l_returnflag = 'N')::INT AS l_returnflag_N, (l_returnflag = 'R')::INT AS l_returnflag_R FROM lineitem")
def k09_one_hot(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return sel.one_hot(li, "l_returnflag", ["A", "N", "R"]).drop("l_returnflag")


@query("m01_simple_regression", sql_with("reg", "SELECT subject_id, regr_count(y, x1)::BIGINT AS n, round(regr_intercept(y, x1), 4) AS intercept, round(regr_slope(y, x1), 4) AS slope FROM reg GROUP BY 1"))
def m01_simple_regression(spark, sf_dir):
    fit = mo.fit_linear(v.reg(spark, sf_dir), ["subject_id"], ["x1"], "y")
    return fit.select("subject_id", "n", F.round("intercept", 4).alias("intercept"), F.round(F.col("coef")[0], 4).alias("slope"))


_RIDGE = "WITH f AS (SELECT subject_id, regr_avgx(y, x1) AS mx, regr_avgy(y, x1) AS my, regr_sxy(y, x1) / (regr_sxx(y, x1) + 50) AS b FROM reg GROUP BY 1) "


@query("m01_ridge", sql_with("reg", _RIDGE + "SELECT subject_id, round(my - b * mx, 4) AS intercept, round(b, 4) AS slope FROM f"))
def m01_ridge(spark, sf_dir):
    fit = mo.fit_linear(v.reg(spark, sf_dir), ["subject_id"], ["x1"], "y", "ridge", 50.0)
    return fit.select("subject_id", F.round("intercept", 4).alias("intercept"), F.round(F.col("coef")[0], 4).alias("slope"))


@query(
    "m01_two_features",
    sql_with("reg", "WITH s AS (SELECT subject_id, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q FROM reg GROUP BY 1), f AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2 FROM s) SELECT subject_id, round(my - b1 * m1 - b2 * m2, 2) AS intercept, round(b1, 3) AS b1, round(b2, 2) AS b2 FROM f"),
)
def m01_two_features(spark, sf_dir):
    fit = mo.fit_linear(v.reg(spark, sf_dir), ["subject_id"], ["x1", "x2"], "y")
    return fit.select("subject_id", F.round("intercept", 2).alias("intercept"), F.round(F.col("coef")[0], 3).alias("b1"), F.round(F.col("coef")[1], 2).alias("b2"))


@query("m02_random_forest")
def m02_random_forest(spark, sf_dir):
    r = v.reg(spark, sf_dir)
    fit = mo.forest_registry(r, XS, "y", "forest", numTrees=5, maxDepth=4)
    return fit.transform(r).groupBy("subject_id").agg(F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("n"))


@query("m03_robust_regression")
def m03_robust_regression(spark, sf_dir):
    r = v.reg(spark, sf_dir)
    fit = mo.forest_registry(r, XS, "y", "robust", maxIter=20)
    return fit.transform(r).groupBy("subject_id").agg(F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("n"))


@query("m03_boosted_trees")
def m03_boosted_trees(spark, sf_dir):
    r = v.reg(spark, sf_dir)
    fit = mo.forest_registry(r, XS, "y", "boosted", maxIter=3, maxDepth=3)
    return fit.transform(r).groupBy("subject_id").agg(F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("n"))


_BLOCKS = "WITH b AS (SELECT l_suppkey AS subject_id, l_linenumber % 3 AS block, l_extendedprice AS y, l_quantity AS x1 FROM lineitem), s AS (SELECT subject_id, block, count(*)::DOUBLE AS n, sum(x1) AS sx, sum(y) AS sy, sum(x1 * x1) AS xx, sum(x1 * y) AS xy, sum(y * y) AS yy FROM b GROUP BY 1, 2), al AS (SELECT unnest([0.1, 100.0, 10000.0])::DOUBLE AS alpha), "
_LOBO = (
    _BLOCKS + "t AS (SELECT a.subject_id, a.block, sum(c.n) AS n, sum(c.sx) AS sx, sum(c.sy) AS sy, sum(c.xx) AS xx, sum(c.xy) AS xy FROM s a JOIN s c ON c.subject_id = a.subject_id AND c.block <> a.block GROUP BY 1, 2), "
    "f AS (SELECT t.subject_id, t.block, alpha, (xy - sx * sy / n) / (xx - sx * sx / n + alpha) AS b, sx / n AS mx, sy / n AS my FROM t, al), "
    "e AS (SELECT f.subject_id, alpha, (yy - 2 * (my - b * mx) * sy - 2 * b * xy + n * pow(my - b * mx, 2) + 2 * (my - b * mx) * b * sx + b * b * xx) / n AS mse FROM f JOIN s USING (subject_id, block)), "
    "sc AS (SELECT subject_id, alpha, avg(mse) AS score FROM e GROUP BY 1, 2) "
)


def _blocks(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("subject_id"), (F.col("l_linenumber") % 3).alias("block"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"))


@query("l08_block_scores", _LOBO + "SELECT subject_id, alpha, round(score / 1e6, 4) AS score FROM sc")
def l08_block_scores(spark, sf_dir):
    s = mo.block_search(_blocks(spark, sf_dir), ["subject_id"], "block", ["x1"], "y", [0.1, 100.0, 10000.0])
    return s.withColumn("score", F.round(F.col("score") / 1e6, 4))


@query("m06_best_parameters", _LOBO + "SELECT subject_id, arg_min(alpha, score) AS alpha, round(min(score) / 1e6, 4) AS score FROM sc GROUP BY 1")
def m06_best_parameters(spark, sf_dir):
    s = mo.block_search(_blocks(spark, sf_dir), ["subject_id"], "block", ["x1"], "y", [0.1, 100.0, 10000.0])
    best = s.groupBy("subject_id").agg(F.min_by("alpha", F.struct("score", "alpha")).alias("alpha"), F.min("score").alias("score"))
    return best.withColumn("score", F.round(F.col("score") / 1e6, 4))


@query(
    "m05_subject_models",
    _LOBO + ", ba AS (SELECT subject_id, arg_min(alpha, score) AS alpha FROM sc GROUP BY 1), w AS (SELECT subject_id, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(xx) AS xx, sum(xy) AS xy FROM s GROUP BY 1), g AS (SELECT subject_id, alpha, n, sx / n AS mx, sy / n AS my, (xy - sx * sy / n) / (xx - sx * sx / n + alpha) AS b FROM w JOIN ba USING (subject_id)) "
    "SELECT subject_id, alpha, n::BIGINT AS n, round(my - b * mx, 3) AS intercept, round(b, 3) AS slope FROM g",
)
def m05_subject_models(spark, sf_dir):
    fit = mo.tune_per_key(_blocks(spark, sf_dir), ["subject_id"], "block", ["x1"], "y", [0.1, 100.0, 10000.0])
    return fit.select("subject_id", "alpha", "n", F.round("intercept", 3).alias("intercept"), F.round(F.col("coef")[0], 3).alias("slope"))


_ENV = ["temperature", "humidity", "pressure", "wind_direction"]
_TEST = "t AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in _ENV) + " FROM env WHERE temperature > 5000)"
_MEANS = "m AS (SELECT subject, " + ", ".join(f"avg({c}) AS {c}" for c in _ENV) + " FROM env GROUP BY 1)"


def _fs(c: str) -> str:
    if c == "wind_direction":
        return "greatest(0, 1 - least(abs(t.wind_direction - m.wind_direction), 360 - abs(t.wind_direction - m.wind_direction)) / 180)"
    return f"CASE WHEN t.{c} = m.{c} THEN 1 ELSE 1 - least(abs(t.{c} - m.{c}) / greatest(abs(t.{c}), abs(m.{c}), 1e-8), 1) END"


def _similarity_sql(w: dict[str, float]) -> str:
    tot = sum(w.values())
    rms = "sqrt((" + " + ".join(f"{w[c]} * pow(1 - s_{c}, 2)" for c in _ENV) + f") / {tot})"
    dot = " + ".join(f"{w[c]} * t_{c} * {c}" for c in _ENV)
    na, nb = (" + ".join(f"{w[c]} * pow({p}{c}, 2)" for c in _ENV) for p in ("t_", ""))
    mean = "(" + " + ".join(f"{w[c]} * s_{c}" for c in _ENV) + f") / {tot}"
    s = "s AS (SELECT m.*, " + ", ".join(f"{_fs(c)} AS s_{c}, t.{c} AS t_{c}" for c in _ENV) + " FROM m, t), "
    q = f"q AS (SELECT subject, 1 / (1 + {rms}) AS euclidean, (({dot}) / (sqrt({na}) * sqrt({nb})) + 1) / 2 AS cosine, {mean} AS mean FROM s)"
    return f"WITH {_TEST}, {_MEANS}, {s}{q} SELECT subject, round(euclidean, 6) AS euclidean, round(cosine, 6) AS cosine, round(0.4 * euclidean + 0.3 * cosine + 0.3 * mean, 6) AS combined FROM q"


def _similarities(spark, sf_dir, weights=None):
    e = v.env(spark, sf_dir)
    out = None
    for m in ("euclidean", "cosine", "combined"):
        s = mo.environment_similarity(e.where("temperature > 5000"), e, "subject", _ENV, m, weights=weights)
        s = s.withColumn("similarity", F.round("similarity", 6)).withColumnRenamed("similarity", m)
        out = s if out is None else out.join(s, "subject")
    return out


@query("m07_similarity", sql_with("env", _similarity_sql(dict.fromkeys(_ENV, 1.0))))
def m07_similarity(spark, sf_dir):
    return _similarities(spark, sf_dir)


_WTS = {"temperature": 1.0, "humidity": 0.8, "pressure": 0.6, "wind_direction": 1.0}


@query("m08_weighted_similarity", sql_with("env", _similarity_sql(_WTS)))
def m08_weighted_similarity(spark, sf_dir):
    return _similarities(spark, sf_dir, mo.FEATURE_WEIGHTS)


_WT = "w AS (SELECT s_suppkey AS subject_id, greatest(s_acctbal, 0) AS similarity FROM supplier WHERE s_suppkey < 12)"
_COMB = "f AS (SELECT row_id, subject_id, CASE WHEN isfinite(pred) THEN pred END AS p FROM preds)"


def _weights(spark, sf_dir):
    s = v.table(spark, sf_dir, "supplier").where("s_suppkey < 12")  # models 12 to 15 have no weight of their own
    return s.select(F.col("s_suppkey").alias("subject_id"), F.greatest("s_acctbal", F.lit(0.0)).alias("similarity"))


@query("m09_ensemble", sql_with("preds", f"WITH {_WT}, {_COMB}, c AS (SELECT row_id, p, coalesce(similarity, 1) AS wt FROM f LEFT JOIN w USING (subject_id)), g AS (SELECT row_id, sum(p * wt) AS wp, sum(CASE WHEN p IS NOT NULL THEN wt END) AS sw, avg(p) AS m, count(p) AS n_models FROM c GROUP BY 1) SELECT row_id, n_models, round(coalesce(CASE WHEN sw > 0 THEN wp / sw ELSE m END, (SELECT avg(p) FROM f), 0), 4) AS prediction FROM g"))
def m09_ensemble(spark, sf_dir):
    return _rounded(mo.combine_ensemble(v.preds(spark, sf_dir), _weights(spark, sf_dir)), prediction=4)


@query("m10_outlier_filter", sql_with("preds", "WITH f AS (SELECT row_id, subject_id, pred AS raw, CASE WHEN isfinite(pred) THEN pred END AS p FROM preds), m AS (SELECT row_id, median(p) AS med FROM f GROUP BY 1), d AS (SELECT f.*, abs(p - med) AS d FROM f JOIN m USING (row_id)), a AS (SELECT row_id, median(d) AS mad FROM d GROUP BY 1) SELECT row_id, count(CASE WHEN raw IS NOT NULL AND NOT coalesce(mad > 0 AND d > 3 * 1.4826 * mad, FALSE) THEN 1 END) AS kept FROM d JOIN a USING (row_id) GROUP BY 1"))
def m10_outlier_filter(spark, sf_dir):
    out = mo.drop_outlying_predictions(v.preds(spark, sf_dir), "row_id", threshold=3.0)
    return out.groupBy("row_id").agg(F.count("pred").alias("kept"))


@query("m11_average_ensemble", sql_with("preds", f"WITH {_COMB} SELECT row_id, round(avg(p), 6) AS prediction FROM f GROUP BY 1"))
def m11_average_ensemble(spark, sf_dir):
    return _rounded(mo.average_ensemble(v.preds(spark, sf_dir)), prediction=6)


@query(
    "m12_grid_ensemble",
    sql_with("preds env", f"WITH {_TEST}, {_MEANS}, s AS (SELECT CASE subject WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS subject_id, 1 / (1 + sqrt((pow(1 - ({_fs('temperature')}), 2) + pow(1 - ({_fs('humidity')}), 2)) / 2)) AS sim FROM m, t), {_COMB}, "
             "c AS (SELECT row_id, p, coalesce(sim, 1) AS wt FROM f LEFT JOIN s USING (subject_id)) SELECT row_id, round(coalesce(sum(p * wt) / sum(CASE WHEN p IS NOT NULL THEN wt END), (SELECT avg(p) FROM f), 0), 4) AS prediction FROM c GROUP BY 1"),
)
def m12_grid_ensemble(spark, sf_dir):
    e = v.env(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")])
    at = F.array_position(names, F.col("subject"))
    train = e.withColumn("subject_id", F.when(at > 0, at - 1).otherwise(4).cast("long"))
    out = mo.weighted_grid_ensemble(v.preds(spark, sf_dir), e.where("temperature > 5000"), train, ["temperature", "humidity", "absent"])
    return _rounded(out, prediction=4)


_REG5 = "f AS (SELECT subject_id % 5 AS m, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_syy(y, x1) AS syy, regr_sxx(y, x1) AS sxx, regr_count(y, x1)::DOUBLE AS n FROM reg GROUP BY 1)"


@query("m13_batch_prediction", sql_with("reg", f"WITH {_REG5} SELECT s_suppkey AS row_id, round(avg(a + b * (s_suppkey % 50)), 3) AS co2_prediction, round(avg((syy - b * b * sxx) / n) / 1e6, 4) AS prediction_uncertainty FROM supplier, f GROUP BY 1"))
def m13_batch_prediction(spark, sf_dir):
    r = v.reg(spark, sf_dir).withColumn("subject_id", F.col("subject_id") % 5)
    fit = mo.fit_linear(r, ["subject_id"], ["x1"], "y")
    rows = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), (F.col("s_suppkey") % 50).cast("double").alias("x1"))
    p = mo.best_model_prediction(rows, fit, "row_id", ["x1"], None)
    return p.select("row_id", F.round("co2_prediction", 3).alias("co2_prediction"), F.round(F.col("prediction_uncertainty") / 1e6, 4).alias("prediction_uncertainty"))


@query("m14_compatible_models", "SELECT l_suppkey AS subject_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_linenumber > 6 THEN l_linenumber END) = 0 OR l_suppkey % 2 = 0")
def m14_compatible_models(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem")
    late = F.max((F.col("l_linenumber") > 6).cast("int"))
    reg = li.groupBy(F.col("l_suppkey").alias("subject_id")).agg(late.alias("late"))
    needs = F.when((F.col("late") == 1) & (F.col("subject_id") % 2 == 1), F.array(F.lit("x1"), F.lit("x9"))).otherwise(F.array(F.lit("x1")))
    return mo.compatible_models(reg.withColumn("features", needs), XS).select("subject_id")


@query("m15_autoregression", sql_with("obs", "WITH d AS (SELECT subject_id, co2, lag(co2) OVER (PARTITION BY subject_id ORDER BY ts, event_id) AS x FROM obs) SELECT subject_id, round(regr_intercept(co2, x), 4) AS intercept, round(regr_slope(co2, x), 6) AS phi1 FROM d WHERE x IS NOT NULL GROUP BY 1"))
def m15_autoregression(spark, sf_dir):
    fit, _, _ = mo.autoregression(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"], "co2", 1)
    return fit.select("subject_id", F.round("intercept", 4).alias("intercept"), F.round(F.col("coef")[0], 6).alias("phi1"))


@query("m16_series_model", sql_with("reg", "WITH r AS (SELECT subject_id, x1, y + 5000 * x1 AS y FROM reg), f AS (SELECT subject_id, regr_avgx(y, x1) AS mx, regr_avgy(y, x1) AS my, regr_sxy(y, x1) / (regr_sxx(y, x1) + 1) AS b FROM r GROUP BY 1) SELECT subject_id, round(my - b * mx, 4) AS intercept, round(b, 4) AS slope FROM f"))
def m16_series_model(spark, sf_dir):
    r = v.reg(spark, sf_dir).withColumn("y", F.col("y") + 5000 * F.col("x1"))
    fit, _ = mo.series_model(r, ["subject_id"], XS, "y", k_best=1)
    return fit.select("subject_id", F.round("intercept", 4).alias("intercept"), F.round(F.col("coef")[0], 4).alias("slope"))


@query("h15_yeo_johnson_fit", sql_with("env", "WITH l AS (SELECT unnest([-1.0, 0.5, 1.0, 1.5, 3.0])::DOUBLE AS lam), t AS (SELECT lam, humidity, (pow(humidity + 1, lam) - 1) / lam AS z FROM env, l) SELECT lam, round(-count(*) / 2.0 * ln(var_pop(z)) + (lam - 1) * sum(ln(1 + humidity)), 4) AS loglik FROM t GROUP BY lam"))
def h15_yeo_johnson_fit(spark, sf_dir):
    from plumewalk.operators.transform import yeo_johnson_likelihood

    e = v.env(spark, sf_dir)
    return _rounded(yeo_johnson_likelihood(e, "humidity", [-1.0, 0.5, 1.0, 1.5, 3.0]), loglik=4)


@query(
    "i09_trend_residual",
    sql_with("loc poi", _IDW + ", rs AS (SELECT pid, sum(w * r) / sum(w) AS residual FROM w GROUP BY 1), st AS (SELECT avg(co2) AS m, stddev_pop(co2) AS s FROM loc) SELECT pid, round(least(greatest(co2 * 4 + residual, m - 5 * s), m + 5 * s), 4) AS prediction FROM loc JOIN rs USING (pid), st"),
)
def i09_trend_residual(spark, sf_dir):
    t, s = _sides(spark, sf_dir)
    res = idw(t, s, "pid", "r", 30.0).select("pid", "residual")
    train = v.loc(spark, sf_dir)
    rows = train.select("pid", (F.col("co2") * 4).alias("fitted")).join(res, "pid")
    return _rounded(mo.trend_with_residual(rows, "co2", "fitted", "residual", train), prediction=4).select("pid", "prediction")


@query("i08_regression_kriging")
def i08_regression_kriging(spark, sf_dir):
    """Rows only: trend on a category dummy plus kriged residuals, checked in parts in the tests."""
    from plumewalk.operators.transform import regression_kriging

    t, s = _sides(spark, sf_dir)
    s = s.join(v.poi(spark, sf_dir).select("fid", (F.col("category") == "SMALL").cast("double").alias("dummy")), "fid")
    t = t.withColumn("dummy", (F.col("pid") % 2).cast("double"))
    return regression_kriging(t, s, "pid", "fid", "r", "dummy", "spherical", {"nugget": 10.0, "psill": 190.0, "reach": 120.0}, k=6)


@query("j01_matrix_completion")
def j01_matrix_completion(spark, sf_dir):
    """Rows only: an iteration, checked against a dense run in the tests."""
    p = v.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("category"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("levels"), F.col("p_retailprice").alias("price")
    )
    return im.impute_attributes(p, exclude=["p_partkey"], max_rank=5, max_iters=15)


@query("j02_edge_imputation")
def j02_edge_imputation(spark, sf_dir):
    """Rows only: the iterated fit is checked against a dense run in the tests."""
    from plumewalk.operators.clean import clean_edges

    e = clean_edges(v.edges(spark, sf_dir)).withColumn("access", F.when(F.col("v") % 3 == 0, "yes").when(F.col("v") % 3 == 1, "no"))
    return im.impute_edges(e, rounds=5).select("u", "v", "highway", "access", "oneway", "lanes", "maxspeed")


@query("j02_foot_rule", sql_with("edges", "SELECT u, v, CASE WHEN highway IN ('footway', 'path', 'unclassified') THEN FALSE ELSE TRUE END AS has_lanes FROM edges"))
def j02_foot_rule(spark, sf_dir):
    out = j02_edge_imputation(spark, sf_dir)
    return out.select("u", "v", (F.col("lanes").isNotNull() & F.col("maxspeed").isNotNull()).alias("has_lanes"))


_E64 = [f"e{i}" for i in range(1, 65)]


@query(
    "m04_knn_features",
    "WITH e AS (SELECT vec_id, label, embedding[3]::DOUBLE AS z, embedding::DOUBLE[] AS e FROM embeddings), "
    "d AS (SELECT a.label, a.vec_id, b.vec_id AS s, b.z, list_distance(a.e, b.e) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id), "
    "k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, s) <= 4) "
    "SELECT label, vec_id, round(avg(z), 6) AS uniform, round(coalesce(avg(CASE WHEN d = 0 THEN z END), sum(z / nullif(d, 0)) / sum(1 / nullif(d, 0))), 6) AS weighted FROM k GROUP BY 1, 2",
)
def m04_knn_features(spark, sf_dir):
    """The other vectors of the same label, over all 64 elements."""
    e = v.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.element_at("embedding", 3).cast("double").alias("z"), *[F.element_at("embedding", i).cast("double").alias(c) for i, c in enumerate(_E64, 1)]
    )
    out = mo.knn_features(e, e.withColumnRenamed("vec_id", "sid"), ["label"], "vec_id", "sid", _E64, "z", k=4, skip_self=True)
    return _rounded(out, uniform=6, weighted=6)

"""Queries over error metrics, residual diagnostics and tests."""

from pyspark.sql import functions as F

from plumewalk.operators import metrics as me
from plumewalk.plans import views as v
from plumewalk.plans.q_series import _ACF
from plumewalk.plans.registry import query
from plumewalk.plans.views import sql_with

KEYS, ORDER = ["subject_id"], ["ts", "event_id"]
_W = "OVER (PARTITION BY subject_id ORDER BY ts, event_id)"

# Predictions: price per unit of quantity by supplier.
_YP = "WITH p AS (SELECT l_suppkey AS subject_id, l_extendedprice AS y, l_quantity * 2100 + l_tax * 1000 AS f FROM lineitem) "


def _yp(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("subject_id"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100 + F.col("l_tax") * 1000).alias("f"))


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("n01_metrics", _YP + ", m AS (SELECT subject_id, count(*) AS n, avg(pow(y - f, 2)) AS mse, avg(abs(y - f)) AS mae, var_pop(y) AS v FROM p GROUP BY 1) SELECT subject_id, n, round(mse, 0) AS mse, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae, round(1 - mse / v, 6) AS r2, round(1 - (mse / v) * (n - 1) / (n - 4), 6) AS adj_r2 FROM m")
def n01_metrics(spark, sf_dir):
    m = me.regression_metrics(_yp(spark, sf_dir), "y", "f", KEYS, p=3)
    return _rounded(m, mse=0, rmse=4, mae=4, r2=6, adj_r2=6).select("subject_id", "n", "mse", "rmse", "mae", "r2", "adj_r2")


@query("n02_mape", _YP + "SELECT subject_id, round(avg(abs(y - f) / greatest(abs(y), 2.220446049250313e-16)) * 100, 6) AS mape FROM p GROUP BY 1")
def n02_mape(spark, sf_dir):
    return me.regression_metrics(_yp(spark, sf_dir), "y", "f", KEYS).select("subject_id", F.round("mape", 6).alias("mape"))


@query("n03_residual_summary", _YP + "SELECT subject_id, count(*) AS n, round(avg(y - f), 4) AS mean, round(stddev_pop(y - f), 4) AS std, round(skewness(y - f), 6) AS skew, round(kurtosis(y - f), 6) AS kurtosis FROM p GROUP BY 1")
def n03_residual_summary(spark, sf_dir):
    return _rounded(me.residual_summary(_yp(spark, sf_dir), "y", "f", KEYS), mean=4, std=4, skew=6, kurtosis=6)


@query("n04_guarded_mse", sql_with("preds", "WITH e AS (SELECT row_id % 50 AS g, pred, 500.0::DOUBLE AS y, pred IS NOT NULL AND isfinite(pred) AS ok FROM preds), m AS (SELECT g, sum((NOT ok)::INT) AS bad, avg(CASE WHEN ok THEN pow(y - pred, 2) END) AS mse FROM e GROUP BY 1) SELECT g, bad > 0 OR mse IS NULL OR mse > 1e10 AS infinite, CASE WHEN bad = 0 AND mse <= 1e10 THEN round(mse, 4) END AS mse FROM m"))
def n04_guarded_mse(spark, sf_dir):
    p = v.preds(spark, sf_dir).select((F.col("row_id") % 50).alias("g"), "pred", F.lit(500.0).alias("y"))
    m = me.guarded_mse(p, "y", "pred", ["g"])
    infinite = F.col("mse") == float("inf")
    return m.select("g", infinite.alias("infinite"), F.when(~infinite, F.round("mse", 4)).alias("mse"))


@query("n05_overfit_ratio", _YP + ", m AS (SELECT subject_id, avg(CASE WHEN y > 50000 THEN pow(y - f, 2) END) AS h, avg(CASE WHEN y <= 50000 THEN pow(y - f, 2) END) AS d FROM p GROUP BY 1) SELECT subject_id, round(h / d, 6) AS ratio, CASE WHEN h / d >= 1.25 THEN 'high' WHEN h / d >= 1.1 THEN 'moderate' ELSE 'low' END AS band FROM m")
def n05_overfit_ratio(spark, sf_dir):
    from plumewalk.functions.scalar import overfit_band

    e = F.pow(F.col("y") - F.col("f"), 2)
    m = _yp(spark, sf_dir).groupBy("subject_id").agg(F.avg(F.when(F.col("y") > 50000, e)).alias("h"), F.avg(F.when(F.col("y") <= 50000, e)).alias("d"))
    ratio, band = overfit_band("h", "d")
    return m.select("subject_id", F.round(ratio, 6).alias("ratio"), band.alias("band"))


@query("n06_residuals", "WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice - 250000 AS r FROM orders), s AS (SELECT o_custkey, stddev_pop(r) AS s FROM p GROUP BY 1) SELECT o_orderkey, round(r, 4) AS residual, round(r / nullif(s, 0), 6) AS standardised FROM p JOIN s USING (o_custkey)")
def n06_residuals(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").withColumn("f", F.lit(250000.0))
    r = me.residuals(o, "o_totalprice", "f", ["o_custkey"])
    return _rounded(r, residual=4, standardised=6).select("o_orderkey", "residual", "standardised")


@query("n08_ljung_box", sql_with("obs", _ACF + "SELECT subject_id, round(max(n * (n + 2.0)) * sum(acf * acf / (n - lag)), 6) AS q FROM ac WHERE lag <= 10 GROUP BY 1"))
def n08_ljung_box(spark, sf_dir):
    return me.ljung_box(v.obs(spark, sf_dir), KEYS, ORDER, "co2", 10).select("subject_id", F.round("q", 6).alias("q"))


_Z = "WITH z AS (SELECT *, co2 - 50 AS e FROM obs) "


@query("n09_durbin_watson", sql_with("obs", _Z + f", d AS (SELECT subject_id, e, e - lag(e) {_W} AS d FROM z) SELECT subject_id, round(sum(d * d) / sum(e * e), 6) AS dw FROM d GROUP BY 1"))
def n09_durbin_watson(spark, sf_dir):
    z = v.obs(spark, sf_dir).withColumn("e", F.col("co2") - 50)
    return _rounded(me.durbin_watson(z, KEYS, ORDER, "e"), dw=6)


@query("n10_jarque_bera", sql_with("obs", "WITH a AS (SELECT subject_id, avg(co2) AS m FROM obs GROUP BY 1), c AS (SELECT subject_id, count(*) AS n, avg(pow(co2 - m, 2)) AS m2, avg(pow(co2 - m, 3)) AS m3, avg(pow(co2 - m, 4)) AS m4 FROM obs JOIN a USING (subject_id) GROUP BY 1) SELECT subject_id, n, round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 4) AS jb FROM c"))
def n10_jarque_bera(spark, sf_dir):
    return me.jarque_bera(v.obs(spark, sf_dir), "co2", KEYS).select("subject_id", "n", F.round("jb", 4).alias("jb"))


@query("n11_normality")
def n11_normality(spark, sf_dir):
    """Rows only: DuckDB has no normal distribution function; checked against a direct sum in the tests."""
    return me.normality_distances(v.obs(spark, sf_dir), "co2")


@query(
    "n12_heteroscedasticity",
    _YP + ", s AS (SELECT pow(y - f, 2) AS e, (f - (SELECT avg(f) FROM p)) / (SELECT stddev_pop(f) FROM p) AS x FROM p), c AS (SELECT count(*)::DOUBLE AS n, corr(e, x) AS a, corr(e, x * x) AS b, corr(x, x * x) AS c FROM s) SELECT n::BIGINT AS n, round(n * a * a, 4) AS bp_lm, round(n * (a * a + b * b - 2 * a * b * c) / (1 - c * c), 4) AS white_lm FROM c",
)
def n12_heteroscedasticity(spark, sf_dir):
    d = _yp(spark, sf_dir).withColumn("r", F.col("y") - F.col("f"))
    return _rounded(me.heteroscedasticity(d, "r", "f"), bp_lm=4, white_lm=4).select("n", "bp_lm", "white_lm")


@query(
    "n13_kpss",
    sql_with("obs", _ACF + f", e AS (SELECT subject_id, ts, event_id, co2 - avg(co2) OVER (PARTITION BY subject_id) AS e FROM obs), ps AS (SELECT subject_id, e, sum(e) {_W} AS s FROM e), t AS (SELECT subject_id, sum(s * s) AS eta, sum(e * e) AS e2, count(*)::DOUBLE AS n FROM ps GROUP BY 1), "
             "w AS (SELECT subject_id, sum((1 - lag / 9.0) * acf) AS w FROM ac WHERE lag <= 8 GROUP BY 1) SELECT subject_id, round(eta / (n * n) / (e2 * (1 + 2 * w) / n), 6) AS kpss, eta / (n * n) / (e2 * (1 + 2 * w) / n) <= 0.463 AS stationary FROM t JOIN w USING (subject_id)"),
)
def n13_kpss(spark, sf_dir):
    return _rounded(me.kpss(v.obs(spark, sf_dir), KEYS, ORDER, "co2", 8), kpss=6).select("subject_id", "kpss", "stationary")


@query("n13_adf", sql_with("obs", f"WITH d AS (SELECT subject_id, co2 - lag(co2) {_W} AS dy, lag(co2) {_W} AS x FROM obs), m AS (SELECT subject_id, count(*) AS n, regr_slope(dy, x) AS b, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy FROM d WHERE dy IS NOT NULL AND x IS NOT NULL GROUP BY 1) SELECT subject_id, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 4) AS adf FROM m"))
def n13_adf(spark, sf_dir):
    return _rounded(me.adf(v.obs(spark, sf_dir), KEYS, ORDER, "co2", lags=0), adf=4).select("subject_id", "adf")


@query(
    "n14_arch_lm",
    sql_with("obs", f"WITH d AS (SELECT *, lag(co2) {_W} AS x FROM obs), m AS (SELECT subject_id, regr_slope(co2, x) AS b, regr_intercept(co2, x) AS a FROM d WHERE x IS NOT NULL GROUP BY 1), e AS (SELECT d.subject_id, ts, event_id, pow(co2 - a - b * x, 2) AS e2 FROM d JOIN m USING (subject_id) WHERE x IS NOT NULL), l AS (SELECT subject_id, e2, lag(e2) {_W} AS q FROM e) SELECT subject_id, round(count(*) * regr_r2(e2, q), 4) AS lm FROM l WHERE q IS NOT NULL GROUP BY 1"),
)
def n14_arch_lm(spark, sf_dir):
    return _rounded(me.arch_lm(v.obs(spark, sf_dir), KEYS, ORDER, "co2", ar_lags=1, arch_lags=1), lm=4).select("subject_id", "lm")


@query(
    "n15_hurst",
    sql_with("obs", f"WITH d AS (SELECT subject_id, k, co2 - lag(co2, k) OVER (PARTITION BY subject_id, k ORDER BY ts, event_id) AS d FROM obs, range(2, 20) r(k)), s AS (SELECT subject_id, k, ln(sqrt(stddev_pop(d))) AS y FROM d GROUP BY 1, 2) SELECT subject_id, round(regr_slope(y, ln(k)) * 2, 6) AS hurst FROM s GROUP BY 1"),
)
def n15_hurst(spark, sf_dir):
    return _rounded(me.hurst(v.obs(spark, sf_dir), KEYS, ORDER, "co2"), hurst=6)


_KW = (
    "WITH r AS (SELECT {k}o_orderpriority AS g, rank() OVER ({p}ORDER BY v) + (count(*) OVER (PARTITION BY {k}v) - 1) / 2.0 AS r, v FROM (SELECT *, round(o_totalprice, -3) AS v FROM orders)), s AS (SELECT {k}g, count(*) AS n, sum(r) AS r FROM r GROUP BY ALL), "
    "t AS (SELECT {k}sum(pow(c, 3) - c) AS t FROM (SELECT {k}v, count(*)::DOUBLE AS c FROM r GROUP BY ALL) GROUP BY ALL), m AS (SELECT {k}sum(n)::DOUBLE AS n, count(*) AS groups, sum(r * r / n) AS q FROM s GROUP BY ALL) "
)


@query("n16_kruskal_wallis", _KW.format(k="o_orderstatus, ", p="PARTITION BY o_orderstatus ") + "SELECT o_orderstatus, groups, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) AS h FROM m JOIN t USING (o_orderstatus)")
def n16_kruskal_wallis(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").withColumn("v", F.round("o_totalprice", -3))
    k = me.kruskal_wallis(o, "o_orderpriority", "v", ["o_orderstatus"])
    return _rounded(k, h=4).select("o_orderstatus", "groups", "h")


_EVENTS = ["click", "error", "purchase", "signup", "view"]


@query(
    "n17_mann_whitney",
    sql_with("obs", "WITH v AS (SELECT variable AS g, round(co2) AS v FROM obs), gr AS (SELECT DISTINCT g FROM v), pr AS (SELECT a.g AS group1, b.g AS group2 FROM gr a JOIN gr b ON a.g < b.g), x AS (SELECT group1, group2, g, v FROM pr JOIN v ON g = group1 OR g = group2), "
             "r AS (SELECT *, rank() OVER (PARTITION BY group1, group2 ORDER BY v) + (count(*) OVER (PARTITION BY group1, group2, v) - 1) / 2.0 AS r FROM x), n AS (SELECT group1, group2, count(CASE WHEN g = group1 THEN 1 END)::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(CASE WHEN g = group1 THEN r END) AS r1 FROM r GROUP BY 1, 2), "
             "t AS (SELECT group1, group2, sum(pow(c, 3) - c) AS t FROM (SELECT group1, group2, v, count(*)::DOUBLE AS c FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * (n - n1) / 12 * (n + 1 - t / (n * (n - 1))) AS var FROM n JOIN t USING (group1, group2)) "
             "SELECT group1, group2, round(u, 2) AS u, round((u - n1 * (n - n1) / 2) / sqrt(var), 6) AS z FROM u"),
)
def n17_mann_whitney(spark, sf_dir):
    o = v.obs(spark, sf_dir).withColumn("v", F.round("co2"))
    return _rounded(me.mann_whitney_pairs(o, "variable", "v", _EVENTS), u=2, z=6).select("group1", "group2", "u", "z")


@query("n18_diagnostic_points", "WITH r AS (SELECT o_orderkey, o_totalprice - 250000 AS r, 1 + o_orderkey % 10 AS u FROM orders), s AS (SELECT avg(r) AS m, stddev_pop(r) AS s FROM r) SELECT o_orderkey, round((r - m) / s, 6) AS standardised, round(sqrt(abs((r - m) / s)), 6) AS root_size, round(1 / (u + 1e-8), 6) AS leverage FROM r, s")
def n18_diagnostic_points(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 250000).alias("r"), (1 + F.col("o_orderkey") % 10).alias("u"))
    d = me.diagnostic_points(o, ["o_orderkey"], "r", "u")
    return _rounded(d, standardised=6, root_size=6, leverage=6).select("o_orderkey", "standardised", "root_size", "leverage")


@query("n18_error_uncertainty", "SELECT round(corr(l_tax, abs(l_extendedprice - 2100 * l_quantity)), 6) AS corr FROM lineitem")
def n18_error_uncertainty(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem").withColumn("r", F.col("l_extendedprice") - 2100 * F.col("l_quantity"))
    return _rounded(me.error_uncertainty(li, "r", "l_tax"), corr=6)


@query("n22_compare_models", _YP + ", m AS (SELECT subject_id, count(*) AS n, avg(pow(y - f, 2)) AS mse FROM p GROUP BY 1) SELECT subject_id, round(n * ln(mse) + 6, 4) AS aic, round(n * ln(mse) + ln(n) * 3, 4) AS bic, n * ln(mse) + ln(n) * 3 = (SELECT min(n * ln(mse) + ln(n) * 3) FROM m) AS best FROM m")
def n22_compare_models(spark, sf_dir):
    m = me.information_criteria(me.regression_metrics(_yp(spark, sf_dir), "y", "f", KEYS), 3)
    return _rounded(me.compare_models(m, "bic", "subject_id"), aic=4, bic=4).select("subject_id", "aic", "bic", "best")


@query("n23_evaluation_report", _YP + ", t AS (SELECT *, CASE WHEN subject_id % 5 = 0 THEN 'holdout' ELSE 'development' END AS role FROM p), m AS (SELECT role, count(*) AS n, avg(pow(y - f, 2)) AS mse, avg(pow(y - f, 2)) / var_pop(y) AS u FROM t GROUP BY 1) SELECT round(max(CASE WHEN role = 'development' THEN mse END), 0) AS dev_mse, round(max(CASE WHEN role = 'holdout' THEN mse END), 0) AS holdout_mse, round(1 - max(CASE WHEN role = 'development' THEN u END), 6) AS dev_r2, round(1 - max(CASE WHEN role = 'holdout' THEN u END), 6) AS holdout_r2, round(max(CASE WHEN role = 'holdout' THEN mse END) / max(CASE WHEN role = 'development' THEN mse END), 6) AS ratio FROM m")
def n23_evaluation_report(spark, sf_dir):
    p = _yp(spark, sf_dir).withColumn("role", F.when(F.col("subject_id") % 5 == 0, "holdout").otherwise("development"))
    r = me.evaluation_report(p, "y", "f", "role")
    return _rounded(r, dev_mse=0, holdout_mse=0, dev_r2=6, holdout_r2=6, ratio=6)



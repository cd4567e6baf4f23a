"""Queries over ordered series: windows, stability, autocorrelation, interpolation."""

from pyspark.sql import functions as F

from plumewalk.operators import series as se
from plumewalk.operators.ordered import sliding, with_position
from plumewalk.plans import views as v
from plumewalk.plans.q_clean import _CODE
from plumewalk.plans.registry import query
from plumewalk.plans.views import sql_with
from plumewalk.operators import clean as cl

KEYS, ORDER = ["subject_id"], ["ts", "event_id"]
_W = "OVER (PARTITION BY subject_id ORDER BY ts, event_id)"
_POS = f"WITH p AS (SELECT *, row_number() {_W} - 1 AS pos, count(*) OVER (PARTITION BY subject_id) AS n FROM obs) "


def _roll(agg, c, k, part="subject_id", order="ts, event_id"):
    w = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} = {k} THEN {agg}({c}) {w} END"


@query("e02_lags", sql_with("obs", "SELECT event_id, " + ", ".join(f"lag(co2, {k}) {_W} AS co2_lag_{k}" for k in se.LAGS) + " FROM obs"))
def e02_lags(spark, sf_dir):
    out = se.lag_features(v.obs(spark, sf_dir), KEYS, ORDER, "co2", windows=[])
    return out.select("event_id", *[f"co2_lag_{k}" for k in se.LAGS])


@query(
    "e03_rolling",
    sql_with("obs", "SELECT event_id, " + ", ".join(f"round({_roll(a, 'co2', k)}, 6) AS co2_rolling_{n}_{k}" for k in se.WINDOWS for a, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))) + " FROM obs"),
)
def e03_rolling(spark, sf_dir):
    out = se.lag_features(v.obs(spark, sf_dir), KEYS, ORDER, "co2", lags=[])
    names = [f"co2_rolling_{n}_{k}" for k in se.WINDOWS for n in ("mean", "std", "min", "max")]
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in names])


@query("e04_difference", sql_with("obs", f"SELECT event_id, round(co2 - lag(co2, 1) {_W}, 6) AS co2_diff_1 FROM obs"))
def e04_difference(spark, sf_dir):
    out = se.lag_features(v.obs(spark, sf_dir), KEYS, ORDER, "co2", lags=[], windows=[])
    return out.select("event_id", F.round("co2_diff_1", 6).alias("co2_diff_1"))


@query(
    "e05_calendar",
    "WITH c AS (SELECT event_id, hour(ts)::INT AS hour, ((dayofweek(ts) + 6) % 7)::INT AS day_of_week, dayofyear(ts)::INT AS day_of_year, month(ts)::INT AS month, quarter(ts)::INT AS quarter FROM events) "
    "SELECT *, round(sin(2 * pi() * hour / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour / 24), 6) + 0 AS hour_cos, round(sin(2 * pi() * day_of_week / 7), 6) + 0 AS day_sin, round(cos(2 * pi() * day_of_week / 7), 6) + 0 AS day_cos, "
    "round(sin(2 * pi() * month / 12), 6) + 0 AS month_sin, round(cos(2 * pi() * month / 12), 6) + 0 AS month_cos FROM c",
)
def e05_calendar(spark, sf_dir):
    out = se.calendar_features(v.table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in out.columns if c.endswith(("_sin", "_cos"))})


@query("e06_position", sql_with("obs", f"SELECT event_id, row_number() {_W} - 1 AS pos FROM obs"))
def e06_position(spark, sf_dir):
    return with_position(v.obs(spark, sf_dir), KEYS, ORDER).select("event_id", "pos")


@query("e07_change_points", sql_with("obs", f"WITH c AS (SELECT event_id, variable, lag(variable) {_W} AS b, row_number() {_W} AS r FROM obs) SELECT event_id, variable FROM c WHERE r = 1 OR variable IS DISTINCT FROM b"))
def e07_change_points(spark, sf_dir):
    return se.change_points(v.obs(spark, sf_dir), KEYS, ORDER, "variable").select("event_id", "variable")


@query("e08_location_groups", sql_with("obs", _CODE + "SELECT subject_id, location, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(co2), 6) AS mean FROM lab GROUP BY subject_id, location"))
def e08_location_groups(spark, sf_dir):
    lab = cl.label_route(v.obs(spark, sf_dir), KEYS, ORDER)
    return lab.groupBy("subject_id", "location").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("co2"), 6).alias("mean"))


@query(
    "e10_stabilised",
    sql_with("obs", f"WITH p AS (SELECT subject_id, event_id, co2, row_number() {_W} - 1 AS pos, {_roll('stddev_samp', 'co2', 5)} AS sd FROM obs), s AS (SELECT subject_id, min(pos) AS p0 FROM p WHERE sd < 20 GROUP BY 1) SELECT event_id, pos FROM p JOIN s USING (subject_id) WHERE pos >= p0 + 4"),
)
def e10_stabilised(spark, sf_dir):
    return se.stabilised(v.obs(spark, sf_dir), KEYS, ORDER, "co2", window=5, threshold=20.0).select("event_id", "pos")


_THRESH = (
    _POS + ", t AS (SELECT * FROM p WHERE pos >= CASE WHEN floor(n * 0.3 + 1e-9) > 0 THEN n - floor(n * 0.3 + 1e-9) ELSE 0 END), "
    f"m AS (SELECT subject_id, {_roll('stddev_samp', 'co2', 5)} AS sd, abs(co2 - lag(co2) {_W}) AS df FROM t), "
    "th AS (SELECT subject_id, median(sd) + stddev_samp(sd) AS st, median(df) + stddev_samp(df) AS dt FROM m GROUP BY 1) "
)


@query("e11_stability_thresholds", sql_with("obs", _THRESH + "SELECT subject_id, round(st, 6) AS std_threshold, round(dt, 6) AS diff_threshold FROM th"))
def e11_stability_thresholds(spark, sf_dir):
    out = se.stability_thresholds(v.obs(spark, sf_dir), KEYS, ORDER, "co2", window=5)
    return out.select("subject_id", F.round("std_threshold", 6).alias("std_threshold"), F.round("diff_threshold", 6).alias("diff_threshold"))


_FLAGS = (
    _THRESH + f", r AS (SELECT subject_id, event_id, pos, n, {_roll('stddev_samp', 'co2', 5)} AS sd, abs(co2 - lag(co2) {_W}) AS df FROM p), "
    "f AS (SELECT r.*, CASE WHEN sd IS NOT NULL THEN coalesce(sd < st, FALSE) END AS so, CASE WHEN df IS NOT NULL THEN coalesce(df < dt, FALSE) END AS dok FROM r LEFT JOIN th USING (subject_id)), "
    "a AS (SELECT subject_id, coalesce(bool_and(so), TRUE) AND coalesce(bool_and(dok), TRUE) AS stable FROM f GROUP BY 1) "
)


@query("e12_fully_stable", sql_with("obs", _FLAGS + "SELECT subject_id, stable FROM a"))
def e12_fully_stable(spark, sf_dir):
    return se.fully_stable(v.obs(spark, sf_dir), KEYS, ORDER, "co2", window=5)


_START = (
    _FLAGS + ", c AS (SELECT *, min(coalesce(so AND dok, FALSE)::INT) OVER (PARTITION BY subject_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM f), "
    "g AS (SELECT subject_id, min(pos) AS p0 FROM c WHERE run = 1 AND pos >= 4 AND pos < n - 3 GROUP BY 1), "
    "s AS (SELECT a.subject_id, CASE WHEN stable THEN 0 ELSE p0 + 3 END AS start FROM a LEFT JOIN g USING (subject_id)) "
)


@query("e13_stable_start", sql_with("obs", _START + "SELECT subject_id, start FROM s WHERE start IS NOT NULL"))
def e13_stable_start(spark, sf_dir):
    return se.stable_start(v.obs(spark, sf_dir), KEYS, ORDER, "co2", window=5)


@query("e13_auto_stable", sql_with("obs", _START + "SELECT event_id FROM p JOIN s USING (subject_id) WHERE pos >= start"))
def e13_auto_stable(spark, sf_dir):
    return se.auto_stable(v.obs(spark, sf_dir), KEYS, ORDER, "co2", window=5).select("event_id")


@query("e15_synthetic_clock", sql_with("obs", _POS + "SELECT event_id, TIMESTAMP '2022-11-11' + to_days((subject_id - 1)::INT) + to_seconds(pos) AS ts FROM p"))
def e15_synthetic_clock(spark, sf_dir):
    return se.synthetic_clock(v.obs(spark, sf_dir), KEYS, ORDER, "subject_id").select("event_id", "ts")


@query(
    "e16_autocorrelation",
    sql_with("obs", f"WITH s AS (SELECT subject_id, k AS lag, co2, lag(co2, k) {_W.replace('PARTITION BY subject_id', 'PARTITION BY subject_id, k')} AS b FROM obs, (SELECT unnest([1, 5, 24]) AS k)) SELECT subject_id, lag::INT AS lag, count(*) AS n, round(corr(co2, b), 6) AS autocorr FROM s GROUP BY subject_id, lag"),
)
def e16_autocorrelation(spark, sf_dir):
    out = se.autocorrelation(v.obs(spark, sf_dir), KEYS, ORDER, "co2", [1, 5, 24])
    return out.withColumn("autocorr", F.round("autocorr", 6))


_TREND = _POS + ", t AS (SELECT subject_id, count(*) AS length, avg(co2) AS mean, stddev_samp(co2) AS std, corr(pos, co2) AS c, var_samp(CASE WHEN pos < n // 2 THEN co2 END) AS v1, var_samp(CASE WHEN pos >= n // 2 THEN co2 END) AS v2 FROM p GROUP BY 1) "


@query("e17_trend", sql_with("obs", _TREND + "SELECT subject_id, length, round(mean, 6) AS mean, round(std, 6) AS std, round(c, 6) AS trend_corr, CASE WHEN c > 0.1 THEN 'increasing' WHEN c < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM t"))
def e17_trend(spark, sf_dir):
    t = se.trend_and_variance(v.obs(spark, sf_dir), KEYS, ORDER, "co2")
    return t.select("subject_id", "length", *[F.round(c, 6).alias(c) for c in ("mean", "std", "trend_corr")], "trend")


@query("e18_variance_ratio", sql_with("obs", _TREND.replace("subject_id", "variable") + "SELECT variable, length, CASE WHEN length > 100 THEN CASE WHEN greatest(v1, v2) / least(v1, v2) < 2 THEN 'stationary' ELSE 'non-stationary' END END AS stationarity FROM t"))
def e18_variance_ratio(spark, sf_dir):
    return se.trend_and_variance(v.obs(spark, sf_dir), ["variable"], ORDER, "co2").select("variable", "length", "stationarity")


_ACF = (
    f"WITH z AS (SELECT subject_id, event_id, ts, co2 - avg(co2) OVER (PARTITION BY subject_id) AS z FROM obs), s AS (SELECT subject_id, k, z, lag(z, k) OVER (PARTITION BY subject_id, k ORDER BY ts, event_id) AS b FROM z, range(1, 21) r(k)), "
    "ac AS (SELECT subject_id, k::INT AS lag, count(*) AS n, coalesce(sum(z * b), 0) / sum(z * z) AS acf FROM s GROUP BY subject_id, k HAVING k < count(*)) "
)


@query("e19_acf", sql_with("obs", _ACF + "SELECT subject_id, lag, n, round(acf, 6) AS acf FROM ac"))
def e19_acf(spark, sf_dir):
    return se.acf(v.obs(spark, sf_dir), KEYS, ORDER, "co2", 20).withColumn("acf", F.round("acf", 6))


@query("e19_memory_length", sql_with("obs", _ACF + "SELECT subject_id, min(lag) AS first_lag FROM ac WHERE abs(acf) < 0.1 GROUP BY 1"))
def e19_memory_length(spark, sf_dir):
    return se.memory_length(v.obs(spark, sf_dir), KEYS, ORDER, "co2", max_lag=20)


@query(
    "e20_pacf",
    sql_with("obs", _ACF + ", r AS (SELECT subject_id, max(CASE WHEN lag = 1 THEN acf END) AS r1, max(CASE WHEN lag = 2 THEN acf END) AS r2 FROM ac GROUP BY 1) SELECT subject_id, 1 AS lag, round(r1, 6) AS pacf FROM r UNION ALL SELECT subject_id, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 6) FROM r"),
)
def e20_pacf(spark, sf_dir):
    out = se.pacf(v.obs(spark, sf_dir), KEYS, ORDER, "co2", max_lag=2)
    return out.withColumn("pacf", F.round("pacf", 6))


_FW = se.difference_weights(0.4, 0.05)


@query("e21_fractional_difference", sql_with("obs", "WITH f AS (SELECT event_id, " + " + ".join(f"({w!r})::DOUBLE * " + ("co2" if k == 0 else f"lag(co2, {k}) {_W}") for k, w in enumerate(_FW)) + " AS d FROM obs) SELECT event_id, round(d, 6) AS fdiff FROM f WHERE d IS NOT NULL"))
def e21_fractional_difference(spark, sf_dir):
    out = se.fractional_difference(v.obs(spark, sf_dir), KEYS, ORDER, "co2", 0.4, 0.05)
    return out.select("event_id", F.round("fdiff", 6).alias("fdiff"))


@query("e22_directional_accuracy", sql_with("obs", f"WITH s AS (SELECT subject_id, sign(co2 - lag(co2) {_W}) AS a, sign(g - lag(g) {_W}) AS b FROM (SELECT *, co2 * (event_id % 7) AS g FROM obs)) SELECT subject_id, round(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a = b)::INT END) * 100, 6) AS directional_accuracy FROM s GROUP BY 1"))
def e22_directional_accuracy(spark, sf_dir):
    o = v.obs(spark, sf_dir).withColumn("g", F.col("co2") * (F.col("event_id") % 7))
    out = se.directional_accuracy(o, KEYS, ORDER, "co2", "g")
    return out.withColumn("directional_accuracy", F.round("directional_accuracy", 6))


_KNOTS = "WITH k AS (SELECT subject_id, epoch(date_trunc('second', ts))::BIGINT AS t, avg(CASE WHEN event_id % 9 <> 0 THEN co2 END) AS y FROM obs GROUP BY 1, 2), sp AS (SELECT subject_id, min(t) AS g0, max(t) AS g1 FROM k GROUP BY 1), "


@query(
    "i01_pchip",
    sql_with(
        "obs",
        _KNOTS + "n AS (SELECT subject_id, " + ", ".join(f"lead({c}, {o}) OVER w AS {c}{o + 1}" if o > 0 else (f"lag({c}, 1) OVER w AS {c}0" if o < 0 else f"{c} AS {c}1") for c in ("t", "y") for o in (-1, 0, 1, 2))
        + " FROM k WHERE y IS NOT NULL WINDOW w AS (PARTITION BY subject_id ORDER BY t)), "
        "h AS (SELECT *, t1 - t0 AS h0, t2 - t1 AS h1, t3 - t2 AS h2, (y1 - y0) / (t1 - t0) AS s0, (y2 - y1) / (t2 - t1) AS s1, (y3 - y2) / (t3 - t2) AS s2 FROM n WHERE t2 IS NOT NULL), "
        "e AS (SELECT *, ((2 * h1 + h2) * s1 - h1 * s2) / (h1 + h2) AS ea, ((2 * h1 + h0) * s1 - h1 * s0) / (h1 + h0) AS eb FROM h), "
        "d AS (SELECT *, CASE WHEN t0 IS NULL AND t3 IS NULL THEN s1 WHEN t0 IS NULL THEN CASE WHEN sign(ea) <> sign(s1) THEN 0 WHEN sign(s1) <> sign(s2) AND abs(ea) > 3 * abs(s1) THEN 3 * s1 ELSE ea END "
        "WHEN s0 * s1 <= 0 THEN 0 ELSE (3 * h1 + 3 * h0) / ((2 * h1 + h0) / s0 + (h1 + 2 * h0) / s1) END AS d0, "
        "CASE WHEN t0 IS NULL AND t3 IS NULL THEN s1 WHEN t3 IS NULL THEN CASE WHEN sign(eb) <> sign(s1) THEN 0 WHEN sign(s1) <> sign(s0) AND abs(eb) > 3 * abs(s1) THEN 3 * s1 ELSE eb END "
        "WHEN s1 * s2 <= 0 THEN 0 ELSE (3 * h2 + 3 * h1) / ((2 * h2 + h1) / s1 + (h2 + 2 * h1) / s2) END AS d1 FROM e), "
        "g AS (SELECT subject_id, g0, unnest(range(0, ((g1 - g0) // 3600) + 1)) AS i FROM sp), "
        "x AS (SELECT g.subject_id, g.g0 + i * 3600 AS t, d.* EXCLUDE (subject_id) FROM g JOIN d ON d.subject_id = g.subject_id AND (g.g0 + i * 3600 >= t1 OR t0 IS NULL) AND (g.g0 + i * 3600 < t2 OR t3 IS NULL)), "
        "u AS (SELECT *, (t - t1)::DOUBLE / h1 AS u FROM x) "
        "SELECT subject_id, t, round((2*u*u*u - 3*u*u + 1) * y1 + (u*u*u - 2*u*u + u) * h1 * d0 + (3*u*u - 2*u*u*u) * y2 + (u*u*u - u*u) * h1 * d1, 4) AS value FROM u",
    ),
)
def i01_pchip(spark, sf_dir):
    t = F.unix_seconds(F.date_trunc("second", F.col("ts")).cast("timestamp"))
    y = F.avg(F.when(F.col("event_id") % 9 != 0, F.col("co2")))
    knots = v.obs(spark, sf_dir).groupBy("subject_id", t.alias("t")).agg(y.alias("y"))
    return se.pchip(knots, KEYS, "t", "y", step=3600).withColumn("value", F.round("value", 4))


@query(
    "i02_resample_linear",
    sql_with("obs", _POS + ", s AS (SELECT * FROM (SELECT *, CASE WHEN pos = 0 OR pos = n - 1 OR pos = n // 2 THEN 1 ELSE 0 END AS k FROM p) WHERE k = 1), q AS (SELECT subject_id, co2, row_number() OVER (PARTITION BY subject_id ORDER BY pos) - 1 AS pos, count(*) OVER (PARTITION BY subject_id) AS n FROM s), "
             "g AS (SELECT DISTINCT subject_id, n, i, i * ((n - 1) / 8.0::DOUBLE) AS a FROM q, range(9) r(i)) SELECT g.subject_id, i, round(lo.co2 + (coalesce(hi.co2, lo.co2) - lo.co2) * (a - floor(a)), 6) AS value FROM g JOIN q lo ON lo.subject_id = g.subject_id AND lo.pos = floor(a) LEFT JOIN q hi ON hi.subject_id = g.subject_id AND hi.pos = floor(a) + 1"),
)
def i02_resample_linear(spark, sf_dir):
    placed = se.group_bounds(with_position(v.obs(spark, sf_dir), KEYS, ORDER), KEYS, {"n": F.count(F.lit(1))})
    few = placed.where((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1) | (F.col("pos") == F.floor(F.col("n") / 2)))
    return se.resample(few, KEYS, ["pos"], "co2", 9).withColumn("value", F.round("value", 6))


@query("i02_resample_cubic")
def i02_resample_cubic(spark, sf_dir):
    """Rows only: the not-a-knot spline is checked against a dense solve in the tests."""
    return se.resample(v.obs(spark, sf_dir), KEYS, ORDER, "co2", 300)


@query("f01_time_order", sql_with("obs", f"SELECT event_id, row_number() {_W} AS nth FROM obs"))
def f01_time_order(spark, sf_dir):
    out = with_position(v.obs(spark, sf_dir), KEYS, ORDER)
    return out.select("event_id", (F.col("pos") + 1).alias("nth"))


@query("f06_head_tail", sql_with("obs", _POS + "SELECT event_id, CASE WHEN pos < floor(n * 0.3 + 1e-9) THEN 'head' ELSE 'tail' END AS part FROM p WHERE pos < floor(n * 0.3 + 1e-9) OR pos >= n - floor(n * 0.3 + 1e-9)"))
def f06_head_tail(spark, sf_dir):
    placed = se.group_bounds(with_position(v.obs(spark, sf_dir), KEYS, ORDER), KEYS, {"n": F.count(F.lit(1))})
    m = F.floor(F.col("n") * 0.3 + 1e-9)
    head, tail = F.col("pos") < m, F.col("pos") >= F.col("n") - m
    return placed.where(head | tail).select("event_id", F.when(head, "head").otherwise("tail").alias("part"))

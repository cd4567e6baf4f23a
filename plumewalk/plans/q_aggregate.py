"""Queries over summaries, lookups, top-k and report tables."""

from pyspark.sql import functions as F

from plumewalk.functions import scalar
from plumewalk.operators import aggregate as ag
from plumewalk.operators import clean as cl
from plumewalk.operators import geometry as gm
from plumewalk.plans import views as v
from plumewalk.plans.q_clean import _CODE, _VM
from plumewalk.plans.registry import query
from plumewalk.plans.views import sql_with


def rows():
    return F.count(F.lit(1)).alias("n")

# Edge points: order lines of an order, concentration from the price, some missing.
_EP = (
    "WITH ep AS (SELECT 'e' || l_orderkey AS edge_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS point_id, "
    "400 + l_quantity AS c0, l_orderkey, l_partkey FROM lineitem), "
    "pt AS (SELECT *, point_id * 5.0 + 2.5 AS d, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE c0 END AS c, 9.0 + l_partkey / 100000.0::DOUBLE AS x, 45.0 + l_partkey / 200000.0::DOUBLE AS y, "
    "CASE l_orderkey % 3 WHEN 0 THEN 'footway' WHEN 1 THEN 'primary' END AS highway FROM ep) "
)


def _edge_points(spark, sf_dir):
    from plumewalk.operators.ordered import with_position

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    p = with_position(v.table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, "point_id")
    return p.select(
        F.concat(F.lit("e"), "l_orderkey").alias("edge_id"), "point_id", (F.col("point_id") * 5.0 + 2.5).alias("distance_along_edge"),
        F.when(F.col("l_partkey") % 19 != 0, 400 + F.col("l_quantity")).alias("predicted_co2"),
        (9.0 + F.col("l_partkey") / F.lit(100000.0)).alias("x"), (45.0 + F.col("l_partkey") / F.lit(200000.0)).alias("y"),
        F.when(F.col("l_orderkey") % 3 == 0, "footway").when(F.col("l_orderkey") % 3 == 1, "primary").alias("highway"),
    )


_INTEGRAL = (
    _EP + ", k AS (SELECT *, (c + lead(c) OVER (PARTITION BY edge_id ORDER BY d)) / 2 AS mid FROM pt WHERE c IS NOT NULL), "
    "ei AS (SELECT edge_id, count(*) AS n_points, avg(c) AS mean_co2, CASE WHEN count(*) = 1 THEN max(c) ELSE sum(mid) END * (5 / 1.4 / 60) AS integral FROM k GROUP BY 1), "
    "me AS (SELECT edge_id, arg_min(x, d) AS start_x, arg_max(y, d) AS end_y, coalesce(arg_min(highway, d), 'unknown') AS highway_type FROM pt GROUP BY 1) "
)


@query("e09_trapezoid", _INTEGRAL + "SELECT edge_id, n_points, round(integral, 6) AS integral FROM ei")
def e09_trapezoid(spark, sf_dir):
    return ag.edge_integrals(_edge_points(spark, sf_dir)).select("edge_id", "n_points", F.round("integral", 6).alias("integral"))


@query("d07_edge_exposure", _INTEGRAL + "SELECT edge_id, round(integral * 12.5, 5) AS exposure, round(mean_co2, 6) AS mean_co2, round(start_x, 6) AS start_x, round(end_y, 6) AS end_y, highway_type FROM ei JOIN me USING (edge_id)")
def d07_edge_exposure(spark, sf_dir):
    e = ag.edge_integrals(_edge_points(spark, sf_dir))
    return e.select(
        "edge_id", F.round(F.col("integral") * 12.5, 5).alias("exposure"), F.round("mean_co2", 6).alias("mean_co2"),
        F.round("start_x", 6).alias("start_x"), F.round("end_y", 6).alias("end_y"), "highway_type",
    )


@query(
    "p06_personal_exposure",
    sql_with("profiles", _INTEGRAL + f", q AS (SELECT profile_id, {_VM.format(fvc='4.0')} AS vm FROM profiles) SELECT o_custkey AS profile_id, edge_id, round(integral * vm, 5) AS exposure FROM orders JOIN ei ON ei.edge_id = 'e' || o_orderkey JOIN q ON q.profile_id = o_custkey"),
)
def p06_personal_exposure(spark, sf_dir):
    from plumewalk.operators.route import personal_exposure

    trips = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.concat(F.lit("e"), "o_orderkey").alias("edge_id"))
    people = v.profiles(spark, sf_dir).withColumn("vm", scalar.minute_ventilation("hr", "fb", "age", "sex", F.lit(4.0)))
    out = personal_exposure(trips, ag.edge_integrals(_edge_points(spark, sf_dir)), people)
    return out.select("profile_id", "edge_id", F.round("exposure", 5).alias("exposure"))


@query("d10_street_types", _EP + "SELECT highway, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, count(c) AS n FROM pt WHERE highway IS NOT NULL AND c IS NOT NULL GROUP BY 1")
def d10_street_types(spark, sf_dir):
    s = ag.street_type_stats(_edge_points(spark, sf_dir))
    return s.select("highway", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("d08_subject_environment", sql_with("env", "SELECT subject, round(avg(temperature), 6) AS temperature, round(avg(humidity), 6) AS humidity, round(avg(pressure), 6) AS pressure, round(avg(wind_direction), 6) AS wind_direction FROM env GROUP BY 1"))
def d08_subject_environment(spark, sf_dir):
    cols = ["temperature", "humidity", "pressure", "wind_direction"]
    return v.env(spark, sf_dir).groupBy("subject").agg(*[F.round(F.avg(c), 6).alias(c) for c in cols])


_LOCS = ["A", "AB", "B", "BC"]


@query(
    "d09_location_means",
    sql_with("obs", _CODE + ", w AS (SELECT subject_id, " + ", ".join(f"avg(CASE WHEN location = '{c}' THEN co2 END) AS m_{c}" for c in _LOCS) + " FROM lab GROUP BY 1) SELECT subject_id, " + ", ".join(f"round(m_{c}, 6) AS m_{c}" for c in _LOCS) + " FROM w UNION ALL SELECT NULL, " + ", ".join(f"round(avg(m_{c}), 6)" for c in _LOCS) + " FROM w"),
)
def d09_location_means(spark, sf_dir):
    lab = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    wide = ag.mean_by_location(lab, "co2", _LOCS)
    return wide.select("subject_id", *[F.round(c, 6).alias(f"m_{c}") for c in _LOCS])


@query("d11_surface_summary", sql_with("poi", "SELECT count(*) AS n, count(levels) AS valid, round(count(levels) / count(*), 6) AS share, min(levels) AS min, max(levels) AS max, round(avg(levels), 6) AS mean, round(stddev_pop(levels), 6) AS std, median(levels) AS median FROM poi"))
def d11_surface_summary(spark, sf_dir):
    return ag.surface_summary(v.poi(spark, sf_dir), "levels").withColumns({c: F.round(c, 6) for c in ("share", "mean", "std")})


_DCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("d12_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c}) AS max FROM lineitem" for c in _DCOLS))
def d12_describe(spark, sf_dir):
    d = ag.describe(v.table(spark, sf_dir, "lineitem"), _DCOLS)
    return d.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("d13_hotspots", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.9) AS t FROM orders) SELECT round(max(t), 6) AS threshold, count(CASE WHEN o_totalprice > t THEN 1 END) AS n_hot, round(count(CASE WHEN o_totalprice > t THEN 1 END) / count(*), 6) AS share FROM orders, q")
def d13_hotspots(spark, sf_dir):
    return ag.hotspots(v.table(spark, sf_dir, "orders"), "o_totalprice").withColumns({c: F.round(c, 6) for c in ("threshold", "share")})


@query("d14_histogram", "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def d14_histogram(spark, sf_dir):
    return ag.histogram(v.table(spark, sf_dir, "orders"), "o_totalprice")


@query("d15_target_statistics", "SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.99), 6) AS q99 FROM events")
def d15_target_statistics(spark, sf_dir):
    s = ag.target_statistics(v.table(spark, sf_dir, "events"), "value")
    q = {f"q{n}": F.round(F.col("quantiles")[i], 6) for i, n in enumerate(("01", "50", "99"))}
    return s.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", *[c.alias(n) for n, c in q.items()])


_FEATS = ["l_quantity", "l_discount", "l_tax"]


@query("d16_target_correlations", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS corr FROM lineitem" for c in _FEATS))
def d16_target_correlations(spark, sf_dir):
    return ag.target_correlations(v.table(spark, sf_dir, "lineitem"), _FEATS, "l_extendedprice").withColumn("corr", F.round("corr", 6))


_RANK = "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _FEATS) + " FROM lineitem) "
_FP = [(a, b) for i, a in enumerate(_FEATS) for b in _FEATS[i + 1 :]]


@query(
    "d16_correlation_matrix",
    _RANK + "SELECT 'pearson' AS method, * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in _FP)
    + ") UNION ALL SELECT 'spearman', * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM r" for a, b in _FP) + ")",
)
def d16_correlation_matrix(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem")
    both = [ag.correlation_matrix(li, _FEATS, m).withColumn("method", F.lit(m)) for m in ("pearson", "spearman")]
    return both[0].unionByName(both[1]).withColumn("corr", F.round("corr", 6))


@query(
    "d17_validation_report",
    sql_with("poi", "WITH d AS (SELECT sum(n - 1)::BIGINT AS r FROM (SELECT category, levels, count(*) AS n FROM poi GROUP BY ALL)) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(CASE WHEN {c} IS NULL THEN 1 END) AS missing, count(DISTINCT {c}) AS \"distinct\", count(DISTINCT {c}) <= 1 AS constant, max(r) AS duplicate_keys FROM poi, d" for c in ("category", "brand", "levels", "fid"))),
)
def d17_validation_report(spark, sf_dir):
    return ag.validation_report(v.poi(spark, sf_dir), ["category", "brand", "levels", "fid"], ["category", "levels"])


@query(
    "d18_profile",
    sql_with("poi", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS missing_share, round(corr({c}, fid), 6) AS corr FROM poi" for c in ("levels", "x", "y"))),
)
def d18_profile(spark, sf_dir):
    p = ag.profile(v.poi(spark, sf_dir), ["levels", "x", "y"], "fid")
    return p.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75", "missing_share", "corr")})


@query(
    "d19_parameter_diversity",
    sql_with("trials", "SELECT 'alpha' AS param, NULL AS value, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max, NULL::BIGINT AS n FROM trials UNION ALL SELECT 'drift', drift, NULL, NULL, NULL, NULL, count(*) FROM trials GROUP BY drift"),
)
def d19_parameter_diversity(spark, sf_dir):
    t = v.trials(spark, sf_dir).withColumn("params", F.create_map(F.lit("alpha"), F.col("value").cast("string"), F.lit("drift"), "drift"))
    numeric, text = ag.parameter_diversity(t)
    numeric = numeric.withColumns({c: F.round(c, 4) for c in ("mean", "std")})
    return numeric.unionByName(text, allowMissingColumns=True).select("param", "value", "mean", "std", "min", "max", "n")


@query("d19_score_summary", sql_with("trials", "SELECT min(value) AS best, max(value) AS worst, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, count(value) AS n FROM trials"))
def d19_score_summary(spark, sf_dir):
    return ag.score_summary(v.trials(spark, sf_dir), "value").withColumns({c: F.round(c, 4) for c in ("mean", "std")})




@query(
    "d20_pair_matrix",
    "WITH p AS (SELECT l_returnflag AS a, CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END AS b, l_discount AS p FROM lineitem), s AS (SELECT a AS r, b AS c, p FROM p UNION ALL SELECT b, a, p FROM p) "
    "SELECT r AS row, " + ", ".join(f"round(avg(CASE WHEN c = '{x}' THEN p END), 8) AS p_{x}" for x in "ANR") + " FROM s GROUP BY r",
)
def d20_pair_matrix(spark, sf_dir):
    f = F.col("l_returnflag")
    p = v.table(spark, sf_dir, "lineitem").select(f.alias("a"), F.when(f == "A", "N").when(f == "N", "R").otherwise("A").alias("b"), F.col("l_discount").alias("p"))
    m = ag.pair_matrix(p, "a", "b", "p", ["A", "N", "R"])
    return m.select("row", *[F.round(x, 8).alias(f"p_{x}") for x in "ANR"])


@query(
    "d21_mad_filter",
    "WITH l AS (SELECT l_suppkey, l_orderkey, l_partkey, l_tax, l_extendedprice, -log10(greatest(least(l_tax + 0.001, 1), 1e-10)) AS lp FROM lineitem), m AS (SELECT l_suppkey, median(lp) AS med FROM l GROUP BY 1), "
    "d AS (SELECT l.*, abs(lp - med) AS dev FROM l JOIN m USING (l_suppkey)), a AS (SELECT l_suppkey, median(dev) AS mad FROM d GROUP BY 1) "
    "SELECT l_suppkey, count(*) AS kept, round(sum(l_tax), 4) AS tax FROM d JOIN a USING (l_suppkey) WHERE mad = 0 OR dev / (mad * 1.4826) < 1.5 GROUP BY 1",
)
def d21_mad_filter(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_tax", (F.col("l_tax") + 0.001).alias("p"))
    kept = ag.drop_outlying_pvalues(li, ["l_suppkey"], "p")
    return kept.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("l_tax"), 4).alias("tax"))


@query("d22_walking_speed", sql_with("obs", "WITH s AS (SELECT subject_id, epoch(max(ts)) - epoch(min(ts)) AS d FROM obs GROUP BY 1) SELECT round(coalesce(avg(3000000.0 / d), 1.4), 6) AS speed FROM s WHERE d > 0"))
def d22_walking_speed(spark, sf_dir):
    return ag.walking_speed(v.obs(spark, sf_dir), 3_000_000.0).withColumn("speed", F.round("speed", 6))


@query("d23_trial_states", sql_with("trials", "SELECT state, count(*) AS n, min(value) AS best_value, arg_min(trial, (value, trial)) AS best_trial FROM trials GROUP BY 1"))
def d23_trial_states(spark, sf_dir):
    return ag.trial_states(v.trials(spark, sf_dir))


@query("f02_top_features", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr({c}, l_extendedprice) AS r FROM lineitem" for c in _FEATS) + ") SELECT \"column\", round(abs(r), 6) AS strength FROM c ORDER BY abs(r) DESC LIMIT 2")
def f02_top_features(spark, sf_dir):
    c = ag.target_correlations(v.table(spark, sf_dir, "lineitem"), _FEATS, "l_extendedprice")
    best = ag.top_rows(c.withColumn("strength", F.abs("corr")), [], [F.desc("strength"), F.col("column")], 2)
    return best.select("column", F.round("strength", 6).alias("strength"))


@query("f03_best_row", sql_with("trials", "SELECT subject_id, arg_min(trial, (value, trial)) AS trial, min(value) AS value FROM trials GROUP BY 1"))
def f03_best_row(spark, sf_dir):
    best = F.min_by(F.struct("trial", "value"), F.struct("value", "trial"))
    return v.trials(spark, sf_dir).groupBy("subject_id").agg(best.alias("b")).select("subject_id", "b.trial", "b.value")


@query("f04_top_five", sql_with("trials", "SELECT state, trial, value, row_number() OVER (PARTITION BY state ORDER BY value, trial)::INT AS rank FROM trials QUALIFY rank <= 5"))
def f04_top_five(spark, sf_dir):
    return ag.top_rows(v.trials(spark, sf_dir), ["state"], [F.col("value"), F.col("trial")], 5).select("state", "trial", "value", "rank")


@query("f05_first_per_key", sql_with("trials", "SELECT subject_id, trial, value FROM trials QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY ts, trial) = 1"))
def f05_first_per_key(spark, sf_dir):
    return ag.first_per_key(v.trials(spark, sf_dir), ["subject_id"], ["ts", "trial"]).select("subject_id", "trial", "value")


_PLACES = "SELECT list_extract(['A','B','C','D','E','F','G','H'], (fid % 8 + 1)::INT) || fid AS name, fid AS pos, x, y FROM poi"


def _places(spark, sf_dir):
    letter = F.element_at(F.array(*map(F.lit, scalar.STATIC_LABELS)), (F.col("fid") % 8).cast("int") + 1)
    return v.poi(spark, sf_dir).select(F.concat(letter, F.col("fid")).alias("name"), F.col("fid").alias("pos"), "x", "y")


@query("c02_static_places", sql_with("obs poi", _CODE + f", pl AS ({_PLACES}), f AS (SELECT substring(name, 1, 1) AS location, x, y FROM pl QUALIFY row_number() OVER (PARTITION BY substring(name, 1, 1) ORDER BY pos) = 1) SELECT event_id, location, x, y FROM lab LEFT JOIN f USING (location) WHERE regime = 'static'"))
def c02_static_places(spark, sf_dir):
    lab = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"]).where("regime = 'static'")
    return gm.place_static(lab, _places(spark, sf_dir)).select("event_id", "location", "x", "y")


# One two-point segment per dynamic label, from the first to the last feature dealt to it.
_SEGS = (
    ", sg AS (SELECT list_extract(['AB','BC','CD','DE','EF','FG','GH'], (fid % 7 + 1)::INT) AS location, arg_min(x, fid) AS ax, arg_min(y, fid) AS ay, arg_max(x, fid) AS bx, arg_max(y, fid) AS by_ FROM poi GROUP BY 1) "
)


def _segments(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(c) for c in ("AB", "BC", "CD", "DE", "EF", "FG", "GH")]), (F.col("fid") % 7).cast("int") + 1)
    p = F.struct("x", "y")
    ends = v.poi(spark, sf_dir).groupBy(name.alias("location")).agg(F.min_by(p, "fid").alias("p"), F.max_by(p, "fid").alias("q"))
    return ends.select("location", F.array("p", "q").alias("pts"))


@query("c03_dynamic_segments", sql_with("obs poi", _CODE + _SEGS + "SELECT event_id, location, round(ax, 6) AS seg_x, round(ay, 6) AS seg_y FROM lab JOIN sg USING (location)"))
def c03_dynamic_segments(spark, sf_dir):
    lab = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    j = lab.join(_segments(spark, sf_dir), "location")
    return j.select("event_id", "location", F.round(F.col("pts")[0].x, 6).alias("seg_x"), F.round(F.col("pts")[0].y, 6).alias("seg_y"))


@query(
    "e14_even_spacing",
    sql_with("obs poi", _CODE + _SEGS + ", o AS (SELECT event_id, location, ax, ay, bx, by_, row_number() OVER (PARTITION BY subject_id, location ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY subject_id, location) AS n FROM lab JOIN sg USING (location)), s AS (SELECT *, coalesce(i::DOUBLE / nullif(n - 1, 0), 0) AS f FROM o) SELECT event_id, location, round(ax + f * (bx - ax), 6) AS x, round(ay + f * (by_ - ay), 6) AS y FROM s"),
)
def e14_even_spacing(spark, sf_dir):
    lab = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    p = gm.place_dynamic(lab, _segments(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    return p.select("event_id", "location", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "g01_union_placed",
    sql_with("obs poi", _CODE + _SEGS + f", pl AS ({_PLACES}), f AS (SELECT substring(name, 1, 1) AS location, x, y FROM pl QUALIFY row_number() OVER (PARTITION BY substring(name, 1, 1) ORDER BY pos) = 1), "
             "o AS (SELECT subject_id, ax, ay, bx, by_, row_number() OVER (PARTITION BY subject_id, location ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY subject_id, location) AS n FROM lab JOIN sg USING (location)), "
             "u AS (SELECT subject_id, 'dynamic' AS regime, ax + coalesce(i::DOUBLE / nullif(n - 1, 0), 0) * (bx - ax) AS x FROM o UNION ALL SELECT subject_id, 'static', x FROM lab LEFT JOIN f USING (location) WHERE regime = 'static') "
             "SELECT subject_id, regime, count(*) AS n, round(avg(x), 6) AS mean_x FROM u GROUP BY ALL"),
)
def g01_union_placed(spark, sf_dir):
    lab = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    static = gm.place_static(lab.where("regime = 'static'"), _places(spark, sf_dir))
    dynamic = gm.place_dynamic(lab, _segments(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    both = static.unionByName(dynamic, allowMissingColumns=True)
    return both.groupBy("subject_id", "regime").agg(rows(), F.round(F.avg("x"), 6).alias("mean_x"))


_HOURW = "WITH w AS (SELECT date_trunc('hour', ts) AS ts, avg(co2) AS temperature FROM obs WHERE variable = 'view' GROUP BY 1) "


def _hour_weather(spark, sf_dir):
    o = v.obs(spark, sf_dir)
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts")
    return o.where("variable = 'view'").groupBy(hour).agg(F.avg("co2").alias("temperature"))


@query("c04_weather_join", sql_with("obs", _HOURW + "SELECT event_id, round(temperature, 6) AS temperature FROM (SELECT event_id, date_trunc('hour', ts) AS ts FROM obs) LEFT JOIN w USING (ts)"))
def c04_weather_join(spark, sf_dir):
    o = v.obs(spark, sf_dir).select("event_id", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"))
    return o.join(_hour_weather(spark, sf_dir), "ts", "left").select("event_id", F.round("temperature", 6).alias("temperature"))


@query("c06_middle_weather", sql_with("obs loc", _HOURW + ", m AS (SELECT ts AS weather_ts, temperature FROM w QUALIFY row_number() OVER (ORDER BY ts) - 1 = (SELECT count(*) FROM w) // 2) SELECT pid, weather_ts, round(temperature, 6) AS temperature FROM loc, m"))
def c06_middle_weather(spark, sf_dir):
    mid = ag.row_at_middle(_hour_weather(spark, sf_dir), ["ts"], ["ts", "temperature"])
    p = v.loc(spark, sf_dir).select("pid", mid.alias("w"))
    return p.select("pid", F.col("w.ts").alias("weather_ts"), F.round("w.temperature", 6).alias("temperature"))


@query("c07_mean_weather", sql_with("env loc", "SELECT pid, t AS temperature, h AS humidity FROM loc, (SELECT round(avg(temperature), 6) AS t, round(avg(humidity), 6) AS h FROM env)"))
def c07_mean_weather(spark, sf_dir):
    e = v.env(spark, sf_dir).agg(F.struct(F.round(F.avg("temperature"), 6).alias("temperature"), F.round(F.avg("humidity"), 6).alias("humidity"))).scalar()
    return v.loc(spark, sf_dir).select("pid", e.alias("w")).select("pid", "w.*")


@query("c09_lung_capacity", sql_with("profiles fvc", "SELECT profile_id, round(fvc_predicted, 6) AS fvc_predicted FROM (SELECT p.profile_id, f.fvc_predicted FROM profiles p JOIN fvc f USING (sex) QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY abs(f.age - p.age), f.age, abs(f.height - p.height), f.height) = 1)"))
def c09_lung_capacity(spark, sf_dir):
    m = ag.match_lung_capacity(v.profiles(spark, sf_dir), v.fvc(spark, sf_dir))
    return m.select("profile_id", F.round("fvc_predicted", 6).alias("fvc_predicted"))


@query("c10_edge_weights", sql_with("edges", "WITH x AS (SELECT u, v, length * 2 AS exposure FROM edges WHERE highway <> 'path') SELECT e.u, e.v, round(coalesce(exposure, 1000), 4) AS weight FROM edges e LEFT JOIN x USING (u, v)"))
def c10_edge_weights(spark, sf_dir):
    from plumewalk.operators.route import exposure_edges

    e = v.edges(spark, sf_dir)
    x = e.where("highway <> 'path'").select(F.concat_ws("_", "u", "v", "key").alias("edge_id"), (F.col("length") * 2).alias("exposure"))
    return exposure_edges(e, x).select("u", "v", F.round("weight", 4).alias("weight"))


@query("c12_profile_grid", sql_with("profiles", "SELECT profile_id, age + a AS age, height + 5 * h AS height, s AS sex FROM profiles, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1]) AS h), (SELECT unnest(['M', 'F']) AS s)"))
def c12_profile_grid(spark, sf_dir):
    p = v.profiles(spark, sf_dir).select("profile_id", F.col("age").alias("a0"), F.col("height").alias("h0"))
    p = p.withColumn("age", F.explode(F.sequence(F.col("a0"), F.col("a0") + 2)))
    p = p.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("sex", F.explode(F.array(F.lit("M"), F.lit("F"))))
    return p.select("profile_id", "age", (F.col("h0") + F.col("h") * 5).alias("height"), "sex")


@query("g02_distinct_breaks", sql_with("poi", "SELECT DISTINCT category, brand FROM poi WHERE category NOT IN (SELECT category FROM poi WHERE levels >= 50 AND brand = 'Brand#1')"))
def g02_distinct_breaks(spark, sf_dir):
    p = v.poi(spark, sf_dir)
    out = p.where("levels >= 50 and brand = 'Brand#1'").select("category")
    return p.select("category", "brand").distinct().join(out, "category", "left_anti")


@query("h13_frequency_bins", "WITH q AS (SELECT list_distinct(list_value(" + ", ".join(f"quantile_cont(o_totalprice, {i / 10})" for i in range(11)) + ")) AS e FROM orders) SELECT greatest(len(list_filter(e, lambda x: x < o_totalprice)) - 1, 0)::INT AS bin, count(*) AS n FROM orders, q GROUP BY 1")
def h13_frequency_bins(spark, sf_dir):
    from plumewalk.operators.splits import frequency_bins

    o = v.table(spark, sf_dir, "orders")
    return frequency_bins(o, "o_totalprice", 10, "bin").groupBy("bin").agg(rows())


@query("i03_resample_dynamic")
def i03_resample_dynamic(spark, sf_dir):
    """Rows only: placement and resampling are checked one by one (e14, i02 and the tests)."""
    from plumewalk.functions.geo import line_length, utm

    lab = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    flat = F.transform("pts", lambda p: F.struct(utm(p.x, p.y)[0].alias("x"), utm(p.x, p.y)[1].alias("y")))
    seg = _segments(spark, sf_dir).withColumn("_flat", flat).select("location", "pts", line_length(F.col("_flat")).alias("length_m"))
    return gm.resample_dynamic(lab, seg, ["subject_id"], ["ts", "event_id"], "co2", 25.0)


@query("i04_dynamic_placement", sql_with("obs poi", _CODE + _SEGS + ", o AS (SELECT subject_id, location, count(*) AS n, max(ax) AS ax, max(bx) AS bx FROM lab JOIN sg USING (location) GROUP BY 1, 2) SELECT subject_id, location, n, round(CASE WHEN n = 1 THEN ax ELSE (ax + bx) / 2 END, 6) AS mean_x FROM o"))
def i04_dynamic_placement(spark, sf_dir):
    lab = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    p = gm.place_dynamic(lab, _segments(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    return p.groupBy("subject_id", "location").agg(rows(), F.round(F.avg("x"), 6).alias("mean_x"))

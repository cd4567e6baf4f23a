"""Queries over readers, cleaning rules and scalar formulas."""

import uuid

from pyspark.sql import functions as F

from plumewalk.functions import geo, scalar
from plumewalk.operators import clean as cl
from plumewalk.operators.enrich import layer_key
from plumewalk.operators.ordered import prefix_sums
from plumewalk.plans import views as v
from plumewalk.plans.registry import query
from plumewalk.plans.views import HAV, MX, MY, sql_with
from plumewalk.session import shared_folder
from plumewalk.sources import readers as rd
from plumewalk.sources import sinks as sk

_CODE = (
    "WITH c AS (SELECT *, sum(signal) OVER (PARTITION BY subject_id ORDER BY ts, event_id)::BIGINT AS code FROM obs), "
    "l AS (SELECT *, CASE WHEN code % 10000 = 0 AND code BETWEEN 0 AND 140000 THEN list_extract(['A','AB','B','BC','C','CD','D','DE','E','EF','F','FG','G','GH','H'], "
    "(code // 10000 + 1)::INT) ELSE code::VARCHAR END AS location FROM c), "
    "lab AS (SELECT *, CASE WHEN location IN ('A','B','C','D','E','F','G','H') THEN 'static' ELSE 'dynamic' END AS regime FROM l) "
)


@query("b01_location", sql_with("obs", _CODE + "SELECT event_id, code AS location_code, location FROM lab"))
def b01_location(spark, sf_dir):
    out = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    return out.select("event_id", "location_code", "location")


@query("b02_regime", sql_with("obs", _CODE + "SELECT location, regime, count(*) AS n FROM lab GROUP BY ALL"))
def b02_regime(spark, sf_dir):
    out = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    return out.groupBy("location", "regime").agg(F.count(F.lit(1)).alias("n"))


@query("e01_running_signal", sql_with("obs", "SELECT event_id, sum(signal) OVER (PARTITION BY subject_id ORDER BY ts, event_id)::BIGINT AS running FROM obs"))
def e01_running_signal(spark, sf_dir):
    out = prefix_sums(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"], {"running": F.col("signal")})
    return out.select("event_id", "running")


@query(
    "a01_read_series",
    "SELECT user_id::INT AS subject_id, event_type AS variable, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS t, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def a01_read_series(spark, sf_dir):
    t = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts").cast("int")
    e = v.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("int").alias("subject_id"), F.col("event_type").alias("variable"), t.cast("int").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "a02_attach_signal",
    sql_with(
        "obs",
        "WITH a AS (SELECT event_id, subject_id, co2, row_number() OVER (PARTITION BY subject_id ORDER BY ts, event_id) AS r FROM obs), "
        "b AS (SELECT subject_id, signal, row_number() OVER (PARTITION BY subject_id ORDER BY ts, event_id) AS r FROM obs) "
        "SELECT a.event_id, a.co2, b.signal FROM a JOIN b USING (subject_id, r)",
    ),
)
def a02_attach_signal(spark, sf_dir):
    o = v.obs(spark, sf_dir)
    table = o.select("subject_id", "ts", "event_id", "co2")
    out = sk.attach_signal(table, o, ["subject_id"], ["ts", "event_id"])
    return out.select("event_id", "co2", "signal")


_HOURLY = "WITH h AS (SELECT subject_id, date_trunc('day', ts) AS t, variable, avg(co2) AS value FROM obs GROUP BY ALL), "
_WIDE = (
    "w AS (SELECT subject_id, t, " + ", ".join(f"max(CASE WHEN variable = '{e}' THEN value END) AS {e}_v" for e in ("click", "error", "view"))
    + " FROM h WHERE variable IN ('click', 'error', 'view') GROUP BY subject_id, t) "
)


@query("a03_load_subject", sql_with("obs", _HOURLY + _WIDE + "SELECT subject_id, t::TIMESTAMP AS t, round(click_v, 6) AS click_v, round(error_v, 6) AS error_v, round(view_v, 6) AS view_v FROM w WHERE click_v IS NOT NULL AND error_v IS NOT NULL AND view_v IS NOT NULL"))
def a03_load_subject(spark, sf_dir):
    return _wide(spark, sf_dir).na.drop()


@query("c01_outer_merge", sql_with("obs", _HOURLY + _WIDE + "SELECT subject_id, t::TIMESTAMP AS t, round(click_v, 6) AS click_v, round(error_v, 6) AS error_v, round(view_v, 6) AS view_v FROM w"))
def c01_outer_merge(spark, sf_dir):
    return _wide(spark, sf_dir)


def _wide(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    read = v.obs(spark, sf_dir).where(F.col("variable").isin("click", "error", "view"))
    long = read.groupBy("subject_id", day.alias("t"), "variable").agg(F.avg("co2").alias("value"))
    wide = long.groupBy("subject_id", "t").pivot("variable", ["click", "error", "view"]).agg(F.first("value"))
    return wide.select("subject_id", "t", *[F.round(c, 6).alias(f"{c}_v") for c in ("click", "error", "view")])


_WEATHER = (
    "WITH r AS (SELECT date_trunc('hour', ts) AS ts, variable, CASE WHEN event_id % 10 = 3 THEN 777 WHEN event_id % 10 = 7 THEN 888 ELSE co2 END AS raw FROM obs), "
    "c AS (SELECT ts, variable, CASE WHEN raw IN (777, 7777) THEN 0 WHEN raw IN (888, 8888, -999) THEN NULL ELSE raw END AS value FROM r) "
)


def _coded(spark, sf_dir):
    raw = F.when(F.col("event_id") % 10 == 3, 777.0).when(F.col("event_id") % 10 == 7, 888.0).otherwise(F.col("co2"))
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return v.obs(spark, sf_dir).select(hour.alias("ts"), "variable", scalar.sensor_codes_to_null(raw).alias("value"))


@query("a05_weather_wide", sql_with("obs", _WEATHER + "SELECT ts, " + ", ".join(f"round(avg(CASE WHEN variable = '{e}' THEN value END), 6) AS s_{e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM c GROUP BY ts"))
def a05_weather_wide(spark, sf_dir):
    sensors = [f"s_{e}" for e in ("click", "error", "purchase", "signup", "view")]
    wide = rd.weather_wide(_coded(spark, sf_dir).select("ts", F.concat(F.lit("s_"), F.col("variable")).alias("sensor"), "value"), sensors)
    return wide.select("ts", *[F.round(s, 6).alias(s) for s in sensors])


@query("b08_sentinel_codes", sql_with("obs", _WEATHER + "SELECT variable, count(*) AS n, count(value) AS valid, count(CASE WHEN value = 0 THEN 1 END) AS zeros, round(avg(value), 6) AS mean FROM c GROUP BY variable"))
def b08_sentinel_codes(spark, sf_dir):
    return _coded(spark, sf_dir).groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("valid"), F.count_if(F.col("value") == 0).alias("zeros"), F.round(F.avg("value"), 6).alias("mean")
    )


@query("a07_tag_layer", "SELECT p_partkey AS fid, p_type AS category, p_brand AS brand FROM part WHERE p_type IN ('SMALL', 'LARGE') OR p_brand = 'Brand#3' OR p_size > 40")
def a07_tag_layer(spark, sf_dir):
    big = F.when(F.col("p_size") > 40, F.lit("yes"))
    tags = F.map_filter(F.create_map(F.lit("shop"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("big"), big), lambda k, x: x.isNotNull())
    base = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), tags.alias("tags"))
    layer = rd.Layers(base).get({"shop": ["SMALL", "LARGE"], "brand": "Brand#3", "big": True})
    return layer.drop("tags")


@query("a08_layer_key", "SELECT md5('{\"shop\": \"' || p_type || '\"}') AS layer_key, count(*) AS n FROM part GROUP BY 1")
def a08_layer_key(spark, sf_dir):
    part = v.table(spark, sf_dir, "part")
    kinds = [r[0] for r in part.select("p_type").distinct().collect()]  # tag values of one tag
    keys = spark.createDataFrame([(k, layer_key({"shop": k})) for k in kinds], "p_type string, layer_key string")
    return part.join(keys, "p_type").groupBy("layer_key").agg(F.count(F.lit(1)).alias("n"))


@query("a09_street_network", sql_with("nodes edges", "SELECT 'node' AS kind, highway, count(*) AS n, NULL::DOUBLE AS total_length FROM nodes GROUP BY highway UNION ALL SELECT 'edge', highway, count(*), round(sum(length), 2) FROM edges GROUP BY highway"))
def a09_street_network(spark, sf_dir):
    n = v.nodes(spark, sf_dir).groupBy("highway").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total_length"))
    e = v.edges(spark, sf_dir).groupBy("highway").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 2).alias("total_length"))
    return n.withColumn("kind", F.lit("node")).unionByName(e.withColumn("kind", F.lit("edge")))


@query("a10_modelling_table", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def a10_modelling_table(spark, sf_dir):
    return rd.modelling_table(v.table(spark, sf_dir, "lineitem"), drop=["l_discount", "l_tax"])


@query("a11_series_table", sql_with("poi", "SELECT fid, x, y FROM poi WHERE x IS NOT NULL AND y IS NOT NULL"))
def a11_series_table(spark, sf_dir):
    return rd.modelling_table(v.poi(spark, sf_dir), drop=[*rd.SERIES_DROP, "levels"])


_EDGE_PRED = "CASE WHEN fid % 19 = 0 THEN NULL ELSE 400 + levels END"


@query("a13_grid_predictions", sql_with("poi", "SELECT fid, x AS lng, y AS lat, 400 + levels AS predicted_co2 FROM poi WHERE levels IS NOT NULL"))
def a13_grid_predictions(spark, sf_dir):
    df = v.poi(spark, sf_dir).select("fid", "x", "y", (400 + F.col("levels")).alias("predicted_co2"))
    return rd.grid_predictions(df)


@query("a12_edge_predictions", sql_with("edges", "SELECT u || '_' || v || '_0' AS edge_id, count(*) AS n_points FROM (SELECT * FROM edges, unnest([0, 1])) GROUP BY ALL"))
def a12_edge_predictions(spark, sf_dir):
    twice = v.edges(spark, sf_dir).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    points = twice.select(F.concat_ws("_", "u", "v", "key", "i").alias("point_id"))
    edge_id = F.regexp_extract("point_id", r"^(.*)_\d+$", 1)
    return points.groupBy(edge_id.alias("edge_id")).agg(F.count(F.lit(1)).alias("n_points"))


@query("a14_fvc_table", sql_with("fvc", "SELECT age, height, sex, round(fvc_predicted, 6) AS fvc_predicted FROM fvc"))
def a14_fvc_table(spark, sf_dir):
    return v.fvc(spark, sf_dir).select("age", "height", "sex", F.round("fvc_predicted", 6).alias("fvc_predicted"))


_SUBJ = "SELECT subject_id, event_id, co2, CASE WHEN event_id % 7 = 0 THEN NULL ELSE co2 / 2 END AS average_building_height_100, CASE WHEN event_id % 11 = 0 THEN NULL ELSE co2 / 3 END AS humidity FROM obs"


@query("b13_combine_subjects", sql_with("obs", f"WITH s AS ({_SUBJ}) SELECT subject_id, event_id, co2, round(coalesce(average_building_height_100, 0), 6) AS average_building_height_100, round(humidity, 6) AS humidity FROM s WHERE humidity IS NOT NULL"))
def b13_combine_subjects(spark, sf_dir):
    s = v.obs(spark, sf_dir).select(
        "subject_id", "event_id", "co2", F.lit(1.0).alias("PM25"),
        F.when(F.col("event_id") % 7 != 0, F.col("co2") / 2).alias("average_building_height_100"),
        F.when(F.col("event_id") % 11 != 0, F.col("co2") / 3).alias("humidity"),
    )
    out = cl.combine_subjects([s.where("subject_id % 2 = 0"), s.where("subject_id % 2 = 1")])
    return out.withColumns({c: F.round(c, 6) for c in ("average_building_height_100", "humidity")})


@query("a17_combined_table", sql_with("obs", f"WITH s AS ({_SUBJ}) SELECT subject_id, count(*) AS n, round(sum(coalesce(average_building_height_100, 0)), 4) AS heights FROM s WHERE humidity IS NOT NULL GROUP BY subject_id"))
def a17_combined_table(spark, sf_dir):
    out = b13_combine_subjects(spark, sf_dir)
    return out.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("average_building_height_100"), 4).alias("heights"))


@query("b03_any_null_drop", sql_with("poi", "SELECT fid, levels FROM poi WHERE levels IS NOT NULL"))
def b03_any_null_drop(spark, sf_dir):
    return v.poi(spark, sf_dir).na.drop().select("fid", "levels")


@query("b04_trim_target", sql_with("obs", "WITH q AS (SELECT quantile_cont(co2, 0.01) AS lo, quantile_cont(co2, 0.99) AS hi FROM obs) SELECT event_id, co2 FROM obs, q WHERE co2 BETWEEN lo AND hi"))
def b04_trim_target(spark, sf_dir):
    return cl.trim_target(v.obs(spark, sf_dir), "co2").select("event_id", "co2")


@query("b05_box_filter", sql_with("loc", "SELECT pid, x, y FROM loc WHERE x BETWEEN 9.228 AND 9.233 AND y BETWEEN 45.475 AND 45.48"))
def b05_box_filter(spark, sf_dir):
    return v.loc(spark, sf_dir).where(cl.inside_box(9.228, 45.475, 9.233, 45.48)).select("pid", "x", "y")


@query("b06_category_filter", "SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'PROMO') OR p_brand IN ('Brand#4', 'Brand#5')")
def b06_category_filter(spark, sf_dir):
    match = scalar.category_match(["p_type", "p_brand", "p_name"], [["SMALL", "PROMO"], ["Brand#4", "Brand#5"], []])
    return v.table(spark, sf_dir, "part").where(match).select("p_partkey")


@query("b07_street_views", sql_with("nodes edges", "SELECT CASE WHEN highway IN ('footway', 'pedestrian', 'unclassified', 'steps', 'corridor', 'path') THEN 'foot' ELSE 'cars' END AS part, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT highway, count(*) FROM edges WHERE highway IN ('residential', 'service') GROUP BY 1 UNION ALL SELECT CASE highway WHEN 'crossing' THEN 'crossings' ELSE 'signals' END, count(*) FROM nodes WHERE highway IS NOT NULL GROUP BY 1"))
def b07_street_views(spark, sf_dir):
    out = None
    for name, part in cl.street_views(v.nodes(spark, sf_dir), v.edges(spark, sf_dir)).items():
        n = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("b09_clean_edges", sql_with("edges", "WITH e AS (SELECT u, v, oneway::INT AS oneway, reversed::INT AS reversed, CASE WHEN oneway THEN 1 ELSE coalesce(lanes::DOUBLE, 0) END AS l, maxspeed::DOUBLE AS maxspeed FROM edges) SELECT u, v, oneway, reversed, nullif(l, 0)::DOUBLE AS lanes, maxspeed FROM e"))
def b09_clean_edges(spark, sf_dir):
    return cl.clean_edges(v.edges(spark, sf_dir)).select("u", "v", "oneway", "reversed", "lanes", "maxspeed")


@query("b10_building_levels", "WITH b AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'piano terra' WHEN p_size % 5 = 1 THEN NULL ELSE p_size::VARCHAR END AS levels, CASE WHEN p_size % 3 = 0 THEN '-1' ELSE (p_size + 1)::VARCHAR END AS level FROM part) SELECT p_partkey, coalesce(CASE WHEN levels = 'piano terra' THEN 0 ELSE levels::DOUBLE END, CASE WHEN level <> '-1' THEN level::DOUBLE END) AS levels FROM b")
def b10_building_levels(spark, sf_dir):
    s = F.col("p_size")
    b = v.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(s % 5 == 0, "piano terra").when(s % 5 != 1, s.cast("string")).alias("levels"),
        F.when(s % 3 == 0, "-1").otherwise((s + 1).cast("string")).alias("level"),
    )
    return cl.building_levels(b)


@query("b11_rename_columns", "SELECT c_custkey AS temperature, c_acctbal AS humidity, c_nationkey AS wind_speed_mean FROM customer")
def b11_rename_columns(spark, sf_dir):
    c = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("T"), F.col("c_acctbal").alias("RH"), F.col("c_nationkey").alias("velocita_vento_medio"))
    return cl.english_weather(c)


_GAPS = {"close2park_50": 2, "num_shops_50": 3, "average_levels_10": 5, "sum_len_10": 7, "humidity": 4}


def _gappy(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    return p.select("p_partkey", *[F.when(F.col("p_partkey") % k != 0, F.col("p_size").cast("double")).alias(c) for c, k in _GAPS.items()])


@query(
    "b12_fill_by_name",
    "WITH g AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN p_partkey % {k} <> 0 THEN p_size::DOUBLE END AS {c}" for c, k in _GAPS.items())
    + " FROM part) SELECT p_partkey, coalesce(close2park_50, 200) AS close2park_50, coalesce(num_shops_50, 0) AS num_shops_50, coalesce(average_levels_10, (SELECT median(average_levels_10) FROM g)) AS average_levels_10, "
    "coalesce(sum_len_10, 0) AS sum_len_10, coalesce(humidity, (SELECT median(humidity) FROM g)) AS humidity FROM g",
)
def b12_fill_by_name(spark, sf_dir):
    return cl.fill_by_name(_gappy(spark, sf_dir), list(_GAPS))


@query(
    "b14_fill_gaps",
    sql_with(
        "obs",
        "WITH s AS (SELECT subject_id, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN co2 END AS h FROM obs WHERE event_id % 17 <> 0), "
        "f AS (SELECT event_id, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY ts, event_id), first_value(h IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS h FROM s) "
        "SELECT event_id, h FROM f WHERE h IS NOT NULL",
    ),
)
def b14_fill_gaps(spark, sf_dir):
    o = v.obs(spark, sf_dir).select(
        "subject_id", "ts", "event_id",
        F.when(F.col("event_id") % 17 != 0, F.col("co2")).alias("target"),
        F.when(F.col("event_id") % 3 != 0, F.col("co2")).alias("h"),
    )
    return cl.prepare_series(o, ["subject_id"], ["ts", "event_id"], "target", ["h"]).select("event_id", "h")


@query(
    "b15_spaced_sample",
    sql_with(
        "obs",
        "WITH p AS (SELECT subject_id, event_id, row_number() OVER (PARTITION BY subject_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY subject_id) AS n FROM obs), "
        "i AS (SELECT DISTINCT subject_id, floor(k * (n - 1) / 19.0 + 1e-9)::BIGINT AS pos FROM p, range(20) r(k) WHERE n > 20) "
        "SELECT p.subject_id, p.event_id FROM p LEFT JOIN i USING (subject_id, pos) WHERE i.pos IS NOT NULL OR p.n <= 20",
    ),
)
def b15_spaced_sample(spark, sf_dir):
    return cl.spaced_sample(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"], 20).select("subject_id", "event_id")


@query("b16_reject_models", sql_with("preds", "WITH f AS (SELECT row_id, subject_id, CASE WHEN isfinite(pred) THEN pred * (subject_id - 7) END AS p FROM preds), m AS (SELECT subject_id, avg(p) AS m FROM f GROUP BY 1) SELECT subject_id, count(*) AS n, count(CASE WHEN m BETWEEN -100 AND 50000 THEN p END) AS kept FROM f JOIN m USING (subject_id) GROUP BY subject_id"))
def b16_reject_models(spark, sf_dir):
    p = v.preds(spark, sf_dir).withColumn("pred", scalar.finite("pred") * (F.col("subject_id") - 7))
    return cl.reject_models(p).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.count("pred").alias("kept"))


@query("b17_valid_profile", sql_with("profiles", "SELECT profile_id, age BETWEEN 18 AND 100 AND sex IN ('M', 'F') AND height BETWEEN 140 AND 220 AND fb BETWEEN 15 AND 30 AND hr BETWEEN 80 AND 150 AS valid FROM profiles"))
def b17_valid_profile(spark, sf_dir):
    return v.profiles(spark, sf_dir).select("profile_id", scalar.valid_profile().alias("valid"))


@query("b19_pick_rows", sql_with("obs", _CODE + "SELECT event_id, location FROM lab WHERE regime = 'dynamic'"))
def b19_pick_rows(spark, sf_dir):
    out = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    return cl.pick_rows(out, regime_name="dynamic").select("event_id", "location")


@query("b20_valid_geometry", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) >= 3")
def b20_valid_geometry(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings").select("vec_id", F.array("embedding").alias("rings"))
    return cl.drop_invalid_geometry(e, least_points=3).select("vec_id")


@query("b21_coerce_numeric", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size::DOUBLE END AS a, CASE WHEN p_size % 4 = 0 THEN p_size::VARCHAR ELSE 'x' || p_size END AS b FROM part")
def b21_coerce_numeric(spark, sf_dir):
    s = F.col("p_size")
    df = v.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array(F.when(s % 4 == 0, F.concat(F.lit("x"), s)).otherwise(s.cast("string"))).alias("a"),
        F.when(s % 4 == 0, s.cast("string")).otherwise(F.concat(F.lit("x"), s)).alias("b"),
    )
    return cl.coerce_numeric(df, ["a", "b"])


@query("b22_static_dummy", sql_with("obs", _CODE + "SELECT event_id, (regime = 'static')::INT AS is_static FROM lab"))
def b22_static_dummy(spark, sf_dir):
    out = cl.label_route(v.obs(spark, sf_dir), ["subject_id"], ["ts", "event_id"])
    return out.select("event_id", (F.col("regime") == "static").cast("int").alias("is_static"))


@query("b23_split_route", "SELECT CASE WHEN len(embedding) > 1 AND label % 2 = 0 THEN 'line' ELSE 'point' END AS kind, count(*) AS n FROM embeddings GROUP BY 1")
def b23_split_route(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    r = e.select("vec_id", F.when((F.size("embedding") > 1) & (F.col("label") % 2 == 0), "line").otherwise("point").alias("geom_type"))
    lines, points = rd.route_parts(r)
    return lines.agg(F.lit("line").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(points.agg(F.lit("point").alias("kind"), F.count(F.lit(1)).alias("n")))


_E = dict(lat1="uy", lon1="ux", lat2="vy", lon2="vx")
_BEAR = (
    "CASE WHEN b < 0 THEN b + 360 ELSE b END"
)


@query("h01_haversine", sql_with("edges", f"SELECT u, v, round({HAV.format(**_E)}, 6) AS km FROM edges"))
def h01_haversine(spark, sf_dir):
    return v.edges(spark, sf_dir).select("u", "v", F.round(geo.haversine_km("uy", "ux", "vy", "vx"), 6).alias("km"))


_B0 = "WITH a AS (SELECT *, degrees(atan2(sin(radians(vx - ux)) * cos(radians(vy)), cos(radians(uy)) * sin(radians(vy)) - sin(radians(uy)) * cos(radians(vy)) * cos(radians(vx - ux)))) AS b0 FROM edges), b AS (SELECT *, (b0 + 360) % 360 AS b FROM a) "


@query("h02_bearing", sql_with("edges", _B0 + "SELECT u, v, round(b, 4) AS bearing FROM b"))
def h02_bearing(spark, sf_dir):
    return v.edges(spark, sf_dir).select("u", "v", F.round(geo.bearing_deg("uy", "ux", "vy", "vx"), 4).alias("bearing"))


_WINDS = "list_extract(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'], (floor((b + 11.25) / 22.5)::INT % 16) + 1)"


@query("h03_cardinal", sql_with("edges", _B0 + f"SELECT {_WINDS} AS wind, count(*) AS n FROM b GROUP BY 1"))
def h03_cardinal(spark, sf_dir):
    wind = geo.cardinal(geo.bearing_deg("uy", "ux", "vy", "vx"))
    return v.edges(spark, sf_dir).groupBy(wind.alias("wind")).agg(F.count(F.lit(1)).alias("n"))


@query("h04_pair_metrics", sql_with("edges", _B0 + f"SELECT u, v, round({HAV.format(**_E)} * 0.621371, 6) AS distance_miles, {_WINDS} AS cardinal, round((uy + vy) / 2, 6) AS mid_lat, round((ux + vx) / 2, 6) AS mid_lon, round(abs(vy - uy), 6) AS delta_lat, round(abs(vx - ux), 6) AS delta_lon FROM b"))
def h04_pair_metrics(spark, sf_dir):
    m = geo.pair_metrics("uy", "ux", "vy", "vx")
    names = ["distance_miles", "mid_lat", "mid_lon", "delta_lat", "delta_lon"]
    return v.edges(spark, sf_dir).select("u", "v", m["cardinal"].alias("cardinal"), *[F.round(m[n], 6).alias(n) for n in names])


_UTM = (
    "WITH k AS (SELECT pid, x, y, 1 / 298.257223563::DOUBLE AS f FROM loc), n AS (SELECT *, f / (2 - f) AS n FROM k), "
    "t AS (SELECT *, 2 * sqrt(n) / (1 + n) AS c, radians(y) AS phi, radians(x - 9) AS dl FROM n), "
    "u AS (SELECT *, sinh(atanh(sin(phi)) - c * atanh(c * sin(phi))) AS t FROM t), "
    "w AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta, n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3, "
    "6378137.0::DOUBLE / (1 + n) * (1 + n*n/4 + n*n*n*n/64) AS ra FROM u) "
)


@query(
    "h05_projection",
    sql_with(
        "loc",
        _UTM + f"SELECT pid, round({MX.format('x')}, 4) AS mx, round({MY.format('y')}, 4) AS my, "
        "round(500000 + 0.9996 * ra * (eta + a1 * cos(2*xi) * sinh(2*eta) + a2 * cos(4*xi) * sinh(4*eta) + a3 * cos(6*xi) * sinh(6*eta)), 3) AS east, "
        "round(0.9996 * ra * (xi + a1 * sin(2*xi) * cosh(2*eta) + a2 * sin(4*xi) * cosh(4*eta) + a3 * sin(6*xi) * cosh(6*eta)), 3) AS north FROM w",
    ),
)
def h05_projection(spark, sf_dir):
    mx, my = geo.project("x", "y")
    east, north = geo.utm("x", "y")
    return v.loc(spark, sf_dir).select("pid", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("h06_metres_per_degree", sql_with("loc", "SELECT pid, round(111320 * cos(radians(y)), 6) AS lon_m, round(x * 111320, 4) AS a, round(x * 110540, 4) AS b, round(x * 111000, 4) AS c FROM loc"))
def h06_metres_per_degree(spark, sf_dir):
    m = geo.metres_per_degree
    return v.loc(spark, sf_dir).select(
        "pid", F.round(m("y", "lon"), 6).alias("lon_m"), F.round(F.col("x") * m("y", "lat"), 4).alias("a"),
        F.round(F.col("x") * m("y", "lat_geodetic"), 4).alias("b"), F.round(F.col("x") * m("y", "pick"), 4).alias("c"),
    )


_VM = "exp(-8.75) * pow(hr, 1.72) * pow(fb, 0.611) * pow(age, 0.298) * pow(CASE WHEN sex = 'M' THEN 1 ELSE 2 END, -0.206) * pow({fvc}, 0.614) / 1000"


@query("h07_minute_ventilation", sql_with("profiles", f"SELECT profile_id, round({_VM.format(fvc='4.2')}, 6) AS vm FROM profiles"))
def h07_minute_ventilation(spark, sf_dir):
    return v.profiles(spark, sf_dir).select("profile_id", F.round(scalar.minute_ventilation("hr", "fb", "age", "sex", F.lit(4.2)), 6).alias("vm"))


@query("h08_feature_similarity", sql_with("env", "SELECT subject, temperature, round(CASE WHEN humidity = 60 THEN 1 ELSE 1 - least(abs(humidity - 60) / greatest(abs(humidity), 60, 1e-8), 1) END, 6) AS s_humidity, round(greatest(0, 1 - least(abs(wind_direction - 350), 360 - abs(wind_direction - 350)) / 180), 6) AS s_wind FROM env"))
def h08_feature_similarity(spark, sf_dir):
    return v.env(spark, sf_dir).select(
        "subject", "temperature", F.round(scalar.feature_similarity("humidity", F.lit(60.0)), 6).alias("s_humidity"),
        F.round(scalar.feature_similarity("wind_direction", F.lit(350.0), circular=True), 6).alias("s_wind"),
    )


@query("h09_plain_name", "SELECT p_partkey, lower(replace(trim(strip_accents(' Velocità ' || p_name || ' Più ')), ' ', '_')) AS name FROM part")
def h09_plain_name(spark, sf_dir):
    return v.table(spark, sf_dir, "part").select("p_partkey", scalar.plain_name(F.concat(F.lit(" Velocità "), F.col("p_name"), F.lit(" Più "))).alias("name"))


@query("h10_text_pieces", "SELECT p_partkey, substring(p_name, 1, 1) AS first_char, split_part(p_name, ' ', 2) AS second, p_partkey || '_' || p_size || '_' || p_brand AS joined FROM part")
def h10_text_pieces(spark, sf_dir):
    return v.table(spark, sf_dir, "part").select(
        "p_partkey", F.substring("p_name", 1, 1).alias("first_char"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"),
        F.concat_ws("_", "p_partkey", "p_size", "p_brand").alias("joined"),
    )


@query("h11_clip_sign_log", "SELECT c_custkey, least(greatest(c_acctbal, -500), 5000) AS clipped, sign(c_acctbal)::DOUBLE AS sgn, round(log10(abs(c_acctbal) + 1), 6) AS lg, round(sqrt(abs(c_acctbal)), 6) AS root FROM customer")
def h11_clip_sign_log(spark, sf_dir):
    a = F.col("c_acctbal")
    return v.table(spark, sf_dir, "customer").select(
        "c_custkey", scalar.clip(a, -500.0, 5000.0).alias("clipped"), F.signum(a).alias("sgn"),
        F.round(F.log10(F.abs(a) + 1), 6).alias("lg"), F.round(F.sqrt(F.abs(a)), 6).alias("root"),
    )


@query("h12_half_open_bins", "SELECT bin, count(*) AS n FROM (SELECT CASE WHEN p_size >= 5 AND p_size < 45 THEN floor((p_size - 5) / 8.0)::INT END AS bin FROM part) GROUP BY bin")
def h12_half_open_bins(spark, sf_dir):
    b = scalar.half_open_bin(F.col("p_size").cast("double"), 5.0, 8.0, 5)
    return v.table(spark, sf_dir, "part").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("h14_sequence_id", "SELECT 'S' || user_id || event_type AS series, count(*) AS n FROM events GROUP BY 1")
def h14_sequence_id(spark, sf_dir):
    return v.table(spark, sf_dir, "events").groupBy(scalar.sequence_id("user_id", "event_type").alias("series")).agg(F.count(F.lit(1)).alias("n"))


@query("h15_yeo_johnson", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 4) AS t05, round(CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) ELSE -(pow(1 - c_acctbal, 2) - 1) / 2 END, 3) AS t00 FROM customer")
def h15_yeo_johnson(spark, sf_dir):
    return v.table(spark, sf_dir, "customer").select("c_custkey", F.round(scalar.yeo_johnson("c_acctbal", 0.5), 4).alias("t05"), F.round(scalar.yeo_johnson("c_acctbal", 0.0), 3).alias("t00"))


@query("h17_casts", sql_with("edges", "SELECT u, v, oneway::INT AS oneway, try_cast(maxspeed AS DOUBLE) AS speed, try_cast(highway AS DOUBLE) AS none FROM edges"))
def h17_casts(spark, sf_dir):
    return v.edges(spark, sf_dir).select("u", "v", F.col("oneway").cast("int").alias("oneway"), F.col("maxspeed").try_cast("double").alias("speed"), F.col("highway").try_cast("double").alias("none"))


def _target(spark) -> str:
    return f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"


@query("a16_subject_sink", sql_with("obs", "SELECT subject_id, count(*) AS n, round(sum(co2), 4) AS total FROM obs GROUP BY 1"))
def a16_subject_sink(spark, sf_dir):
    """Written by subject, read back with the subject from the folder names."""
    path = _target(spark)
    sk.write_subjects(v.obs(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("subject_id").cast("long").alias("subject_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("co2"), 4).alias("total"))


@query("a18_csv_sink", sql_with("loc", "SELECT pid, x, y, co2 FROM loc"))
def a18_csv_sink(spark, sf_dir):
    path = _target(spark)
    sk.write_csv(v.loc(spark, sf_dir).select("pid", "x", "y", "co2"), path)
    return spark.read.schema("pid long, x double, y double, co2 double").csv(path, header=True)


@query("a19_chunk_sink", sql_with("profiles", "SELECT sex, count(*) AS n, TRUE AS small FROM profiles GROUP BY 1"))
def a19_chunk_sink(spark, sf_dir):
    path = _target(spark)
    sk.write_chunks(v.profiles(spark, sf_dir), path, 100)
    back = spark.read.schema("profile_id long, age int, sex string, height double, fb double, hr double").csv(path, header=True)
    sized = back.groupBy("sex", F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("k"))
    return sized.groupBy("sex").agg(F.sum("k").alias("n"), (F.max("k") <= 100).alias("small"))


@query("a20_trial_tables", sql_with("trials", "SELECT state, count(*) AS n, min(value) AS best FROM trials GROUP BY 1"))
def a20_trial_tables(spark, sf_dir):
    path = _target(spark)
    t = v.trials(spark, sf_dir)
    summary = t.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("best"))
    sk.write_trials({"trials": t.select("trial", "value")}, summary, path)
    return spark.read.schema("state string, n long, best double").json(f"{path}/summary")


@query("a21_parquet_to_csv", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def a21_parquet_to_csv(spark, sf_dir):
    path = _target(spark)
    sk.parquet_to_csv(spark, f"{sf_dir}/customer.parquet", path)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return spark.read.schema(schema).csv(path, header=True).select("c_custkey", "c_acctbal", "c_mktsegment")

"""Domain tables derived from the given tables, once as DataFrames and once as SQL.

The given tables hold no sensor data, so each stands in for one: events are
observations, parts are map features and street nodes, orders are trials and
so on. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewalk.functions.geo import haversine_km

WEST, EAST, SOUTH, NORTH = 9.2257, 9.23768, 45.47162, 45.48537
X0, DX, Y0, DY = 9.2257, 0.01198, 45.47162, 0.01375


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scatter(key: str) -> tuple[Column, Column]:
    """A position in the city box that spreads keys evenly and differs per key."""
    k = F.col(key).cast("long")
    x = F.lit(X0) + F.lit(DX) * ((k * 7919) % 9973).cast("double") / F.lit(9973.0)
    y = F.lit(Y0) + F.lit(DY) * ((k * 104729) % 9967).cast("double") / F.lit(9967.0)
    return x, y


def obs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"),
        "ts",
        "event_id",
        F.col("value").alias("co2"),
        F.col("event_type").alias("variable"),
        F.when(F.col("event_id") % 5 == 4, 10000).otherwise(0).alias("signal"),
    )


def loc(spark, sf_dir) -> DataFrame:
    x, y = scatter("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pid"), F.col("user_id").alias("subject_id"), "ts",
        F.col("value").alias("co2"), x.alias("x"), y.alias("y"),
    )


def pts(spark, sf_dir) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pid"),
        (F.lit(X0) + F.lit(DX) * (e(1) + 0.5)).alias("x"),
        (F.lit(Y0) + F.lit(DY) * (e(2) + 0.5)).alias("y"),
        e(3).alias("z"),
        F.col("label").alias("cls"),
    )


def poi(spark, sf_dir) -> DataFrame:
    x, y = scatter("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("fid"), x.alias("x"), y.alias("y"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("p_size")).cast("double").alias("levels"),
    )


def poly(spark, sf_dir) -> DataFrame:
    """A square of half side 2e-5 * (1 + levels) degrees around each feature."""
    h = F.lit(2e-5) * (1 + F.coalesce("levels", F.lit(0.0)))
    p = lambda sx, sy: F.struct((F.col("x") + sx * h).alias("x"), (F.col("y") + sy * h).alias("y"))
    ring = F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1))
    return poi(spark, sf_dir).select(
        "fid", "category", F.lit("polygon").alias("geom_type"), F.array(ring).alias("rings"), "levels"
    )


# The street classes in the order they are dealt out to edges.
STREETS = ["residential", "service", "footway", "path", "primary", "unclassified"]


def nodes(spark, sf_dir) -> DataFrame:
    return poi(spark, sf_dir).select(
        F.col("fid").alias("osmid"), "x", "y",
        F.when(F.col("fid") % 11 == 0, "crossing").when(F.col("fid") % 13 == 0, "traffic_signals").alias("highway"),
    )


def edges(spark, sf_dir) -> DataFrame:
    """Streets n-(n+1) and n-2n between nodes, as straight two-point lines."""
    n = nodes(spark, sf_dir).select(F.col("osmid").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    fan = n.withColumn("v", F.explode(F.array_distinct(F.array(F.col("u") + 1, F.col("u") * 2)))).where("v <> u")
    to = n.select(F.col("u").alias("v"), F.col("ux").alias("vx"), F.col("uy").alias("vy"))
    k = (F.col("u") + F.col("v")) % 6
    return fan.join(to, "v").select(
        "u", "v", F.lit(0).alias("key"),
        F.element_at(F.array(*map(F.lit, STREETS)), k.cast("int") + 1).alias("highway"),
        (haversine_km("uy", "ux", "vy", "vx") * 1000).alias("length"),
        F.when(F.col("u") % 4 == 0, None).otherwise((F.col("u") % 4).cast("string")).alias("lanes"),
        F.when(F.col("u") % 3 == 0, None).otherwise(((F.col("u") % 3) * 25).cast("string")).alias("maxspeed"),
        (F.col("u") % 2 == 1).alias("oneway"),
        (F.col("v") % 2 == 1).alias("reversed"),
        "ux", "uy", "vx", "vy",
    )


def profiles(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("profile_id"), (18 + c % 63).cast("int").alias("age"),
        F.when(c % 2 == 0, "M").otherwise("F").alias("sex"),
        (150.0 + (c % 50)).cast("double").alias("height"),
        (12.0 + (c % 20)).cast("double").alias("fb"), (70.0 + (c % 90)).cast("double").alias("hr"),
    )


def fvc(spark, sf_dir) -> DataFrame:
    """Lung-capacity lookup by age, height and sex, as the profiles of all customers need it."""
    return (
        profiles(spark, sf_dir)
        .groupBy("sex", (F.floor(F.col("age") / 3) * 3).cast("int").alias("age"), (F.floor(F.col("height") / 5) * 5).cast("double").alias("height"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "age", "height", "sex",
            (2.0 + 0.03 * (F.col("height") - 150) - 0.01 * (F.col("age") - 16) + F.when(F.col("sex") == "M", 0.5).otherwise(0.0)).alias("fvc_predicted"),
        )
    )


def preds(spark, sf_dir) -> DataFrame:
    """Model predictions, long: row = order, model = supplier mod 16, some null, some infinite."""
    sub = F.col("l_suppkey") % 16
    k = F.col("l_orderkey") + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), sub.alias("subject_id"),
        F.when(k % 23 == 0, None).when(k % 101 == 0, float("inf")).otherwise(F.col("l_extendedprice") / 97.3).alias("pred"),
    )


def env(spark, sf_dir) -> DataFrame:
    """Environment rows: subject = market segment."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("subject"), F.col("c_acctbal").alias("temperature"),
        (30.0 + (c * 13) % 61).cast("double").alias("humidity"), (1000.0 + (c * 7) % 29).cast("double").alias("pressure"),
        ((c * 37) % 360).cast("double").alias("wind_direction"),
    )


def reg(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"), F.col("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"),
    )


def trials(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trial"), F.col("o_custkey").alias("subject_id"),
        F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("value"),
        F.col("o_orderpriority").alias("drift"), F.col("o_orderdate").alias("ts"),
    )


_XY = (
    "9.2257::DOUBLE + 0.01198::DOUBLE * (({k} * 7919) % 9973)::DOUBLE / 9973.0::DOUBLE AS x, "
    "45.47162::DOUBLE + 0.01375::DOUBLE * (({k} * 104729) % 9967)::DOUBLE / 9967.0::DOUBLE AS y"
)
HAV = (
    "2 * 6371.0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
    "cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"
)
MX = "6378137.0 * radians({0})"
MY = "6378137.0 * ln(tan(pi() / 4 + radians({0}) / 2))"

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), "SELECT user_id AS subject_id, ts, event_id, value AS co2, event_type AS variable, "
            "CASE WHEN event_id % 5 = 4 THEN 10000 ELSE 0 END AS signal FROM events"),
    "loc": ((), f"SELECT event_id AS pid, user_id AS subject_id, ts, value AS co2, {_XY.format(k='event_id')} FROM events"),
    "pts": ((), "SELECT vec_id AS pid, 9.2257::DOUBLE + 0.01198::DOUBLE * (embedding[1]::DOUBLE + 0.5::DOUBLE) AS x, "
            "45.47162::DOUBLE + 0.01375::DOUBLE * (embedding[2]::DOUBLE + 0.5::DOUBLE) AS y, "
            "embedding[3]::DOUBLE AS z, label AS cls FROM embeddings"),
    "poi": ((), f"SELECT p_partkey AS fid, {_XY.format(k='p_partkey')}, p_type AS category, p_brand AS brand, "
            "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size::DOUBLE END AS levels FROM part"),
    "poly": (("poi",), "SELECT fid, category, levels, x - h AS x1, x + h AS x2, y - h AS y1, y + h AS y2 FROM "
             "(SELECT *, 0.00002::DOUBLE * (1 + coalesce(levels, 0)) AS h FROM poi)"),
    "nodes": (("poi",), "SELECT fid AS osmid, x, y, CASE WHEN fid % 11 = 0 THEN 'crossing' WHEN fid % 13 = 0 THEN "
              "'traffic_signals' END AS highway FROM poi"),
    "edges": (("nodes",), "SELECT a.osmid AS u, b.osmid AS v, 0 AS key, "
              "list_extract(['residential','service','footway','path','primary','unclassified'], ((a.osmid + b.osmid) % 6 + 1)::INT) AS highway, "
              + HAV.format(lat1="a.y", lon1="a.x", lat2="b.y", lon2="b.x") + " * 1000 AS length, "
              "CASE WHEN a.osmid % 4 = 0 THEN NULL ELSE (a.osmid % 4)::VARCHAR END AS lanes, "
              "CASE WHEN a.osmid % 3 = 0 THEN NULL ELSE ((a.osmid % 3) * 25)::VARCHAR END AS maxspeed, "
              "a.osmid % 2 = 1 AS oneway, b.osmid % 2 = 1 AS reversed, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy "
              "FROM nodes a JOIN nodes b ON (b.osmid = a.osmid + 1 OR b.osmid = a.osmid * 2) AND b.osmid <> a.osmid"),
    "profiles": ((), "SELECT c_custkey AS profile_id, (18 + c_custkey % 63)::INT AS age, CASE WHEN c_custkey % 2 = 0 THEN 'M' "
                 "ELSE 'F' END AS sex, 150.0::DOUBLE + c_custkey % 50 AS height, 12.0::DOUBLE + c_custkey % 20 AS fb, "
                 "70.0::DOUBLE + c_custkey % 90 AS hr FROM customer"),
    "fvc": (("profiles",), "SELECT age, height, sex, 2.0::DOUBLE + 0.03::DOUBLE * (height - 150) - 0.01::DOUBLE * (age - 16) + "
            "CASE WHEN sex = 'M' THEN 0.5::DOUBLE ELSE 0 END AS fvc_predicted FROM (SELECT DISTINCT sex, (floor(age / 3.0) * 3)::INT AS age, "
            "(floor(height / 5) * 5)::DOUBLE AS height FROM profiles)"),
    "preds": ((), "SELECT l_orderkey AS row_id, l_suppkey % 16 AS subject_id, CASE WHEN (l_orderkey + l_suppkey) % 23 = 0 THEN NULL "
              "WHEN (l_orderkey + l_suppkey) % 101 = 0 THEN 'Infinity'::DOUBLE ELSE l_extendedprice / 97.3::DOUBLE END AS pred FROM lineitem"),
    "env": ((), "SELECT c_mktsegment AS subject, c_acctbal AS temperature, (30 + (c_custkey * 13) % 61)::DOUBLE AS humidity, "
            "(1000 + (c_custkey * 7) % 29)::DOUBLE AS pressure, ((c_custkey * 37) % 360)::DOUBLE AS wind_direction FROM customer"),
    "reg": ((), "SELECT l_suppkey AS subject_id, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem"),
    "trials": ((), "SELECT o_orderkey AS trial, o_custkey AS subject_id, o_orderstatus AS state, o_totalprice AS value, "
               "o_orderpriority AS drift, o_orderdate AS ts FROM orders"),
}


def sql_with(views: str, body: str) -> str:
    """``body`` after the WITH clause of the named views and all they rest on."""
    done: list[str] = []

    def need(name: str) -> None:
        for d in SQL[name][0]:
            need(d)
        if name not in done:
            done.append(name)

    for v in views.split():
        need(v)
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in done)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE ') :]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"

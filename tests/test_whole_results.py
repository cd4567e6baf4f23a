"""Inputs that used to vanish or be refused give rows."""

from collections import Counter

from pyspark.sql import functions as F

from plumewalk.functions.scalar import plain_name
from plumewalk.operators import clean, model, route, splits
from plumewalk.operators.geometry import route_segments
from plumewalk.operators.spatial import pair_tiles
from plumewalk.sources.readers import weather_wide


def test_blocks_of_models_agree_with_one_array(spark):
    models = spark.createDataFrame([(s, None, float(s), [1.0 * s, 2.0], 0.5) for s in range(23)], "subject_id int, error string, intercept double, coef array<double>, train_mse double")
    rows = spark.createDataFrame([(r, r / 3, r / 7) for r in range(11)], "rid long, a double, b double")
    one, many = (sorted(map(tuple, model.predict_all(rows, models, "rid", ["a", "b"], block=b).collect())) for b in (10_000, 4))
    assert one == many and len(one) == 11 * 23


def test_short_series_stay(spark):
    rows = spark.createDataFrame([(k, t) for k, n in ((1, 4), (2, 20)) for t in range(n)], "k int, t int")
    got = splits.forecast_holdout(rows, ["k"], ["t"], 5).groupBy("k", "role").count().collect()
    assert {(r["k"], r["role"], r["count"]) for r in got} == {(1, "short", 4), (2, "train", 15), (2, "test", 5)}


def test_routes_with_other_breaks_stay(spark):
    pts = "array<struct<x: double, y: double>>"
    routes = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])], f"route_id int, pts {pts}")
    breaks = spark.createDataFrame([(1, 0.0, 0.5), (1, 0.5, 1.0)], "route_id int, x double, y double")
    got = route_segments(routes, breaks, labels=("A", "B")).collect()
    assert {(r["route_id"], r["location"], r["error"]) for r in got} == {(1, "A", None), (1, "B", None), (2, None, "0 breaks for 2 pieces")}


def test_unreachable_pairs_stay(spark):
    edges = spark.createDataFrame([(1, 2, 0, 10.0), (3, 4, 0, 5.0)], "u long, v long, key int, length double")
    none = spark.createDataFrame([], "edge_id string, exposure double")
    nodes = spark.createDataFrame([(i, i / 100, 45.0) for i in range(1, 5)], "osmid long, x double, y double")
    pairs = spark.createDataFrame([(1, 2), (1, 4)], "source long, target long")
    got = {r["target"]: r for r in route.compare_routes(edges, none, nodes, pairs).collect()}
    assert got[2]["recommended"] == "shortest_is_cleanest"
    assert got[4]["shortest_km"] is None and got[4]["recommended"] is None


def test_repeated_readings_are_averaged(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "b", 1.0)], "ts int, sensor string, value double")
    assert {tuple(r) for r in weather_wide(long, ["a", "b"]).collect()} == {(1, 3.0, None), (2, None, 1.0)}


def test_signals_are_added_before_they_are_cut(spark):
    rows = spark.createDataFrame([(1, t, 0.6) for t in range(4)], "k int, t int, signal double")
    got = [r["location_code"] for r in clean.label_route(rows, ["k"], ["t"]).orderBy("t").select(F.col("location_code")).collect()]
    assert got == [0, 1, 1, 2]


def test_tile_pairs_of_a_crowded_cell_are_spread(spark):
    cells = lambda n, name: spark.range(n + 3).select(F.when(F.col("id") < n, 0).otherwise(F.col("id")).alias("cell"), F.col("id").alias(name))
    left, right = cells(60, "a"), cells(45, "b").where("cell < 47")
    got = pair_tiles(left, right, ["cell"], ["a"], ["b"], 24)
    rows = got.select("cell", "a", "b", F.spark_partition_id().alias("task")).collect()
    want = {(0, a, b) for a in range(60) for b in range(45)}
    assert sorted((r["cell"], r["a"], r["b"]) for r in rows) == sorted(want)
    assert max(Counter(r["task"] for r in rows).values()) <= 0.25 * len(rows)


def test_names_are_folded_to_ascii(spark):
    names = {"Velocità Più": "velocita_piu", " Straße 10 µg/m³ ": "strasse_10_ug/m3", "Łódź °C": "lodz_degc", "ễ ø 漢x": "e_o_x"}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["p"] for r in rows.select("n", plain_name("n").alias("p")).collect()} == names

"""Grids, edge sampling and the route: tables of positions made from geometry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewalk.functions.geo import line_between, line_length, locate, point_at, utm
from plumewalk.operators.aggregate import first_per_key
from plumewalk.operators.ordered import with_position
from plumewalk.operators.series import group_bounds, resample
from plumewalk.session import block_partitions

# Labels of the route pieces, the one across the line end first.
PIECE_LABELS = ["FG", "GH", "AB", "BC", "CD", "DE", "EF"]


def centred_grid(spark: SparkSession, box: tuple[float, float, float, float], resolution: float) -> DataFrame:
    """Cell-centred lattice over (west, south, east, north) at ``resolution`` metres."""
    west, south, east, north = box
    lon_m = 111320 * math.cos(math.radians((south + north) / 2))
    cols = int((east - west) * lon_m / resolution)
    rows = int((north - south) * 111320 / resolution)
    dx, dy = (east - west) / cols, (north - south) / rows
    return spark.range(cols * rows).select(
        (F.lit(west + dx / 2) + F.col("id") % cols * F.lit(dx)).alias("x"),
        (F.lit(south + dy / 2) + F.floor(F.col("id") / cols) * F.lit(dy)).alias("y"),
        F.lit(1).alias("sub"),
        (F.col("id") % cols).cast("int").alias("grid_col"),
        F.floor(F.col("id") / cols).cast("int").alias("grid_row"),
    )


def edge_grid(spark: SparkSession, box: tuple[float, float, float, float], resolution: float) -> DataFrame:
    """Lattice from the south-west corner that overshoots the far sides by up to one cell."""
    west, south, east, north = box
    dx = resolution / (111320 * math.cos(math.radians((south + north) / 2)))
    dy = resolution / 110540
    cols = math.ceil((east + dx - west) / dx)
    rows = math.ceil((north + dy - south) / dy)
    return spark.range(cols * rows).select(
        (F.lit(west) + F.col("id") % cols * F.lit(dx)).alias("x"),
        (F.lit(south) + F.floor(F.col("id") / cols) * F.lit(dy)).alias("y"),
        F.lit("grid").alias("location"), F.lit("dynamic").alias("regime"), F.lit(1).alias("sub"),
    )


def edge_points(edges: DataFrame, interval: float, lat_centre: float, line: str = "pts", carry: Sequence[str] = ("highway", "maxspeed", "lanes", "oneway")) -> DataFrame:
    """Points every ``interval`` metres along each edge; a shorter edge gets its midpoint.

    A small file of nodes makes many points, so edges are dealt out to all tasks first.
    """
    metre = F.lit(111320.0 * math.cos(math.radians(lat_centre)))
    width = block_partitions(edges.sparkSession, 1 << 62)
    sized = edges.repartition(width, "u", "v", "key").withColumn("_deg", line_length(F.col(line))).withColumn("edge_length", F.col("_deg") * metre)
    short = F.col("edge_length") < interval
    n = F.when(short, 1).otherwise(F.floor(F.col("edge_length") / interval)).cast("int")
    each = sized.withColumn("point_id", F.explode(F.sequence(F.lit(0), n - 1)))
    along = F.when(short, F.col("edge_length") / 2).otherwise((F.col("point_id") + 0.5) * interval)
    placed = each.withColumn("distance_along_edge", along).withColumn(
        "_p", point_at(F.col(line), F.try_divide(F.col("distance_along_edge"), metre))
    )
    return placed.select(
        F.concat_ws("_", "u", "v", "key").alias("edge_id"), "point_id", "distance_along_edge", "edge_length",
        *carry, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"),
    )


def prediction_points(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Nodes and edge points in one table; edge points keep edge_id, distance and length."""
    n = nodes.select(
        F.concat(F.lit("node_"), F.col("osmid")).alias("point_id"), "x", "y", "highway", F.lit("node").alias("point_type")
    )
    e = points.withColumn("point_id", F.concat_ws("_", "edge_id", "point_id")).withColumn("point_type", F.lit("edge"))
    return n.unionByName(e, allowMissingColumns=True).withColumn("sub", F.lit(1))


def grid_matrix(grid: DataFrame, value: str, columns: Sequence[int]) -> DataFrame:
    """One row per grid_row with a column per grid_col."""
    return grid.groupBy("grid_row").pivot("grid_col", list(columns)).agg(F.first(value))


def break_distances(routes: DataFrame, breaks: DataFrame, route: str = "route_id", line: str = "pts") -> DataFrame:
    """Sorted distinct distances along each route of its break points: route, nth (from 1), at."""
    d = breaks.select(route, "x", "y").distinct().join(routes.select(route, line), route)
    d = d.select(route, locate(F.col(line), F.col("x"), F.col("y")).alias("at"))
    packed = d.groupBy(route).agg(F.array_sort(F.collect_list("at")).alias("ats"))  # a route has a few breaks
    return packed.select(route, F.posexplode("ats").alias("nth", "at")).withColumn("nth", F.col("nth") + 1)


def route_segments(routes: DataFrame, breaks: DataFrame, route: str = "route_id", line: str = "pts", labels: Sequence[str] = tuple(PIECE_LABELS)) -> DataFrame:
    """Labelled pieces of closed routes: route, location, start, stop, pts, length_m, error.

    The piece across the line end comes first. Routes need as many distinct
    breaks as there are labels; any other gives one row with ``error`` alone.
    """
    d = break_distances(routes, breaks, route, line)
    counted = routes.select(route).join(d.groupBy(route).agg(F.array_sort(F.collect_list("at")).alias("ats")), route, "left")
    n = F.coalesce(F.size("ats"), F.lit(0))
    wrong = counted.where(n != len(labels)).select(route, F.concat(n.cast("string"), F.lit(f" breaks for {len(labels)} pieces")).alias("error"))
    packed = counted.where(n == len(labels))
    full = packed.join(routes.select(route, line), route).withColumn("_len", line_length(F.col(line)))
    each = full.select("*", F.posexplode(F.array(*map(F.lit, labels))).alias("_i", "location"))
    low, high = F.element_at("ats", F.greatest(F.col("_i"), F.lit(1))), F.element_at("ats", F.col("_i") + 1)
    ends = each.withColumns({"start": F.when(F.col("_i") == 0, F.element_at("ats", -1)).otherwise(low), "stop": high})
    pts = F.col(line)
    wrapped = F.concat(line_between(pts, F.col("start"), F.col("_len")), line_between(pts, F.lit(0.0), F.col("stop")))
    cut = F.when(F.col("_i") == 0, wrapped).otherwise(line_between(pts, F.col("start"), F.col("stop")))
    out = ends.withColumn("piece", cut)
    flat = F.transform("piece", lambda p: F.struct(utm(p.x, p.y)[0].alias("x"), utm(p.x, p.y)[1].alias("y")))
    pieces = out.withColumn("_flat", flat).select(
        route, "location", "start", "stop", F.col("piece").alias("pts"), line_length(F.col("_flat")).alias("length_m"), F.lit(None).cast("string").alias("error")
    )
    return pieces.unionByName(wrong, allowMissingColumns=True)


def place_static(df: DataFrame, places: DataFrame) -> DataFrame:
    """Static rows with the first route point whose name starts with their location letter."""
    key = places.withColumn("location", F.substring("name", 1, 1))
    spots = first_per_key(key, ["location"], ["pos"]).select("location", "x", "y")
    return df.join(spots, "location", "left")


def place_dynamic(df: DataFrame, segments: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Dynamic rows spread evenly along the segment of their location; rows without a segment are dropped.

    Row i of n stands at i / (n - 1) of the length, counted per key and location.
    """
    by = [*keys, "location"]
    placed = with_position(df, by, order, "_i")
    sized = group_bounds(placed, by, {"_n": F.count(F.lit(1))}).join(segments.select("location", "pts"), "location")
    share = F.coalesce(F.try_divide(F.col("_i").cast("double"), F.col("_n") - 1), F.lit(0.0))
    at = sized.withColumn("_p", point_at(F.col("pts"), share * line_length(F.col("pts"))))
    return at.withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_i", "_n", "_p", "pts")


def resample_dynamic(df: DataFrame, segments: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, step: float = 5.0) -> DataFrame:
    """One row every ``step`` metres per key and location: x, y along the segment, the value by cubic resampling."""
    by = [*keys, "location"]
    known = segments.select("location", "pts", F.floor(F.floor("length_m") / step).cast("long").alias("_m"))
    fitted = df.join(known.select("location", "_m"), "location").where(F.col("_m") > 0)
    series = resample(fitted, by, order, value, "_m").withColumnRenamed("value", value)
    at = series.join(known, "location")
    share = F.coalesce(F.try_divide(F.col("i").cast("double"), F.col("_m") - 1), F.lit(0.0))
    spot = at.withColumn("_p", point_at(F.col("pts"), share * line_length(F.col("pts"))))
    return spot.select(*keys, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), value, "location", F.lit("dynamic").alias("regime"), "i")



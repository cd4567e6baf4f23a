"""Geometry as Column expressions, without any UDF.

A ring or line is ``array<struct<x double, y double>>``; a polygon is an array
of closed-or-open rings, the first being the shell and the others holes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MERCATOR_R = 6378137.0
MILES_PER_KM = 0.621371

# The sixteen compass winds, clockwise from north.
WINDS = [
    "N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
    "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW",
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would turn a null into 1


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 <= b < 360."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    dlon = F.radians(lon2 - lon1)
    east = F.sin(dlon) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def cardinal(bearing) -> Column:
    sector = F.floor((col(bearing) + 11.25) / 22.5).cast("int") % 16
    return F.element_at(F.array(*[F.lit(w) for w in WINDS]), sector + 1)


def pair_metrics(lat1, lon1, lat2, lon2) -> dict[str, Column]:
    """Distance, bearing, wind name, midpoint and absolute deltas of a point pair."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    km = haversine_km(lat1, lon1, lat2, lon2)
    bearing = bearing_deg(lat1, lon1, lat2, lon2)
    return {
        "distance_km": km,
        "distance_miles": km * MILES_PER_KM,
        "bearing": bearing,
        "cardinal": cardinal(bearing),
        "mid_lat": (lat1 + lat2) / 2,
        "mid_lon": (lon1 + lon2) / 2,
        "delta_lat": F.abs(lat2 - lat1),
        "delta_lon": F.abs(lon2 - lon1),
    }


def mercator_x(lon) -> Column:
    return MERCATOR_R * F.radians(col(lon))


def mercator_y(lat) -> Column:
    return MERCATOR_R * F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2))


def project(lon, lat, crs: str = "3857") -> tuple[Column, Column]:
    """Planar x, y. '3857' keeps map units, 'metric' scales them to ground metres, 'deg' passes through."""
    if crs == "deg":
        return col(lon), col(lat)
    x, y = mercator_x(lon), mercator_y(lat)
    if crs == "3857":
        return x, y
    if crs == "metric":
        return utm(lon, lat)
    raise ValueError(f"unknown crs {crs!r}")


def utm(lon, lat, zone: int = 32) -> tuple[Column, Column]:
    """Northern-hemisphere UTM easting and northing by the third-order Krueger series."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    rectifying = MERCATOR_R / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    k0, c = 0.9996, 2 * math.sqrt(n) / (1 + n)
    phi = F.radians(col(lat))
    dlon = F.radians(col(lon) - F.lit(float(zone * 6 - 183)))
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + k0 * rectifying * east, k0 * rectifying * north


def metres_per_degree(lat, kind: str) -> Column:
    """The planar degree lengths in use: 'lon' 111320 cos(lat), 'lat' 111320, 'lat_geodetic' 110540, 'pick' 111000."""
    if kind == "lon":
        return 111320.0 * F.cos(F.radians(col(lat)))
    return F.lit({"lat": 111320.0, "lat_geodetic": 110540.0, "pick": 111000.0}[kind])


def euclid(ax, ay, bx, by) -> Column:
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return F.sqrt(dx * dx + dy * dy)


def ring_edges(ring: Column) -> Column:
    """Directed edges of a ring; a ring left open is closed, a closing duplicate adds a null-length edge."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), nxt.alias("b"))


def line_edges(line: Column) -> Column:
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.arrays_zip(F.slice(line, 1, n).alias("a"), F.slice(line, 2, n).alias("b"))


def segment_param(px, py, ax, ay, bx, by) -> Column:
    """Clamped parameter of the nearest position on segment a-b; 0 for a zero-length segment."""
    dx, dy = bx - ax, by - ay
    u = F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(u, F.lit(0.0))))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    u = segment_param(px, py, ax, ay, bx, by)
    return euclid(px, py, ax + u * (bx - ax), ay + u * (by - ay))


def edge_table(geom_type: Column, rings: Column) -> Column:
    """All edges of a geometry with what a distance or area needs per edge, computed once per feature.

    Shells run counter-clockwise and holes clockwise, so signed sums over the
    edges take holes away. A point is one null-length edge.
    """
    def turned(ring, index):
        doubled = F.aggregate(
            ring_edges(ring), F.lit(0.0), lambda acc, e: acc + e.a.x * e.b.y - e.b.x * e.a.y
        )
        clockwise = doubled < 0
        return F.when(clockwise == (index == 0), F.reverse(ring)).otherwise(ring)

    closed = F.flatten(F.transform(F.transform(rings, turned), ring_edges))
    opened = F.flatten(F.transform(rings, lambda r: F.when(F.size(r) == 1, ring_edges(r)).otherwise(line_edges(r))))

    def facts(e):
        dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
        l2 = dx * dx + dy * dy
        return F.struct(
            e.a.x.alias("ax"), e.a.y.alias("ay"), e.b.y.alias("by"), dx.alias("dx"), dy.alias("dy"), l2.alias("l2"),
            F.coalesce(F.try_divide(F.lit(1.0), l2), F.lit(0.0)).alias("il2"),
            F.coalesce(F.try_divide(dx, dy), F.lit(0.0)).alias("slope"),
        )

    return F.transform(F.when(geom_type == "polygon", closed).otherwise(opened), facts)


def line_length(line: Column, metric=euclid) -> Column:
    return F.aggregate(
        line_edges(line), F.lit(0.0), lambda acc, e: acc + metric(e.a.x, e.a.y, e.b.x, e.b.y)
    )


def point_at(line: Column, distance: Column) -> Column:
    """Struct (x, y) at ``distance`` along a polyline, clamped to its ends."""
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(acc, e):
        length = euclid(e.a.x, e.a.y, e.b.x, e.b.y)
        share = F.least(F.greatest(F.coalesce(F.try_divide(distance - acc.done, length), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        here = acc.x.isNull() | (distance > acc.done)
        return F.struct(
            (acc.done + length).alias("done"),
            F.when(here, e.a.x + share * (e.b.x - e.a.x)).otherwise(acc.x).alias("x"),
            F.when(here, e.a.y + share * (e.b.y - e.a.y)).otherwise(acc.y).alias("y"),
        )

    return F.aggregate(line_edges(line), start, step, lambda acc: F.struct(acc.x.alias("x"), acc.y.alias("y")))


def locate(line: Column, px: Column, py: Column) -> Column:
    """Distance along a polyline of the position nearest to a point; the first one on ties."""
    start = F.struct(F.lit(0.0).alias("done"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at"))

    def step(acc, e):
        length = euclid(e.a.x, e.a.y, e.b.x, e.b.y)
        u = segment_param(px, py, e.a.x, e.a.y, e.b.x, e.b.y)
        d = segment_distance(px, py, e.a.x, e.a.y, e.b.x, e.b.y)
        return F.struct(
            (acc.done + length).alias("done"),
            F.least(acc.best, d).alias("best"),
            F.when(d < acc.best, acc.done + u * length).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(line_edges(line), start, step, lambda acc: acc["at"])


def line_between(line: Column, start: Column, stop: Column) -> Column:
    """The piece of a polyline between two distances along it."""
    first = F.struct(F.lit(0.0).alias("done"), F.array().cast("array<struct<x:double,y:double>>").alias("kept"))

    def step(acc, e):
        done = acc.done + euclid(e.a.x, e.a.y, e.b.x, e.b.y)
        inner = F.array(F.struct(e.b.x.alias("x"), e.b.y.alias("y")))
        kept = F.when((done > start) & (done < stop), F.concat(acc.kept, inner)).otherwise(acc.kept)
        return F.struct(done.alias("done"), kept.alias("kept"))

    inner = F.aggregate(line_edges(line), first, step, lambda acc: acc.kept)
    return F.concat(F.array(point_at(line, start)), inner, F.array(point_at(line, stop)))

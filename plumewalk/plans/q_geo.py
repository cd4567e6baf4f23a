"""Queries over lines, grids, routes and paths."""

from pyspark.sql import functions as F

from plumewalk.functions import geo
from plumewalk.operators import geometry as gm
from plumewalk.operators import route as rt
from plumewalk.plans import views as v
from plumewalk.plans.registry import query
from plumewalk.plans.views import HAV, sql_with

BOX = (v.WEST, v.SOUTH, v.EAST, v.NORTH)
_METRE = "111320.0::DOUBLE * cos(radians((45.47162::DOUBLE + 45.48537::DOUBLE) / 2))"


def _lines(spark, sf_dir):
    """A polyline of eight vertices per embedding: elements 1, 2 are the first vertex and so on."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    pts = F.array(*[F.struct(e(2 * i + 1).alias("x"), e(2 * i + 2).alias("y")) for i in range(8)])
    return v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("route_id"), pts.alias("pts"), e(17).alias("qx"), e(18).alias("qy"), "embedding"
    )


_LINES = (
    "WITH ed AS (SELECT vec_id AS route_id, k, embedding[2*k-1]::DOUBLE AS ax, embedding[2*k]::DOUBLE AS ay, embedding[2*k+1]::DOUBLE AS bx, embedding[2*k+2]::DOUBLE AS by_ FROM embeddings, range(1, 8) r(k)), "
    "el AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM ed), "
    "cu AS (SELECT *, sum(len) OVER (PARTITION BY route_id ORDER BY k) - len AS done, sum(len) OVER (PARTITION BY route_id) AS total FROM el) "
)


@query("g03_point_along", _LINES + ", d AS (SELECT DISTINCT route_id, total, f, f * total AS dd FROM cu, (SELECT unnest([0.0, 0.25, 0.6, 1.0])::DOUBLE AS f)) SELECT d.route_id, f, round(ax + least(greatest((dd - done) / len, 0), 1) * (bx - ax), 5) AS x, round(ay + least(greatest((dd - done) / len, 0), 1) * (by_ - ay), 5) AS y FROM d JOIN cu USING (route_id) QUALIFY row_number() OVER (PARTITION BY d.route_id, f ORDER BY CASE WHEN dd > done OR k = 1 THEN k ELSE 0 END DESC) = 1")
def g03_point_along(spark, sf_dir):
    at = _lines(spark, sf_dir).withColumn("f", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.6, 1.0)))))
    p = at.withColumn("p", geo.point_at(F.col("pts"), F.col("f") * geo.line_length(F.col("pts"))))
    return p.select("route_id", "f", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


_NEAR = (
    _LINES + ", q AS (SELECT vec_id AS route_id, j, embedding[2*j+15]::DOUBLE AS px, embedding[2*j+16]::DOUBLE AS py FROM embeddings, range(1, 8) s(j)), "
    "u AS (SELECT cu.*, j, px, py, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (len * len), 0), 1) AS u FROM cu JOIN q USING (route_id)), "
    "lo AS (SELECT route_id, j, arg_min(done + u * len, sqrt(pow(px - ax - u * (bx - ax), 2) + pow(py - ay - u * (by_ - ay), 2))) AS along, max(total) AS total FROM u GROUP BY 1, 2) "
)


@query("g04_linear_reference", _NEAR + "SELECT route_id, round(along, 4) AS along FROM lo WHERE j = 1")
def g04_linear_reference(spark, sf_dir):
    return _lines(spark, sf_dir).select("route_id", F.round(geo.locate(F.col("pts"), F.col("qx"), F.col("qy")), 4).alias("along"))


@query(
    "g05_route_segments",
    _NEAR + ", s AS (SELECT route_id, total, list_sort(list(along)) AS ats FROM lo WHERE j < 7 OR route_id % 5 <> 0 GROUP BY 1, 2), l AS (SELECT route_id, total, ats, i, list_extract(['FG','GH','AB','BC','CD','DE','EF'], i::INT) AS location FROM s, range(1, 8) t(i) WHERE len(ats) = 7) "
    "SELECT route_id, location, round(CASE WHEN i = 1 THEN ats[7] ELSE ats[i - 1] END, 4) AS start, round(ats[i], 4) AS stop, NULL::VARCHAR AS error FROM l "
    "UNION ALL SELECT route_id, NULL, NULL, NULL, len(ats) || ' breaks for 7 pieces' FROM s WHERE len(ats) <> 7",
)
def g05_route_segments(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    e = lambda i: F.element_at("embedding", i).cast("double")
    spots = F.array(*[F.struct(e(2 * j + 15).alias("x"), e(2 * j + 16).alias("y")) for j in range(1, 8)])
    spots = F.when(F.col("route_id") % 5 == 0, F.slice(spots, 1, 6)).otherwise(spots)  # one break short: no pieces, but a row that says so
    breaks = lines.select("route_id", F.inline(spots))
    s = gm.route_segments(lines, breaks)
    return s.select("route_id", "location", F.round("start", 4).alias("start"), F.round("stop", 4).alias("stop"), "error")


def _street_lines(spark, sf_dir):
    a, b = F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y"))
    return v.edges(spark, sf_dir).withColumn("pts", F.array(a, b))


_SAMPLED = (
    f"WITH l AS (SELECT *, u || '_' || v || '_0' AS edge_id, sqrt(pow(vx - ux, 2) + pow(vy - uy, 2)) * {_METRE} AS m FROM edges), "
    "p AS (SELECT *, unnest(range(0, CASE WHEN m < 25 THEN 1 ELSE floor(m / 25)::BIGINT END)) AS i FROM l), "
    "ep AS (SELECT edge_id, i::INT AS point_id, m, highway, CASE WHEN m < 25 THEN m / 2 ELSE (i + 0.5) * 25 END AS d, ux, uy, vx, vy FROM p) "
)
_MID = ((v.SOUTH + v.NORTH) / 2,)


@query("g06_edge_points", sql_with("edges", _SAMPLED + "SELECT edge_id, point_id, round(d, 3) AS distance_along_edge, round(m, 3) AS edge_length, highway, round(ux + d / m * (vx - ux), 6) AS x, round(uy + d / m * (vy - uy), 6) AS y FROM ep"))
def g06_edge_points(spark, sf_dir):
    p = gm.edge_points(_street_lines(spark, sf_dir), 25.0, _MID[0])
    return p.select(
        "edge_id", "point_id", F.round("distance_along_edge", 3).alias("distance_along_edge"), F.round("edge_length", 3).alias("edge_length"),
        "highway", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
    )


@query("g09_prediction_table", sql_with("edges", _SAMPLED + "SELECT 'edge' AS point_type, edge_id || '_' || point_id AS point_id, edge_id, round(d, 3) AS distance_along_edge, highway FROM ep UNION ALL SELECT 'node', 'node_' || osmid, NULL, NULL, highway FROM nodes"))
def g09_prediction_table(spark, sf_dir):
    p = gm.edge_points(_street_lines(spark, sf_dir), 25.0, _MID[0])
    t = gm.prediction_points(v.nodes(spark, sf_dir), p)
    return t.select("point_type", "point_id", "edge_id", F.round("distance_along_edge", 3).alias("distance_along_edge"), "highway")


_G7 = (
    "WITH s AS (SELECT ((9.23768::DOUBLE - 9.2257::DOUBLE) * " + _METRE + " / 50)::DOUBLE AS c, ((45.48537::DOUBLE - 45.47162::DOUBLE) * 111320 / 50)::DOUBLE AS r), "
    "n AS (SELECT floor(c)::INT AS nc, floor(r)::INT AS nr FROM s), k AS (SELECT nc, nr, (9.23768::DOUBLE - 9.2257::DOUBLE) / nc AS dx, (45.48537::DOUBLE - 45.47162::DOUBLE) / nr AS dy FROM n), "
    "g AS (SELECT i::INT AS grid_col, j::INT AS grid_row, 9.2257::DOUBLE + dx / 2 + i * dx AS x, 45.47162::DOUBLE + dy / 2 + j * dy AS y, dx, dy FROM k, range(0, 1000) a(i), range(0, 1000) b(j) WHERE i < nc AND j < nr), "
    "h AS (SELECT floor((x - 9.2257::DOUBLE) / dx)::INT AS grid_col, floor((y - 45.47162::DOUBLE) / dy)::INT AS grid_row, count(*) AS n, avg(co2) AS m FROM loc, k GROUP BY 1, 2) "
)


@query("g07_centred_grid", sql_with("loc", _G7 + "SELECT grid_col, grid_row, round(g.x, 6) AS x, round(g.y, 6) AS y, coalesce(h.n, 0) AS n, round(h.m, 6) AS mean_co2 FROM g LEFT JOIN h USING (grid_col, grid_row)"))
def g07_centred_grid(spark, sf_dir):
    g, h = _grid_means(spark, sf_dir)
    return g.join(h, ["grid_col", "grid_row"], "left").select(
        "grid_col", "grid_row", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.coalesce("n", F.lit(0)).alias("n"), F.round("m", 6).alias("mean_co2")
    )


def _grid_means(spark, sf_dir):
    g = gm.centred_grid(spark, BOX, 50.0)
    import math

    cols = int((v.EAST - v.WEST) * 111320 * math.cos(math.radians((v.SOUTH + v.NORTH) / 2)) / 50.0)
    rows = int((v.NORTH - v.SOUTH) * 111320 / 50.0)
    c = F.floor((F.col("x") - v.WEST) / F.lit((v.EAST - v.WEST) / cols)).cast("int")
    r = F.floor((F.col("y") - v.SOUTH) / F.lit((v.NORTH - v.SOUTH) / rows)).cast("int")
    h = v.loc(spark, sf_dir).groupBy(c.alias("grid_col"), r.alias("grid_row")).agg(F.count(F.lit(1)).alias("n"), F.avg("co2").alias("m"))
    return g, h


@query("g10_grid_matrix", sql_with("loc", _G7 + ", m AS (SELECT grid_row, grid_col, h.m FROM g LEFT JOIN h USING (grid_col, grid_row)) SELECT grid_row, " + ", ".join(f"round(max(CASE WHEN grid_col = {c} THEN m END), 6) AS c{c}" for c in range(18)) + " FROM m GROUP BY 1"))
def g10_grid_matrix(spark, sf_dir):
    g, h = _grid_means(spark, sf_dir)
    m = gm.grid_matrix(g.join(h, ["grid_col", "grid_row"], "left"), "m", list(range(18)))
    return m.select("grid_row", *[F.round(str(c), 6).alias(f"c{c}") for c in range(18)])


@query(
    "g08_edge_grid",
    sql_with("loc", f"WITH k AS (SELECT 100 / ({_METRE}) AS dx, 100 / 110540.0::DOUBLE AS dy), n AS (SELECT dx, dy, ceil((9.23768::DOUBLE + dx - 9.2257::DOUBLE) / dx)::INT AS nc, ceil((45.48537::DOUBLE + dy - 45.47162::DOUBLE) / dy)::INT AS nr FROM k), "
             "g AS (SELECT 9.2257::DOUBLE + i * dx AS x, 45.47162::DOUBLE + j * dy AS y, i, j FROM n, range(0, 500) a(i), range(0, 500) b(j) WHERE i < nc AND j < nr), "
             "h AS (SELECT round((x - 9.2257::DOUBLE) / dx)::BIGINT AS i, round((y - 45.47162::DOUBLE) / dy)::BIGINT AS j, count(*) AS n FROM loc, k GROUP BY 1, 2) SELECT round(g.x, 6) AS x, round(g.y, 6) AS y, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (i, j)"),
)
def g08_edge_grid(spark, sf_dir):
    import math

    dx, dy = 100 / (111320 * math.cos(math.radians(_MID[0]))), 100 / 110540
    g = gm.edge_grid(spark, BOX, 100.0)
    near = lambda c, o, d: F.round((F.col(c) - F.lit(o)) / F.lit(d)).cast("long")
    g = g.withColumns({"i": near("x", v.WEST, dx), "j": near("y", v.SOUTH, dy)})
    h = v.loc(spark, sf_dir).groupBy(near("x", v.WEST, dx).alias("i"), near("y", v.SOUTH, dy).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(h, ["i", "j"], "left").select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.coalesce("n", F.lit(0)).alias("n"))


# Origin-destination pairs: from the node of each nation to the node of each of its suppliers.
_PAIRS = "od AS (SELECT DISTINCT s_nationkey::BIGINT AS source, s_suppkey AS target FROM supplier) "


def _pairs(spark, sf_dir):
    s = v.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("source"), F.col("s_suppkey").alias("target")).distinct()


def _search(weight: str, table: str = "w0", extra: str = "") -> str:
    """Distances from every origin by a recursive query that keeps one row per (origin, node)."""
    return (
        f"WITH RECURSIVE {extra}{_PAIRS}, {table} AS (SELECT u, v, min(w) AS w FROM (SELECT u, v, {weight} AS w FROM edges UNION ALL SELECT v, u, {weight} FROM edges) WHERE u <> v GROUP BY 1, 2), "
        "sp(source, node, dist) USING KEY (source, node) AS (SELECT DISTINCT source, source, 0.0::DOUBLE FROM od UNION "
        f"SELECT n.source, n.node, n.dist FROM (SELECT sp.source, e.v AS node, min(sp.dist + e.w) AS dist FROM sp JOIN {table} e ON e.u = sp.node GROUP BY 1, 2) n "
        "LEFT JOIN recurring.sp o ON o.source = n.source AND o.node = n.node WHERE o.dist IS NULL OR n.dist < o.dist) "
    )


@query("p01_shortest_distance", sql_with("edges", _search("length") + "SELECT source, node, round(dist, 3) AS dist FROM sp"))
def p01_shortest_distance(spark, sf_dir):
    best = rt.distances(rt.undirected(v.edges(spark, sf_dir), "length"), _pairs(spark, sf_dir))
    return best.select("source", "node", F.round("dist", 3).alias("dist"))


# A long one-way network: streets n -> n+1 and n -> n+17, so paths have many edges and no way leads back.
_WIDE = "wide AS (SELECT a.osmid AS u, b.osmid AS v, " + v.HAV.format(lat1="a.y", lon1="a.x", lat2="b.y", lon2="b.x") + " * 1000 AS w FROM nodes a JOIN nodes b ON b.osmid IN (a.osmid + 1, a.osmid + 17)), "


def _wide(spark, sf_dir):
    n = v.nodes(spark, sf_dir).select("osmid", "x", "y")
    fan = n.select(F.col("osmid").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.explode(F.array(F.col("osmid") + 1, F.col("osmid") + 17)).alias("v"))
    to = n.select(F.col("osmid").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return fan.join(to, "v").select("u", "v", (geo.haversine_km("uy", "ux", "vy", "vx") * 1000).alias("length"))


_SEARCH_WIDE = (
    "WITH RECURSIVE " + _WIDE + _PAIRS + ", sp(source, node, dist) USING KEY (source, node) AS (SELECT DISTINCT source, source, 0.0::DOUBLE FROM od UNION "
    "SELECT n.source, n.node, n.dist FROM (SELECT sp.source, e.v AS node, min(sp.dist + e.w) AS dist FROM sp JOIN wide e ON e.u = sp.node GROUP BY 1, 2) n "
    "LEFT JOIN recurring.sp o ON o.source = n.source AND o.node = n.node WHERE o.dist IS NULL OR n.dist < o.dist) "
)


@query("p01_one_way_distance", sql_with("nodes", _SEARCH_WIDE + "SELECT source, node, round(dist, 3) AS dist FROM sp"))
def p01_one_way_distance(spark, sf_dir):
    best = rt.distances(rt.directed(_wide(spark, sf_dir), "length"), _pairs(spark, sf_dir))
    return best.select("source", "node", F.round("dist", 3).alias("dist"))


@query("p03_one_way_paths", sql_with("nodes", _SEARCH_WIDE + "SELECT od.source, od.target, round(dist, 3) AS dist, round(dist, 3) AS along FROM od LEFT JOIN sp ON sp.source = od.source AND sp.node = od.target"))
def p03_one_way_paths(spark, sf_dir):
    """Distances of all pairs, unreachable ones included, and the same summed along the edges of each path."""
    edges = _wide(spark, sf_dir)
    found = rt.shortest_paths(edges, _pairs(spark, sf_dir), "length", one_way=True)
    step = F.expr("transform(sequence(0, size(path) - 2), i -> struct(path[i] AS u, path[i + 1] AS v))")
    legs = found.select("source", "target", F.explode_outer(F.when(F.size("path") > 1, step)).alias("s"))
    along = legs.select("source", "target", "s.u", "s.v").join(edges, ["u", "v"], "left").groupBy("source", "target").agg(F.sum("length").alias("along"))
    both = found.join(along, ["source", "target"])
    return both.select("source", "target", F.round("dist", 3).alias("dist"), F.round(F.when(F.size("path") == 1, 0.0).otherwise(F.col("along")), 3).alias("along"))


def _exposed(spark, sf_dir):
    """Exposure of an edge by its street class; service streets have none."""
    e = v.edges(spark, sf_dir)
    return e.where("highway <> 'service'").select(
        F.concat_ws("_", "u", "v", "key").alias("edge_id"), (F.col("length") * (1 + F.col("v") % 7)).alias("exposure")
    )


_EXPW = "CASE WHEN highway = 'service' THEN 1000 ELSE length * (1 + v % 7) END"


@query("p02_exposure_graph", sql_with("edges", f"SELECT u, v, round(min(w), 3) AS weight FROM (SELECT u, v, {_EXPW} AS w FROM edges UNION ALL SELECT v, u, {_EXPW} FROM edges) WHERE u <> v GROUP BY 1, 2"))
def p02_exposure_graph(spark, sf_dir):
    g = rt.undirected(rt.exposure_edges(v.edges(spark, sf_dir), _exposed(spark, sf_dir)))
    return g.select("u", "v", F.round("weight", 3).alias("weight"))


@query("p03_least_exposure", sql_with("edges", _search(_EXPW) + "SELECT od.source, od.target, round(dist, 3) AS dist FROM od LEFT JOIN sp ON sp.source = od.source AND sp.node = od.target"))
def p03_least_exposure(spark, sf_dir):
    e = rt.exposure_edges(v.edges(spark, sf_dir), _exposed(spark, sf_dir))
    found = rt.shortest_paths(e, _pairs(spark, sf_dir), "weight")
    return found.select("source", "target", F.round("dist", 3).alias("dist"))


# The customer's path visits the nodes of their orders in order.
_VISITS = "vi AS (SELECT o_custkey AS source, 0::BIGINT AS target, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_orderkey % (SELECT count(*) FROM nodes) AS osmid FROM orders), pp AS (SELECT vi.*, x, y FROM vi JOIN nodes USING (osmid)) "


def _visits(spark, sf_dir):
    n = v.nodes(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    from plumewalk.operators.ordered import with_position

    o = with_position(v.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "seq")
    return o.select(F.col("o_custkey").alias("source"), F.lit(0).cast("long").alias("target"), "seq", (F.col("o_orderkey") % n).alias("osmid"))


@query("c13_path_coordinates", sql_with("nodes", "WITH " + _VISITS + "SELECT source, target, seq, osmid, round(x, 6) AS x, round(y, 6) AS y FROM pp"))
def c13_path_coordinates(spark, sf_dir):
    p = _visits(spark, sf_dir).join(v.nodes(spark, sf_dir).select("osmid", "x", "y"), "osmid")
    return p.select("source", "target", "seq", "osmid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_HAVL = HAV.format(lat1="y", lon1="x", lat2="y2", lon2="x2")
_HAVD = HAV.format(lat1="ay", lon1="ax", lat2="by_", lon2="bx")


@query(
    "p04_path_metrics",
    sql_with("nodes", "WITH " + _VISITS + ", l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pp WINDOW w AS (PARTITION BY source, target ORDER BY seq)), "
             f"t AS (SELECT source, target, count(*) AS n_nodes, coalesce(sum({_HAVL}), 0) AS km, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_max(x, seq) AS bx, arg_max(y, seq) AS by_ FROM l GROUP BY 1, 2), "
             f"d AS (SELECT *, {_HAVD} AS dk FROM t) SELECT source, target, n_nodes, round(km, 5) AS distance_km, round(km * 0.621371, 5) AS distance_miles, round(dk, 5) AS direct_km, round(km - dk, 5) AS extra_km FROM d"),
)
def p04_path_metrics(spark, sf_dir):
    p = _visits(spark, sf_dir).join(v.nodes(spark, sf_dir).select("osmid", "x", "y"), "osmid")
    m = rt.path_lengths(p)
    return m.select("source", "target", "n_nodes", *[F.round(c, 5).alias(c) for c in ("distance_km", "distance_miles", "direct_km", "extra_km")])


def _search_km(weight: str) -> str:
    """As ``_search`` for the exposure weight, carrying the length of the route it keeps."""
    return (
        f", w1 AS (SELECT u, v, min(w) AS w, arg_min(length, w) AS len FROM (SELECT u, v, length, {weight} AS w FROM edges UNION ALL SELECT v, u, length, {weight} FROM edges) WHERE u <> v GROUP BY 1, 2), "
        "sq(source, node, dist, km) USING KEY (source, node) AS (SELECT DISTINCT source, source, 0.0::DOUBLE, 0.0::DOUBLE FROM od UNION "
        "SELECT n.source, n.node, n.dist, n.km FROM (SELECT sq.source, e.v AS node, min(sq.dist + e.w) AS dist, arg_min(sq.km + e.len, sq.dist + e.w) AS km FROM sq JOIN w1 e ON e.u = sq.node GROUP BY 1, 2) n "
        "LEFT JOIN recurring.sq o ON o.source = n.source AND o.node = n.node WHERE o.dist IS NULL OR n.dist < o.dist) "
    )


@query(
    "p05_compare_routes",
    sql_with("edges", _search("length") + _search_km(_EXPW) + "SELECT od.source, od.target, round(sp.dist / 1000, 4) AS shortest_km, round(sq.km / 1000, 4) AS least_exposure_km, CASE WHEN round(sq.km / 1000 - sp.dist / 1000, 9) > 0 THEN 'longer_but_cleaner' WHEN sp.dist IS NOT NULL THEN 'shortest_is_cleanest' END AS recommended FROM od LEFT JOIN sp ON sp.source = od.source AND sp.node = od.target LEFT JOIN sq ON sq.source = od.source AND sq.node = od.target"),
)
def p05_compare_routes(spark, sf_dir):
    c = rt.compare_routes(v.edges(spark, sf_dir), _exposed(spark, sf_dir), v.nodes(spark, sf_dir), _pairs(spark, sf_dir))
    return c.select("source", "target", F.round("shortest_km", 4).alias("shortest_km"), F.round("least_exposure_km", 4).alias("least_exposure_km"), "recommended")

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumewalk.functions import geo
from plumewalk.operators import enrich as en
from plumewalk.operators import geostat as gs
from plumewalk.operators import nearest as nn
from plumewalk.operators import spatial as sp


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    # A third of the sites share one position and a third of the features share another.
    s = [(i, 50.0 if i % 3 == 0 else float(x), 50.0 if i % 3 == 0 else float(y)) for i, (x, y) in enumerate(rng.uniform(0, 200, (90, 2)))]
    f = [(i, 55.0 if i % 3 == 0 else float(x), 50.0 if i % 3 == 0 else float(y), float(i % 5)) for i, (x, y) in enumerate(rng.uniform(-20, 220, (60, 2)))]
    return spark.createDataFrame(s, "pid int, px double, py double"), spark.createDataFrame(f, "fid int, fx double, fy double, v double"), s, f


def brute(s, f, r):
    return sorted((a[0], b[0]) for a in s for b in f if math.hypot(a[1] - b[1], a[2] - b[2]) <= r)


@pytest.mark.parametrize("limit", [3, 10_000])
@pytest.mark.parametrize("r", [1.0, 7.5, 40.0, 500.0])
def test_within_equals_brute_force(sides, r, limit):
    sites, feats, s, f = sides
    got = sp.within(sites, feats, r, limit=limit)
    assert sorted((x["pid"], x["fid"]) for x in got.collect()) == brute(s, f, r)


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_features_copied_to_cells_are_not_broadcast(sides):
    sites, feats, *_ = sides
    assert broadcasts(sp.within(sites, feats, 7.5, limit=10_000)) == 0


@pytest.mark.parametrize("limit", ["3", "10000"])
def test_beyond_all_ends_at_the_first_feature(spark, sides, limit):
    sites, feats, s, f = sides
    spark.conf.set("spark.plumewalk.maxGroupRows", limit)
    try:
        twice = sites.unionByName(sites).unionByName(spark.createDataFrame([(900, None, 1.0)], sites.schema))
        got = sp.beyond_all(twice, feats, 7.5, "pid")
        near = {a for a, _ in brute(s, f, 7.5)}
        assert sorted(r["pid"] for r in got.collect()) == sorted([a[0] for a in s if a[0] not in near] * 2 + [900])
        assert "LeftSemi" in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.plumewalk.maxGroupRows")


@pytest.mark.parametrize("rows", [3, 1024])
def test_inverse_distance_makes_no_row_per_pair(spark, sides, monkeypatch, rows):
    """Sums over near samples come from blocks; nothing that is written down holds a broadcast or a pair."""
    sites, feats, s, f = sides
    real, seen = gs.durable, []
    monkeypatch.setattr(gs, "TILE_ROWS", rows)
    monkeypatch.setattr(gs, "NEAR_ROWS", rows)
    monkeypatch.setattr(gs, "durable", lambda df: seen.append(df) or real(df))
    got = {r["pid"]: r["residual"] for r in gs.idw(sites, feats, "pid", "v", 60.0).collect()}
    assert len(seen) == 3 and sum(map(broadcasts, seen[:2])) == 0
    assert "MapInPandas" in seen[2]._jdf.queryExecution().toString()
    for a in s:
        w = [(max(math.hypot(a[1] - b[1], a[2] - b[2]), 1e-10), b[3]) for b in f]
        w = [x for x in w if x[0] < 60] or w
        assert got[a[0]] == pytest.approx(sum(v / d**2 for d, v in w) / sum(1 / d**2 for d, _ in w))


@pytest.mark.parametrize("k", [1, 4, 60, 75])
def test_nearest_equals_brute_force(sides, k):
    sites, feats, s, f = sides
    got = {}
    for x in sp.nearest(sites, feats, "pid", "fid", k=k).collect():
        got.setdefault(x["pid"], []).append((x["rank"], x["fid"]))
    for a in s:
        order = sorted((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in f)[:k]
        assert [i for _, i in sorted(got[a[0]])] == [i for _, i in order]


def test_nearest_other_metric(sides):
    sites, feats, s, f = sides
    got = {x["pid"]: x["fid"] for x in sp.nearest(sites, feats, "pid", "fid", metric="chebyshev").collect()}
    for a in s:
        want = min((max(abs(a[1] - b[1]), abs(a[2] - b[2])), b[0]) for b in f)[1]
        assert got[a[0]] == want


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_nearest_of_clusters_and_outliers(spark, monkeypatch, metric):
    """A crowd, far sites, far features, one hot spot, odd coordinates; several tiles; the site itself left out."""
    monkeypatch.setattr(nn, "TILE", 8)
    monkeypatch.setattr(nn, "SEATS", 16)
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(1e6, 10, (20, 2)), rng.uniform(-1e7, 1e7, (10, 2)), np.tile([[3.0, 4.0]], (60, 1))])
    rows = [(i, float(x), float(y), f"v{i}") for i, (x, y) in enumerate(p)]
    odd = [(900, None, 1.0, "n"), (901, float("nan"), 1.0, "n"), (902, float("inf"), 1.0, "n")]
    sites = spark.createDataFrame([r[:3] for r in rows + odd], "pid long, px double, py double")
    feats = spark.createDataFrame(rows + odd, "fid long, fx double, fy double, tag string")
    got = {}
    for r in sp.nearest(sites, feats, "pid", "fid", k=4, metric=metric, skip_self=True).collect():
        assert r["tag"] == f"v{r['fid']}"
        got.setdefault(r["pid"], []).append((r["rank"], r["fid"]))
    d = nn.METRICS[metric](np.abs(p[:, None, 0] - p[None, :, 0]), np.abs(p[:, None, 1] - p[None, :, 1]))
    assert set(got) == set(range(len(p)))
    for i, own in got.items():
        order = [j for j in np.lexsort((np.arange(len(p)), d[i])) if j != i][:4]
        assert [j for _, j in sorted(own)] == order


def test_nearest_visits_few_tiles():
    """Sites far outside a crowd visit its rim, and the sum of visits stays a small multiple of the sites."""
    rng = np.random.default_rng(6)
    f = rng.normal(0, 1, (20_000, 2))
    f = f[np.lexsort((f[:, 1], np.floor(f[:, 0] * 10)))]
    edge = np.arange(0, len(f), 50)
    head = {"n": np.full(len(edge), 50), "tile": edge} | {f"{n}{c}": fn.reduceat(f[:, k], edge) for k, c in enumerate("xy") for n, fn in (("min", np.minimum), ("max", np.maximum))}
    for sites, most in ((rng.normal(0, 1, (500, 2)), 25), (rng.normal(0, 1, (500, 2)) + [1e4, 0], 25), (rng.uniform(-1e5, 1e5, (500, 2)), 80)):
        total = sum(len(who) for _, who in nn.visits(sites[:, 0], sites[:, 1], head, nn.METRICS["euclidean"], 5))
        assert 500 <= total < 500 * most


def test_nearest_shuffles_no_row_per_tile(sides, monkeypatch):
    """What a site finds in one tile is merged where it is found; rows that repeat a site's id share k rows."""
    sites, feats, s, f = sides
    monkeypatch.setattr(nn, "TILE", 8)
    found = sp.nearest(sites, feats, "pid", "fid", k=3)
    plan = found._jdf.queryExecution().toString()
    assert plan.split("== Optimized")[1].index("MapInArrow") < plan.split("== Optimized")[1].index("Repartition") and "row_number" not in plan
    want = {(r["pid"], r["rank"], r["fid"]) for r in found.collect()}
    assert len(want) == 3 * len(s)
    twice = sp.nearest(sites.union(sites.where("pid % 2 = 0")), feats, "pid", "fid", k=3).collect()
    assert len(twice) == len(want)
    lists = nn.nearest_lists(sites, feats, "pid", "fid", k=3).collect()
    assert {(r["pid"], i, n["fid"]) for r in lists for i, n in enumerate(r["near"], 1)} == want


def test_nearest_without_a_side(sides):
    sites, feats, *_ = sides
    assert sp.nearest(sites.limit(0), feats, "pid", "fid").count() == 0
    none = sp.nearest(sites, feats.limit(0), "pid", "fid")
    assert none.count() == 0 and none.columns == ["pid", "px", "py", "fid", "fx", "fy", "v", "dist", "rank"]


@pytest.mark.parametrize("tile_rows", [4, 1000])
def test_pair_counts_with_crowded_cells(spark, sides, monkeypatch, tile_rows):
    _, _, s, _ = sides
    pts = spark.createDataFrame(s, "pid int, px double, py double")
    real = sp.tile_pairs
    monkeypatch.setattr(gs, "tile_pairs", lambda *a, **k: real(*a, **{**k, "tile_rows": tile_rows}))
    got = {r["band"]: r["n"] for r in gs.pair_counts(pts, "pid", 60.0, 6).collect()}
    want = {}
    for i, a in enumerate(s):
        for b in s[i + 1 :]:
            d = math.hypot(a[1] - b[1], a[2] - b[2])
            if d < 60:
                want[int(d // 10)] = want.get(int(d // 10), 0) + 1
    assert got == want


def test_band_counts_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    a, b = rng.uniform(0, 8, (2, 700)), rng.uniform(-60, 70, (2, 900))
    a[0, 5], b[1, 7] = np.nan, np.inf
    a[:, 6], b[:, 8:11] = 0.0, [[10.0, 0.7, 60.0], [0.0, 0.0, 0.0]]
    d = np.sqrt((a[0][:, None] - b[0]) ** 2 + (a[1][:, None] - b[1]) ** 2)
    for width, bands in ((10.0, 6), (0.1, 600)):
        want = np.bincount(np.floor(d[d < 60] / width).astype(int), minlength=bands)[:bands]
        np.testing.assert_array_equal(gs.band_counts(*a, *b, width, bands, 60.0, 1 << 12), want)


def test_group_band_counts_are_those_of_all_pairs():
    """Also for points on the ends of bands, copies, few points and far away tiles, whole groups within one band or not."""
    rng = np.random.default_rng(8)
    for scale, shift in ((4.0, 0.0), (30.0, 12.0), (400.0, 90.0), (3.0, 57.0)):
        a, b = ({"px": 1e6 + rng.uniform(0, scale, n) + s, "py": 5e6 + rng.uniform(0, scale, n)} for n, s in ((700, 0.0), (901, shift)))
        b["px"][:40], b["py"][:40] = a["px"][:40] + np.arange(40) * 2.5, a["py"][:40]
        a["px"][50:60], a["py"][50:60] = a["px"][40:50], a["py"][40:50]
        for width, bands, most in ((10.0, 6, 60.0), (0.1, 30, 3.0), (7.0, 9, 60.0)):
            got, want = gs.group_band_counts(a, b, False, width, bands, most), gs.band_counts(a["px"], a["py"], b["px"], b["py"], width, bands, most)
            np.testing.assert_array_equal(got, want)
            want = gs.band_counts(a["px"], a["py"], a["px"], a["py"], width, bands, most)
            want[0] -= 700
            np.testing.assert_array_equal(gs.group_band_counts(a, a, True, width, bands, most), want // 2)


def test_tiles_are_not_copied_more_often_for_more_points(spark, monkeypatch):
    """A tile meets its own cell and four more, and crowded cells make larger groups, not more of them."""
    seen, real = [], sp.pair_tiles

    def pair_tiles(left, right, cell, left_id, right_id, width, group=4):
        seen.append((left.count(), right.count(), left.columns, group))
        return real(left, right, cell, left_id, right_id, width, group)

    monkeypatch.setattr(sp, "pair_tiles", pair_tiles)
    pts = spark.range(24_000).select("id", (F.col("id") % 200 / 10).alias("px"), F.floor(F.col("id") / 200).alias("py"))
    kernel = lambda a, b, same: pd.DataFrame({"n": [len(a["px"]) * (len(a["px"]) - 1) // 2 if same else len(a["px"]) * len(b["px"])]})
    few = sp.tile_pairs(pts.where("id < 600"), 500.0, "id", ["px", "py"], kernel, "n long", tile_rows=20, with_id=False)
    assert few.agg(F.sum("n")).first()[0] == 600 * 599 // 2
    sp.tile_pairs(pts, 500.0, "id", ["px", "py"], kernel, "n long", tile_rows=8, with_id=False)  # not run
    tiles, copies, columns, group = seen[-1]
    assert copies == 5 * tiles and "a_id" not in columns
    assert tiles / group <= 2 * sp.TILE_GROUPS


def test_groups_of_positions_and_features_grow_with_the_positions(spark, monkeypatch):
    """So that tiles of a crowded cell are not copied more often the more there are."""
    groups, real = [], en.pair_tiles

    def pair_tiles(left, right, cell, left_id, right_id, width, group=4):
        groups.append(group)
        return real(left, right, cell, left_id, right_id, width, group)

    monkeypatch.setattr(en, "pair_tiles", pair_tiles)
    monkeypatch.setattr(en, "SITE_TILE", 2)
    pts = spark.range(4_000).select("id", (F.col("id") * 1e-7).alias("x"), F.lit(0.0).alias("y"))
    layer = spark.range(30).select((F.col("id") * 1e-5).alias("x"), F.lit(0.0).alias("y"))
    wide = en.enrich(pts, {"poi": layer}, [en.FeatureSpec("all", "poi", [50], "count")])
    assert groups[0] > 16
    assert wide.where("num_all_50 <> 30").count() == 0 and wide.count() == 4_000


def test_tiles_out_of_reach_are_not_compared(spark, tmp_path):
    """Strips of a cell that lie further apart than the reach never come to the kernel."""
    pts = spark.range(400).select("id", (F.col("id") / 10).alias("px"), F.lit(0.0).alias("py"))

    def kernel(a, b, same):
        import pandas as pd

        return pd.DataFrame({"gap": [max(a["px"].min() - b["px"].max(), b["px"].min() - a["px"].max())]})

    gaps = [r["gap"] for r in sp.tile_pairs(pts, 10.0, "id", ["px", "py"], kernel, "gap double", tile_rows=10).collect()]
    assert gaps and max(gaps) <= 10.0


def measure(spark, rings, at, radii):
    """Distances and disc areas of one polygon as seen from several positions."""
    ring = [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
    df = spark.createDataFrame([("polygon", ring)], "g string, rings array<array<struct<x:double,y:double>>>")
    edges = df.select(F.inline(geo.edge_table(F.col("g"), F.col("rings")))).toPandas()
    t = {c: edges[c].to_numpy() for c in edges.columns} | {"_solid": np.ones(1)}
    px, py = (np.array([p[i] for p in at], dtype=float)[:, None] for i in (0, 1))
    d, a = en.shape_measures(px, py, t, np.array([0]), radii)
    return d[:, 0], {r: v[:, 0] for r, v in a.items()}


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


@pytest.mark.parametrize("ring", [SQUARE, SQUARE[::-1], [*SQUARE, SQUARE[0]]])
def test_disc_areas_of_a_square(spark, ring):
    d, a = measure(spark, [ring], [(2, 2), (0, 2), (0, 0), (-9, 0), (6, 2)], [1.0, 10.0])
    np.testing.assert_allclose(a[1.0], [math.pi, math.pi / 2, math.pi / 4, 0, 0], atol=1e-9)
    assert a[10.0][0] == pytest.approx(16.0)
    np.testing.assert_allclose(d, [0, 0, 0, 9, 2], atol=1e-12)


def test_hole_is_outside(spark):
    hole = [(1, 1), (3, 1), (3, 3), (1, 3)]
    d, a = measure(spark, [SQUARE, hole], [(2, 2), (0.5, 0.5)], [0.4, 10.0])
    np.testing.assert_allclose(d, [1.0, 0.0])
    np.testing.assert_allclose(a[0.4], [0.0, math.pi * 0.16], atol=1e-9)
    assert a[10.0][0] == pytest.approx(12.0)


@pytest.mark.parametrize("site_tile, edge_tile", [(3, 5), (512, 2048)])
def test_shape_blocks_in_crowded_cells(spark, monkeypatch, site_tile, edge_tile):
    monkeypatch.setattr(en, "SITE_TILE", site_tile)
    monkeypatch.setattr(en, "EDGE_TILE", edge_tile)
    assert len(en.radius_classes([(0, 1.0, "a"), (0, 4.0, "b"), (0, 100.0, "c")])) == 2
    assert len(en.radius_classes([(0, 1.0, "a"), (0, 100.0, "c")], floor=200.0)) == 1
    rng = np.random.default_rng(8)
    sites = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 50, (40, 2)))]
    boxes = []
    for i, (x, y) in enumerate(rng.uniform(0, 50, (30, 2))):
        h = 25.0 if i == 0 else float(rng.uniform(0.5, 6))
        boxes.append((float(x), float(y), h, float(i % 4)))
    ring = lambda x, y, h: [[{"x": x + a * h, "y": y + b * h} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]]
    layer = spark.createDataFrame([("polygon", ring(x, y, h), v) for x, y, h, v in boxes] * 2, "geom_type string, rings array<array<struct<x:double,y:double>>>, v double")
    pts = spark.createDataFrame(sites, "pid int, x double, y double")
    specs = [en.FeatureSpec("b", "l", [1, 4], "count"), en.FeatureSpec("b", "l", [4], "mean", "v"), en.FeatureSpec("b", "l", [100], "proximity")]
    got = {r["pid"]: r for r in en.enrich(pts, {"l": layer}, specs, crs="deg").collect()}
    for pid, x, y in sites:
        d = [math.hypot(max(abs(x - bx) - h, 0), max(abs(y - by) - h, 0)) for bx, by, h, _ in boxes]
        for r in (1, 4):
            assert got[pid][f"num_b_{r}"] == 2 * sum(v <= r for v in d)
        near = [b[3] for v, b in zip(d, boxes) if v <= 4]
        assert got[pid]["average_b_4"] == (pytest.approx(np.mean(near)) if near else None)
        assert got[pid]["close2b_100"] == 1


def test_positions_go_by_groups():
    """Whole groups take shapes that are near all of them; few distances are left, and sums are those of all pairs."""
    rng = np.random.default_rng(4)
    px, py, fx, fy, v = rng.uniform(0, 20, 512), rng.uniform(0, 20, 512), rng.uniform(-100, 120, 3000), rng.uniform(-100, 120, 3000), rng.integers(0, 9, 3000)
    order, seen = en.z_sorted(px, py), []
    px, py = px[order], py[order]

    def distance(x, y, shape, reach):
        seen.append(len(x))
        return np.hypot(x - fx[shape], y - fy[shape])

    got = en.near_groups(px, py, distance, v[:, None].astype(float), 80.0, 1 << 12)
    near = np.hypot(px[:, None] - fx, py[:, None] - fy) <= 80
    np.testing.assert_array_equal(got, np.stack([near @ v, near.sum(1)], axis=1))
    assert sum(seen) < 0.2 * near.size
    t = {"px": px, "py": py, "x": px, "y": py, "fx": fx, "fy": fy, "_copies": np.ones(3000), "_f0": np.ones(3000), "_s_v": v.astype(float), "_n_v": np.ones(3000)}
    rows = en.shape_tile(t, [("n", "copies", None, 0, 80.0), ("s", "sum", "v", 0, 80.0), ("c", "any", None, 0, 0.5)])
    np.testing.assert_array_equal(rows[["s", "n"]], got)
    np.testing.assert_array_equal(rows["c"], (np.hypot(px[:, None] - fx, py[:, None] - fy) <= 0.5).any(1))


def test_radius_monotone_and_copies(spark):
    pts = spark.createDataFrame([(i, 9.23, 45.478) for i in range(30)] + [(99, 9.231, 45.479)], "pid int, x double, y double")
    layer = spark.createDataFrame([(9.2301, 45.4781, "a", 2.0)] * 10 + [(9.2306, 45.4781, "b", None)], "x double, y double, kind string, v double")
    specs = [
        en.FeatureSpec("t", "l", [20, 50, 100], "count"),
        en.FeatureSpec("t", "l", [20, 2000], "proximity", "kind", ["b"]),
        en.FeatureSpec("t", "l", [50], "mean", "v"),
        en.FeatureSpec("none", "l", [50], "count", ["kind"], [[]]),
        en.FeatureSpec("t", "l", [50], "sum", "v"),
    ]
    out = en.enrich(pts, {"l": layer}, specs).orderBy("pid").collect()
    assert len(out) == 31
    r = out[0]
    assert r["num_t_20"] <= r["num_t_50"] <= r["num_t_100"] and r["num_t_20"] == 10
    assert r["average_t_50"] == 2.0 and r["sum_t_50"] == 20.0 and r["num_none_50"] == 0
    assert r["close2t_20"] == 0 and r["close2t_2000"] == 1
    assert out[-1]["sum_t_50"] == 0.0 and out[-1]["average_t_50"] is None


def test_line_layer_and_unknown_mode(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.002)], "pid int, x double, y double")
    line = [[{"x": -1.0, "y": 0.0005}, {"x": 1.0, "y": 0.0005}]]
    layer = spark.createDataFrame([("line", line)], "geom_type string, rings array<array<struct<x:double,y:double>>>")
    spec = en.FeatureSpec("s", "roads", [60], "proximity")
    got = {r["pid"]: r["close2s_60"] for r in en.enrich(pts, {"roads": layer}, [spec]).collect()}
    assert got == {1: 1, 2: 0}
    bad = en.FeatureSpec("s", "roads", [60], "nope")
    with pytest.raises(KeyError):
        en.enrich(pts, {"roads": layer}, [bad])
    assert en.enrich(pts, {"roads": layer}, [bad], on_error="skip").columns == pts.columns


def test_read_specs(tmp_path):
    p = tmp_path / "specs.toml"
    p.write_text('[[features]]\nprefix = "water"\nsource = { natural = ["water"], waterway = true }\nradii = [25, 100]\nmode = "proximity"\n')
    (spec,) = en.read_specs(str(p))
    assert spec.names() == ["close2water_25", "close2water_100"]
    assert len(en.layer_key(spec.source)) == 32
    assert en.read_specs(str(tmp_path / "none.toml")) == []


def test_idw_far_targets_use_all_samples(spark):
    s = [(0.0, 0.0, 1.0), (10.0, 0.0, 3.0), (10.0, 0.0, 3.0)]
    samples = spark.createDataFrame(s, "fx double, fy double, r double")
    targets = spark.createDataFrame([(1, 1.0, 0.0), (2, 100.0, 0.0)], "id int, px double, py double")
    got = {r["id"]: r["residual"] for r in gs.idw(targets, samples, "id", "r", 5.0).collect()}
    w = [1 / (100 - x) ** 2 for x, _, _ in s]
    assert got[1] == pytest.approx(1.0)
    assert got[2] == pytest.approx(sum(a * b[2] for a, b in zip(w, s)) / sum(w))


def test_moran_constant_and_reference_variance(spark):
    pts = [(i, float(i % 5), float(i // 5), 2.0, float((i * 7) % 11)) for i in range(25)]
    df = spark.createDataFrame(pts, "pid int, px double, py double, flat double, v double")
    r = gs.morans_i(df, "pid", "flat", 1.5).first()
    assert (r["i"], r["z"], r["p"]) == (0.0, 0.0, 1.0)
    got = gs.morans_i(df, "pid", "v", 1.5, variance="reference").first()
    xy, v = np.array([p[1:3] for p in pts]), np.array([p[4] for p in pts])
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    w = np.where((d > 0) & (d <= 1.5), 1 / np.where(d > 0, d, 1), 0)
    w = w / w.sum(1, keepdims=True)
    z, n = v - v.mean(), 25
    i = n / w.sum() * (w * np.outer(z, z)).sum() / (z**2).sum()
    s0, s1, s2 = w.sum(), 0.5 * ((w + w.T) ** 2).sum(), (w.sum(1) ** 2).sum()
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - (n - 1) * (n - 2) * (n - 3) * s0**2) / ((n - 1) ** 2 * (n - 2) * (n - 3) * s0**2)
    assert got["i"] == pytest.approx(i) and got["variance"] == pytest.approx(var)


def test_kriging_matches_dense_solve(spark):
    rng = np.random.default_rng(1)
    s = [(i, float(x), float(y), float(x + 2 * y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (12, 2)))]
    samples = spark.createDataFrame(s, "fid int, fx double, fy double, v double")
    targets = spark.createDataFrame([(1, 5.0, 5.0), (2, s[0][1], s[0][2])], "pid int, px double, py double")
    fit = {"nugget": 0.0, "psill": 4.0, "reach": 8.0}
    got = {r["pid"]: (r["estimate"], r["variance"]) for r in gs.local_kriging(targets, samples, "pid", "fid", "v", "spherical", fit, k=12).collect()}
    xy = np.array([r[1:3] for r in s])
    lag = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    a = np.ones((13, 13))
    a[:12, :12] = gs.variogram_value("spherical", lag, **fit)
    a[12, 12] = 0
    b = np.append(gs.variogram_value("spherical", np.hypot(xy[:, 0] - 5, xy[:, 1] - 5), **fit), 1.0)
    w = np.linalg.solve(a, b)
    assert got[1][0] == pytest.approx(w[:12] @ np.array([r[3] for r in s])) and got[1][1] == pytest.approx(w @ b)
    assert got[2][0] == pytest.approx(s[0][3]) and got[2][1] == pytest.approx(0, abs=1e-9)


def test_variogram_fit_recovers_shape(spark):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(i, float(x), float(y), float(math.sin(x) + y)) for i, (x, y) in enumerate(rng.uniform(0, 3, (150, 2)))], "pid int, px double, py double, v double")
    fit = gs.fit_variogram(pts, "pid", "v", "exponential", lags=8)
    assert fit["psill"] > 0 and fit["nugget"] >= 0 and fit["reach"] > 0


def test_workers_need_no_package(tmp_path):
    """A session started far from the repository runs the block kernels."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from plumewalk import get_session\n"
        "from plumewalk.operators import enrich as en\n"
        "spark = get_session('far')\n"
        "pts = spark.createDataFrame([(1, 9.23, 45.478)], 'pid int, x double, y double')\n"
        "print('found', en.enrich(pts, {'l': pts}, [en.FeatureSpec('t', 'l', [10], 'count')]).first()['num_t_10'])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 1" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("kind", ["variogram", "covariogram"])
def test_pairs_within_one_bin_are_not_taken_one_by_one(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    n = 700
    x, y, z = rng.uniform(0, 9, n), rng.uniform(0, 9, n), rng.normal(size=n)
    x[:20], y[:20] = np.arange(20) * 0.45, 4.5  # on the edges of bins, with a copy
    x[20:25], y[20:25] = x[:5], y[:5]
    found = []

    def tile_pairs(points, reach, point_id, attrs, kernel, schema, *more):
        found.append(kernel)
        raise StopIteration

    monkeypatch.setattr(gs, "tile_pairs", tile_pairs)
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "pid long, px double, py double, v double")
    for make in (lambda: gs.surface(df, "pid", "v", kind, extent=(4.5, 4.5)), lambda: gs.directional(df, "pid", "v", kind, lags=5, max_lag=4.0)):
        with pytest.raises(StopIteration):
            make()
    looked = []
    degrees, floor = np.degrees, np.floor
    monkeypatch.setattr(gs.np, "degrees", lambda v: looked.append(v.size) or degrees(v))
    tile = {"px": x, "py": y, "_z": z}
    a, b = ({c: v[half] for c, v in tile.items()} for half in (slice(0, 500), slice(500, n)))
    parts = [pd.concat([kernel(a, a, True), kernel(b, b, True), kernel(a, b, False)]) for kernel in found]
    assert sum(looked) < 0.8 * n * n / 2
    i, j = np.indices((n, n))
    product = kind == "covariogram"
    v = z[i] * z[j] if product else (z[i] - z[j]) ** 2
    bx, by = (floor((w[i] - w[j]) / 0.45).astype(int) + 10 for w in (x, y))
    ok = (bx >= 0) & (bx < 20) & (by >= 0) & (by < 20) & ((i != j) | product)
    got = parts[0].groupby("bin").sum().reindex(range(400), fill_value=0)
    at = (bx * 20 + by)[ok]
    assert (got["n"].to_numpy() == np.bincount(at, minlength=400)).all()
    assert np.allclose(got["total"], np.bincount(at, v[ok], 400), atol=1e-9)
    dx, dy = x[i] - x[j], y[i] - y[j]
    k, angle = floor(np.sqrt(dx * dx + dy * dy) / 0.8).astype(int), degrees(np.arctan2(dy, dx)) % 180
    free, tol = (i < j) & (k < 5) & ((dx != 0) | (dy != 0) | (not product)), 10.0 if product else 22.5
    want = {-1: free}
    for d in gs.DIRECTIONS:
        fits = free & ((np.abs(angle - d) < tol) | (np.abs(angle - d - 180) < tol) | (np.abs(angle - d + 180) < tol))
        want[d], free = fits, free if product else free & ~fits
    got = parts[1].groupby(["direction", "bin"]).sum()
    for d, fits in want.items():
        mine = got.loc[d].reindex(range(5), fill_value=0)
        assert (mine["n"].to_numpy() == np.bincount(k[fits], minlength=5)).all()
        assert np.allclose(mine["total"], np.bincount(k[fits], v[fits], 5), atol=1e-9)


def test_inverse_distances_leave_out_what_is_beyond_reach():
    rng = np.random.default_rng(3)
    a, b = ({"px": rng.uniform(x0, x0 + 5, 300), "py": rng.uniform(0, 60, 300)} for x0 in (0, 7))
    b["px"][0], b["py"][0] = a["px"][0], a["py"][0]
    b["px"][1] = np.nan
    got, looked = np.zeros((300, 300)), 0
    for i, j, inv in gs.inverse_distances(a, b, 8.0):
        got[np.ix_(i, j)] = inv
        looked += inv.size
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.hypot(a["px"][:, None] - b["px"], a["py"][:, None] - b["py"])
        want = np.where((d > 0) & (d <= 8.0), 1 / d, 0.0)
    assert np.allclose(got, want) and 0 < looked < 0.4 * 300 * 300


def test_areas_of_a_group_take_only_edges_at_the_rim(monkeypatch):
    rng = np.random.default_rng(5)
    rings = []
    for k in range(60):
        c, s = rng.uniform(-40, 100, 2), rng.uniform(3, 60)
        turn = np.sort(rng.uniform(0, 2 * np.pi, 6)) if k % 3 else np.arange(4) * np.pi / 2 + np.pi / 4
        shell = [tuple(c + s * np.array([math.cos(a), math.sin(a)])) for a in turn]
        hole = [tuple(c + s / 3 * np.array([math.cos(a), -math.sin(a)])) for a in np.arange(4) * np.pi / 2]
        rings.append([shell, hole] if k % 3 == 0 else [shell])
    rows = [[(p, q) for ring in shape for p, q in zip(ring, ring[1:] + ring[:1])] for shape in rings]
    (ax, ay), (bx, by) = (np.array([e[side] for shape in rows for e in shape]).T for side in (0, 1))
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = {"ax": ax, "ay": ay, "by": by, "dx": dx, "dy": dy, "l2": l2, "il2": 1 / l2, "slope": np.divide(dx, dy, out=np.zeros_like(dx), where=dy != 0)}
    corners = [np.array([p for ring in shape for p in ring]) for shape in rings]
    t |= {"minx": np.array([c[:, 0].min() for c in corners]), "maxx": np.array([c[:, 0].max() for c in corners])}
    t |= {"miny": np.array([c[:, 1].min() for c in corners]), "maxy": np.array([c[:, 1].max() for c in corners])}
    t |= {"_size": np.array([float(len(s)) for s in rows]), "_solid": (np.arange(60) % 7 > 0) * 1.0, "_copies": np.arange(60) % 3 + 1.0, "_f0": np.ones(60), "_f1": (np.arange(60) % 2) * 1.0}
    px, py = rng.uniform(0, 60, 400), rng.uniform(0, 60, 400)
    px[:20], py[:20] = ax[:20], ay[:20]  # on corners
    px[20:40], py[20:40] = ax[:20] + dx[:20] / 2, ay[:20] + dy[:20] / 2  # on edges
    t |= {"px": px, "py": py, "x": px + 0.0, "y": py + 0.0}
    wanted = [("a", "area", None, 0, 12.0), ("b", "area", None, 1, 30.0), ("n", "copies", None, 0, 12.0)]
    site, shape = (v.ravel() for v in np.indices((400, 60)))
    dist, areas = en.pair_measures(px, py, site, shape, t, (12.0, 30.0), 1 << 20)
    fact = t["_copies"] * t["_solid"]
    want = {"a": areas[12.0].reshape(400, 60) @ fact, "b": areas[30.0].reshape(400, 60) @ (fact * t["_f1"]), "n": (dist <= 12.0).reshape(400, 60) @ t["_copies"]}
    measured = []
    plain = en.pair_measures
    monkeypatch.setattr(en, "pair_measures", lambda px, py, site, *more: measured.append(len(site)) or plain(px, py, site, *more))
    for names in (["a", "b"], ["a", "b", "n"]):
        got = en.shape_tile(t, [w for w in wanted if w[0] in names])
        if names == ["a", "b"]:
            assert sum(measured) < 0.05 * 400 * 60
        got = got.set_index(["x", "y"]).reindex(pd.MultiIndex.from_arrays([px, py])).fillna(0.0)
        for n in names:
            assert np.allclose(got[n], want[n], atol=1e-6), n

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumewalk.functions.tails import chi2_upper, normal_two_sided
from plumewalk.operators import clean as cl
from plumewalk.operators import geometry as gm
from plumewalk.operators import impute as im
from plumewalk.operators import metrics as me
from plumewalk.operators import model as mo
from plumewalk.operators import route as rt
from plumewalk.operators import select as sel
from plumewalk.operators import series as se
from plumewalk.operators import splits as sl


def dense_spline(y, at):
    n = len(y)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        b[i] = 6 * (y[i + 1] - 2 * y[i] + y[i - 1])
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    m = np.linalg.solve(a, b)
    k = np.clip(np.floor(at).astype(int), 0, n - 2)
    u = at - k
    v = 1 - u
    return v * y[k] + u * y[k + 1] + ((v**3 - v) * m[k] + (u**3 - u) * m[k + 1]) / 6


@pytest.mark.parametrize("n, block", [(4, 4096), (37, 4096), (600, 70), (2, 4096), (1, 4096)])
def test_resample(spark, n, block):
    y = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "k int, t int, v double")
    got = se.resample(df, ["k"], ["t"], "v", 250, block=block).orderBy("i").toPandas()
    at = np.arange(250) * ((n - 1) / 249)
    want = dense_spline(y, at) if n >= 4 else np.interp(at, np.arange(n), y)
    assert list(got["i"]) == list(range(250))
    np.testing.assert_allclose(got["value"], want, atol=1e-9)


@pytest.mark.parametrize("y", [[1, 2, 4, 7, 11], [1, 3, 2, 2, 5], [0, 0, 1, 0, 0]])
def test_pchip_passes_knots_and_keeps_shape(spark, y):
    t = [0, 3, 5, 9, 12]
    df = spark.createDataFrame([(1, a, float(b)) for a, b in zip(t, y)], "k int, t long, v double")
    got = {r["t"]: r["value"] for r in se.pchip(df, ["k"], "t", "v").collect()}
    assert sorted(got) == list(range(13))
    for a, b in zip(t, y):
        assert got[a] == pytest.approx(b)
    for (a, b), (p, q) in zip(zip(t, t[1:]), zip(y, y[1:])):
        for s in range(a, b + 1):
            assert min(p, q) - 1e-9 <= got[s] <= max(p, q) + 1e-9


def test_pchip_continues_over_missing_ends(spark):
    rows = [(1, 0, None), (1, 2, 4.0), (1, 4, 8.0), (1, 6, None)]
    df = spark.createDataFrame(rows, "k int, t long, v double")
    got = [r["value"] for r in se.pchip(df, ["k"], "t", "v").orderBy("t").collect()]
    np.testing.assert_allclose(got, [0, 2, 4, 6, 8, 10, 12])


def test_pacf_matches_yule_walker(spark):
    y = np.cumsum(np.random.default_rng(2).normal(size=80))
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "k int, t int, v double")
    got = [r["pacf"] for r in se.pacf(df, ["k"], ["t"], "v", 6).orderBy("lag").collect()]
    z = y - y.mean()
    rho = np.array([1.0] + [(z[k:] * z[:-k]).sum() / (z**2).sum() for k in range(1, 7)])
    for k in range(1, 7):
        toe = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k - 1] == pytest.approx(np.linalg.solve(toe, rho[1 : k + 1])[-1])


def test_acf_of_constant_is_zero(spark):
    df = spark.createDataFrame([(1, i, 5.0) for i in range(10)], "k int, t int, v double")
    assert {r["acf"] for r in se.acf(df, ["k"], ["t"], "v", 3).collect()} == {0.0}


def test_tails():
    assert chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-9)


def test_normality_distances(spark):
    v = np.round(np.random.default_rng(4).normal(size=200), 1)
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    r = me.normality_distances(df, "v").first()
    x = np.sort(v)
    f = np.array([0.5 * math.erfc(-(a - v.mean()) / v.std(ddof=1) / math.sqrt(2)) for a in x])
    i = np.arange(1, 201)
    assert r["ks_d"] == pytest.approx(max((i / 200 - f).max(), (f - (i - 1) / 200).max()))
    assert r["anderson_a2"] == pytest.approx(-200 - ((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))).mean())


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4)) * [1, 10, 0.1, 5] + [1000, 0, 5, -3]
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=200)
    df = spark.createDataFrame([(int(i % 2), *map(float, r), float(b), int(i % 4)) for i, (r, b) in enumerate(zip(x, y))], "k int, a double, b double, c double, d double, y double, fold int")
    return df, x, y


def test_ols_and_inference(sample):
    df, x, y = sample
    fit = mo.linear_inference(df, [], ["a", "b", "c", "d"], "y").first()
    full = np.column_stack([np.ones(200), x])
    w = np.linalg.lstsq(full, y, rcond=None)[0]
    res = y - full @ w
    se_ = np.sqrt(res @ res / 195 * np.diag(np.linalg.inv(full.T @ full)))
    np.testing.assert_allclose(fit["coef"], w, rtol=1e-6)
    np.testing.assert_allclose(fit["t_values"], w / se_, rtol=1e-5)


def test_lasso_optimality(sample):
    df, x, y = sample
    fit = mo.fit_linear(df, [], ["a", "b", "c", "d"], "y", "lasso", 0.3).first()
    w = np.array(fit["coef"])
    xc, yc = x - x.mean(0), y - y.mean()
    grad = xc.T @ (yc - xc @ w) / 200
    for g, b in zip(grad, w):
        if b == 0:
            assert abs(g) <= 0.3 + 1e-6
        else:
            assert g == pytest.approx(0.3 * np.sign(b), abs=1e-6)


def test_block_search_equals_direct_folds(sample):
    df, x, y = sample
    got = {r["alpha"]: r["score"] for r in mo.block_search(df.withColumn("all", F.lit(1)), ["all"], "fold", ["a", "b", "c", "d"], "y", [0.5, 50.0]).collect()}
    fold = np.arange(200) % 4
    for alpha, score in got.items():
        errs = []
        for k in range(4):
            tr, te = fold != k, fold == k
            m, my = x[tr].mean(0), y[tr].mean()
            w = np.linalg.solve((x[tr] - m).T @ (x[tr] - m) + alpha * np.eye(4), (x[tr] - m).T @ (y[tr] - my))
            errs.append(((y[te] - my - (x[te] - m) @ w) ** 2).mean())
        assert score == pytest.approx(np.mean(errs), rel=1e-6)


def test_small_group_is_reported(spark):
    df = spark.createDataFrame([(1, float(i), float(i)) for i in range(3)], "k int, x double, y double")
    r = mo.fit_linear(df, ["k"], ["x"], "y").first()
    assert r["coef"] is None and "3 rows" in r["error"]
    assert mo.predict_linear(df, mo.fit_linear(df, ["k"], ["x"], "y"), ["k"], ["x"]).where("prediction is not null").count() == 0


def test_principal_components_and_elimination(sample):
    df, x, y = sample
    cols = ["a", "b", "c", "d"]
    load, k = sel.principal_components(df, cols, 0.8)
    val = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = {r["component"]: r["explained"] for r in load.collect()}
    np.testing.assert_allclose([got[i] for i in range(4)], val / val.sum(), rtol=1e-6)
    assert k == int(np.searchsorted(np.cumsum(val / val.sum()), 0.8) + 1)
    scored = sel.project_components(df, cols, 0.99)
    assert scored.agg(F.var_samp("pc1")).first()[0] == pytest.approx(val[0], rel=1e-6)
    assert set(sel.recursive_elimination(sel.scale(df, [*cols, "y"]), cols, "y", keep=2)) == {"a", "b"}


def test_ensemble_corner_cases(spark):
    p = spark.createDataFrame([(1, 1, 10.0), (1, 2, 30.0), (2, 1, None), (2, 2, float("inf")), (3, 1, float("nan")), (3, 3, 8.0)], "row_id int, subject_id int, pred double")
    w = spark.createDataFrame([(1, 3.0), (2, 1.0)], "subject_id int, similarity double")
    got = {r["row_id"]: r["prediction"] for r in mo.combine_ensemble(p, w).collect()}
    assert got == {1: 15.0, 2: 16.0, 3: 8.0}
    zero = spark.createDataFrame([(1, 0.0), (2, 0.0)], "subject_id int, similarity double")
    assert {r["row_id"]: r["prediction"] for r in mo.combine_ensemble(p, zero).collect()}[1] == 20.0
    none = p.withColumn("pred", F.lit(None).cast("double"))
    assert {r["prediction"] for r in mo.combine_ensemble(none, w).collect()} == {0.0}


def test_matrix_completion_matches_dense(spark):
    rng = np.random.default_rng(11)
    full = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5))
    x = np.where(rng.uniform(size=full.shape) < 0.15, np.nan, full)
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id int, a double, b double, c double, d double, e double")
    got = im.complete_matrix(df, list("abcde"), max_iters=12, tolerance=0.0, every=5).orderBy("id").toPandas()[list("abcde")].to_numpy()
    z, known, shrink = np.nan_to_num(x), ~np.isnan(x), None
    for _ in range(12):
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        shrink = s[0] / 50 if shrink is None else shrink
        z = np.where(known, x, (u * np.maximum(s - shrink, 0)) @ vt)
    np.testing.assert_allclose(got, z, atol=1e-8)


def test_edge_imputation_rules(spark):
    rows = [(i, i + 1, 0, ["footway", "primary", "service"][i % 3], "yes" if i % 4 else None, int(i % 2), 0, 10.0 + i, None if i % 5 == 0 else float(1 + i % 3), None if i % 7 == 0 else 30.0 + i, f"s{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "u int, v int, key int, highway string, access string, oneway int, reversed int, length double, lanes double, maxspeed double, name string")
    out = im.impute_edges(df, rounds=3).orderBy("u").collect()
    assert [r["name"] for r in out] == [r[10] for r in rows]
    for r, src in zip(out, rows):
        if r["highway"] == "footway":
            assert r["lanes"] is None and r["maxspeed"] is None
        else:
            assert r["lanes"] >= 0 and r["maxspeed"] >= 0
            if src[8] is not None:
                assert r["lanes"] == src[8]
        assert r["access"] == "yes"


def test_routes(spark):
    e = spark.createDataFrame([(1, 2, 0, 5.0), (1, 2, 1, 2.0), (2, 3, 0, 2.0), (1, 3, 0, 9.0), (7, 8, 0, 1.0)], "u long, v long, key int, length double")
    pairs = spark.createDataFrame([(1, 3), (3, 3), (1, 8)], "source long, target long")
    got = {(r["source"], r["target"]): (r["dist"], r["path"]) for r in rt.shortest_paths(e, pairs).collect()}
    assert got == {(1, 3): (4.0, [1, 2, 3]), (3, 3): (0.0, [3]), (1, 8): (None, None)}


@pytest.mark.parametrize("placed", [False, True])
def test_search_over_cells(spark, monkeypatch, placed):
    """Random one-way networks in small cells against a plain search, with paths that leave a cell and come back."""
    rng = np.random.default_rng(12)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 170), rng.integers(0, 60, 170), rng.uniform(0, 9, 170))] + [(0, 1, None), (5, 5, 1.0)]
    nodes = spark.createDataFrame([(i, float(rng.uniform()), float(rng.uniform())) for i in range(55)], "osmid long, x double, y double") if placed else None
    e = spark.createDataFrame(edges, "u long, v long, length double")
    monkeypatch.setattr(rt, "CELL", 6)
    best = {s: {s: 0.0} for s in (0, 3, 99)}
    for own in best.values():
        for _ in range(60):
            for a, b, w in edges:
                if a in own and w is not None and own[a] + w < own.get(b, 1e9):
                    own[b] = own[a] + w
    pairs = spark.createDataFrame([(s, t) for s in best for t in (0, 7, 20, 59, 99, 1000)], "source long, target long")
    found = rt.search(rt.directed(e, "length"), pairs, None, nodes, 6)
    assert found.packed.count() > 9
    got = {(r["source"], r["node"]): r["dist"] for r in rt.distances(rt.directed(e, "length"), pairs, nodes).collect()}
    assert got == pytest.approx({(s, n): d for s, own in best.items() for n, d in own.items()})
    cost = {}
    for a, b, w in edges:
        if w is not None:
            cost[a, b] = min(w, cost.get((a, b), 1e9))
    for f in (rt.paths(rt.search(rt.directed(e, "length"), pairs, pairs, nodes, 6), pairs), rt.shortest_paths(e, pairs, one_way=True, nodes=nodes)):
        for r in f.collect():
            want = best[r["source"]].get(r["target"])
            assert (r["dist"] is None) == (want is None) == (r["path"] is None)
            if want is not None:
                assert r["path"][0] == r["source"] and r["path"][-1] == r["target"]
                assert r["dist"] == pytest.approx(want) == pytest.approx(sum(cost[x] for x in zip(r["path"], r["path"][1:])))


def test_rounds_follow_cells(spark, tmp_path, monkeypatch):
    """A chain of 161 nodes in cells of 40 takes 5 rounds, and each writes just the cell that is reached."""
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(160)], "u long, v long, length double")
    start = spark.createDataFrame([(0,)], "source long")
    monkeypatch.setattr(rt, "shared_folder", lambda _: str(tmp_path))
    found = rt.search(rt.directed(e, "length"), start, size=40)
    (folder,) = tmp_path.glob("search-*")
    written = [spark.read.schema(rt._STATE).parquet(str(p)).count() for p in sorted(folder.iterdir(), key=lambda p: int(p.name))]
    assert written == [1] * 5 + [0] and found.reached.count() == 5


def test_a_longer_chain_has_no_more_cells(spark):
    """Without a size the cells of a network keep their number, up to a bound on their nodes."""
    chain = lambda n: spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    cells = lambda n: rt.network_cells(chain(n), spark.range(1).select(F.col("id").alias("node"))).select("cell").distinct().count()
    assert cells(500) == 2 and cells(30_000) == cells(60_000) == rt.CELLS


def test_a_batch_of_cells_is_taken_row_by_row(spark, monkeypatch):
    """Rows that hold cells become Python objects one after the other, and results leave in small batches."""
    monkeypatch.setattr(rt, "BATCH", 1)
    arcs = pa.list_(pa.struct([("ua", pa.int32()), ("va", pa.int32()), ("weight", pa.float64())]))
    old = pa.struct([("dist", pa.list_(pa.float64())), ("prev", pa.list_(pa.int64())), ("prev_at", pa.list_(pa.int32()))])
    offers = pa.list_(pa.struct([("at", pa.int32()), ("dist", pa.float64()), ("prev", pa.int64())]))
    n = 5
    columns = {
        "source": pa.array(range(n), pa.int64()), "cell": pa.array([0] * n, pa.int64()), "round": pa.array([0] * n, pa.int32()), "old": pa.array([None] * n, old),
        "offers": pa.array([[{"at": 0, "dist": 1.0, "prev": None}]] * n, offers), "ids": pa.array([[7, 8]] * n, pa.list_(pa.int64())),
        "arcs": pa.array([[{"ua": 0, "va": 1, "weight": 2.0}]] * n, arcs), "border": pa.array([[1]] * n, pa.list_(pa.int32())),
    }
    got = list(rt._settle(iter([pa.RecordBatch.from_pydict(columns)])))
    assert [b.num_rows for b in got] == [1] * n
    assert got[0].to_pylist()[0]["dist"] == [1.0, 3.0] and got[0].to_pylist()[0]["changed"] == [{"at": 1, "dist": 3.0}]


def test_long_path_backtracking(spark):
    e = spark.createDataFrame([(i, i + 1, 0, 1.0) for i in range(20)], "u long, v long, key int, length double")
    pairs = spark.createDataFrame([(0, 20)], "source long, target long")
    assert rt.shortest_paths(e, pairs).first()["path"] == list(range(21))


def test_walk_forward_covers_test_rows_once(spark):
    df = spark.createDataFrame([(1, i) for i in range(53)], "k int, t int")
    f = sl.walk_forward(df, ["k"], ["t"], k=5).where("role = 'test'").groupBy("t").count()
    assert f.where("count > 1").count() == 0 and f.count() == 5 * (53 // 6)


def test_group_folds_keep_subjects_whole(spark):
    df = spark.createDataFrame([(s, i) for s in range(13) for i in range(3 + s * 5 % 17)], "subject_id int, i int")
    f = sl.group_folds(df, k=4)
    assert f.groupBy("subject_id").agg(F.count_distinct("fold").alias("n")).where("n <> 1").count() == 0
    assert f.count() == df.count() and f.select("fold").distinct().count() == 4


def test_route_segments_and_placement(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in [(9.0, 45.0), (9.01, 45.0), (9.01, 45.01), (9.0, 45.01), (9.0, 45.0)]]
    routes = spark.createDataFrame([(1, ring)], "route_id int, pts array<struct<x:double,y:double>>")
    b = [(9.002, 45.0), (9.006, 45.0), (9.01, 45.002), (9.01, 45.007), (9.005, 45.01), (9.0, 45.008), (9.0, 45.003)]
    breaks = spark.createDataFrame([(1, *p) for p in b] + [(1, *b[0])], "route_id int, x double, y double")
    seg = gm.route_segments(routes, breaks)
    rows = {r["location"]: r for r in seg.collect()}
    assert sorted(rows) == sorted(gm.PIECE_LABELS)
    total = sum((r["stop"] - r["start"]) % 0.04 for r in rows.values())
    assert total == pytest.approx(0.04)
    assert (rows["FG"]["pts"][0]["x"], rows["FG"]["pts"][-1]["x"]) == pytest.approx((9.0, 9.002))
    data = spark.createDataFrame([(1, i, "AB", 400.0 + i) for i in range(5)], "subject_id int, t int, location string, CO2 double")
    placed = gm.place_dynamic(data, seg, ["subject_id"], ["t"]).orderBy("t").collect()
    assert placed[0]["x"] == pytest.approx(rows["AB"]["pts"][0]["x"]) and placed[4]["y"] == pytest.approx(rows["AB"]["pts"][-1]["y"])
    again = gm.resample_dynamic(data, seg, ["subject_id"], ["t"], "CO2", 50.0).orderBy("i").collect()
    assert len(again) == int(math.floor(rows["AB"]["length_m"]) // 50) and again[0]["CO2"] == pytest.approx(400.0)


def test_null_rules():
    assert cl.null_rule("close2park_5") == 200.0 and cl.null_rule("average_nearby_num_lanes_50") == 0.0
    assert cl.null_rule("average_x") == "median_or_0.3" and cl.null_rule("sum_len") == 0.0
    assert cl.null_rule("humidity") == "median_or_0" and cl.null_rule("humidity", "app") == 0.0


def test_bad_options(spark):
    df = spark.createDataFrame([(1, "A")], "subject_id int, regime string")
    with pytest.raises(ValueError):
        cl.pick_rows(df, regime_name="nope")
    with pytest.raises(ValueError):
        mo.register_step("x")(lambda p: None) and mo.register_step("x")(lambda p: None)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_knn_on_features_in_small_blocks(sample, metric):
    df, x, y = sample
    rows = df.withColumn("id", F.monotonically_increasing_id()).cache()
    got = mo.knn_features(rows, rows.withColumnRenamed("id", "sid"), ["k"], "id", "sid", ["a", "b", "c", "d"], "y", 3, metric, block=16)
    got = {r["id"]: r["uniform"] for r in got.collect()}
    ids = [r["id"] for r in rows.orderBy("id").collect()]
    keyed = {r["id"]: (r["k"], np.array([r["a"], r["b"], r["c"], r["d"]]), r["y"]) for r in rows.collect()}
    norm = {"euclidean": lambda d: np.sqrt((d**2).sum()), "manhattan": lambda d: np.abs(d).sum(), "chebyshev": lambda d: np.abs(d).max()}[metric]
    assert len(got) == len(ids)
    for i in ids[:40]:
        k, v, _ = keyed[i]
        near = sorted((norm(v - w), j) for j, (kk, w, _) in keyed.items() if kk == k)[:3]
        assert got[i] == pytest.approx(np.mean([keyed[j][2] for _, j in near]))


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 1e6), (0.0, 1.5)])
def test_nearest_rows_measures_few_pairs(monkeypatch, scale, offset):
    """The matrix product leaves few pairs to measure, and copies, ties and far origins give what measuring all gives."""
    rng = np.random.default_rng(8)
    b = rng.normal(offset, scale, (900, 6))
    b[100:200] = b[:100]
    ids = rng.permutation(900)
    d = mo.distances(b[:400, None, :], b[None, :, :], "euclidean", 2.0)
    d[ids[:400, None] == ids[None, :]] = np.inf
    rows, cols = mo.best_of_block(d, ids, 4)
    real, seen = mo.distances, []
    monkeypatch.setattr(mo, "distances", lambda a, *rest: seen.append(len(a)) or real(a, *rest))
    got = mo.nearest_rows(b[:400], b, ids[:400], ids, 4, "euclidean", 2.0, True)
    assert got[0].tolist() == rows.tolist() and got[1].tolist() == cols.tolist() and got[2].tolist() == d[rows, cols].tolist()
    assert scale == 0.0 or sum(seen) < 0.05 * d.size


def test_fit_deals_out_large_parts(sample, monkeypatch):
    """A part with more rows than a task of a fit may hold is dealt out; the fit takes every row."""
    df, x, y = sample
    seen = []
    monkeypatch.setattr(mo, "FIT_ROWS", 20)
    from pyspark.ml import Pipeline

    real = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, rows: seen.append(rows) or real(self, rows))
    mo.forest_registry(df.coalesce(1), ["a", "b"], "y", "boosted", maxIter=1, maxDepth=1)
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == df.na.drop(subset=["a", "b", "y"]).count() and max(sizes) <= 20


def test_edge_points_are_dealt_out(spark):
    """The points of edges in one file part come from many tasks."""
    line = F.array(*[F.struct(F.lit(9.0 + i * 0.01).alias("x"), F.lit(45.0).alias("y")) for i in range(2)])
    edges = spark.range(400).coalesce(1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(0).alias("key"), line.alias("pts"))
    points = gm.edge_points(edges, 25.0, 45.0, carry=())
    assert points.groupBy("edge_id").count().where("count > 1").count() == 400
    assert points.select(F.spark_partition_id().alias("p")).distinct().count() > 4

"""Top-k search against all inner products."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumewalk.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, share int, score string, own string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, asked, k=10):
    def whole(v):
        v = [float(np.float32(x)) if x is not None else math.nan for x in v] if v is not None else [math.nan]
        return tuple(math.floor(1024 * x) for x in v) if all(map(math.isfinite, v)) else None

    sound = [(i, w) for i, v in rows if (w := whole(v)) is not None]
    out = Counter()
    for q, v in asked:
        if q is None or (w := whole(v)) is None:
            continue
        others = list(sound)
        if (q, w) in others:
            others.remove((q, w))
        scored = sorted((-sum(a * b for a, b in zip(w, u, strict=True)), i is None, i or 0) for i, u in others if len(u) == len(w))[:k]
        out.update((q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(scored, 1))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(900)]
    rows += [(5000 + i, rows[100][1]) for i in range(400)]  # copies of a query's vector
    rows += [(100, rows[100][1]), (200, rows[3][1]), (None, rows[100][1]), (None, rows[7][1])]  # repeated ids and rows, null ids
    rows += [(2000, None), (2100, [None] * 16), (2200, [math.nan] + [0.1] * 15), (2300, [math.inf] + [0.1] * 15), (2400, [0.0] * 16), (2500, []), (2501, []), (2600, [1.0, 2.0]), (2601, [3.0, -1.0])]
    return rows


def test_matches_all_products(spark, rows, monkeypatch):
    vectors = frame(spark, rows)
    asked = [(i, v) for i, v in rows if i is not None and i % 100 == 0]
    monkeypatch.setattr(topk, "BLOCK", 64)
    got = topk.top_k(vectors.repartition(5), vectors.where(F.col("vec_id") % 100 == 0))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == brute(rows, asked)
    few = frame(spark, rows[:5])
    assert Counter(map(tuple, topk.top_k(few, few).collect())) == brute(rows[:5], rows[:5])
    assert topk.top_k(vectors.limit(0), vectors).count() == 0 and topk.top_k(vectors, vectors.limit(0)).count() == 0


def test_query_on_a_folder(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(map(tuple, queries.op13_topk(spark, str(tmp_path)).collect()))
    assert got == brute(rows, [(i, v) for i, v in rows if i is not None and i % 100 == 0])


def lists_of(v):
    return np.argsort(-v, axis=0, kind="stable").T.astype(np.uint16)


def test_reading_stops_early():
    """On rows whose components agree the bound ends the search long before the block does."""
    rng = np.random.default_rng(2)
    v = (rng.pareto(1.5, (4000, 1)) * rng.uniform(0.8, 1.2, (4000, 6)) * 100).astype(np.int64)
    best = topk.Best(10)
    query = np.array([3, 1, 4, 1, 5, 9])
    scored = topk.read_lists(query, -1, v, lists_of(v), np.arange(4000), np.ones(4000, bool), best)
    want = sorted((-int(s), i) for i, s in enumerate(v @ query))[:10]
    assert [(-int(s), int(i)) for s, i in zip(best.score, best.id, strict=True)] == want and scored < 800
    assert topk.read_lists(query, -1, v // 1000, lists_of(v // 1000), np.arange(4000), np.ones(4000, bool), best) == 0


def test_large_components_stay_exact():
    rng = np.random.default_rng(4)
    for size in (10, 2**20, 2**28, 2**45):
        v, q = rng.integers(-size, size, (50, 8)), rng.integers(-size, size, 8)
        want = [max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(row, q, strict=True)))) for row in v]
        assert topk.product(v, q).tolist() == want
        best = topk.Best(5)
        topk.read_lists(q, -1, v, lists_of(v), np.arange(50), np.ones(50, bool), best)
        assert [(-int(s), int(i)) for s, i in zip(best.score, best.id, strict=True)] == sorted((-s, i) for i, s in enumerate(want))[:5]

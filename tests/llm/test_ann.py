import random

import numpy as np
import pytest

from threadloom.llm.ann import Coded, distances, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, x int, id string, r int, c int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "i", 2, 3, 0.5) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, ask, k):
    usable = [(i, [float(np.float32(a)) for a in v]) for i, v in rows if i is not None and v is not None and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    best: dict = {}
    for i, v in usable:
        if ask(i):
            best[i] = min(best.get(i, v), v)
    out = []
    for q, x in best.items():
        d: dict = {}
        for i, v in usable:
            if i != q and len(v) == len(x):
                s = float(distances(np.array(x), np.array([v]))[0])
                d[i] = min(d.get(i, s), s)
        out += [(q, n, i, s) for n, (s, i) in enumerate(sorted((s, i) for i, s in d.items())[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("bands", [64 << 20, 24 * 8 * 30])
def test_against_brute_force(spark, bands):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, list(rows[20][1])) for i in range(60)]  # one vector many times
    rows += [(400, None), (500, [0.0] * 8), (600, [1.0, None] + [0.0] * 6), (700, [float("nan")] * 8), (800, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (900, []), (1100, [1.0, 2.0]), (1200, [1.0, 2.5]), (20, rows[20][1]), (30, [9.0] * 8)]
    df = frame(spark, rows)
    got = nearest(df, df.where("vec_id % 20 = 0"), 10, band_bytes=bands).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, lambda i: i % 20 == 0, 10)


def test_few_and_none(spark):
    df = frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])])
    assert [tuple(r) for r in nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 1.0)]
    empty = frame(spark, [])
    assert nearest(empty, empty).count() == 0 and nearest(df, empty).count() == 0


def test_distances_beyond_doubles(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 1.0]), (3, [3.0, 1.0]), (4, [4.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in nearest(df, df.where("vec_id in (0, 3)")).orderBy("query_id", "rank").collect()]
    inf = float("inf")
    assert got == [(0, 1, 1.0), (0, 2, inf), (0, 3, inf), (0, 4, inf), (3, 4, 1.0), (3, 0, inf), (3, 1, inf), (3, 2, inf)]


def test_bounds_hold():
    r = np.random.default_rng(1)
    for scale in (1e-6, 1.0, 1e6):
        a, b = r.normal(size=(20, 1500)) * scale, r.normal(size=(30, 1500))
        low, high = Coded(a).bounds(Coded(b), slice(0, 20), slice(0, 30))
        true = ((a[:, None, :] - b[None]) ** 2).sum(axis=2)
        assert (low <= true).all() and (true <= high).all()

"""Exact search against brute force, with ties, repeats and vectors that take no part."""

import tracemalloc

import numpy as np

from textloom.llm import neighbours


def brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    out = []
    for q, (i, a) in enumerate(good):
        if i % 20 == 0:
            near = []
            for j, b in good:
                if j != i and len(a) == len(b):
                    s = 0.0
                    for x, y in zip(a.tolist(), b.tolist()):
                        s += x * y
                    near.append((-s, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(40)]  # ties
    rows += [(400, None), (420, []), (440, [0.0] * 16), (460, [float("nan")] * 16), (480, [1.0, None] * 8), (500, [float("inf")] + [1.0] * 15), (None, rows[0][1]), (520, [1.0] * 3), (521, [2.0] * 3), (700, [1e-30] * 16), (720, [1e20] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect())
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20)
    assert got == want


def test_bounds_hold_for_long_vectors():
    rng = np.random.default_rng(4)
    a, b = (neighbours.Tile(np.arange(30), (rng.normal(size=(30, 2500)) * 10.0 ** rng.integers(-3, 4, (30, 1))).astype(np.float32)) for _ in range(2))
    approx, err = neighbours.bounds(a, b)
    exact = a.v.astype(np.float64) @ b.v.astype(np.float64).T
    assert (np.abs(approx - exact) <= err).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, df).count() == 0


def test_very_large_and_very_small_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * 10.0 ** float(p)).tolist()) for i, p in enumerate(rng.choice([160, 153, 0, -160, -300], 120))]
    rows += [(200 + i, (rng.integers(-3, 4, 8) * 5e-324).tolist()) for i in range(40)]
    rows += [(300, [1e308] * 8), (301, [1e308, -1e308] * 4), (320, [1e-320, 1e300] * 4), (340, [1.0, 5e-324] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect())
    good = [(i, v) for i, v in rows if any(v)]
    want = []
    for i, a in good:
        if i % 20 == 0:
            near = []
            for j, b in good:
                if j != i:
                    s = 0.0
                    for x, y in zip(a, b):
                        s += x * y
                    near.append((0, 0.0, j, s) if s != s else (1, -s, j, s))  # what isn't a number comes first
            want += [(i, r + 1, j, s) for r, (_, _, j, s) in enumerate(sorted(near, key=lambda x: x[:3])[:20])]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=lambda x: x[:2])]
    assert all(g[3] == w[3] or (g[3] != g[3] and w[3] != w[3]) for g, w in zip(got, sorted(want, key=lambda x: x[:2])))


def test_cells_of_many_blocks_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i % 290, rng.normal(size=12).astype(np.float32).tolist(), i, "x") for i in range(300)]
    rows += [(7, rows[7][1], 1, "y")] * 200  # a hot id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, tag int, cell string").repartition(4)
    asked = df.where("vec_id % 20 = 0")
    one = sorted(tuple(r) for r in neighbours.nearest(df, asked).collect())
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 500)
    assert sorted(tuple(r) for r in neighbours.nearest(df, asked).collect()) == one and len(one) >= 300


def peak_mb(queries, candidates, k=20):
    own, other, best = neighbours.Tile(np.arange(len(queries)) + 10**6, queries), neighbours.Tile(np.arange(len(candidates)), candidates), neighbours.Best(len(queries), k)
    tracemalloc.start()
    neighbours.search(own, other, best, np.arange(len(queries)))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return peak, best


def test_memory_does_not_grow_with_the_queries_of_a_block():
    rng = np.random.default_rng(7)
    peak, _ = peak_mb(rng.normal(size=(6000, 16)).astype(np.float32), rng.normal(size=(5000, 16)).astype(np.float32))
    assert peak < 150


def test_memory_does_not_grow_with_the_ties_of_long_vectors():
    rng = np.random.default_rng(8)
    candidates = rng.choice([-1.0, 1.0], (1500, 512)).astype(np.float32)
    candidates[:, 0] = 1  # all products are 1
    queries = np.zeros((100, 512), np.float32)
    queries[:, 0] = 1
    peak, best = peak_mb(queries, candidates)
    assert peak < 150
    out = [tuple(x) for b in neighbours._found(type("Block", (), {"n": 100, "tags": np.arange(100), "ids": np.arange(100)}), best) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(out) == [(q, q, i, 1.0) for q in range(100) for i in range(20)]


def test_large_groups_of_copies_in_rounds_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(100)]
    rows += [(i, [2.0] * 8) for i in range(100, 260)]  # copies
    rows += [(120, [2.0] * 8)] * 60 + [(119, [2.0] * 8)] * 30  # of one id more than are asked for
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(2)
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 20)
    assert sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()) == want
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 8000)
    assert sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()) == want

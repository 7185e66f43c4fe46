from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.llm import neighbours


def brute(rows, k=10, is_query=lambda i: i % 100 == 0):
    good = [(i, np.array(x, dtype=np.float64)) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    out = []
    for q in sorted({i for i, _ in good if is_query(i)}):
        least = {}
        for i, x in good:
            for c, y in good if i == q else ():
                if c != q and len(y) == len(x):
                    d = float(np.sqrt(((x - y) ** 2).sum()))
                    least[c] = min(d, least.get(c, d))
        near = sorted((d, c) for c, d in least.items())[:k]
        out += [(q, n, c, pytest.approx(d)) for n, (d, c) in enumerate(near, 1)]
    return sorted(out, key=lambda r: r[:2])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("x", F.lit(1))


def random_rows(n=700, width=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[50:120] = x[50]  # ties
    x[200:230] *= 1000
    x[300:330] *= 1e-4
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(800, None), (801, []), (802, [0.0] * width), (803, [float("nan")] * width), (804, [float("inf")] + [1.0] * (width - 1)), (805, [None] + [1.0] * (width - 1)), (None, [1.0] * width), (900, [1.0, 2.0]), (901, [1.0, 3.0])]
    return rows


@pytest.mark.parametrize("tile", [37, 4096])
def test_exact_against_brute_force(spark, tile):
    rows = random_rows()
    out = neighbours.nearest(vectors(spark, rows), tile_rows=tile, tile_queries=max(2, tile // 10))
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2]) == brute(rows)


def test_fewer_candidates_than_k_and_other_queries(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)]
    got = neighbours.nearest(vectors(spark, rows), queries=F.col("vec_id") > 3).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == brute(rows, is_query=lambda i: i > 3)
    assert neighbours.nearest(vectors(spark, rows).limit(0)).collect() == []
    assert neighbours.nearest(vectors(spark, rows), queries=F.lit(None).cast("boolean")).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (1e-3, 1.0, 1e4):
        a, b = rng.normal(size=(20, 1500)) * scale, rng.normal(size=(30, 1500)) * scale
        low, high = neighbours.tile_distances(a, b)
        true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
        assert (low <= true).all() and (true <= high).all()
        assert (high - low).max() < 0.1 * true.max()


@pytest.mark.parametrize("tile", [16, 4096])
def test_repeated_ids_are_one_query_and_one_candidate(spark, tile):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(150)]
    rows += [rows[0], rows[0], rows[100], rows[7], rows[7]]  # repeated as they are
    rows += [(100, [0.5, 0.5, 0.0, 0.0]), (100, [1.0, 2.0])]  # queries with several vectors
    rows += [(9, (np.array(rows[0][1]) + 0.01 * j).tolist()) for j in range(20)] + [(300, [3.0, 4.0])]
    out = sorted((tuple(r) for r in neighbours.nearest(vectors(spark, rows), tile_rows=tile, tile_queries=2).collect()), key=lambda r: r[:2])
    assert out == brute(rows)
    assert all(len({r[2] for r in out if r[0] == q}) == 10 for q in (0, 100))


def test_heap_keeps_the_nearest_of_each_id():
    heap, held = [], {}
    for d, c in [(5.0, 1), (4.0, 2), (3.0, 1), (9.0, 3), (2.0, 3), (3.0, 0), (6.0, 2)]:
        neighbours.offer(heap, held, 3, d, c)
    assert sorted((-d, -c) for d, c in heap) == [(2.0, 3), (3.0, 0), (3.0, 1)] and held == {3: 2.0, 0: 3.0, 1: 3.0}

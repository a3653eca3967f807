from __future__ import annotations

import math

import numpy as np
import pytest

from hourvault.llm import voronoi


def expected(rows, k=10, every=100):
    kept = []
    for key, vector in rows:
        if key is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, [math.floor(1024 * x) for x in vector]))
    out = []
    for i, (key, q) in enumerate(kept):
        if key % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), other) for j, (other, v) in enumerate(kept) if j != i)
        out += [(key, rank, other, -s) for rank, (s, other) in enumerate(scored[:k], 1)]
    return sorted(out)


def result(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(k, v, 0, 1) for k, v in rows], "vec_id long, embedding array<float>, cell int, distance int").repartition(parts)
    return sorted(map(tuple, voronoi.top_inner_products(df, **options).collect()))


def as_float(rows):
    return [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]


def clustered(seed, n=600, dim=8):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, dim))
    return [(int(i * 10), (centres[i % 6] + 0.1 * random.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_scores_are_those_of_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(voronoi, "CELL_ROWS", 40)
    monkeypatch.setattr(voronoi, "GROUP_ROWS", 8)
    monkeypatch.setattr(voronoi, "DATA_CHUNK", 30)
    monkeypatch.setattr(voronoi, "QUERY_CHUNK", 4)
    rows = as_float(clustered(seed))
    assert result(spark, rows) == expected(rows)


def test_far_cells_are_not_replicated():
    import pandas as pd

    cells = pd.DataFrame({"far": [1.0, 1.0], "near": [0.0, 0.0], "smallest": [[0.1] * 11, [0.1] * 11]})
    groups = pd.DataFrame({"far": [0.5]})
    bound = voronoi._bounds(groups, cells, np.array([[0.0, 100.0]]), 10)
    assert bound[0] == pytest.approx(0.6)


def test_ties_repeats_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(1, 60)] + [
        (100, [1.0, 2.0]), (100, [1.0, 2.0]), (200, [0.0, 0.0]), (300, None), (400, [1.0, None]), (500, [float("nan"), 1.0]),
        (600, [float("inf"), 1.0]), (700, [3.0]), (800, []), (None, [9.0, 9.0]), (900, [-1.0, -2.0, 0.5]), (1, [5.0, 5.0]),
    ]
    assert result(spark, rows) == expected(rows)


def test_large_components_are_exact(spark):
    rows = as_float([(i, [(i * 7919 % 101) * 1e4 + 0.5, -(i % 13) * 3e4]) for i in range(0, 400, 4)])
    assert result(spark, rows) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0])], [(1, [1.0]), (2, [2.0])], [(100, [1.0]), (2, [2.0])], [(100, None)]])
def test_few_rows(spark, rows):
    assert result(spark, rows) == expected(rows)

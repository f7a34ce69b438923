from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import inner_product
from attest.llm.inner_product import LIMIT, Tile, top_products
from attest.llm.queries import op11_topk

SCHEMA = "vec_id long, embedding array<float>, label int, tile string"


def brute(rows: list[tuple], k: int = 5, every: int = 50) -> list[tuple]:
    usable = [(i, r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for at, query, q in usable:
        if query is None or query % every:
            continue
        scored = [(max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(q, v)))), vec) for i, vec, v in usable if i != at]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(query, rank, vec, score) for rank, (score, vec) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, tmp_path):
    at = str(tmp_path / "sf")
    spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    out = op11_topk(spark, at)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


def test_odd_vectors(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (50, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [3.0]), (100, [-1.0, -2.0, 5.0]), (None, [9.0, 9.0]), (8, [-0.001, 0.001])]
    rows += [(100, [-1.0, -2.0, 5.0]), (9, [-3.0, -4.0]), (10, [-3.0, -4.0]), (150, [1.0] * 2000), (200, [3e37, -1.0]), (11, [3e37, 1.0])]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_few_and_none(spark, tmp_path):
    assert found(spark, [(0, [1.0]), (1, [2.0])], tmp_path / "a") == [(0, 1, 1, 131072)]
    assert found(spark, [(0, [1.0])], tmp_path / "b") == []
    assert found(spark, [], tmp_path / "c") == []


@pytest.mark.parametrize("shape", ["clusters", "lengths", "ties"])
def test_equals_brute_force(spark, tmp_path, monkeypatch, shape):
    """Small buckets, so that several tiles and buckets take part; a third of the rows are one vector."""
    monkeypatch.setattr(inner_product, "BUCKET", 32)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 8))
    if shape == "clusters":
        v = v[rng.integers(0, 12, 900)] + 0.05 * v
        v[:300] = v[0]
    elif shape == "lengths":
        v *= rng.lognormal(0, 1.5, size=(900, 1))
    else:
        v = rng.integers(-1, 2, size=(900, 8)) / 256
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v.astype(np.float32))]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_each_way_of_pruning_is_taken_and_loses_nothing():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 16))
    v = np.floor(256 * (centres[rng.integers(0, 6, 3000)] + 0.1 * rng.normal(size=(3000, 16))) * rng.lognormal(0, 1, size=(3000, 1)))
    v = v[np.argsort(-(v**2).sum(axis=1))]
    queries = v[::60]
    tile = Tile(v, np.arange(3000), np.arange(3000))
    scores = queries @ v.T
    kth = np.sort(scores, axis=1)[:, -5]
    for least in (np.zeros(50), kth * 0.9, kth):
        got = tile.best(queries, np.full(50, -1), least, 5)
        for i, xs in enumerate(got):
            want = sorted(((int(s), j, j) for j, s in enumerate(scores[i])), key=lambda x: (-x[0], x[1]))[:5]
            assert xs == want
    assert all(tile.used.values())


def test_coordinate_bounds_keep_all_that_reach_the_cosine():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 4))
    v = v[np.argsort(-(v**2).sum(axis=1))]
    tile = Tile(v, np.arange(500), np.arange(500))
    for q in [*rng.normal(size=(60, 4)), np.array([1.0, 0, 0, 0]), np.array([0, -1.0, 0, 0])]:
        unit = q / np.linalg.norm(q)
        for least in (0.5, 0.7, 0.95, 0.999):
            assert set(np.flatnonzero(tile.units @ unit >= least)) <= set(tile.reaches(0, unit, least))


def test_interface_with_other_k(spark):
    df = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    out = top_products(df, F.col("vec_id") == 3, k=2, scale=1).collect()
    assert [tuple(r) for r in sorted(out, key=lambda r: r["rank"])] == [(3, 1, 39, 118), (3, 2, 38, 115)]

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import topk

KINDS = "vec_id long, embedding array<double>"


def brute(rows, k, every=100):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(own):
        if q is not None and math.fmod(q, every) == 0:
            hits = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(s * t for s, t in zip(x, y)))), c is None, c or 0) for b, (c, y) in enumerate(own) if a != b)[:k]
            out += [(q, n, None if null else c, -s) for n, (s, null, c) in enumerate(hits, 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "ASKS", 3)
    monkeypatch.setattr(topk, "STEP", 4)


def clusters(n=300, seed=2):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    return [(i, [x + r.gauss(0, 0.05) for x in r.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("cells", [1, 3, 4096])
def test_clusters(spark, small_blocks, monkeypatch, cells):
    monkeypatch.setattr(topk, "CELLS", cells)
    rows = clusters()
    assert result(topk.top_products(spark.createDataFrame(rows, KINDS), k=4, every=10, pivots=5)) == brute(rows, 4, 10)


def test_odd_vectors(spark, small_blocks):
    rows = clusters(90) + [(100, None), (200, []), (300, [float("nan")]), (400, [1.0, None]), (500, [float("inf")]), (600, [0.5]), (None, [1.0, 2.0]), (-100, [0.0] * 6), (0, [1.0] * 9), (0, [1.0] * 9)]
    assert result(topk.top_products(spark.createDataFrame(rows, KINDS), k=3)) == brute(rows, 3)


def test_a_third_of_the_rows_are_one_vector(spark, small_blocks):
    rows = clusters(100) + [(i, [1.0, -0.5, 0.25, 0.0, 0.0, 1.0]) for i in range(100, 200)]
    assert result(topk.top_products(spark.createDataFrame(rows, KINDS).repartition(5), k=10, every=5)) == brute(rows, 10, 5)


def test_large_components(spark):
    rows = [(0, [3e9, 1e12]), (1, [3e9, -1e12]), (2, [2e9 + 0.5, 1.0]), (100, [1e30, 1.0])]
    assert result(topk.top_products(spark.createDataFrame(rows, KINDS), k=2)) == brute(rows, 2)


def test_empty_no_queries_and_clashing(spark):
    assert result(topk.top_products(spark.createDataFrame([], KINDS))) == []
    assert result(topk.top_products(spark.createDataFrame([(1, [1.0])], KINDS))) == []
    assert result(topk.top_products(spark.createDataFrame([(100, [1.0])], KINDS))) == []
    rows = clusters(30)
    odd = spark.createDataFrame(rows, KINDS).withColumns({x: F.lit("z") for x in ("row", "x", "v", "block", "q", "score", "rank")})
    assert result(topk.top_products(odd, k=2)) == brute(rows, 2)


def test_bounds_eliminate(spark, monkeypatch):
    x = spark.createDataFrame(clusters(400), KINDS).select("vec_id", F.col("embedding").alias("x"))
    placed = topk.located(x, topk.pivots_of(x, 5, 100, 1024.0), 1024.0).toArrow()
    block, rounds, best = topk.Block([placed], 5), [], topk.Block.best
    monkeypatch.setattr(topk, "STEP", 16)
    monkeypatch.setattr(topk.Block, "best", lambda self, *x: rounds.append(1) or best(self, *x))
    q = 17
    block.search(placed["row"][q].as_py(), placed["v"][q].values.to_numpy(), placed["n2"][q].as_py(), placed["dist"][q].values.to_numpy(), float("-inf"))
    assert 0 < 16 * len(rounds) < 200

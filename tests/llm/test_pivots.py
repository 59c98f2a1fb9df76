import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.llm import pivots

KIND = "vec_id long, embedding array<float>, rank int, block array<int>"
LONG = (1 << 63) - 1


def brute(rows, k):
    """All pairs with Python's integers; (query_id, rank, vec_id, score)."""
    usable = [(i, [math.floor(64.0 * float(np.float32(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (query, q) in enumerate(usable):
        if query % 20 == 0:
            scores = sorted((-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(q, v)))), i) for m, (i, v) in enumerate(usable) if m != n)
            out += [(query, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k, **sizes):
    frame = spark.createDataFrame([(i, v, 9, [1]) for i, v in rows], KIND).repartition(3)
    got = pivots.top_k(frame, F.col("vec_id") % 20 == 0, k, **sizes)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("sizes", [{}, {"pivots": 3, "candidates": 16, "queries": 2}])
def test_same_as_brute_force(spark, sizes):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 330)]  # equal vectors: ties by id
    rows += [(20, rows[20][1]), (20, [0.1] * 6), (40, rows[40][1]), (40, rows[40][1])]  # repeated ids and rows
    rows += [(400, None), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (440, [math.nan] * 6), (460, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (480, []), (500, [2.0, -1.0])]
    assert found(spark, rows, 7, **sizes) == brute(rows, 7)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(i, [3e8 + 64.0 * i, 1.0 * i]) for i in range(0, 45, 5)] + [(60, [3e38, 1.0]), (61, [-3e38, 2.0])]
    assert found(spark, rows, 4) == brute(rows, 4)


def test_few_and_no_rows(spark):
    assert found(spark, [(0, [1.0]), (1, [2.0])], 20) == [(0, 1, 1, 64 * 128)]
    assert found(spark, [(0, [1.0])], 20) == found(spark, [], 20) == found(spark, [(0, None), (20, [math.nan])], 20) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])], 20) == []


def test_bounds_spare_work():
    """Of clustered rows, a query evaluates few outside its cluster."""
    rng = np.random.default_rng(2)
    vectors = np.floor(64 * np.concatenate([rng.normal(5 * np.eye(8)[c], 0.05, (200, 8)) for c in range(8)]))
    chosen = pivots.choose_pivots(vectors, 16)
    table = pivots.distances(vectors, chosen)
    block = lambda rows: pivots.Block(np.array(rows, np.int64).tobytes(), vectors[rows].tobytes(), table[rows].tobytes())
    evaluated = []
    inner, pivots.inner_products = pivots.inner_products, lambda v, *rest: (evaluated.append(len(v)), inner(v, *rest))[1]
    try:
        best = {q: scores for q, _, scores in pivots.eliminate(block([0, 300]), block(list(range(1600))), np.full(2, -np.inf), 10)}
    finally:
        pivots.inner_products = inner
    assert all((best[i] == np.sort(vectors @ vectors[q])[::-1][:10]).all() for i, q in enumerate((0, 300)))
    assert sum(evaluated) < 2 * 800

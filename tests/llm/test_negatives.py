import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquant.llm import negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, id long, rank int, q string"


def brute(rows, every=50, positives=5, wanted=3):
    """All anchors against all rows, with Python's whole numbers."""
    seen = set()
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        seen.add((i, tuple(math.floor(256 * x) for x in v), label))
    out = set()
    for i, v, label in seen:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in seen if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out |= {(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits[:wanted], 1)}
    return out


def result(df):
    return {tuple(r) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], SCHEMA)


def mined(df, every=50):
    return result(negatives.mine(df, F.col("vec_id") % every == 0))


@pytest.mark.parametrize("tile, size, step", [(40, 6, 0.01), (700, 64, 0.05), (150, 3, 0.3)])
def test_against_all_pairs(spark, monkeypatch, tile, size, step):
    monkeypatch.setattr(negatives, "TILE", tile)
    rng = np.random.default_rng(tile)
    centre = rng.normal(size=(8, size))
    # Rounded vectors, so that scores tie and rows repeat.
    v = np.round((centre[rng.integers(0, 8, 600)] + rng.normal(size=(600, size)) * 0.3) / step) * step
    rows = [(i, v[i].tolist(), int(rng.integers(0, 5))) for i in range(600)]
    rows += [(600 + i, v[7].tolist(), i % 2) for i in range(200)]  # many copies of one vector, anchors among them
    rows += rows[:30]
    want = brute(rows, 25)
    assert len(want) > 100
    assert mined(frame(spark, rows).repartition(6), 25) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 1.0], 1), (1, None, 1), (2, [], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 2.0], None), (8, [1e307, 1.0], 1),
            (0, [1.0, 0.5], 1), (50, [1.0, 0.5], 2), (100, [3.0], 1), (101, [2.0], 1), (102, [1.5], 2), (9, [1.0, 0.4], 1), (10, [0.7, 0.4], 2), (11, [-1.0, 0.0], 2),
            (12, [0.0, 0.0], 1), (13, [0.0, 0.0], 3), (150, [0.0, 0.0], 1), (0, [0.2, 0.1], 1)]
    want = brute(rows)
    assert want
    assert mined(frame(spark, rows)) == want
    assert mined(frame(spark, rows).limit(0)) == set()


def test_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 3e5 + rng.integers(0, 2, 3) * 4e6).tolist(), i % 3) for i in range(150)]
    want = brute(rows)
    assert max(r[4] for r in want) > 2**53
    assert mined(frame(spark, rows)) == want


def test_boxes_bound_the_scores():
    rng = np.random.default_rng(5)
    q, queries = rng.integers(-50, 50, (300, 5)).astype(float), rng.integers(-50, 50, (20, 5)).astype(float)
    tile = negatives.Tile(np.arange(300).tobytes(), np.zeros(300, np.int64).tobytes(), False, q.astype(np.int16).tobytes(), 5)
    low, high = negatives.intervals(tile.low, tile.high, queries)
    for leaf, (a, b) in enumerate(zip(tile.first, tile.last)):
        score = queries @ q[a:b].T
        assert (low[:, leaf] <= score.min(1)).all() and (score.max(1) <= high[:, leaf]).all()


def test_op11_on_the_table(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        label = r["label"] if r["label"] is None or r["vec_id"] % 7 else (r["label"] + 1) % 10
        rows.append((r["vec_id"], r["embedding"], label))
    assert result(queries.op11(spark, SF)) == brute(rows)

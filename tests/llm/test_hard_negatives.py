"""Mined negatives against a plain sort of all scores."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from mediacat.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=10, positives=5, k=10, low=30, high=90):
    ok = [(no, i, y, [math.floor(256 * x) for x in v]) for no, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0, r[2])
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    for no, i, y, v in ok:
        if i is None or i % every:
            continue
        scored = [(hold(sum(a * b for a, b in zip(v, w, strict=True))), j, m, z) for m, j, z, w in ok if m != no and len(w) == len(v)]
        for p, pid, _, _ in sorted((r for r in scored if r[3] == y), key=order)[:positives]:
            near = sorted((r for r in scored if r[3] != y and low * p <= 100 * r[0] <= high * p), key=order)[:k]
            out += [(i, pid, rank, n[1], p, n[0]) for rank, n in enumerate(near, 1)]
    return sorted(out, key=str)


def result(spark, rows, every=10, schema=SCHEMA, **how):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(map(tuple, H.hard_negatives(df, F.expr(f"vec_id % {every} = 0"), **how).collect()), key=str)


def vectors(seed, n, dim=6, labels=3):
    rng = random.Random(seed)
    shared = [rng.gauss(0, 1) for _ in range(dim)]
    return [(k, shared if k % 3 == 0 else [rng.gauss(0.3, 1) for _ in range(dim)], rng.randrange(labels)) for k in range(n)]


def test_equals_plain_sort(spark):
    rows = vectors(1, 300)
    want = plain(rows)
    assert len(want) > 500 and result(spark, rows) == want
    assert result(spark, rows, positives=2, k=3, low=50, high=70) == plain(rows, positives=2, k=3, low=50, high=70)


def test_many_blocks_and_batches(spark, monkeypatch):
    """Small blocks and batches; what tasks hold at once follows from the blocks' rows."""
    monkeypatch.setattr(H, "BLOCK_NUMBERS", 640)
    monkeypatch.setattr(H, "BATCH", 4)
    rows = vectors(2, 500)
    assert result(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [
    [],
    [(0, [1.0, 2.0], 1)],
    [(0, [1.0], 1), (0, [1.0], 1), (10, [0.5], 2), (10, [0.5], 2), (None, [0.5], 2), (None, [1.0], 1), (20, [1.0], 1)],
    [(0, None, 1), (10, [1.0], None), (20, [None, 1.0], 1), (30, [float("nan")], 1), (40, [float("inf")], 1), (50, [], 1), (60, [], 1), (61, [], 2)],
    [(0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [2.0], 2), (3, [1.0, 0.0], 1), (4, [0.5, 9.0], 2), (5, [-1.0, 0.0], 1), (6, [0.0, 1.0], 2)],
    [(k, [1e12, 3e11 + k], k % 2) for k in range(12)] + [(12, [1e308, 1e300], 0), (13, [1.7e308], 0)],
    [(k, [3e5 * (k + 1), 1.0], k % 3) for k in range(20)],
    [(k, [float(k % 4)] * 3, k % 2) for k in range(40)],
])
def test_small_cases(spark, rows):
    assert result(spark, rows) == plain(rows)


def test_clashing_names_and_floats(spark):
    rows = [(k, [0.25 * k, 1.0], k % 3, k, "x") for k in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<float>, y long, row int, score string")
    got = sorted(map(tuple, H.hard_negatives(df, F.col("id") % 10 == 0, "id", "y", "v").collect()), key=str)
    assert got == plain([r[:3] for r in rows])


def test_limits_round_inwards():
    assert H.limits(7, 30, 90) == (3, 6) and H.limits(-7, 30, 90) == (-2, -7) and H.limits(0, 30, 90) == (0, 0)
    assert H.limits(2**62, 30, 90) == (-(-30 * 2**62 // 100), 90 * 2**62 // 100)

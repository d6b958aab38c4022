"""Hard negatives against every anchor compared with every row."""

import math
import random

import numpy as np
import pytest
from lectern.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score int, V string"


def plain(rows):
    """The contract, by list position."""
    big = float("inf")
    live = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        live.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for a, (i, label, v) in enumerate(live):
        if i is None or i % 100:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, _, w) in enumerate(live) if b != a and len(w) == len(v)}
        order = sorted(score, key=lambda b: (-score[b], live[b][0] if live[b][0] is not None else big))
        for p in [b for b in order if live[b][1] == label][:5]:
            fit = [b for b in order if live[b][1] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out += [(i, live[p][0], k + 1, live[b][0], score[p], score[b]) for k, b in enumerate(fit)]
    return sorted(out, key=str)


def compare(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in H.mine(df, **options).collect()), key=str)
    assert got == plain(rows)
    return got


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return [(int(k), [float(x) for x in centres[k % 12] + rng.normal(size=d) * 0.3], int(rng.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 8, "shard_rows": 40, "anchors": 3}, {"shard_rows": 7, "most_codes": 3}])
def test_against_all_pairs(spark, options):
    assert compare(spark, clustered(900, 6, 1), **options)


def test_random_directions(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(16)], rng.randrange(3)) for k in range(-300, 400)]
    assert compare(spark, rows, cell_rows=16, shard_rows=100)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = clustered(400, 4, 3)
    hot = [0.5, 0.25, -0.5, 1.0]
    rows += [(1000 + k % 130, hot, k % 2) for k in range(260)] + [(100, hot, 1)] * 3 + [(1100, hot, 0)] * 2
    rows += [(None, hot, 0), (None, hot, 1), (None, None, 1), (5, None, 1), (200, hot, None), (300, [1.0, None, 0.0, 0.0], 1), (400, [float("nan")] * 4, 1), (500, [float("inf"), 0.0, 0.0, 0.0], 2)]
    rows += [(600, [], 1), (601, [], 2), (602, [], 1), (700, [1.0, 2.0], 3), (701, [1.0, 2.0], 3), (703, [1.0, 1.5], 4), (800, [0.0] * 4, 2), (801, [0.0] * 4, 2), (802, [0.0] * 4, 1), (-100, [-1.0, 0.5, 0.0, 2.0], -3)]
    rng.shuffle(rows)
    assert compare(spark, rows, shard_rows=50, cell_rows=20)


def test_large_components(spark):
    rows = [(k, [float((k * 7919) % 1000) * 100.0, float((k * 104729) % 997) * 250.0, 3.0], k % 3) for k in range(300)]
    assert compare(spark, rows)


def test_empty(spark):
    assert H.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert compare(spark, [(100, [1.0], 1)]) == []


def test_visits_in_order_of_the_sum():
    rng = np.random.default_rng(4)
    u, w = rng.normal(size=9), rng.normal(size=7)
    got = list(H.visit(u, w))
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(9) for j in range(7)]
    assert [b for b, _, _ in got] == sorted((b for b, _, _ in got), reverse=True)
    assert all(b == pytest.approx(u[i] + w[j]) for b, i, j in got)


def test_clusters_prune(spark):
    """Most cells are not visited where rows lie in clusters."""
    rows = clustered(3000, 8, 9)
    df = H.scaled(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    coded, shared = H.build(df, 4096, 8, 64, 10**9)
    plan = H.Plan(shared.value)
    shard = H.Shard(coded.toArrow(), plan)
    seen = []
    shard.scores = lambda q, a, z, f=shard.scores: (seen.append(z - a), f(q, a, z))[1]
    v = H.matrix(df.where("vec_id % 100 = 0").toArrow().column("v").combine_chunks(), plan.width)
    for q in v:
        shard.best(q, 8, 1, True, [(2**62, -2**62)], 6)
    assert sum(seen) < 0.35 * len(rows) * len(v)

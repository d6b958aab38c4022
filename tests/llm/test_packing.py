import random
from itertools import combinations

import pytest
from lectern.llm.packing import best_borders, pack


def padding(histogram, borders):
    return sum(c * (min(b for b in borders if b >= n) - n) for n, c in histogram.items())


@pytest.mark.parametrize("seed", range(6))
def test_borders_are_optimal(seed):
    r = random.Random(seed)
    h = {n: r.randint(1, 50) for n in r.sample(range(0, 60), 11)}
    for k in (1, 2, 3, 4):
        best = min(padding(h, [*c, max(h)]) for c in combinations(sorted(h)[:-1], k - 1))
        got = best_borders(h, k)
        assert len(got) == k and padding(h, got) == best


def test_batches_keep_every_word_within_budget(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(0, 400))) for i in range(600)] + [(i, "a b c") for i in range(600, 1200)] + [(2000, None), (2001, " "), (2002, "z " * 5000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), buckets=4, token_budget=2000, max_tokens=1000).collect()
    n = {}
    for x in got:
        n[x.doc_id] = n.get(x.doc_id, 0) + x.n_tokens
        assert 0 <= x.padding == x.border - x.n_tokens
    assert n == {i: len((t or "").split()) for i, t in rows}
    batches = {}
    for x in got:
        batches.setdefault((x.bucket, x.batch), []).append(x.slot)
    for k in {b for b, _ in batches}:
        ids = sorted(b for c, b in batches if c == k)
        border = next(x.border for x in got if x.bucket == k)
        assert ids == list(range(len(ids)))
        assert all(sorted(batches[k, b]) == list(range(len(batches[k, b]))) for b in ids)
        assert all(len(batches[k, b]) == 2000 // max(border, 1) for b in ids[:-1])
        assert all(len(batches[k, b]) * border <= 2000 for b in ids)
    again = pack(spark.createDataFrame(rows[::-1], "doc_id long, text string"), buckets=4, token_budget=2000, max_tokens=1000).collect()
    assert sorted(again) == sorted(got)


def test_odd_tables(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, batch int")).collect() == []
    got = pack(spark.createDataFrame([(None, None, 1), (None, None, 1), (1, "a", 2)], "doc_id long, text string, n_tokens int")).collect()
    assert sorted((x.doc_id or 0, x.n_tokens, x.padding) for x in got) == [(0, 0, 0), (0, 0, 0), (1, 1, 0)]

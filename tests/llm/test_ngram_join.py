import random
import re

import pytest
from lectern.llm.ngram_join import keep_one, ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=5, percent=80):
    def grams(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    sets = {i: grams(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < .5:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
        elif kind < .65:
            w = passage + [r.choice(words) for _ in range(r.randint(0, 25))]
        else:
            w = [r.choice(words) for _ in range(r.choice([1, 2, 4, 5, 6, 40, 90]))]
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "A b C"), (n + 4, "a B c"), (n + 5, "a b\x0bc")]


@pytest.mark.parametrize("seed,block", [(1, 2_000_000), (2, 300), (3, 900), (4, 120)])
def test_components_match_brute_force(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df, parts=4, block_tokens=block).collect()}
    assert got == brute(rows)


def test_two_hops(spark):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df, parts=7, parts_at_once=4, held_entries=500).collect()}
    assert got == brute(rows)


def by_rows(rows):
    """brute over row numbers, then named by ids: sorted (doc_id, n, component) of all rows."""
    found, low = brute(list(enumerate(t for _, t in rows))), {}
    for k, (i, _) in enumerate(rows):
        c = found[k][1]
        if i is not None and found[k][0]:
            low[c] = min(low.get(c, i), i)
    return sorted((repr(i), found[k][0], repr(low.get(found[k][1]) if found[k][0] else i)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [11, 12])
def test_ids_that_repeat_or_are_null(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, 1, 2, 3, *range(10, 60)]), t) for _, t in corpus(seed)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((repr(x.doc_id), x.n_shingles, repr(x.component_id)) for x in ngram_components(df, parts=4).collect())
    assert got == by_rows(rows)
    found = brute(list(enumerate(t for _, t in rows)))
    kept = keep_one(df, parts=4).collect()
    assert len(kept) == len({c for n, c in found.values() if n}) + sum(n == 0 for n, _ in found.values())
    group = {}
    for k, (i, t) in enumerate(rows):
        group[t] = found[k][1]
    assert len({group[x.text] for x in kept if brute([(0, x.text)])[0][0]}) == len({c for n, c in found.values() if n})


@pytest.mark.parametrize("hops", [64, 3])
def test_ngrams_that_every_document_has(spark, hops):
    passage = " ".join(f"licence{k}" for k in range(12))
    rows = [(i, f"{t or ''} {passage}") for i, t in corpus(21)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           ngram_components(df, parts=6, held_entries=700, heavy_entries=20, parts_at_once=hops).collect()}
    assert got == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(empty).collect() == []
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "x " * 30000, "b"), (3, "x " * 30000 + "y", "c"), (None, "p q", "d"), (7, "P q", "d")],
                               "doc_id long, text string, n long" .replace("n long", "n string"))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_components(df).collect())
    assert got == [(0, 1, 7), (1, 0, 1), (1, 0, 1), (2, 1, 2), (3, 2, 3), (7, 1, 7)]
    assert keep_one(df).columns == ["doc_id", "text", "n"]
    assert sorted(r.doc_id or 0 for r in keep_one(df).collect()) == [1, 1, 2, 3, 7]
    assert keep_one(df.limit(0)).collect() == []
    clash = df.withColumnRenamed("n", "comp").selectExpr("*", "'x' as gone_id", "1 as key", "'y' as best", "2 as stays")
    assert keep_one(clash).columns == clash.columns and keep_one(clash).count() == 5

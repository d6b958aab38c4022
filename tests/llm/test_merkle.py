"""The Merkle manifest against a plain version by the definition."""

import random
import zlib
from hashlib import sha256

import pytest
from lectern.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, slot int, GRP string"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def others(tree, at):
    for level in tree[:-1]:
        run = at - at % 3
        yield level[run:at], level[at + 1:run + 3]
        at //= 3


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r[:5])
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    root = top[-1][0] if order else None
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            way = [*others(trees[s], i), *others(top, k)]
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                h = leaf((*r[:4], r[4].replace("\n", "")))
            for a, z in way:
                h = digest([*a, h, *z])
            out.append((r[0], leaf(r), trees[s][-1][0], root, digest(x for a, z in way for x in a + z), h, h == root))
    return out


def check(spark, rows):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return got


@pytest.mark.parametrize("sizes", [[1], [3, 1], [4, 81, 82], [700, 2, 9, 27, 28, 243, 244]])
def test_all_sizes(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(i, f"s{k}", "en", 3, f"a{i}\nb") for k, n in enumerate(sizes) for i in rng.sample(range(-50_000, 9_000_000), n)]
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False} or len(rows) < 5


def test_nulls_ties_and_copies(spark):
    rng = random.Random(1)
    rows = [(None, "hot", "en", 1, "same")] * 100 + [(7, "hot", None, 2, f"t{i % 9}\n") for i in range(120)] + [(5, None, None, None, None), (5, "", "", None, ""), (None, None, "é", 0, "\n\n")]
    rows += [(rng.choice([2**62, -2**63, 2**63 - 1, 64, 65, 66, 7]), rng.choice(["hot", "ü", "z"]), "en", 4, rng.choice(["", "x\ny", "long" * 5000])) for _ in range(90)]
    check(spark, rows)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranks_are_gapless(spark):
    rows = spark.range(3000).selectExpr("'g' || (id % 2) AS grp", "(id * 7919) % 100003 - 50000 AS key")
    got = merkle.ranked(rows, ["grp"], "key")[0].collect()
    for g in ("g0", "g1"):
        own = sorted((r.key, r.slot) for r in got if r.grp == g)
        assert [s for _, s in own] == list(range(len(own)))
        assert {r.total for r in got if r.grp == g} == {len(own)}

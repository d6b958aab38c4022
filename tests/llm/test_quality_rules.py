"""Quality rules against a plain version, word by word."""

import hashlib
import math
import random
import re

import pytest
from lectern.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, kept string, SCORE int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    n = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in WORD.findall(low)]
    return [x % Q.BUCKETS for x in n] + [(a * 31 + b + 7) % Q.BUCKETS for a, b in zip(n, n[1:])]


def plain(rows, trusted):
    raw, target = [0] * Q.BUCKETS, [0] * Q.BUCKETS
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in trusted and i is not None
    scale = sum(target) / max(sum(raw), 1)
    table = [math.floor(math.log((a + Q.PRIOR) / (b * scale + Q.PRIOR)) * Q.UNITS + 0.5) for a, b in zip(target, raw)]
    out = []
    for i, t in rows:
        words, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = {}
        for k in range(len(words) - 2):
            seen.setdefault(tuple(words[k:k + 3]), []).append(k)
        repeat = len({k + j for v in seen.values() if len(v) > 1 for k in v for j in range(3)})
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        g = grams(t)
        total = sum(table[x] for x in g) if any(target) else 0
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat, failed,
                    not failed and total >= math.floor(-0.1 * Q.UNITS + 0.5) * len(g), total / len(g) / Q.UNITS if g else 0.0))
    return out


def texts(n, seed=3):
    rng = random.Random(seed)
    good, bad = [f"wort{i}" for i in range(60)], [f"x{i}$$$" for i in range(60)]
    out = []
    for i in range(n):
        pool = bad if i % 4 == 0 else good
        words = [rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 49, 50, 51, 300]))]
        out.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in words)))
    return out


def compare(spark, rows, trusted):
    df = spark.createDataFrame([(i, t, "y", 1) for i, t in rows], SCHEMA)
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = [tuple(r) for r in Q.rules(df, ids).collect()]
    want = plain(rows, set(trusted))
    key = lambda r: tuple(map(str, r[:8]))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:8] == b[:8] and a[8] == pytest.approx(b[8], abs=1e-4)
    return got


def test_against_plain(spark):
    rows = texts(120) + [(200, None), (201, ""), (202, "é# ü|"), (None, "nul id " * 60), (5, "A b C\nA b C\n \n \na b c " * 30), (203, "İ ẞ x " * 40), (204, "w" * 70_000 + " z" * 60)] + [(7, "again " * 3)] * 5
    got = compare(spark, rows, [i for i, _ in rows if i is not None and i % 4] + [1, 1])
    by = {r[0]: r for r in got if r[0] is not None and r[0] < 120}
    assert any(r[7] for r in by.values()) and all(not r[7] for i, r in by.items() if i % 4 == 0)


def test_no_trusted_and_empty(spark):
    rows = texts(12)
    assert all(r[7] != r[6] for r in compare(spark, rows, []))
    assert Q.rules(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long")).collect() == []


def test_keep_returns_whole_rows(spark):
    rows = [*texts(40), (None, "nul id " * 60)]
    df = spark.createDataFrame([(i, t, "y", 1) for i, t in rows], SCHEMA)
    ids = spark.createDataFrame([(i,) for i, _ in rows if i and i % 4], "doc_id long")
    want = sorted(r.doc_id or -1 for r in Q.rules(df, ids).collect() if r.kept)
    got = Q.keep(df, ids)
    assert got.columns == df.columns and sorted(r.doc_id or -1 for r in got.collect()) == want


@pytest.mark.parametrize("size, junk", [("sf0.01", 0.15), ("sf0.1", 0.01)])
def test_good_and_bad_documents_are_told_apart(spark, size, junk):
    """At most `junk` of the bad ones are kept, fewer as there is more to learn from, and no size drops good ones."""
    sf = f"/root/testdata/{size}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # learned from half of the trusted rows; the others are held out
    got = Q.rules(docs, labels.where("quality = 1 and doc_id % 2 = 0")).where("not base_failed").join(labels.where("doc_id % 2 = 1 or quality = 0"), "doc_id")
    rates = {r.quality: r.rate for r in got.groupBy("quality").agg({"kept": "count"}).join(got.where("kept").groupBy("quality").count(), "quality", "left").selectExpr("quality", "coalesce(count, 0) / `count(kept)` AS rate").collect()}
    assert rates[1] > 0.995 and rates[0] < junk


def test_bound_takes_some_trusted_rows(spark):
    rows = [(i, t) for i, t in texts(800) if i % 4]
    df = spark.createDataFrame([(i, t, "y", 1) for i, t in rows], SCHEMA)
    ids = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    a, b = ({r.doc_id: r.kept for r in Q.rules(df, ids, bound=n).collect()} for n in (100, 100_000))
    assert a == b and any(a.values())


def test_all_trusted_rows_are_the_target_however_many(spark, monkeypatch):
    """Above the bound the texts meet the ids by a shuffle; counts, and so scores, stay those of all trusted rows."""
    rows = [*texts(400, 8), (None, "nul id " * 60), (7, "again " * 60), (7, "again " * 60)]
    ids = [i for i, _ in rows if i is not None and i % 4]
    whole = Q.rules
    monkeypatch.setattr(Q, "rules", lambda docs, trusted: whole(docs, trusted, bound=20))
    assert len(ids) > 200 and any(r[7] for r in compare(spark, rows, ids))

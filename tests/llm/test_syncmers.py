import base64
import hashlib
import random
import re
import struct

import pytest
import regex
import xxhash
from lectern.llm.queries import table
from lectern.llm.syncmers import APART, K, LONGEST, S, edited_pairs, fingerprints, passages, with_blocks
from pyspark.sql import functions as F


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def units(text):
    """From the definition: words of up to 24 characters, else single characters."""
    apart = "".join(rf"\p{{{x}}}" for x in APART)
    for run in re.findall(r"[^\x20\x09-\x0D]+", text):
        yield from [run] if len(run) <= LONGEST and not regex.search(f"[{apart}]", run) else run


def anchors(text):
    """From the definition: (place, hash) of every closed syncmer."""
    w = [0] * (K - 1) + [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units(text)] + [0] * (K - 1)

    def fold(*hashes):
        whole = 42
        for h in hashes:
            whole = xxhash.xxh64_intdigest(struct.pack("<q", h), whole)
        return signed(whole)
    g, out = [fold(a, b) for a, b in zip(w, w[1:])], []
    for i in range(len(w) - K + 1):
        inner = g[i:i + K - S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, fold(*(g[i + j] for j in sorted({*range(0, K - S, S), K - S})))))
    return out


def alike(a, b):
    a, b = ({h for _, h in anchors(x)} for x in (a, b))
    return len(a & b) / len(a | b)


def edited(texts):
    """From the definition, texts in descending order: (text, edited text, next text)."""
    for k, t in enumerate(texts):
        nxt, m = texts[(k + 1) % len(texts)], len(t) // 2
        yield t, t[:len(t) - m] + nxt[:m], nxt


def some_texts(seed, n):
    r = random.Random(seed)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "looked", "around", "slowly"]
    han = [chr(0x4E00 + i) for i in range(300)]
    kinds = (lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 80))), lambda: "".join(r.choice(han) for _ in range(r.randint(1, 300))),
             lambda: base64.b64encode(r.randbytes(r.randint(1, 300))).decode(), lambda: "".join(r.choice("aé😀\n") for _ in range(r.randint(0, 40))))
    return [r.choice(kinds)() for _ in range(n)]


def test_anchors_match_the_definition(spark):
    texts = [*some_texts(1, 40), "", "a", "a" * 50, "ab" * 30000, "x" * 24 + " " + "y" * 25, "ein Wörterbuch 漢字 test漢 \u0e01\u0e02 x"]
    got = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert [(a.place, a.hash) for a in r.anchors] == anchors(texts[r.doc_id]), r.doc_id
        assert r.n_chars == len(texts[r.doc_id])


@pytest.mark.parametrize("seed,ids", [(2, lambda r, k: k), (3, lambda r, k: r.randint(-(1 << 63), (1 << 63) - 1)), (4, lambda r, k: k + (k % 3) * 10**15)])
def test_edited_texts_and_likeness_match_brute_force(spark, seed, ids):
    r = random.Random(seed)
    rows = {ids(r, k): t for k, t in enumerate(some_texts(seed, 60))}
    got = {x.doc_id: x for x in edited_pairs(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5), block=4, cells=8).collect()}
    order = sorted(rows, reverse=True)
    assert sorted(got) == sorted(rows)
    for i, (t, e, nxt) in zip(order, edited([rows[i] for i in order])):
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert x.near_edited == pytest.approx(alike(t, e)) and x.near_next == pytest.approx(alike(t, nxt))
        assert (x.fingerprint == x.edited_fingerprint) == (sorted({h for _, h in anchors(t)})[:64] == sorted({h for _, h in anchors(e)})[:64])


def test_one_changed_character_of_a_text_without_blanks(spark):
    r = random.Random(9)
    t = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(1000))
    got = {x.doc_id: x for x in edited_pairs(spark.createDataFrame([(2, t), (1, t[:400] + "x" + t[401:])], "doc_id long, text string")).collect()}
    assert got[2].near_next > 0.9 and got[2].near_edited > 0.4


def test_places_find_shared_passages(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(60)]
    a, b = [word() for _ in range(300)] + shared + [word() for _ in range(50)], [word() for _ in range(20)] + shared
    prints = fingerprints(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, word())], "doc_id long, text string"))
    got = passages(prints, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")).collect()
    assert [(x.a, x.b, x.shift) for x in got] == [(1, 2, -280)]
    assert 300 <= got[0].first < 315 and 350 < got[0].last <= 364


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in edited_pairs(docs).collect()}
    order = sorted(text, reverse=True)
    for i, (t, e, _) in zip(order, edited([text[i] for i in order])):
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    close = [got[i].near_edited for i, t in text.items() if len(t) > 300]
    assert 0.25 < sum(close) / len(close) < 0.45


@pytest.mark.parametrize("hot", [[], [5], [5, 6, 900]])
def test_blocks_keep_the_order_and_split_hot_ids(spark, hot):
    r = random.Random(3)
    ids = [r.randint(0, 1000) for _ in range(300)] + [i for i in hot for _ in range(400)] + [None] * 350
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    got = with_blocks(rows, block=10, cells=16).collect()
    key = sorted(((x.doc_id is not None, x.doc_id or 0, x.text_hash), x.block) for x in got)
    assert [b for _, b in key] == sorted(b for _, b in key)
    assert max(sum(x.block == b for x in got) for b in {x.block for x in got}) < 60


def test_odd_tables(spark):
    df = spark.createDataFrame([(5, None, 1), (5, None, 1), (3, "", 1), (2, "é漢😀 x" * 9000, 1), (None, "one two", 1), (-1 << 40, "a", 1)], "doc_id long, text string, anchors int")
    got = edited_pairs(df.selectExpr("*", "1 as block", "2 as head", "3 as text_hash")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, -1 << 40, 1), (False, 2, 45000), (False, 3, 0), (False, 5, 0), (False, 5, 0), (True, 0, 7)]
    by = {r.doc_id: r for r in got}
    assert by[2].edited_sha256 == hashlib.sha256((("é漢😀 x" * 9000)[:22500] + "a").encode()).hexdigest()
    assert by[-1 << 40].edited_sha256 == hashlib.sha256(b"a").hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256(b"one ").hexdigest()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert edited_pairs(df.limit(0)).collect() == []
    none = edited_pairs(df.where("doc_id is null")).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in none] == [(None, 7, 1.0)]

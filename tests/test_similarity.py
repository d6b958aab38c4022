"""Fuzzy matching against every pair, and chunking of a small volume."""

import random

import pytest
from lectern.operators import similarity as S
from pyspark.sql import functions as F


def texts(seed, count, sizes):
    """Base texts and edited copies of some, over few letters so that pairs of letters are common."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcd ef") for _ in range(r.choice(sizes))).strip() or "a" for _ in range(count)]

    def edit(t):
        t = list(t)
        for _ in range(r.randint(0, max(1, len(t) // 6))):
            i = r.randrange(len(t) + 1)
            t[i:i + r.randint(0, 1)] = r.choice(["", "x", "b"])
        return "".join(t)
    return base, [edit(r.choice(base)) for _ in range(count)] + ["", None]


@pytest.mark.parametrize("least", [73, 80, 92])
def test_no_pair_is_lost(spark, least):
    a, b = texts(least, 60, [1, 2, 3, 4, 5, 6, 7, 8, 12, 30])
    left = spark.createDataFrame([(0, x) for x in a], "block int, a string")
    right = spark.createDataFrame([(0, x) for x in b], "block int, b string")
    for partial, score in ((False, S.indel), (True, S.window_best)):
        got = {(r.a, r.b) for r in S.candidates(left, right, least, partial).collect()}
        want = {(x, y) for x in a for y in b if y and score(x, y) > least}
        assert want and want <= got


def test_window_best_against_all_windows():
    r = random.Random(5)
    for _ in range(300):
        x, y = ("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(2))
        s, t = sorted((x, y), key=len)
        plain = 100.0 if s in t else max(S.indel(s, t[max(i, 0):i + len(s)]) for i in range(1 - len(s), len(t)))
        assert S.window_best(x, y) == plain


def test_best_match_takes_smaller_key_on_ties(spark):
    left = spark.createDataFrame([(1, "Deep Learning"), (2, None), (3, ""), (4, "qqqq")], "k int, text string")
    right = spark.createDataFrame([(9, "deep learning"), (7, "Deep learning"), (5, "deep learner"), (6, None)], "j int, text string")
    assert [tuple(r) for r in S.best_match(left, right, "k", "j", "text", 80).collect()] == [(1, 7, 100.0)]
    assert S.best_match(left.limit(0), right, "k", "j", "text", 80).count() == 0


VOLUME = """# Table of Contents
## Section 1
# Sharing Disagreement by Weighing Evidence in Groups
Author: Somebody

## Abstract
This study looks at disagreement.

## Methods & Context
A trial with one class.

## Results
Groups agreed more often.
"""


def volume(spark):
    return spark.createDataFrame([(2024, i, t) for i, t in enumerate(VOLUME.splitlines())], "block int, line int, text string")


PAPERS = [("p1", 2024, "Sharing Disagreement by Weighing Evidence in Groups", None), ("p2", 2024, "Weighing Evidence", "Short text"),
          ("p3", 2024, "Something Entirely Different and Unknown", ""), ("p4", 2023, "Sharing Disagreement by Weighing Evidence in Groups", None)]


def test_titles_whole_then_in_part_within_their_block(spark):
    papers = spark.createDataFrame(PAPERS, "paper_id string, block int, title string, abstract string")
    got = {r.paper_id: (r.line, r.score) for r in S.title_lines(papers, volume(spark)).collect()}
    assert got == {"p1": (2, 1.0), "p2": (2, 1.0)}


def test_chunks(spark):
    papers = spark.createDataFrame(PAPERS, "paper_id string, block int, title string, abstract string")
    rows = S.chunks(papers, volume(spark), S.title_lines(papers, volume(spark))).collect()
    first = sorted((r.section, r.label) for r in rows if r.paper_id == "p1")
    assert first == [(1, "introduction"), (2, "methods"), (3, "results")]
    assert [(r.text, r.confidence, r.low) for r in rows if r.paper_id == "p3"] == [(PAPERS[2][2], 0.5, True)]
    assert {r.confidence for r in rows if r.paper_id == "p1"} == {1.0}


def test_page_heads_takes_first_best_page(spark):
    pages = spark.createDataFrame([(0, p, t) for p, t in [(3, "A Title of Note\nx"), (20, "noise\nA Title of Note\ny"), (21, "A Title of Note"), (30, "a\nb\nc\nd\ne\nf\nAnother Thing Far Below")]], "block int, page int, text string")
    titles = spark.createDataFrame([("a", 0, "A title of note"), ("b", 0, "Another thing far below")], "paper_id string, block int, title string")
    assert [tuple(r) for r in S.page_heads(titles, pages).collect()] == [("a", 20, 100.0)]


def test_cascade_tiers(spark):
    files = spark.createDataFrame([(1, "paper-0010", "x"), (2, "zz-abc-12-zz", "y"), (3, "nothing", "Same: Title!"), (4, "nothing", "A long enough title that goes on and on differently"), (5, "nothing", "short"), (6, "none", None), (7, "none", "The whole short-titled paper head")], "file_id int, stem string, title string")
    papers = spark.createDataFrame([("icls-paper-0010-b", "q"), ("icls-paper-0010-a", "q"), ("abc-12", "same title"), ("z-1", "SAME title"), ("z-2", "Series 3: a long enough title that goes ON and on in another way"), ("z-3", None), ("z-4", "Whole short-titled paper he")], "paper_id string, title string")
    got = {r.file_id: (r.paper_id, r.tier) for r in S.cascade(files, papers).collect()}
    assert got == {1: ("icls-paper-0010-a", 1), 2: ("abc-12", 1), 3: ("abc-12", 2), 4: ("z-2", 3), 7: ("z-4", 3)}


def test_cascade_where_many_names_begin_alike(spark):
    """Against every pair: stems within ids and ids within stems that share their first letters, equal titles in a large group."""
    r = random.Random(8)
    stems = [f"doc-{r.randint(1, 400)}{r.choice(['', '-', '-end'])}" for _ in range(150)] + [f"x-v1-doc-{r.randint(1, 200)}-end-y" for _ in range(60)] + ["docs", "v1-do"]
    titles = ["", "Same title of all", "A long title that goes on for quite a while and ends", "Part 2: a long title that goes on for quite a while, but differs", "Unlike the others in all of its words"]
    files = [(i, t, r.choice(titles)) for i, t in enumerate(stems)]
    papers = [(f"v1-doc-{k}-end", r.choice(titles[:3])) for k in range(1, 200)] + [("a-paper", titles[2])]
    key = lambda t: "".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")

    def tier(stem, a, paper, b):
        a, b = key(a), key(b)
        if len(stem) >= 5 and (stem in paper or paper in stem):
            return 1
        return 2 if a and a == b else 3 if len(a) > 20 and (a[:30] in b or len(b) > 20 and b[:30] in a) else 9
    want = {i: min((tier(s, a, k, b), k) for k, b in papers) for i, s, a in files}
    got = {x.file_id: (x.tier, x.paper_id) for x in S.cascade(spark.createDataFrame(files, "file_id int, stem string, title string"), spark.createDataFrame(papers, "paper_id string, title string")).collect()}
    assert got == {i: x for i, x in want.items() if x[0] < 9} and {x[0] for x in got.values()} == {1, 2, 3}


def test_stretches_are_places_not_pairs(spark):
    """2,000 texts that begin alike meet 2,000 longer ones in as many stretches as those have places and lengths."""
    short = spark.range(2000).selectExpr("concat('other', id) as a")
    long = spark.range(2000).selectExpr("concat('v1-other', id, '-end') as b")
    got = S.stretches(short, long, 5)
    assert got.count() == 2000 * 4 and got.join(short, "a").count() == sum(len(str(i)) for i in range(2000))


@pytest.mark.parametrize("least", [40, 73, 92])
def test_similar_against_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(S, "TILE_A", 20)
    monkeypatch.setattr(S, "TILE_B", 30)
    a, b = texts(least, 60, [1, 2, 5, 8, 12, 63, 64, 65, 130])
    a, b = {*a, "漢字 é", "x" * 300}, {x for x in b if x} | {"漢字 e", "x" * 250 + "y" * 9}
    got = {(r.a, r.b): r.score for r in S.similar(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), least).collect()}
    assert got == {(x, y): S.indel(x, y) for x in a for y in b if S.indel(x, y) > least}


def test_best_match_of_many_like_texts(spark):
    """200 by 30,000 texts of the same letters, most of which pass every count of letters: every pair of letters in common made a row before."""
    import time

    r = random.Random(3)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7))) for _ in range(60)]
    right = [" ".join(r.choice(words) for _ in range(9)) for _ in range(30000)]
    left = [" ".join(w if r.random() < 0.9 else "xx" for w in right[k * 100].split()) for k in range(200)]
    began = time.time()
    got = S.best_match(spark.createDataFrame(list(enumerate(left)), "k int, text string"), spark.createDataFrame(list(enumerate(right)), "j int, text string"), "k", "j", "text", 80).collect()
    assert time.time() - began < 60
    assert {x.k for x in got} >= {k for k in range(200) if S.indel(left[k], right[k * 100]) > 80} and len(got) > 150
    assert all(x.score >= S.indel(left[x.k], right[x.k * 100]) and x.score == S.indel(left[x.k], right[x.j]) for x in got)

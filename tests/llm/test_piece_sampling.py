import math
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from lectern.llm.piece_sampling import BLANK, Pieces, decode, encode, sample_texts
from lectern.llm.queries import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL)


def all_paths(pieces, text):
    """Every segmentation with its share of the total, by exhaustive search."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    log = dict(zip(pieces.id.tolist(), pieces.log.tolist()))
    word = {m.id_to_piece(i): i for i in log}
    s, out = BLANK + text.replace(" ", BLANK), []

    def walk(at, ids, total):
        if at == len(s):
            out.append((tuple(ids), total))
        for n in range(1, 17):
            if at + n <= len(s) and (i := word.get(s[at:at + n])) is not None:
                walk(at + n, [*ids, i], total + log[i])
    walk(0, [], 0.0)
    z = math.log(sum(math.exp(t) for _, t in out))
    return {ids: t - z for ids, t in out}


def test_all_paths_come_out_with_their_probabilities(pieces):
    want = all_paths(pieces, "a cat")
    got = sample_texts(pieces, ["a cat"], np.array([5]), len(want) + 5, 1)[0]
    assert {tuple(i.tolist()): round(lp, 9) for i, lp, _, _ in got} == {i: round(lp, 9) for i, lp in want.items()}
    keys = [k for _, _, k, _ in got]
    assert keys == sorted(keys, reverse=True) and all(inc == 0 for *_, inc in got)


def test_sampling_follows_the_distribution_without_replacement(pieces):
    want, n = all_paths(pieces, "the in"), 4000
    first, kept = Counter(), Counter()
    for got in sample_texts(pieces, ["the in"] * n, np.arange(n), 3, 9):
        ids = [tuple(i.tolist()) for i, *_ in got]
        assert len(set(ids)) == 3
        first[ids[0]] += 1
        for i, (_, lp, _, inc) in zip(ids, got):
            kept[i] += 1 / math.exp(inc)
    for i, lp in want.items():
        p = math.exp(lp)
        assert abs(first[i] / n - p) < 5 * math.sqrt(p / n) + 1e-3
        if p > .02:  # inverse inclusion weights estimate 1 for every segmentation
            assert abs(kept[i] / n - 1) < .2


def test_pairs_come_in_the_order_of_sampling_without_replacement(pieces):
    want, n = all_paths(pieces, "an"), 20000
    seen = Counter()
    for got in sample_texts(pieces, ["an"] * n, np.arange(n), 3, 4):
        seen[tuple(tuple(i.tolist()) for i, *_ in got)[:2]] += 1
    for a, x in want.items():
        for b, y in want.items():
            if a != b:
                p = math.exp(x + y) / (1 - math.exp(x))
                assert abs(seen[a, b] / n - p) < 5 * math.sqrt(p / n) + 1e-3


def test_round_trip_and_determinism(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    got = decode(encode(docs, MODEL, samples=3), MODEL).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == 3 * len(text) and all(r.decoded == text[r.doc_id] for r in got)
    assert len({(r.doc_id, tuple(r.ids)) for r in got}) == len(got)
    again = encode(docs.repartition(7), MODEL, samples=3).collect()
    assert {(r.doc_id, r.sample, tuple(r.ids)) for r in again} == {(r.doc_id, r.sample, tuple(r.ids)) for r in got}


def test_odd_tables(spark):
    texts = [None, "", " ", "\n\n", "a▁b ▁", "漢字😀\x00é  x", "x" * 30000, "ab " * 20000, "  lead"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "a b", "c"), (4, texts[4], "c")], "doc_id long, text string, ids string")
    got = decode(encode(df, MODEL, samples=2), MODEL, keep_ids=False).collect()
    for i, t in enumerate(texts):
        mine = [r.decoded for r in got if r.doc_id == i]
        assert mine and set(mine) == {t or ""}, i
    assert encode(df.limit(0), MODEL).collect() == []
    assert not (Path(__file__).parents[2] / "piece_bpe_32k.model").exists()

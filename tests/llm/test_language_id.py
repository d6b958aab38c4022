import zlib
from collections import Counter

import numpy as np
from lectern.llm.language_id import ORDER, Model, keep_known, languages
from lectern.llm.queries import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = languages(docs).collect()
    assert len(rows) == 10000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    print("accuracy", right, "rejected", sum(r.rejected for r in rows))
    assert right > 0.97 and sum(r.rejected for r in rows) < 20


def slow_prob(counts, alphabet, gram):
    """Interpolated Kneser-Ney from its definition; counts: ORDER-gram -> count."""
    tables = {ORDER: dict(counts)}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    vocab = 1 / (len(alphabet) + 1)

    def p(n, g):
        if n == 0:
            return vocab
        t = tables[n]
        one, two = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        d = min(max(one / max(one + 2 * two, 1), .1), .95)
        total = sum(c for k, c in t.items() if k[:-1] == g[:-1])
        kinds = sum(k[:-1] == g[:-1] for k in t)
        low = p(n - 1, g[1:])
        return low if not total else max(t.get(g, 0) - d, 0) / total + d * kinds / total * low
    return p(ORDER, gram)


def test_probabilities_match_the_definition():
    text = "    " + "the cat sat on the mat and the rat sat on the hat " * 2 + "then that"
    counts = Counter(text[i:i + ORDER] for i in range(len(text) - ORDER + 1))
    other = Counter("    xyxyx"[i:i + ORDER] for i in range(5))
    m = Model(["a", "b"], [*counts, *other], np.array([0] * len(counts) + [1] * len(other)), np.array([*counts.values(), *other.values()], float))
    probe = "    the mat that hit zat"
    chars = np.array([ord(c) for c in probe], np.uint32)
    got = m.log_probs(chars, np.arange(ORDER - 1, len(probe)))
    for i, row in zip(range(ORDER - 1, len(probe)), got):
        want = slow_prob(counts, {c for g in [*counts, *other] for c in g}, probe[i - ORDER + 1:i + 1])
        assert np.isclose(np.exp(row[0]), want, atol=1e-12)


def test_odd_tables(spark):
    de, en = "der hund und die katze laufen über die straße ", "the dog and the cat are walking over the street "
    docs = [(i, (de if i % 2 else en) * (1 + i % 3), "de" if i % 2 else "en", 1) for i in range(200)]
    docs += [(300, None, "en", 1), (301, "123 !!", "de", 1), (302, en * 4000, None, 1), (None, de, "de", 1), (304, "", None, 1), (305, "漢" * 300, None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in languages(df).collect()}
    assert [got[i].lang_pred for i in (300, 301, 302, None, 304)] == ["und", "und", "en", "de", "und"]
    assert got[3].lang_pred == "de" and 0 <= got[3].score <= 1
    kept = keep_known(df)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and {300, 301, 304, 305}.isdisjoint(ids) and set(range(200)) <= ids
    assert languages(df.limit(0)).collect() == []


def test_rare_languages_are_learned_and_kept(spark):
    en, fi = "the dog and the cat are walking over the street ", "koira ja kissa juoksevat kadun yli kohti vanhaa taloa "
    docs = spark.range(30000).selectExpr("id as doc_id", f"repeat(if(id % 1500 = 7, '{fi}', '{en}'), 2 + cast(id % 3 as int)) as text", "if(id % 1500 = 7, 'fi', 'en') as lang")
    rare = docs.where("lang = 'fi'")
    assert rare.count() == 20
    got = languages(docs, bound=300).where("doc_id % 1500 = 7").collect()
    assert len(got) == 20 and all(r.lang_pred == "fi" and not r.rejected for r in got)
    assert keep_known(docs, bound=300).where("lang = 'fi'").count() == 20


def texts_of_three_languages(spark, n):
    words = {"a": "lorem ipsum dolor sit amet", "b": "veni vidi vici alea iacta", "c": "panta rhei gnothi seauton"}
    rows = [(i, " ".join(words[k].split()[(i * j) % 4] + str(i % 7) for j in range(1, 9)), k) for i in range(n) for k in [sorted(words)[i % 3]]]
    return spark.createDataFrame([*rows, (n, "", "a"), (n + 1, None, "b"), (n + 2, "42", "c")], "doc_id long, text string, lang string")


def test_model_counts_all_labelled_texts(spark):
    """The n-grams of every labelled text outside the calibration fold are counted, and weigh as the local model's."""
    import lectern.llm.language_id as L

    docs = texts_of_three_languages(spark, 6000)
    counted, weigh = [], L._weights
    L._weights = lambda types, bound: counted.extend(types.collect()) or weigh(types, bound)
    try:
        model, level = L._fit(docs, L.F.lit(True), 1 << 16).value
    finally:
        L._weights = weigh
    texts = [r for r in docs.collect() if r.text]
    assert sum(r.c for r in counted) > 0.85 * sum(len(L.characters(L.pa.array([r.text]))[1]) for r in texts)
    local = Model(model.langs, [r.gram for r in counted], np.array([model.langs.index(r.lang) for r in counted]), np.array([r.c for r in counted], float))
    chars, at, _ = L.characters(L.pa.array([texts[0].text, "quo vadis ipsum gnothi z"]))
    assert model.base == local.base and np.allclose(model.log_probs(chars, at), local.log_probs(chars, at), atol=1e-12)
    assert set(level) == {"a", "b", "c"}


def test_probabilities_add_up_to_one_when_rare_ngrams_are_not_stored(spark):
    import lectern.llm.language_id as L

    docs = texts_of_three_languages(spark, 300)
    model, _ = L.train(docs, bound=40)
    assert all(len(keys) <= 3 * 40 for keys, _ in model.probs)
    letters = sorted({c for r in docs.collect() for c in (r.text or "") if c.isalpha()} | {" ", "ж"})
    probes = np.array([[ord(x) for x in head + c] for head in ("m ip", "rem ", "zzzz") for c in letters], np.uint32)
    p = np.exp(model.log_probs(probes.ravel(), np.arange(len(probes)) * ORDER + ORDER - 1)).reshape(3, len(letters), 3).sum(1)
    assert len(letters) * model.base == 1 and np.allclose(p, 1)


def test_every_ngram_is_in_the_model(spark):
    """More 5-grams of one language than any earlier limit (65,536 of an order): rare ones weigh as the definition has it."""
    import lectern.llm.language_id as L

    letters = "abcdefghijklmnopqrstuvwx"
    words = [a + b + c + d + e for a in letters[:12] for b in letters[:12] for c in letters[:12] for d in letters[:12] for e in letters[:6]]
    docs = spark.createDataFrame([(k, " ".join(words[k::400]), "a") for k in range(400)], "doc_id long, text string, lang string")
    model, _ = L.train(docs)
    grams = {" " * (ORDER - 1) + r.text for r in docs.collect()}
    seen = {t[i:i + ORDER] for t in grams for i in range(len(t) - ORDER + 1)}
    assert 65536 < 0.8 * len(seen) < len(model.probs[0][0]) <= len(seen)


def test_a_model_too_large_to_broadcast_gives_the_same_rows(spark, monkeypatch):
    import lectern.llm.language_id as L

    docs = texts_of_three_languages(spark, 600).union(spark.createDataFrame([(None, "veni vidi", "b"), (None, "veni vidi", "b"), (700, "漢" * 400, None)], "doc_id long, text string, lang string"))

    def figures():
        rows = languages(docs).collect()
        kept = keep_known(docs, bound=None)
        assert kept.columns == docs.columns
        return sorted([(r.doc_id or -1, r.lang_pred, round(r.score, 9), round(r.cross_entropy, 9), r.rejected) for r in rows]), sorted((r.doc_id or -1, r.text) for r in kept.collect())
    whole = figures()
    monkeypatch.setattr(L, "HELD", 10)
    monkeypatch.setattr(L, "CELL_BYTES", 4000)
    assert isinstance(L.train(docs)[0], L.Spread)
    assert figures() == whole and len(whole[0]) == 606


def test_keep_known_learns_every_ngram(spark, monkeypatch):
    import lectern.llm.language_id as L

    seen, weigh = [], L._weights
    monkeypatch.setattr(L, "_weights", lambda types, bound: seen.append((types.count(), weigh(types, bound))) or seen[-1][1])
    words = [a + b + c + d + e for a in "abcdefghijkl" for b in "mnopqrstuv" for c in "abcdefghijkl" for d in "mnopqrstuv" for e in "aeiouy"]
    docs = spark.createDataFrame([(k, " ".join(words[k::300]), "a") for k in range(300)], "doc_id long, text string, lang string")
    assert keep_known(docs).count() == 300
    types, (_, _, stored, size) = seen[0]
    assert types > 80000 and stored.where("n = 5").count() == types and size == stored.count()

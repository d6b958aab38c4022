from lectern.llm.queries import table
from lectern.llm.weak_quality import LABELLERS, fit_label_model, keep_good, quality


def test_against_curated_labels_never_seen(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = {r.doc_id: r for r in quality(table(spark, sf, "documents")).collect()}
    assert len(rows) == 10000
    good = [rows[i].keep for i, q in truth.items() if q == 1]
    bad = [rows[i].keep for i, q in truth.items() if q == 0]
    print("good kept", sum(good) / len(good), "bad kept", sum(bad) / len(bad))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_em_finds_accuracies():
    import random
    r = random.Random(4)
    acc, counts = [.95, .9, .8, .75, .9, .85, .7, .6], {}
    for _ in range(20000):
        y = r.random() < .8
        p = 0
        for k in range(len(LABELLERS)):
            v = 1 if r.random() < .2 else 2 * int((r.random() < acc[k]) == y)
            p += v * 3 ** k
        counts[p] = counts.get(p, 0) + 1
    _, accuracy, prior = fit_label_model(counts)
    assert abs(prior - .8) < .02
    for k, a in enumerate(acc):
        assert abs(accuracy[k] - a) < .03


def test_odd_tables(spark):
    docs = [(i, f"A plain line of words number {i} that ends here. And one more follows it.", "x") for i in range(60)]
    docs += [(i, "&&& ### *** |||| $$$ " * 20, "x") for i in range(60, 75)] + [(100, None, "x"), (101, " \n", "x"), (102, "Fine words go on. " * 9000, None), (None, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in quality(df).collect()}
    assert not got[100].keep and not got[101].keep and not got[70].keep and got[3].keep and got[None].keep
    assert len(quality(df).collect()) == len(docs)
    kept = keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, r in got.items() if r.keep)
    assert quality(df.limit(0)).collect() == []


def test_all_documents_train_the_scorer(spark, monkeypatch):
    """Whatever the bound, every document with a word reaches a shard, and small shards agree with one large one."""
    import lectern.llm.weak_quality as W

    learned, train = spark.sparkContext.accumulator(0), W._train

    def counting(posterior, epochs):
        run = train(posterior, epochs)
        return lambda table: learned.add(table.num_rows) or run(table)
    monkeypatch.setattr(W, "_train", counting)
    docs = [(i, f"A plain line of words number {i} that ends here. And one more follows it." if i % 5 else "&&& ### *** |||| $$$ " * (3 + i % 7)) for i in range(900)] + [(900, None), (901, " \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    few = {r.doc_id: r.keep for r in quality(df, bound=100).collect()}
    assert learned.value == 900
    assert few == {r.doc_id: r.keep for r in quality(df).collect()} and not few[5] and few[6]

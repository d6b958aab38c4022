import math
import random
import zlib

import numpy as np
import pytest
from lectern.llm.linear import Ftrl
from lectern.llm.toxicity import toxicity
from lectern.llm.queries import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = toxicity(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")).collect()
    truth = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    assert len(rows) == 10000 and len({r.doc_id for r in rows}) == 10000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    print("recall", hit / sum(truth[r.doc_id] for r in held), "precision", hit / sum(r.predicted for r in held), len(held))
    assert hit >= 0.75 * sum(truth[r.doc_id] for r in held)
    assert hit >= 0.9 * sum(r.predicted for r in held)


def test_odd_tables(spark):
    docs = [(i, "you idiot trash" if i % 3 == 0 else "a fine day", 9) for i in range(300)] + [(400, None, 1), (401, "", 1), (402, "idiot " * 50000, 1), (None, "a fine day", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None), (None, 1), (6, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(df, labels).collect()}
    assert got[402].predicted == 1 and got[None].predicted == 0 and got[None].held_out is False
    assert got[400].score == got[401].score and 0 < got[400].score < 1
    empty = toxicity(df.limit(0), labels.limit(0)).collect()
    assert empty == []
    assert {r.predicted for r in toxicity(df, labels.limit(0)).collect()} <= {0, 1}


@pytest.mark.parametrize("valued", [False, True])
def test_learner_equals_a_plain_version_by_coordinate(valued):
    r = random.Random(6)
    rows = [([*r.sample(range(40), r.randint(1, 8))], r.random() < .4) for _ in range(400)]
    alpha, beta, l1, l2 = .7, 1.0, .3, .05
    model, z, n = Ftrl(alpha=alpha, beta=beta, l1=l1, l2=l2, size=40), [0.0] * 41, [0.0] * 41

    def weight(i):
        if i != 40 and abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1) * (i != 40)) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for idx, y in rows:
        value = [r.random() if valued else 1.0 for _ in idx]
        model.learn(np.array(idx), np.array(value), float(y))
        both = [*zip(idx, value), (40, 1.0)]
        w = {i: weight(i) for i, _ in both}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in both)))
        for i, v in both:
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    got = dict(zip(*(x.tolist() for x in model.compact())))
    assert set(got) == {i for i in range(41) if weight(i) and n[i]}
    assert all(got[i] == pytest.approx(weight(i)) for i in got)


def test_training_rows_do_not_depend_on_partitions(spark):
    docs = [(i % 90, f"{'you idiot' if i % 3 == 0 else 'fine day'} {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), labels).collect()) for n in (2, 9))
    assert a == b

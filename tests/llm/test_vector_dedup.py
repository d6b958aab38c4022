import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from lectern.llm.ngram_join import Classes
from lectern.llm.vector_dedup import ProductCode, enough, near_vectors, shape, unit


def brute(ids, x, cosine=0.95):
    u = unit(x)
    hit = u @ u.T >= cosine
    c = Classes(len(ids))
    for i, j in zip(*np.nonzero(hit)):
        c.join(int(i), int(j))
    low = {}
    for i, v in enumerate(ids):
        low[c.find(i)] = min(low.get(c.find(i), v), v)
    return {v: (int(hit[i].sum()) - 1, low[c.find(i)]) for i, v in enumerate(ids)}


def clustered(seed, n=900, dim=64):
    r = np.random.RandomState(seed)
    x = [r.standard_normal(dim)]
    for _ in range(n - 1):
        k = r.rand()
        base = x[r.randint(len(x))]
        x.append(base.copy() if k < .2 else base + r.standard_normal(dim) * np.linalg.norm(base) / 8 * r.choice([.1, .3, .33]) if k < .6 else r.standard_normal(dim))
    return np.array(x).astype(np.float32).astype(float)


def test_links_match_brute_force(spark):
    for seed, rows in ((1, 4096), (2, 40)):
        x = clustered(seed)
        df = spark.createDataFrame([(i + 10, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(5)
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, block_rows=rows).collect()}
        want = brute(list(range(10, 10 + len(x))), x)
        assert sum(n for n, _ in want.values()) > 500
        assert got == want


def test_list_decoding_is_complete():
    r = np.random.RandomState(0)
    code = ProductCode(16, 9, 3.0, 2, 2)
    x = unit(r.standard_normal((20, 16)))
    for v, f in zip(x, code.decode(x)):
        want = []
        for c, (turn, book) in enumerate(zip(code.rotations, code.books)):
            y = v @ turn
            want += [c * 81 + i * 9 + j for i in range(9) for j in range(9)
                     if y[code.parts[0]] @ book[0][i] + y[code.parts[1]] @ book[1][j] >= code.height]
        assert sorted(f.tolist()) == sorted(want)


def test_odd_tables(spark):
    ddl = "vec_id long, embedding array<float>, n_links string"
    assert near_vectors(spark.createDataFrame([], ddl)).collect() == []
    rows = [(1, [1.0, 0.0], ""), (2, [1.0, 0.0], ""), (2, [1.0, 0.0], ""), (3, None, ""), (4, [0.0, 0.0], ""), (5, [1.0, None], ""),
            (6, [float("nan"), 1.0], ""), (7, [float("inf"), 1.0], ""), (8, [], ""), (9, [1.0, 0.0, 0.0], ""), (10, [2.0, 0.01], ""), (11, [-1.0, 0.0], "")]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, ddl)).collect())
    assert got[:3] == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False)]
    assert [g for g in got if g[0] == 10] == [(10, 3, 1, False)]
    assert all(g == (g[0], 0, g[0], True) for g in got if g[0] in (3, 4, 5, 6, 7, 8, 9, 11))


def pairs_at(r, n, dim, cosine=0.95):
    x, z = unit(r.standard_normal((n, dim))), r.standard_normal((n, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + (1 - cosine ** 2) ** 0.5 * unit(z)


def test_vectors_exceed_the_asked_number_of_filters():
    x = unit(np.random.RandomState(3).standard_normal((3000, 32)))
    many = [len(f) for f in ProductCode(32, 289, 8.0, 4, 2).decode(x)]
    assert 0.85 * 32 < np.mean(many) < 1.15 * 32


def test_codes_keep_the_miss_rate_at_any_size():
    for dim, n in ((64, 2000), (32, 500_000), (64, 10_000_000), (8, 100_000), (3, 5000)):
        words, parts = shape(n, dim, 8.0, 48, 2)
        per_code, codes, rate = enough(dim, words, 8.0, 4, parts, 0.95, 1e-6)
        x, y = pairs_at(np.random.RandomState(n), 1000, dim, 0.9501)
        found = ProductCode(dim, words, per_code, codes, parts).decode(np.concatenate([x, y]))
        assert rate <= 1e-6 and codes >= 4
        assert all(len(np.intersect1d(a, b)) for a, b in zip(found[:1000], found[1000:]))
    assert shape(10_000_000, 64, 8.0, 48, 2)[1] == 2


def test_recall_of_a_large_table(spark, tmp_path):
    r = np.random.RandomState(5)
    x, y = pairs_at(r, 2000, 32, 0.951)
    v = np.concatenate([x, y, r.standard_normal((96_000, 32))]).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 32).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    got = {k.vec_id: k.n_links for k in near_vectors(spark.read.parquet(str(tmp_path / "v.parquet")).repartition(8)).collect()}
    u = unit(v)
    asked = np.arange(0, 4000, 8)
    assert all(got[i] == n for i, n in zip(asked, (u[asked] @ u.T >= 0.95).sum(axis=1) - 1)) and len(got) == len(v)


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (7, None), (7, [0.0, 0.0]), (None, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, Component_id string")
    got = sorted((tuple(r) for r in near_vectors(df).collect()), key=str)
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 2, 1, False), (None, 1, None, False), (None, 1, None, False), (7, 0, 7, True), (7, 0, 7, True), (None, 0, None, False)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []

import random
import zlib

from lectern.llm.common import numbered
from lectern.llm.sharding import borders, histogram_sort, slim, write_shards


def test_bytes_are_near_equal_and_slots_gapless(spark):
    r = random.Random(5)
    rows = [(i, "x" * r.randint(0, 3000)) for i in range(700)] + [(700 + i, "same text " * 20) for i in range(500)] + [(5000, None), (5001, None), (5002, "")]
    got = histogram_sort(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(x.doc_id for x in got) == sorted(i for i, _ in rows)
    text = dict(rows)
    by = {}
    for x in got:
        raw = (text[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        by.setdefault(x.shard, []).append(x)
    assert set(by) <= set(range(40))
    for s in by.values():
        assert sorted(x.slot for x in s) == list(range(len(s)))
    mean = sum(x.size for x in got) / 40
    assert all(abs(sum(x.size for x in by.get(s, [])) - mean) <= 3016 for s in range(40))


def test_borders_equal_a_full_sort(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(i, "ab" * r.randint(1, 40) + str(i % 50)) for i in range(4000)], "doc_id long, text string")
    rows = slim(df)
    local = sorted((x.h % (1 << 64), x.d % (1 << 64), x.size) for x in rows.collect())
    total, cuts = sum(x[2] for x in local), borders(rows, 8, 0.01)
    for j, cut in enumerate(cuts):
        below = sum(n for h, d, n in local if (h, d) < cut)
        assert abs(below - total * (j + 1) / 8) <= max(0.01 * total / 8, max(x[2] for x in local))
    split = [c for c in cuts if any((h, 0) < c < (h, 1 << 64) and c[0] == h for h, _, _ in local)]
    assert all(c[1] == 0 or c in split for c in cuts)


def test_odd_tables(spark):
    assert histogram_sort(spark.createDataFrame([], "doc_id long, text string, size string")).collect() == []
    got = histogram_sort(spark.createDataFrame([(None, "a", 1), (3, "b" * 100000, 2), (3, "b" * 100000, 2)], "doc_id long, text string, shard int")).collect()
    assert sorted((x.doc_id or 0, x.size) for x in got) == [(0, 17), (3, 100016), (3, 100016)]
    assert len({(x.shard, x.slot) for x in got}) == 3


def test_written_shards_hold_every_row_once(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.choice([None, 1, 2, *range(300)]), "t" * r.randint(0, 90), k) for k in range(900)] + [(None, "same", 0)] * 200 + [(4, None, 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(6)
    path = str(tmp_path / "shards")
    write_shards(docs, path, shards=5, cell_rows=40)
    got = spark.read.parquet(path)
    assert set(got.columns) == {"doc_id", "text", "slot", "_slot", "shard"}
    back = got.collect()
    assert sorted((repr(x.doc_id), repr(x.text), x.slot) for x in back) == sorted((repr(i), repr(t), k) for i, t, k in rows)
    for s in {x.shard for x in back}:
        assert sorted(x._slot for x in back if x.shard == s) == list(range(sum(x.shard == s for x in back)))
    sizes = [sum(len(x.text or "") + 16 for x in back if x.shard == s) for s in range(5)]
    assert max(sizes) - min(sizes) < 0.5 * sum(sizes) / 5 + 200 * 20


def test_rows_that_agree_in_everything_fill_many_cells(spark):
    df = spark.createDataFrame([(1, 7)] * 900 + [(2, k) for k in range(50)], "g int, v int").repartition(9)
    got = numbered(df, "g", ["v"], "n", 20).collect()
    for g, n in ((1, 900), (2, 50)):
        assert sorted(x.n for x in got if x.g == g) == list(range(n))

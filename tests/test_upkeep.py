"""Versions, Markdown tables, profiles, file registries, stored postings and scorers on small cases."""

import json
import os

import pytest
from lectern.operators import markdown, profiles, search, upserts
from lectern.sources import files
from lectern.sources.versions import VersionedTable
from lectern.streaming import incremental
from pyspark.sql import functions as F

SCHEMA = "k long, seq long, v string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def state(table, version=None):
    return sorted((r.k is None, r.k, r.seq, r.v) for r in table.read(version).collect())


def data_bytes(folder, part):
    return {str(p.parent): sum(f.stat().st_size for f in p.parent.glob("*.parquet")) for p in folder.glob(f"{part}/**/*.parquet")}


def test_versions_merge_and_time_travel(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], "seq", SCHEMA, compact_every=3)
    assert state(t) == [] and t.versions() == []
    assert t.append(rows(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n"), (3, 5, "x"), (3, 5, "y")), 1)
    assert t.append(rows(spark, (1, 0, "later batch")), 2)
    first = [(False, 1, 2, "b"), (False, 2, 1, "c"), (False, 3, 5, "y"), (True, None, 1, "n")]
    assert state(t, 1) == first and state(t) == [(False, 1, 0, "later batch"), *first[1:]]
    assert t.append(rows(spark, (None, 2, "m")), 3) and t.versions()[0][1:] == ("base/version=3", [])
    assert state(t)[-1] == (True, None, 2, "m") and len(state(t)) == 4
    assert not t.append(rows(spark, (9, 9, "replayed")), 2) and len(state(t)) == 4


def test_written_bytes_follow_the_batch(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], "seq", SCHEMA)
    t.append(spark.range(20000).selectExpr("id AS k", "1L AS seq", "cast(id AS string) AS v"), 1)
    for version in (2, 3, 4):
        t.append(rows(spark, (version, 2, "x")), version)
    sizes = data_bytes(tmp_path / "t", "delta")
    large, *small = (next(v for k, v in sizes.items() if k.endswith(f"version={n}")) for n in (1, 2, 3, 4))
    assert max(small) < large / 20 and not data_bytes(tmp_path / "t", "base") and t.read().count() == 20000


def test_reload_is_atomic_and_old_versions_go(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], "seq", SCHEMA)
    t.append(rows(spark, (1, 1, "a")), 1)
    t.append(rows(spark, (2, 1, "b")), 2)
    before = t.read()
    # a reload that dies while writing leaves the table as it was
    with pytest.raises(Exception):
        t.reload(rows(spark, (1, 1, "z")).withColumn("v", F.raise_error(F.lit("stop"))))
    assert state(t) == [(False, 1, 1, "a"), (False, 2, 1, "b")]
    assert t.reload(rows(spark, (7, 1, "new"))) == 3 and state(t) == [(False, 7, 1, "new")]
    assert before.count() == 2
    assert sorted(t.drop_old(keep=1)) == ["delta/version=1", "delta/version=2", "manifest/version=1", "manifest/version=2"]
    assert state(t) == [(False, 7, 1, "new")] and not data_bytes(tmp_path / "t", "delta")


def test_stream_replays_nothing(spark, tmp_path):
    def run(**options):
        incremental.start(spark, str(tmp_path / "in/*"), rows(spark, (1, 1, "a")).schema, str(tmp_path / options.pop("to")), ["k"], "seq", str(tmp_path / options.pop("cp")), **options).awaitTermination()
    rows(spark, (1, 1, "old"), (2, 1, "keep")).write.parquet(str(tmp_path / "in/a"))
    run(to="t", cp="c")
    rows(spark, (1, 2, "new"), (3, 1, "add")).write.parquet(str(tmp_path / "in/b"))
    run(to="t", cp="c", keep=1)
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], "seq", SCHEMA)
    assert state(table) == [(False, 1, 2, "new"), (False, 2, 1, "keep"), (False, 3, 1, "add")] and [v for v, _, _ in table.versions()] == [2]
    run(to="t", cp="lost")  # a lost checkpoint: the first batch holds all files again, and its version is written below the newest
    assert state(table)[0] == (False, 1, 2, "new")
    run(to="f", cp="c2", first_wins=True)
    assert len(state(VersionedTable(spark, str(tmp_path / "f"), ["k"], "seq", SCHEMA))) == 3


TABLE = "Intro | no row\n\n| ID | Title | Authors |\n|----|:---|--:|\n| `p1` | Old \\| one | A |\n|p2|Two  |B|\n| p3 | Three |\nAfter\n| p1 | not | a table |\n\n| pid | x |\n|-|-|\n| p1 | y |\r\nend"


def test_tables_come_out_as_rows(spark):
    got = [(r.line, r.column, r.value) for r in markdown.table_rows(spark.createDataFrame([(1, TABLE), (2, None), (3, "| a |\n| b |")], "id int, text string")).orderBy("line", "column").collect()]
    assert got == [(4, "authors", "A"), (4, "id", "p1"), (4, "title", "Old | one"), (5, "authors", "B"), (5, "id", "p2"), (5, "title", "Two"), (6, "id", "p3"), (6, "title", "Three"), (12, "pid", "p1"), (12, "x", "y")]


def test_patches_leave_other_bytes_alone(spark):
    docs = spark.createDataFrame([(1, TABLE, "e"), (2, "no table | here\n", "e"), (3, None, "e")], "id int, text string, extra string")
    patches = spark.createDataFrame([("p1", "Title", "New | a\nb"), ("p1", "title", None), ("p2", "authors", "B"), ("p3", "authors", "none there"), ("p3", "title", None), ("p9", "title", "q"), ("p1", "x", "y")], "row_key string, column string, value string")
    got = {r.id: (r.text, r.patched, r.extra) for r in markdown.patch_tables(docs, patches, ["id", "pid"]).collect()}
    want = TABLE.replace("| `p1` | Old \\| one | A |", "| `p1` | New \\| a b | A |").replace("| p3 | Three |", "| p3 | |")
    assert got == {1: (want, 2, "e"), 2: ("no table | here\n", 0, "e"), 3: (None, 0, "e")}
    again = spark.createDataFrame([(1, want)], "id int, text string")
    assert markdown.patch_tables(again, patches.where("column <> 'Title'").unionByName(spark.createDataFrame([("p1", "title", "New | a b")], patches.schema)), ["id", "pid"]).first().patched == 0
    one = patches.withColumn("id", F.lit(2))
    assert {r.id: r.patched for r in markdown.patch_tables(docs, one, ["id"]).collect()} == {1: 0, 2: 0, 3: 0}


def merge(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def test_deep_merge(spark):
    cases = [({"a": {"b": {"c": {"d": 1, "e": [1, {"x": None}]}}}, "k": "s"}, {"a": {"b": {"c": {"d": {"new": "ü\"q\""}}}, "l": []}}), ({}, {"a": 1}), ({"a": {"b": 1}}, {"a": 2}), ({"a": 2}, {"a": {"b": 1}}), ({"a": {"b": 1}}, {"a": None}),
             ({"a": {}}, {"a": {}}), ({"a.b": {"c\n": 1}}, {"a.b": {"d": True}}), ({"a": 1.5}, {}), ({"x": {"y": {"z": {"w": {"v": 1}}}}}, {"x": {"y": {"z": {"w": {"u": 2}}}}})]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(cases)] + [(90, None, '{"a":1}'), (91, '{"a":1}', None), (92, None, None)], "i int, a string, b string")
    got = {r.i: json.loads(r.merged) for r in profiles.deep_merge(df, "i", "a", "b").collect()}
    assert got == {**{i: merge(a, b) for i, (a, b) in enumerate(cases)}, 90: {"a": 1}, 91: {"a": 1}, 92: {}}


def test_files_are_registered(spark, tmp_path):
    for name, text in (("My  Paper-1.PDF", "one"), ("-second.v2.pdf", "two"), ("third", "three")):
        (tmp_path / name).write_text(text)
    empty = spark.createDataFrame([], "id string, file_name string, path string, sha256 string, size long, registered_at timestamp")
    at = lambda y: F.to_timestamp(F.lit(f"{y}-01-01 00:00:00"))
    known, changes = files.register(files.source_files(spark, str(tmp_path)), empty, at(2020))
    assert {r.id: r.change for r in changes.collect()} == {"my-paper-1": "new", "second.v2": "new", "third": "new"}
    known = spark.createDataFrame(known.collect(), known.schema)
    (tmp_path / "third").write_text("changed")
    os.remove(tmp_path / "-second.v2.pdf")
    after, changes = files.register(files.source_files(spark, str(tmp_path)), known, at(2021))
    assert {r.id: r.change for r in changes.collect()} == {"my-paper-1": "unchanged", "second.v2": "absent", "third": "changed"}
    assert {r.id: (r.size, r.registered_at.year) for r in after.collect()} == {"my-paper-1": (3, 2020), "second.v2": (3, 2020), "third": (7, 2021)}


DOCS = [(1, "Peer learning", "peers learn with peers", 2020), (2, "Design", "we learn", 2021), (3, None, "", 2021), (4, "Peer design", "peer", 2022), (5, "Other", "nothing", 2022)]


def test_index_gives_the_scores_of_the_scan(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id int, title string, body string, year int")
    search.build_index(docs, "id", ["title", "body"], str(tmp_path), buckets=16, keep=("year",))
    for asked in ("peer learn", "Design!", "unknown", ""):
        want = sorted((-r.score, r.id) for r in search.bm25(docs, "id", ["title", "body"], asked).collect())
        got = [(-r.score, r.id) for r in search.search_index(spark, str(tmp_path), "id", ["title", "body"], asked).collect()]
        assert got == want, asked
    late = search.search_index(spark, str(tmp_path), "id", ["title", "body"], "peer learn", where=F.col("year") > 2020).collect()
    assert {r.id for r in late} == {2, 4}
    plan = search.search_index(spark, str(tmp_path), "id", ["title", "body"], "peer")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_own_scorers_load_once_a_worker(spark, tmp_path):
    mark = tmp_path / "loads"
    mark.mkdir()
    where = str(mark)

    def loader():
        import os
        import uuid

        open(f"{where}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda asked, passages: [float(len(p)) for p in passages]

    def shortest():
        return lambda asked, passages: [-float(len(p)) for p in passages]
    hits = spark.range(200).selectExpr("id", "repeat('x', cast(id % 50 as int)) AS t", "1.0 AS score").repartition(12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for _ in range(2):
            top = [r.id for r in search.rerank(hits, "q", F.col("t"), "id", 3, load=loader).collect()]
            assert top == [49, 99, 149]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    loads = [p.name.split("-")[0] for p in mark.iterdir()]
    assert loads and len(loads) == len(set(loads))
    assert [r.id for r in search.rerank(hits.union(spark.sql("SELECT 999L, null, 1.0")), "q", F.col("t"), "id", 2, load=shortest).collect()] == [0, 50]


def test_snippet_takes_terms_literally(spark):
    assert spark.createDataFrame([("we use c++ here",)], "t string").select(search.snippet(F.col("t"), ["c("])).first()[0] is None


def test_manifest_entries_are_set_or_appended(spark):
    manifest = spark.createDataFrame([("a", "A", 1, "note"), ("b", "B", 2, None)], "id string, name string, n int, note string")
    changes = spark.createDataFrame([("a", None, 9), ("c", "C", None)], "id string, name string, n int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(upserts.update_or_append(manifest, changes, "id")) == [("a", "A", 9, "note"), ("b", "B", 2, None), ("c", "C", None, None)]
    assert rows(upserts.update_or_append(manifest, changes, "id", append=False)) == [("a", "A", 9, "note"), ("b", "B", 2, None)]


def test_synchronised_counts_changes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "c", "x"), (None, "d", "x")], "id int, title string, authors string")
    master = spark.createDataFrame([(1, "a", "y"), (2, "b", None), (9, "z", "z")], "id int, title string, authors string")
    out, counts = upserts.synchronised(old, master, "id", ["title", "authors"])
    assert {r.id: (r.title, r.authors) for r in out.collect()} == {1: ("a", "y"), 2: ("b", None), 3: ("c", "x"), None: ("d", "x")}
    assert tuple(counts.first()) == (1, 2)


def test_first_conference_header_alone_changes(spark):
    df = spark.createDataFrame([("a **Conference:** ISLS  2021 b **Conference:** ISLS 2022", "X$1"), ("none", "X"), (None, "X"), ("**Conference:** ICLS 2021", "X")], "t string, c string")
    assert [r[0] for r in df.select(upserts.conference_header("t", "c")).collect()] == ["a **Conference:** X$1 2021 b **Conference:** ISLS 2022", "none", None, "**Conference:** ICLS 2021"]


def test_ties_in_an_upsert_do_not_depend_on_chance(spark):
    old = spark.createDataFrame([], "k int, seq int, v string")
    new = [(1, 1, v) for v in "bcad"] + [(1, 1, None)]
    for order in (new, new[::-1]):
        assert upserts.upsert(old, spark.createDataFrame(order, old.schema).repartition(3), ["k"], "seq").first().v == "d"
    moved = upserts.rekey(spark.createDataFrame([(1, "z"), (2, "y"), (2, "x")], "p int, v string"), spark.createDataFrame([(2, 1)], "old_key int, new_key int"), "p", ["p"])
    assert [tuple(r) for r in moved.collect()] == [(1, "x")]

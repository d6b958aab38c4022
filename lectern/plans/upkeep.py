"""Versions of tables, patched Markdown tables, merged profiles, file registries, stored postings: as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markdown, profiles, quality, review, search, similarity, upserts
from ..sources import files
from ..sources.tables import table
from ..sources.versions import VersionedTable, workspace
from . import roles as R
from .corpus import _BM25
from .registering import registry

FOUND, SQL, query = registry()


# ---------------------------------------------------------------- tables in versions

_EVENTS = "user_id long, event_id long, event_type string"


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "event_type")


def _loaded(spark, d, compact_every: int, first_wins: bool = False) -> VersionedTable:
    """The events in four batches, one of them sent twice."""
    t = VersionedTable(spark, workspace(spark, "events"), ["user_id"], "event_id", _EVENTS, compact_every)
    for version in (1, 2, 3, 2, 4):
        (t.append_new if first_wins else t.append)(_events(spark, d).where(F.col("event_id") % 4 == version - 1), version)
    return t


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) n FROM events) WHERE n = 1")
def stm1_merged_batches(spark, d):
    return _loaded(spark, d, 3).read()


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, event_id DESC) n FROM events) WHERE n = 1")
def stm1_first_of_batches(spark, d):
    return _loaded(spark, d, 16, True).read()


@query("SELECT user_id, min(event_id) AS event_id, 'reloaded' AS event_type FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def ups6_reload(spark, d):
    t = _loaded(spark, d, 16)
    t.reload(_events(spark, d).where("user_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.lit("reloaded").alias("event_type")))
    return t.read()


# ---------------------------------------------------------------- Markdown tables

_ROW = "concat('| `k', {i}, '` | ', replace(x, '|', '\\\\|'), ' |', source, '|')"


@query("""WITH t AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id, source, unnest(range(len(l))) AS i, unnest(l) AS x FROM t),
 n AS (SELECT c.*, r_name || '|' || reverse(r_name) AS v FROM c LEFT JOIN region ON r_regionkey = i),
 o AS (SELECT doc_id, i, CASE WHEN v IS NOT NULL THEN '| `k' || i || '` | ' || replace(v, '|', '\\|') || ' |' || source || '|' ELSE '| `k' || i || '` | ' || replace(x, '|', '\\|') || ' |' || source || '|' END AS line, v FROM n)
 SELECT doc_id AS id, 'Before |' || chr(10) || '| ID | Title | Source |' || chr(10) || '|---|:--|---|' || chr(10) || string_agg(line, chr(10) ORDER BY i) || chr(10) || 'After | it' AS text, count(v) AS patched FROM o GROUP BY doc_id""")
def ups9_patched_tables(spark, d):
    rows = "array_join(transform(split(text, chr(10)), (x, i) -> " + _ROW.format(i="i") + "), chr(10))"
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(f"concat('Before |', chr(10), '| ID | Title | Source |', chr(10), '|---|:--|---|', chr(10), {rows}, chr(10), 'After | it')").alias("text"))
    patches = table(spark, d, "region").select(F.concat(F.lit("k"), "r_regionkey").alias("row_key"), F.lit("title").alias("column"), F.concat("r_name", F.lit("|"), F.reverse("r_name")).alias("value"))
    return markdown.patch_tables(docs, patches, ["id", "pid"])


@query("""SELECT doc_id AS id, (i + 2)::INTEGER AS line, u.c AS column, CASE u.c WHEN 'id' THEN 'k' || i WHEN 'title' THEN regexp_replace(x, '^[\\s`]+|[\\s`]+$', '', 'g') ELSE source END AS value
 FROM (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents), LATERAL (VALUES ('id'), ('title'), ('source')) u(c)""")
def ups9_table_rows(spark, d):
    rows = "array_join(transform(split(text, chr(10)), (x, i) -> " + _ROW.format(i="i") + "), chr(10))"
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(f"concat('| ID | Title | Source |', chr(10), '|---|:--|---|', chr(10), {rows})").alias("text"))
    return markdown.table_rows(docs)


# ---------------------------------------------------------------- profiles

_BASE = "concat('{\"a\":{\"b\":{\"c\":', cast(length(text) AS {text}), ',\"d\":[1,{\"q\":null}]},\"x\":[1,2]},\"k\":\"', source, '\",\"z\":{\"y\":{\"w\":{\"v\":true}}}}')"
_OVER = "CASE doc_id % 6 WHEN 0 THEN '{\"a\":{\"b\":{\"d\":2,\"e\":\"u|\\u00e9\"}}}' WHEN 1 THEN '{\"a\":{\"x\":[3]},\"new\":{\"m\":{}}}' WHEN 2 THEN '{\"a\":1}' WHEN 3 THEN '{\"z\":{\"y\":{\"w\":{\"v\":false,\"t\":1.5}}},\"k\":\"o\"}' WHEN 4 THEN '{}' END"
_PATHS = {"c": "$.a.b.c", "d": "$.a.b.d", "e": "$.a.b.e", "x": "$.a.x", "k": "$.k", "v": "$.z.y.w.v", "t": "$.z.y.w.t", "m": "$.new.m"}


@query(f"""WITH m AS (SELECT doc_id, json_merge_patch(CAST({_BASE.replace('{text}', 'VARCHAR').replace('null', '0')} AS JSON), CAST(coalesce({_OVER}, '{{}}') AS JSON)) AS j FROM documents)
 SELECT doc_id, {', '.join(f"json_extract_string(j, '{p}') AS {n}" for n, p in _PATHS.items())}, CASE WHEN doc_id % 6 = 2 THEN json_extract_string(j, '$.a') END AS a FROM m""")
def map1_deep_merge(spark, d):
    both = table(spark, d, "documents").select("doc_id", F.expr(_BASE.replace("{text}", "STRING").replace("null", "0")).alias("b"), F.expr(_OVER).alias("o"))
    m = profiles.deep_merge(both, "doc_id", "b", "o")
    return m.select("doc_id", *[F.get_json_object("merged", p).alias(n) for n, p in _PATHS.items()], F.when(F.col("doc_id") % 6 == 2, F.get_json_object("merged", "$.a")).alias("a"))


_PROFILES = [("common", '{"profile": {"id": "common", "limits": {"rows": 10, "marks": ["a", "b"]}}, "roles": {"method": ["methods"], "results": ["findings"]}}'),
             ("first", '{"profile": {"id": "first", "limits": {"rows": 99}}, "roles": {"method": ["design"]}}'), ("second", '{"profile": {"limits": {"marks": []}}, "extra": {"deep": {"deeper": 1}}}')]


@query("""SELECT doc_id, CASE WHEN regexp_matches(source, '(?i)SRC1') THEN 'first' WHEN regexp_matches(source, '(?i)src.$') THEN 'second' ELSE 'common' END AS profile_id,
 CASE WHEN regexp_matches(source, '(?i)SRC1') THEN '99' ELSE '10' END AS rows, CASE WHEN NOT regexp_matches(source, '(?i)SRC1') AND regexp_matches(source, '(?i)src.$') THEN '[]' ELSE '["a","b"]' END AS marks,
 CASE WHEN regexp_matches(source, '(?i)SRC1') THEN '["design"]' ELSE '["methods"]' END AS method, '["findings"]' AS results, CASE WHEN NOT regexp_matches(source, '(?i)SRC1') AND regexp_matches(source, '(?i)src.$') THEN '1' END AS deeper FROM documents""")
def src7_resolved_profiles(spark, d):
    layered = spark.createDataFrame(_PROFILES, "profile_id string, document string")
    got = profiles.resolve(table(spark, d, "documents").select("doc_id", "source"), "source", layered, [("first", "SRC1"), ("second", "src.$")], "common")
    paths = {"rows": "$.profile.limits.rows", "marks": "$.profile.limits.marks", "method": "$.roles.method", "results": "$.roles.results", "deeper": "$.extra.deep.deeper"}
    return got.select("doc_id", "profile_id", *[F.get_json_object("profile", p).alias(n) for n, p in paths.items()])


# ---------------------------------------------------------------- files

@query("""WITH f AS (SELECT 'my-doc-' || doc_id AS id, doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents)
 SELECT id, CASE doc_id % 3 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' ELSE 'new' END AS change, sha256, size, doc_id % 3 = 0 AS as_before FROM f
 UNION ALL SELECT 'gone-' || r_regionkey, 'absent', 'old', 1, true FROM region""")
def src13_registered_files(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/"), "source", F.lit("/-My  Doc "), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    then = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    known = docs.where("doc_id % 3 < 2").select(F.concat(F.lit("my-doc-"), "doc_id").alias("id"), F.lit("f").alias("file_name"), "path", F.when(F.col("doc_id") % 3 == 0, F.sha2("content", 256)).otherwise("other").alias("sha256"), F.length("content").cast("long").alias("size"), then.alias("registered_at"))
    gone = table(spark, d, "region").select(F.concat(F.lit("gone-"), "r_regionkey").alias("id"), F.lit("f").alias("file_name"), F.lit("p").alias("path"), F.lit("old").alias("sha256"), F.lit(1).cast("long").alias("size"), then.alias("registered_at"))
    after, changes = files.register(docs, known.unionByName(gone))
    return after.join(changes, "id").select("id", "change", "sha256", "size", (F.col("registered_at") == then).alias("as_before"))


# ---------------------------------------------------------------- search

@query(_BM25 + " SELECT id, score FROM s ORDER BY score DESC, id LIMIT 50")
def ir3_index_search(spark, d):
    path = workspace(spark, "postings")
    search.build_index(R.papers(spark, d), "id", ["title", "body"], path)
    return search.search_index(spark, path, "id", ["title", "body"], "Trash, thing!", 50)


def by_length():
    """A scorer to show the contract: the share of a passage's letters that a query's letters would be."""
    return lambda asked, passages: [len(asked) / max(len(p), 1) for p in passages]


@query(_BM25 + ", h AS (SELECT s.id, score, round_even(13.0::DOUBLE / greatest(length(title), 1), 4) AS rerank_score FROM s JOIN " + R.PAPERS + " p ON p.id = s.id ORDER BY score DESC, s.id LIMIT 50) SELECT id, rerank_score FROM h ORDER BY rerank_score DESC, score DESC, id LIMIT 15")
def ir9_own_scorer(spark, d):
    hits = search.search(R.papers(spark, d), "id", ["title", "body"], "Trash, thing!", 50)
    return search.rerank(hits, "Trash, thing!", F.col("title"), "id", 15, load=by_length).select("id", "rerank_score")


# ---------------------------------------------------------------- matching files to papers

_STEM = "CASE doc_id % 4 WHEN 0 THEN concat('doc-', doc_id, '-') WHEN 1 THEN concat('pre-v1-doc-', doc_id, '-end-post') ELSE concat('other', doc_id) END"
_TITLE = "CASE doc_id % 4 WHEN 2 THEN concat(' ', substr(text, 1, 60), '!') WHEN 3 THEN concat(substr(text, 1, 44), ' changed ', doc_id) ELSE '' END"
_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH f AS (SELECT doc_id AS file_id, {_STEM} AS stem, {_KEY.format(_TITLE)} AS k FROM documents), p AS (SELECT 'v1-doc-' || doc_id || '-end' AS paper_id, {_KEY.format('substr(text, 1, 60)')} AS k FROM documents),
 m AS (SELECT file_id, paper_id, CASE WHEN contains(paper_id, stem) OR contains(stem, paper_id) THEN 1 WHEN f.k <> '' AND f.k = p.k THEN 2 WHEN length(f.k) > 20 AND (contains(p.k, substr(f.k, 1, 30)) OR (length(p.k) > 20 AND contains(f.k, substr(p.k, 1, 30)))) THEN 3 END AS tier FROM f, p)
 SELECT file_id, arg_min(paper_id, tier::VARCHAR || paper_id) AS paper_id, min(tier) AS tier FROM m WHERE tier IS NOT NULL GROUP BY 1""")
def jn12_file_cascade(spark, d):
    rows = table(spark, d, "documents")
    given = rows.select(F.col("doc_id").alias("file_id"), F.expr(_STEM).alias("stem"), F.expr(_TITLE).alias("title"))
    papers = rows.select(F.concat(F.lit("v1-doc-"), "doc_id", F.lit("-end")).alias("paper_id"), F.substring("text", 1, 60).alias("title"))
    return similarity.cascade(given, papers)


# ---------------------------------------------------------------- manifests, headers, synchronisation, reports

@query("""WITH m AS (SELECT doc_id AS id, source AS name, n_chars AS papers, 'kept' AS note FROM documents WHERE doc_id % 2 = 0), c AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' END AS name, quality AS papers FROM labels)
 SELECT coalesce(m.id, c.id) AS id, coalesce(c.name, m.name) AS name, coalesce(c.papers, m.papers)::BIGINT AS papers, note FROM m FULL JOIN c ON c.id = m.id""")
def ups11_manifest_entries(spark, d):
    manifest = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("n_chars").cast("long").alias("papers"), F.lit("kept").alias("note"))
    changes = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").alias("name"), F.col("quality").cast("long").alias("papers"))
    return upserts.update_or_append(manifest, changes, "id")


_HEADED = "concat(substr(text, 1, 30), CASE doc_id % 3 WHEN 0 THEN concat(chr(10), '**Conference:** ISLS  2019', chr(10), '**Conference:** ISLS 2020') WHEN 1 THEN '**Conference:** ICLS 2019' ELSE '' END, substr(text, 31))"


@query(f"SELECT doc_id, regexp_replace({_HEADED}, '\\*\\*Conference:\\*\\*\\s*ISLS\\s+(\\d{{4}})', '**Conference:** ' || upper(source) || ' \\1') AS text FROM documents")
def ups10_conference_headers(spark, d):
    return table(spark, d, "documents").select("doc_id", upserts.conference_header(F.expr(_HEADED), F.upper("source")).alias("text"))


@query("SELECT count(*) FILTER (source IS DISTINCT FROM s) AS source_changes, count(*) FILTER (lang IS DISTINCT FROM l) AS lang_changes FROM documents JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'src1' END AS s, CASE WHEN toxic = 1 THEN 'xx' ELSE 'en' END AS l FROM labels) USING (doc_id)")
def agg19_sync_counters(spark, d):
    master = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "src1").alias("source"), F.when(F.col("toxic") == 1, "xx").otherwise("en").alias("lang"))
    return upserts.synchronised(table(spark, d, "documents").select("doc_id", "source", "lang"), master, "doc_id", ["source", "lang"])[1]


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN source WHEN quality = 1 THEN 'src1' END AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def ups8_synchronised(spark, d):
    master = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "src1").alias("source"))
    return upserts.synchronised(table(spark, d, "documents").select("doc_id", "source"), master, "doc_id", ["source"])[0]


@query("""SELECT c_custkey AS review_id, count(DISTINCT p) AS papers FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS p FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0) UNION SELECT c_custkey, -1 FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey GROUP BY 1""")
def ups12_review_list(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("review_id"), F.col("o_orderkey").alias("paper_id"), "o_orderstatus")
    reviews = table(spark, d, "customer").select(F.col("c_custkey").alias("review_id"))
    added = reviews.where("review_id % 3 = 0").select("review_id", F.lit(-1).cast("long").alias("paper_id"))
    now = upserts.members(orders, added, orders.where("o_orderstatus = 'F' and paper_id % 2 = 0").select("review_id", "paper_id"))
    return upserts.listed_members(now, reviews)


_REPORT = """SELECT (SELECT count(*) FROM documents) AS detected_papers, (SELECT round(avg(CASE WHEN doc_id % 4 > 0 THEN (doc_id % 100) / 100.0::DOUBLE END), 3) FROM documents) AS confidence, (SELECT count(*) FROM documents WHERE doc_id % 9 = 0 OR trim(split_part(text, chr(10), 1)) = '') AS missing_title,
 (SELECT count(*) FROM documents WHERE doc_id % 7 < 2) AS missing_authors, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS missing_abstract, (SELECT count(*) FROM conversations WHERE role <> 'user') AS unmapped_headings, (SELECT count(*) FROM benchmark) AS expected_papers"""


@query(_REPORT)
def qua9_ingestion_report(spark, d):
    title = F.when(F.col("doc_id") % 9 > 0, F.split_part("text", F.lit("\n"), F.lit(1)))
    people = F.when(F.col("doc_id") % 7 > 1, F.array("source")).when(F.col("doc_id") % 7 > 0, F.array().cast("array<string>"))
    papers = table(spark, d, "documents").select(title.alias("title"), people.alias("authors"), F.when(F.col("doc_id") % 5 > 0, "text").otherwise(" ").alias("abstract"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 100 / 100.0).alias("confidence"))
    parts = R.turns(spark, d).select(F.when(F.col("heading") == "user", F.array("heading")).alias("roles"))
    return quality.ingestion_report(papers, parts, table(spark, d, "benchmark"))


@query(_REPORT)
def snk18_report_file(spark, d):
    path = workspace(spark, "report")
    review.report(qua9_ingestion_report(spark, d), path)
    return spark.read.schema("detected_papers long, confidence double, missing_title long, missing_authors long, missing_abstract long, unmapped_headings long, expected_papers long").json(path)

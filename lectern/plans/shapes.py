"""Queries on shapes: columns, lists, maps, JSON, names, caps, exports and reloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import review
from ..sources.tables import table
from . import roles as R
from .registering import registry

FOUND, SQL, query = registry()


@query("SELECT c_custkey, c_nationkey, c_mktsegment, c_name FROM customer")
def prj4_placed_column(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    return review.place(c, "c_nationkey", after="c_custkey", drop=("c_acctbal",)).select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")


@query("SELECT doc_id, source AS place, n_chars AS size FROM documents")
def prj5_flat_values(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.struct(F.col("source").alias("value"), F.lit("given").alias("status")).alias("place"), F.struct(F.col("n_chars").alias("value")).alias("size"))
    return review.flat_values(s)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def prj6_visible_columns(spark, d):
    o = table(spark, d, "orders")
    visible = [c for c in o.columns if c in ("o_orderkey", "o_orderstatus", "o_orderpriority")]
    return o.select(*visible)


@query("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def prj8_protected_delete(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return review.without_rows(review.without_columns(docs, ["lang"]), gone).select(F.col("id").alias("doc_id"), "source")


@query("""SELECT c_custkey, CASE WHEN starts_with(n, 'Agentic Review') THEN n ELSE p || ' - ' || CASE WHEN n = '' THEN lower(c_mktsegment) || ', review' ELSE n END END AS name, CASE WHEN starts_with(n, 'Agentic Review') THEN 'Agentic Review' ELSE p END AS protocol
 FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey % 3 = 0 THEN '' WHEN c_nationkey % 3 = 1 THEN c_name ELSE 'Agentic Review - ' || c_name END AS n, CASE WHEN c_custkey % 2 = 0 THEN 'Expanded Scope' ELSE 'Dipstick Review' END AS p FROM customer)""")
def prj9_review_name(spark, d):
    name = F.when(F.col("c_nationkey") % 3 == 0, "").when(F.col("c_nationkey") % 3 == 1, F.col("c_name")).otherwise(F.concat(F.lit("Agentic Review - "), "c_name"))
    fields = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("title"), F.lit("sections"))).otherwise(F.array(F.lit("title")))
    named, protocol = review.review_name(name, F.array(F.lower("c_mktsegment"), F.lit("review")), search_fields=fields)
    return table(spark, d, "customer").select("c_custkey", named.alias("name"), protocol.alias("protocol"))


@query("""SELECT p_partkey, CASE WHEN v = 1 THEN 'Full Paper' WHEN n >= 6 THEN CASE WHEN v = 2 THEN 'Symposium' ELSE 'Full Paper' END WHEN n BETWEEN 3 AND 5 THEN 'Short Paper' WHEN n BETWEEN 1 AND 2 THEN 'Poster'
 WHEN v = 2 AND contains(lower(p_name), 'symposium') THEN 'Symposium' WHEN v = 3 THEN 'Poster' ELSE 'Short Paper' END AS kind
 FROM (SELECT p_partkey, p_name, nullif(p_partkey % 5, 4) AS v, CASE WHEN p_size > 8 THEN NULL ELSE p_size END AS n FROM part)""")
def str3_type_table(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.nullif(F.col("p_partkey") % 5, F.lit(4)).alias("v"), F.when(F.col("p_size") <= 8, F.col("p_size")).alias("n"))
    return p.select("p_partkey", T.volume_type("v", "n", "p_name", F.lit("")).alias("kind"))


@query("SELECT doc_id, list_filter(regexp_extract_all(split_part(text, chr(10), 1), '[A-Za-z]+'), lambda w: length(w) > 6)[1:5] AS words FROM documents")
def lim3_capped_lists(spark, d):
    words = F.filter(F.regexp_extract_all(T.first_line("text"), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) > 6)
    return table(spark, d, "documents").select("doc_id", F.slice(words, 1, 5).alias("words"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def lim5_next_batch(spark, d):
    """The next hundred pending papers: the cap is the feature."""
    return table(spark, d, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderdate")


@query(f"SELECT id, len(list_intersect(list_distinct(string_split(lower(title), ' ')), list_distinct(string_split(lower(body), ' '))))::BIGINT AS common FROM {R.PAPERS}")
def set4_common_words(spark, d):
    return R.papers(spark, d).select("id", F.size(F.array_intersect(F.split(F.lower("title"), " "), F.split(F.lower("body"), " "))).cast("long").alias("common"))


@query("SELECT doc_id, list_sort(list_filter(list_distinct([source, lang, 'title', 'id']), lambda x: x IS NOT NULL AND x NOT IN ('id', 'title'))) AS extra FROM documents")
def set8_extra_columns(spark, d):
    chosen, visible = F.array("source", F.lit("title")), F.array("lang", F.lit("id"))
    extra = F.array_except(F.array_union(chosen, visible), F.array(*map(F.lit, ["id", "title"])))
    return table(spark, d, "documents").select("doc_id", F.sort_array(F.array_compact(extra)).alias("extra"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, '2024-01-02T03:04:05Z' AS extracted_at FROM orders")
def dte1_timestamps(spark, d):
    now = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "orders").select("o_orderkey", iso(F.col("o_orderdate").cast("timestamp_ntz")).alias("created_at"), iso(now).alias("extracted_at"))


@query("SELECT p_partkey, array_to_string(list_distinct_in_order, '|') AS words, has_steel FROM (SELECT p_partkey, list_concat(w[1:1], ['new'], w[2:]) AS list_distinct_in_order, list_contains(w, 'STEEL') AS has_steel FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part))")
def arr1_list_operations(spark, d):
    w = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_insert(w, 2, F.lit("new")), "|").alias("words"), F.array_contains(w, "STEEL").alias("has_steel"))


@query("SELECT c_custkey, c_name AS display_name FROM customer")
def arr2_coerced_names(spark, d):
    """Author lists as JSON, of strings or of objects with a name: the name in either case."""
    text = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.array("c_name"))).otherwise(F.to_json(F.array(F.struct(F.col("c_name").alias("name")))))
    objects, plain = F.from_json("j", "array<struct<name string>>"), F.from_json("j", "array<string>")
    names = F.when(F.col("j").startswith('[{'), F.transform(objects, lambda x: x["name"])).otherwise(plain)
    return table(spark, d, "customer").select("c_custkey", text.alias("j")).select("c_custkey", F.explode(names).alias("display_name"))


@query("SELECT p_partkey, 'base' AS a, p_brand AS b, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c FROM part")
def map1_merged_maps(spark, d):
    """Nested maps: the override wins key by key, one level down as well."""
    base = F.create_map(F.lit("x"), F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit("base")), F.lit("y"), F.create_map(F.lit("c"), F.lit("small")))
    over = F.create_map(F.lit("x"), F.create_map(F.lit("b"), F.col("p_brand")), F.lit("y"), F.when(F.col("p_size") > 25, F.create_map(F.lit("c"), F.lit("big"))))
    merged = F.map_zip_with(base, over, lambda _, m, n: F.map_zip_with(m, F.coalesce(n, m), lambda _, x, y: F.coalesce(y, x)))
    m = table(spark, d, "part").select("p_partkey", merged.alias("m"))
    return m.select("p_partkey", F.col("m")["x"]["a"].alias("a"), F.col("m")["x"]["b"].alias("b"), F.col("m")["y"]["c"].alias("c"))


@query("SELECT doc_id, source AS place, n_chars AS size, NULL::VARCHAR AS wrong FROM documents")
def jsn1_nested_get(spark, d):
    """A JSON column parsed by schema; a field of another type than asked is null."""
    raw = F.to_json(F.struct(F.struct(F.col("source").alias("place"), F.col("n_chars").alias("size")).alias("meta")))
    j = table(spark, d, "documents").select("doc_id", raw.alias("data_json"))
    v = j.select("doc_id", F.from_json("data_json", "meta struct<place string, size bigint>").alias("x"), F.from_json("data_json", "meta struct<place bigint>").alias("y"))
    return v.select("doc_id", "x.meta.place", "x.meta.size", F.col("y.meta.place").cast("string").alias("wrong"))


@query("""SELECT CAST(o.o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, coalesce(CAST(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END)::BIGINT AS VARCHAR), '') AS returned, coalesce(CAST(max(CASE WHEN l_returnflag = 'N' THEN l_quantity END)::BIGINT AS VARCHAR), '') AS held
 FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o.o_orderkey, o_orderpriority""")
def snk11_review_csv(spark, d):
    papers = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    kind = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "N", "held")
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), kind.alias("property_id")).agg(F.max(F.col("l_quantity").cast("long")).alias("value"))
    return review.review_csv(papers, seen, ["returned", "held"])


@query("""WITH s AS (SELECT l_orderkey AS paper_id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
 SELECT o_custkey AS review_id, count(*) AS papers, sum(coalesce(n, 0))::BIGINT AS observed FROM orders LEFT JOIN s ON paper_id = o_orderkey GROUP BY 1""")
def snk17_bundles(spark, d):
    o = table(spark, d, "orders")
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("property_id")).agg(F.max("l_quantity").alias("value"))
    got = review.bundles(o.select(F.col("o_custkey").alias("review_id"), F.col("o_orderkey").alias("paper_id")), o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")), seen)
    whole = F.size(F.from_json("bundle", "entries array<struct<paper_id bigint>>")["entries"])
    return got.where(whole == F.col("papers")).select("review_id", "papers", "observed")


@query("SELECT p_partkey, replace(p_name, '.', '_') || '.json' AS file FROM part")
def snk19_definition_files(spark, d):
    return table(spark, d, "part").select("p_partkey", review.definition_file(F.col("p_name")).alias("file"))


@query("SELECT id, coalesce(e, c) AS hit FROM (SELECT n.n_nationkey AS id, (SELECT min(c_custkey) FROM customer WHERE c_custkey = n.n_nationkey AND c_custkey % 2 = 0) AS e, (SELECT min(r_regionkey) FROM region WHERE contains(n.n_name, r_name) OR r_regionkey = n.n_regionkey) AS c FROM nation n)")
def jn26_contains_fallback(spark, d):
    """An exact match by id, else the first region that the text contains or the key names."""
    n = table(spark, d, "nation")
    exact = n.join(table(spark, d, "customer"), (F.col("c_custkey") == F.col("n_nationkey")) & (F.col("c_custkey") % 2 == 0)).groupBy("n_nationkey").agg(F.min("c_custkey").alias("e"))
    rest = n.join(exact, "n_nationkey", "left_anti")
    inside = F.col("n_name").contains(F.col("r_name")) | (F.col("r_regionkey") == F.col("n_regionkey"))
    near = rest.join(F.broadcast(table(spark, d, "region")), inside).groupBy("n_nationkey").agg(F.min("r_regionkey").alias("c"))  # five regions
    both = n.join(exact, "n_nationkey", "left").join(near, "n_nationkey", "left")
    return both.select(F.col("n_nationkey").alias("id"), F.coalesce(F.col("e"), F.col("c")).alias("hit"))

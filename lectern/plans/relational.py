"""Filters, joins, aggregations, sorts, sets and network analytics as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import network
from ..sources.tables import table, top_layer
from . import roles as R
from .registering import registry

FOUND, SQL, query = registry()


# ---------------------------------------------------------------- filters and projections

@query(f"SELECT paper_id, year FROM {R.DATED} WHERE year BETWEEN 1994 AND 1996")
def flt1_year_range(spark: SparkSession, d: str) -> DataFrame:
    return R.dated(spark, d).where(F.col("year").between(1994, 1996)).select("paper_id", "year")


@query(f"SELECT paper_id, conference FROM {R.DATED} WHERE conference ILIKE '%high%' OR conference ILIKE '%low%'")
def flt2_substring(spark, d):
    return R.dated(spark, d).where(F.col("conference").ilike("%high%") | F.col("conference").ilike("%low%")).select("paper_id", "conference")


@query(f"SELECT paper_id, order_index FROM {R.TURNS} WHERE heading = 'user'")
def flt3_exact_section(spark, d):
    return R.turns(spark, d).where(F.col("heading") == "user").select("paper_id", "order_index")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'trash') OR contains(lower(text), 'license')")
def flt4_any_keyword(spark, d):
    return table(spark, d, "documents").where(F.lower("text").contains("trash") | F.lower("text").contains("license")).select("doc_id")


@query(r"SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}])(?i:idiot)($|[^\p{L}\p{N}])') AS idiot, regexp_matches(text, '(^|[^\p{L}\p{N}])(?i:that)($|[^\p{L}\p{N}])') AS that FROM documents")
def flt5_word_bounded(spark, d):
    def word(w):
        return F.col("text").rlike(rf"(^|[^\p{{L}}\p{{N}}])(?i:{w})($|[^\p{{L}}\p{{N}}])")
    return table(spark, d, "documents").select("doc_id", word("idiot").alias("idiot"), word("that").alias("that"))


@query(f"SELECT id FROM {R.PAPERS} p WHERE conference IN ('src1', 'src2') AND paper_type <> 'de' AND id NOT IN (1, 2, 3) AND contains(lower(title), 'the')")
def flt6_scope(spark, d):
    p = R.papers(spark, d)
    return p.where(F.col("conference").isin("src1", "src2") & (F.col("paper_type") != "de") & ~F.col("id").isin(1, 2, 3) & F.lower("title").contains("the")).select("id")


@query(f"SELECT DISTINCT paper_id FROM {R.TURNS} WHERE text ILIKE '%the the%' OR text ILIKE '%of the%'")
def flt7_phrase_sections(spark, d):
    return R.turns(spark, d).where(F.col("text").ilike("%the the%") | F.col("text").ilike("%of the%")).select("paper_id").distinct()


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def flt8_in_list(spark, d):
    wanted = table(spark, d, "nation").where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(wanted, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query(f"SELECT id, body IS NULL OR trim(body) = '' AS is_blank FROM {R.PAPERS}")
def flt9_null_or_blank(spark, d):
    from ..functions.text import blank
    return R.papers(spark, d).select("id", blank("body").alias("is_blank"))


@query("SELECT doc_id, CAST(length(trim(text)) AS INTEGER) AS size FROM documents WHERE length(trim(text)) > 0 AND length(trim(text)) < 150")
def flt10_short_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(F.trim("text")).alias("size")).where("size > 0 and size < 150")


@query(f"SELECT paper_id FROM {R.DATED} WHERE status IS DISTINCT FROM 'F'")
def flt11_pending(spark, d):
    return R.dated(spark, d).where(~F.col("status").eqNullSafe("F")).select("paper_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000 AND (o_orderstatus LIKE 'O%' OR o_orderstatus LIKE 'P%')")
def flt12_many_predicates(spark, d):
    o = table(spark, d, "orders")
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= 1000) & (F.col("o_orderstatus").like("O%") | F.col("o_orderstatus").like("P%"))).select("o_orderkey")


@query("SELECT * FROM part WHERE CAST(p_partkey AS VARCHAR) ILIKE '%12%' OR p_name ILIKE '%12%' OR p_brand ILIKE '%12%' OR p_type ILIKE '%12%' OR CAST(p_size AS VARCHAR) ILIKE '%12%'")
def flt13_any_column(spark, d):
    from functools import reduce
    p = table(spark, d, "part")
    return p.where(reduce(lambda a, b: a | b, [F.col(c).cast("string").ilike("%12%") for c in p.columns if c != "p_retailprice"]))


@query(f"SELECT id, line FROM {R.LINES} WHERE NOT regexp_matches(text, '(?i)(licensed under|all rights)') AND length(text) > 15 AND starts_with(text, 'The')")
def flt14_stop_list(spark, d):
    keep = ~F.col("text").rlike("(?i)(licensed under|all rights)") & (F.length("text") > 15) & F.col("text").startswith("The")
    return R.lines(spark, d).where(keep).select("id", "line")


@query(f"SELECT id, n_chars FROM {R.PAPERS} WHERE body <> '' AND length(body) > 50 ORDER BY id LIMIT 20")
def flt15_rich_rows(spark, d):
    return R.papers(spark, d).where((F.col("body") != "") & (F.length("body") > 50)).orderBy("id").limit(20).select("id", "n_chars")


@query(f"SELECT id, line FROM {R.LINES} WHERE length(text) >= 20 AND (contains(text, ' | ') OR contains(text, '@') OR contains(text, '!!'))")
def flt16_signature(spark, d):
    marks = F.col("text").contains(" | ") | F.col("text").contains("@") | F.col("text").contains("!!")
    return R.lines(spark, d).where((F.length("text") >= 20) & marks).select("id", "line")


@query("SELECT o_orderkey, CASE WHEN l >= f THEN l - f + 1 END AS pages FROM (SELECT l_orderkey AS o_orderkey, min(l_linenumber) AS f, max(l_linenumber) AS l FROM lineitem GROUP BY 1)")
def prj1_page_count(spark, d):
    from ..functions.text import page_count
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("f"), F.max("l_linenumber").alias("l"))
    return g.select("o_orderkey", page_count("f", "l").alias("pages"))


@query("SELECT d.doc_id, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def prj2_defaults(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return both.select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS v, event_type FROM events")
def src5_json_column(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("v"), "event_type")


@query("SELECT p_partkey, p_brand, p_name FROM (SELECT p_partkey, p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) n FROM part) WHERE n = 1")
def src6_layered_definitions(spark, d):
    return top_layer(table(spark, d, "part").select("p_partkey", "p_brand", "p_name"), "p_brand", "p_partkey")


# ---------------------------------------------------------------- joins

@query(f"SELECT a.paper_id, a.author_id, p.year FROM {R.PAPER_AUTHORS} a JOIN {R.DATED} p USING (paper_id)")
def jn1_inner(spark, d):
    return R.paper_authors(spark, d).join(R.dated(spark, d), "paper_id").select("paper_id", "author_id", "year")


@query(f"SELECT paper_id, string_agg(s_name, '; ' ORDER BY author_order, author_id) AS authors FROM {R.PAPER_AUTHORS} JOIN supplier ON s_suppkey = author_id GROUP BY 1")
def jn2_ordered_authors(spark, d):
    both = R.paper_authors(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), "s_name"), "author_id")
    return both.groupBy("paper_id").agg(network.ordered_join("s_name", ["author_order", "author_id"], "; ").alias("authors"))


@query(f"SELECT a.paper_id, a.author_id AS a1, b.author_id AS a2 FROM {R.PAPER_AUTHORS} a JOIN {R.PAPER_AUTHORS} b ON a.paper_id = b.paper_id AND a.author_id < b.author_id")
def jn3_self_join(spark, d):
    return network.author_pairs(R.paper_authors(spark, d))


@query(f"SELECT a.paper_id, a.dimension, a.value, b.value AS other FROM {R.LABELS} a LEFT JOIN {R.LABELS} b ON a.paper_id = b.paper_id AND (a.dimension <> b.dimension OR a.value <> b.value)")
def jn4_left_theta(spark, d):
    a = R.labels(spark, d)
    b = a.select(F.col("paper_id").alias("p2"), F.col("dimension").alias("d2"), F.col("value").alias("other"))
    on = (F.col("paper_id") == F.col("p2")) & ((F.col("dimension") != F.col("d2")) | (F.col("value") != F.col("other")))
    return a.join(b, on, "left").select("paper_id", "dimension", "value", "other")


@query(f"SELECT p.id, count(t.order_index) AS sections, coalesce(sum(length(t.text)), 0)::BIGINT AS chars FROM {R.PAPERS} p LEFT JOIN {R.TURNS} t ON t.paper_id = p.id GROUP BY 1")
def jn5_left_group(spark, d):
    # turns are counted before the join, so the join is one row a paper
    g = R.turns(spark, d).groupBy("paper_id").agg(F.count("order_index").alias("s"), F.sum(F.length("text")).alias("c"))
    p = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return p.join(g, p.id == g.paper_id, "left").select("id", F.coalesce("s", F.lit(0)).alias("sections"), F.coalesce("c", F.lit(0)).alias("chars"))


@query(f"SELECT p.paper_id, a.author_id, s.s_name FROM {R.DATED} p LEFT JOIN {R.PAPER_AUTHORS} a USING (paper_id) LEFT JOIN supplier s ON s.s_suppkey = a.author_id")
def jn6_chained_left(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), "s_name")
    return R.dated(spark, d).select("paper_id").join(R.paper_authors(spark, d), "paper_id", "left").join(s, "author_id", "left").select("paper_id", "author_id", "s_name")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def jn7_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def jn8_semi(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@query(f"SELECT p.paper_id, (SELECT min_by(author_id, (author_order, author_id)) FROM {R.PAPER_AUTHORS} a WHERE a.paper_id = p.paper_id) AS primary_author FROM {R.DATED} p")
def jn9_scalar_subquery(spark, d):
    first = R.paper_authors(spark, d).groupBy("paper_id").agg(F.min_by("author_id", F.struct("author_order", "author_id")).alias("primary_author"))
    return R.dated(spark, d).select("paper_id").join(first, "paper_id", "left")


@query(f"SELECT p.id, t.heading FROM {R.PAPERS} p JOIN {R.TURNS} t ON t.paper_id = p.id AND t.order_index = 0")
def jn10_first_child(spark, d):
    first = R.turns(spark, d).where("order_index = 0").select(F.col("paper_id").alias("id"), "heading")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(first, "id")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN (SELECT lower(split_part(text, ' ', 1)) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1) d ON d.k = lower(split_part(b.text, ' ', 1))")
def jn11_fallback_key(spark, d):
    def key(c):
        return F.lower(F.split_part(c, F.lit(" "), F.lit(1)))
    first = table(spark, d, "documents").groupBy(key(F.col("text")).alias("k")).agg(F.min("doc_id").alias("doc_id"))
    return table(spark, d, "benchmark").select("item_id", key(F.col("text")).alias("k")).join(first, "k").select("item_id", "doc_id")


@query("""SELECT o_orderkey, event_id FROM (SELECT o_orderkey, event_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(o_custkey - user_id), event_id) n
  FROM orders JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1) ON abs(o_custkey - user_id) <= 2) WHERE n = 1""")
def jn16_nearest_key(spark, d):
    return network.nearest_key(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id")),
                               "o_orderkey", "o_custkey", "user_id", "event_id", 2).select("o_orderkey", "event_id")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'middle' ELSE 'large' END AS label FROM part")
def jn17_range_override(spark, d):
    bands = spark.createDataFrame([(1, 10, "small"), (11, 30, "middle"), (31, 1000, "large")], "lo int, hi int, label string")
    p = table(spark, d, "part").select("p_partkey", "p_size")
    # the overrides table has three rows
    return p.join(F.broadcast(bands), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "label")


@query("SELECT n_nationkey, r_regionkey, n_regionkey = r_regionkey AS inside FROM nation CROSS JOIN region")
def jn20_grid(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.crossJoin(F.broadcast(r)).select("n_nationkey", "r_regionkey", (F.col("n_regionkey") == F.col("r_regionkey")).alias("inside"))


@query("SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON substr(d.text, 1, 30) = substr(b.text, 1, 30) GROUP BY 1")
def jn21_prefix_match(spark, d):
    a = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 30).alias("k"))
    return a.join(table(spark, d, "documents").select("doc_id", F.substring("text", 1, 30).alias("k")), "k").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT l_orderkey, l_linenumber, f FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS f FROM lineitem GROUP BY ALL) USING (l_orderkey, l_linenumber)")
def jn22_first_wins(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("f"))


@query("SELECT doc_id, bool_or(a) AS in_labels, bool_or(b) AS in_turns FROM (SELECT doc_id, false a, false b FROM documents UNION ALL SELECT doc_id, true, false FROM labels UNION ALL SELECT conv_id, false, true FROM conversations) GROUP BY 1")
def jn23_membership(spark, d):
    def flags(df, key, a, b):
        return df.select(F.col(key).alias("doc_id"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    u = flags(table(spark, d, "documents"), "doc_id", False, False).union(flags(table(spark, d, "labels"), "doc_id", True, False)).union(flags(table(spark, d, "conversations"), "conv_id", False, True))
    return u.groupBy("doc_id").agg(F.bool_or("a").alias("in_labels"), F.bool_or("b").alias("in_turns"))


@query("SELECT l_orderkey, o_orderkey IS NOT NULL AS known FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey")
def jn24_validate_ids(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("hit"))
    return table(spark, d, "lineitem").select("l_orderkey").distinct().join(o, "l_orderkey", "left").select("l_orderkey", F.col("hit").isNotNull().alias("known"))


# ---------------------------------------------------------------- aggregations

@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def agg1_group_count(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS long_ones FROM documents")
def agg2_global_count(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long_ones"))


@query("SELECT count(DISTINCT l_orderkey) AS papers, count(DISTINCT l_suppkey) AS authors FROM lineitem")
def agg3_count_distinct(spark, d):
    l = table(spark, d, "lineitem")
    return l.agg(F.count_distinct("l_orderkey").alias("papers"), F.count_distinct("l_suppkey").alias("authors"))


@query(f"SELECT dimension, value, count(DISTINCT paper_id) AS papers, count(DISTINCT centrality) AS scores FROM {R.LABELS} GROUP BY ALL")
def agg4_two_distinct(spark, d):
    return R.labels(spark, d).groupBy("dimension", "value").agg(F.count_distinct("paper_id").alias("papers"), F.count_distinct("centrality").alias("scores"))


@query("""SELECT 'text' AS field, count(*) FILTER (WHERE trim(text) <> '') AS populated, count(*) AS total FROM documents
 UNION ALL SELECT 'lang', count(*) FILTER (WHERE trim(lang) <> ''), count(*) FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE trim(source) <> ''), count(*) FROM documents""")
def agg6_completeness(spark, d):
    return network.completeness(table(spark, d, "documents").select("text", "lang", "source"))


@query(f"SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n BETWEEN 3 AND 4 THEN '3-4' ELSE '5+' END AS bucket, count(*) AS papers FROM (SELECT paper_id, count(*) AS n FROM {R.TURNS} GROUP BY 1) GROUP BY 1")
def agg7_histogram(spark, d):
    n = R.turns(spark, d).groupBy("paper_id").agg(F.count("*").alias("n"))
    b = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n").between(3, 4), "3-4").otherwise("5+")
    return n.groupBy(b.alias("bucket")).agg(F.count("*").alias("papers"))


@query(f"SELECT p.paper_id, coalesce(max(centrality) FILTER (WHERE dimension = 'brand'), 1) AS brand, coalesce(max(centrality) FILTER (WHERE dimension = 'size'), 1) AS size FROM {R.DATED} p LEFT JOIN {R.LABELS} l USING (paper_id) GROUP BY 1")
def agg9_max_default(spark, d):
    top = R.labels(spark, d).groupBy("paper_id").pivot("dimension", ["brand", "size"]).agg(F.max("centrality"))
    return R.dated(spark, d).select("paper_id").join(top, "paper_id", "left").select("paper_id", F.coalesce("brand", F.lit(1)).alias("brand"), F.coalesce("size", F.lit(1)).alias("size"))


@query(f"SELECT value, count(*) AS n FROM {R.LABELS} WHERE dimension = 'brand' GROUP BY 1 ORDER BY n DESC, value")
def agg10_frequency(spark, d):
    return R.labels(spark, d).where("dimension = 'brand'").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


@query("SELECT lang, n_chars AS median FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) r, count(*) OVER (PARTITION BY lang) n FROM documents) WHERE r = n // 2 + 1")
def agg11_upper_median(spark, d):
    return network.upper_median(table(spark, d, "documents"), "lang", "n_chars").withColumnRenamed("n_chars", "median")


@query("SELECT count(*) FILTER (WHERE quality IS NULL) AS unlabelled, count(*) FILTER (WHERE quality = 0) AS bad, round(avg(n_chars), 1) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id)")
def agg12_conditional(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return both.agg(F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("quality") == 0).alias("bad"), F.round(F.avg("n_chars"), 1).alias("mean_chars"))


@query("SELECT lang, round(100.0 * sum(quality) / count(*), 2) AS good_pct FROM documents JOIN labels USING (doc_id) WHERE n_chars > 50 GROUP BY 1")
def agg13_rate(spark, d):
    both = table(spark, d, "documents").where("n_chars > 50").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.round(F.sum("quality") * 100.0 / F.count("*"), 2).alias("good_pct"))


@query(f"SELECT paper_id, string_agg(value, '; ' ORDER BY value) AS brands FROM {R.LABELS} WHERE dimension = 'brand' GROUP BY 1")
def agg16_label_strings(spark, d):
    return R.labels(spark, d).where("dimension = 'brand'").groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("value")), "; ").alias("brands"))


@query(r"SELECT heading, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS words FROM " + R.TURNS + " GROUP BY 1")
def agg17_words(spark, d):
    return R.turns(spark, d).groupBy("heading").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("words"))


@query(f"SELECT year, count(*) AS papers, count(*) FILTER (WHERE status = 'F') AS done FROM {R.DATED} GROUP BY 1")
def agg18_coverage(spark, d):
    return R.dated(spark, d).groupBy("year").agg(F.count("*").alias("papers"), F.count_if(F.col("status") == "F").alias("done"))


@query("SELECT count(*) FILTER (WHERE quality <> toxic) AS changed, count(*) FILTER (WHERE quality = toxic) AS same FROM labels")
def agg19_changes(spark, d):
    return table(spark, d, "labels").agg(F.count_if(F.col("quality") != F.col("toxic")).alias("changed"), F.count_if(F.col("quality") == F.col("toxic")).alias("same"))


@query(f"SELECT year, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 4) AS share FROM {R.LABELS} JOIN {R.DATED} USING (paper_id) WHERE dimension = 'size' AND centrality >= 2 GROUP BY year, value")
def agg20_trends(spark, d):
    return network.trends(R.labels(spark, d).where("dimension = 'size'"), R.dated(spark, d).select("paper_id", "year"), 2)


@query(f"SELECT a1, a2, count(*) AS weight FROM (SELECT a.author_id AS a1, b.author_id AS a2 FROM {R.PAPER_AUTHORS} a JOIN {R.PAPER_AUTHORS} b ON a.paper_id = b.paper_id AND a.author_id < b.author_id) GROUP BY ALL HAVING count(*) >= 2 ORDER BY weight DESC, a1, a2 LIMIT 110")
def agg21_network_top(spark, d):
    return network.author_pairs(R.paper_authors(spark, d)).groupBy("a1", "a2").agg(F.count("*").alias("weight")).where("weight >= 2").orderBy(F.desc("weight"), "a1", "a2").limit(110)


@query(f"SELECT paper_id, min_by(text, order_index) AS text FROM {R.TURNS} WHERE heading <> 'user' GROUP BY 1")
def agg23_first_child(spark, d):
    return R.turns(spark, d).where("heading <> 'user'").groupBy("paper_id").agg(F.min_by("text", "order_index").alias("text"))


# ---------------------------------------------------------------- sorts, limits, sets

@query(f"SELECT paper_id, year FROM {R.DATED} ORDER BY year DESC, paper_id LIMIT 50")
def srt2_year_sort(spark, d):
    return R.dated(spark, d).select("paper_id", "year").orderBy(F.desc("year"), "paper_id").limit(50)


@query(f"SELECT year, conference, count(*) AS n FROM {R.DATED} GROUP BY ALL ORDER BY year DESC, n DESC, conference")
def srt4_export_order(spark, d):
    return R.dated(spark, d).groupBy("year", "conference").agg(F.count("*").alias("n")).orderBy(F.desc("year"), F.desc("n"), "conference")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 100")
def lim4_paging(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(100).limit(100)


@query("SELECT doc_id AS id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0 ORDER BY id")
def set1_distinct_union(spark, d):
    l = table(spark, d, "labels")
    return l.where("toxic = 1").select(F.col("doc_id").alias("id")).union(l.where("quality = 0").select("doc_id")).distinct().orderBy("id")


@query("SELECT doc_id AS id, 'doc' AS kind FROM documents UNION ALL SELECT item_id, 'item' FROM benchmark")
def set2_union_all(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind")).unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("item").alias("kind")))


@query("SELECT doc_id AS id, 'both' AS side FROM (SELECT doc_id FROM documents INTERSECT SELECT conv_id FROM conversations) UNION ALL SELECT conv_id, 'only' FROM (SELECT conv_id FROM conversations EXCEPT SELECT doc_id FROM documents)")
def set3_intersect_except(spark, d):
    a, b = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "conversations").select(F.col("conv_id").alias("id"))
    return a.intersect(b).withColumn("side", F.lit("both")).union(b.subtract(a).withColumn("side", F.lit("only")))


@query("SELECT DISTINCT source FROM documents")
def set6_distinct(spark, d):
    return table(spark, d, "documents").select("source").distinct()


@query("SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT doc_id FROM labels WHERE quality = 1) a FULL JOIN (SELECT doc_id FROM labels WHERE toxic = 0) b ON a.doc_id = b.doc_id")
def set9_compare(spark, d):
    l = table(spark, d, "labels")
    return network.compare(l.where("quality = 1").select(F.col("doc_id").alias("id")), l.where("toxic = 0").select(F.col("doc_id").alias("id")), "id")


# ---------------------------------------------------------------- networks

@query(f"SELECT a.paper_id, a.author_id AS a1, b.author_id AS a2, p.year, 1.0::DOUBLE AS weight FROM {R.PAPER_AUTHORS} a JOIN {R.PAPER_AUTHORS} b ON a.paper_id = b.paper_id AND a.author_id < b.author_id JOIN {R.DATED} p ON p.paper_id = a.paper_id")
def ana1_coauthors(spark, d):
    return network.author_pairs(R.paper_authors(spark, d)).join(R.dated(spark, d).select("paper_id", "year"), "paper_id").withColumn("weight", F.lit(1.0))


@query(f"""WITH l AS {R.LABELS}, g AS (SELECT a.dimension, a.value, count(DISTINCT a.paper_id) AS volume, count(DISTINCT b.value) AS co_labels FROM l a LEFT JOIN l b ON a.paper_id = b.paper_id AND (a.dimension <> b.dimension OR a.value <> b.value) GROUP BY ALL),
 m AS (SELECT (SELECT volume FROM g ORDER BY volume OFFSET (SELECT count(*) // 2 FROM g) LIMIT 1) AS mv, (SELECT co_labels FROM g ORDER BY co_labels OFFSET (SELECT count(*) // 2 FROM g) LIMIT 1) AS mc)
 SELECT dimension, value, volume, co_labels, CASE WHEN volume >= mv AND co_labels >= mc THEN 'motor' WHEN volume >= mv THEN 'basic' WHEN co_labels >= mc THEN 'niche' ELSE 'emerging' END AS quadrant FROM g, m""")
def ana3_density_matrix(spark, d):
    return network.density_matrix(R.labels(spark, d))


@query(f"SELECT a1, a2, year, count(*) AS n FROM (SELECT a.author_id AS a1, b.author_id AS a2, p.year FROM {R.PAPER_AUTHORS} a JOIN {R.PAPER_AUTHORS} b ON a.paper_id = b.paper_id AND a.author_id < b.author_id JOIN {R.DATED} p ON p.paper_id = a.paper_id) GROUP BY ALL")
def ana4_yearly_pairs(spark, d):
    return network.author_pairs(R.paper_authors(spark, d)).join(R.dated(spark, d).select("paper_id", "year"), "paper_id").groupBy("a1", "a2", "year").agg(F.count("*").alias("n"))

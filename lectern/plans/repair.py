"""Parsing and repair of headings, authors, contents lists and references, as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import network, quality, sections
from ..sources.tables import table
from . import roles as R
from .registering import registry

FOUND, SQL, query = registry()


# ---------------------------------------------------------------- windows over lines

@query(f"""WITH f AS (SELECT id, line, text, CASE WHEN starts_with(text, 'The') THEN 'article' WHEN starts_with(text, 'Der') THEN 'artikel' END AS h FROM {R.LINES}),
 c AS (SELECT id, line, text, h, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING), 'Full Text') AS label FROM f)
 SELECT id, label, string_agg(text, chr(10) ORDER BY line) AS text FROM c WHERE h IS NULL GROUP BY ALL""")
def win6_canonical_sections(spark, d):
    label = F.when(F.col("text").startswith("The"), "article").when(F.col("text").startswith("Der"), "artikel")
    c = sections.carried(R.lines(spark, d).withColumn("h", label), F.col("h").isNotNull(), F.col("h"), "label")
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    return c.where("h is null").groupBy("id", F.coalesce("label", F.lit("Full Text")).alias("label")).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


@query("SELECT doc_id, i::INTEGER AS section, trim(part) AS text FROM (SELECT doc_id, unnest(range(1, len(string_split(text, '. ')) + 1)) AS i, unnest(string_split(text, '. ')) AS part FROM documents) WHERE trim(part) <> ''")
def win7_split_sections(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "text"))
    return parts.select("doc_id", (F.col("i") + 1).alias("section"), F.trim("text").alias("text")).where("text <> ''")


@query(f"""WITH f AS (SELECT id, line, text, sum(CASE WHEN starts_with(text, 'The') THEN 1 WHEN starts_with(text, 'And') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS k FROM {R.LINES}),
 g AS (SELECT id, k, arg_min(starts_with(text, 'The'), line) AS inside FROM f WHERE k > 0 GROUP BY ALL) SELECT f.id, f.line FROM f JOIN g ON g.id = f.id AND g.k = f.k WHERE inside""")
def win11_in_block(spark, d):
    opens, shuts = F.col("text").startswith("The"), F.col("text").startswith("And")
    state = sections.carried(R.lines(spark, d), opens | shuts, opens, "inside")
    return state.where("inside").select("id", "line")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) n FROM documents) WHERE n = 1")
def win15_argmax(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


@query(rf"SELECT id, line, text || ' ' || nxt AS text FROM (SELECT id, line, text, lead(text) OVER (PARTITION BY id ORDER BY line) AS nxt FROM {R.LINES}) WHERE regexp_matches(rtrim(text), '(?i)(^|\s)(the|of|and|in|der|de|la|que|und|et)\s*$') AND nxt IS NOT NULL")
def win16_wrapped_lines(spark, d):
    nxt = F.lead("text").over(Window.partitionBy("id").orderBy("line"))
    dangling = F.rtrim("text").rlike(r"(?i)(^|\s)(the|of|and|in|der|de|la|que|und|et)\s*$")
    return R.lines(spark, d).withColumn("nxt", nxt).where(dangling & F.col("nxt").isNotNull()).select("id", "line", F.concat_ws(" ", "text", "nxt").alias("text"))


# ---------------------------------------------------------------- parsing

@query("SELECT l_orderkey, l_linenumber, regexp_extract('Item ' || l_partkey || ' ..... ' || l_suppkey, '^(.*?)\\s*\\.{3,}\\s*(\\d+)$', 1) AS title, l_suppkey::INTEGER AS page FROM lineitem")
def str35_contents_line(spark, d):
    line = F.concat(F.lit("Item "), F.col("l_partkey"), F.lit(" ..... "), F.col("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.regexp_extract(line, r"^(.*?)\s*\.{3,}\s*(\d+)$", 1).alias("title"), F.regexp_extract(line, r"^(.*?)\s*\.{3,}\s*(\d+)$", 2).cast("int").alias("page"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'icls-' || year(o_orderdate) WHEN o_orderstatus = 'O' THEN 'cscl-' || year(o_orderdate) END AS volume FROM orders")
def str44_volume_key(spark, d):
    ident = F.concat(F.when(F.col("o_orderstatus") == "F", "icls-").when(F.col("o_orderstatus") == "O", "cscl-").otherwise("none-"), F.lit("paper-"), F.year("o_orderdate"))
    o = table(spark, d, "orders").withColumn("ident", ident)
    key = F.concat(F.regexp_extract("ident", "(icls|cscl)", 1), F.lit("-"), F.regexp_extract("ident", r"(\d{4})$", 1))
    return o.select("o_orderkey", F.when(F.col("ident").rlike("icls|cscl"), key).alias("volume"))


@query("SELECT p_partkey, p_partkey % 4 AS volume FROM part")
def str8_volume_number(spark, d):
    text = F.concat(F.lit("Proceedings, Volume "), F.col("p_partkey") % 4, F.lit(", pp."))
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(text, r"(?i)\bVolume\s+(\d+)\b", 1).cast("long").alias("volume"))


@query("SELECT doc_id, regexp_matches(lower(split_part(text, chr(10), 1)), 'licen|copyright') OR contains(source, '1') AND length(text) < 400 AS is_special FROM documents")
def str5_special_test(spark, d):
    head = F.lower(T.first_line("text"))
    return table(spark, d, "documents").select("doc_id", (head.rlike("licen|copyright") | (F.col("source").contains("1") & (F.length("text") < 400))).alias("is_special"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(lower(c_mktsegment), 'auto|mach') THEN 'industry' WHEN regexp_matches(lower(c_mktsegment), 'house|furn') THEN 'home' ELSE regexp_replace(regexp_replace(lower(trim(c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END AS label FROM customer")
def str10_label_or_slug(spark, d):
    low = F.lower("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", F.when(low.rlike("auto|mach"), "industry").when(low.rlike("house|furn"), "home").otherwise(T.slug("c_mktsegment")).alias("label"))


@query("SELECT p_partkey, role FROM part JOIN (VALUES ('STEEL', 'metal'), ('BRASS', 'metal'), ('SMALL', 'size'), ('LARGE', 'size')) a(alias, role) ON list_contains(string_split(p_type, ' '), alias) GROUP BY ALL")
def str11_roles(spark, d):
    aliases = spark.createDataFrame([("STEEL", "metal"), ("BRASS", "metal"), ("SMALL", "size"), ("LARGE", "size")], "word string, role string")
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))
    return words.join(F.broadcast(aliases), "word").select("p_partkey", "role").distinct()  # four aliases


@query(r"SELECT n_nationkey, upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS label FROM nation WHERE NOT contains(n_name, ' ')")
def str12_title_case(spark, d):
    return table(spark, d, "nation").where(~F.col("n_name").contains(" ")).select("n_nationkey", F.initcap(F.lower("n_name")).alias("label"))


@query("SELECT id, line, length(trim(text)) < 4 OR regexp_matches(text, '^\\s*\\d+\\s*$') OR regexp_matches(lower(text), 'https?://|doi|et al') AS artifact FROM " + R.LINES)
def str20_artifact_lines(spark, d):
    t = F.col("text")
    return R.lines(spark, d).select("id", "line", ((F.length(F.trim(t)) < 4) | t.rlike(r"^\s*\d+\s*$") | F.lower(t).rlike("https?://|doi|et al")).alias("artifact"))


@query(r"SELECT s_suppkey, list_aggregate(list_filter(string_split(s_name || '; Ada L. ; x@y.org; Univ 3', ';'), lambda a: NOT regexp_matches(a, '[0-9@]')), 'string_agg', '|') AS names FROM supplier")
def str23_author_list(spark, d):
    parts = F.split(F.concat("s_name", F.lit("; Ada L. ; x@y.org; Univ 3")), ";")
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.filter(parts, lambda a: ~a.rlike("[0-9@]")), "|").alias("names"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?s)\.\s+([^.]{61,}?)\.', 1), ''), 'none') AS block FROM documents")
def str31_abstract_block(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.regexp_extract("text", r"(?s)\.\s+([^.]{61,}?)\.", 1), F.lit("")), F.lit("none")).alias("block"))


@query("SELECT o_orderkey, 'Customer ' || o_custkey || ' (' || year(o_orderdate) || '). ' || o_orderpriority || '. ' || o_orderstatus || '.' AS citation FROM orders")
def str34_citation(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("Customer %d (%d). %s. %s.", F.col("o_custkey"), F.year("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("citation"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN '*+' WHEN 'de' THEN '+' ELSE '*' END AS tag FROM documents")
def str42_provenance(spark, d):
    sources = F.when(F.col("lang") == "en", F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(F.col("lang") == "de", F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a")))
    return table(spark, d, "documents").select("doc_id", T.provenance(sources, {"a": "*", "b": "+"}).alias("tag"))


# ---------------------------------------------------------------- references

_CITED = r"coalesce(nullif(regexp_extract(text, '\"([^\"]+)\"', 1), ''), nullif(regexp_extract(text, '\(\d{4}\)\.\s*([^.]+)\.', 1), ''), nullif(regexp_extract(text, '^([^.]+)\.', 1), ''), text)"


@query(f"SELECT item_id, {_CITED} AS title FROM benchmark")
def ext17_cited_title(spark, d):
    t = F.col("text")
    tries = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r'"([^"]+)"', r"\(\d{4}\)\.\s*([^.]+)\.", r"^([^.]+)\.")]
    return table(spark, d, "benchmark").select("item_id", F.coalesce(*tries, t).alias("title"))


@query(rf"SELECT id, line FROM {R.LINES} WHERE regexp_matches(regexp_replace(lower(text), 'review of educational research|annual review', '', 'g'), '(^|[^\p{{L}}])(the|review|reviews)($|[^\p{{L}}])') AND length(text) > 15")
def ext18_review_titles(spark, d):
    rest = F.regexp_replace(F.lower("text"), "review of educational research|annual review", "")
    return R.lines(spark, d).where(rest.rlike(r"(^|[^\p{L}])(the|review|reviews)($|[^\p{L}])") & (F.length("text") > 15)).select("id", "line")


@query(rf"SELECT DISTINCT id, trim(regexp_replace(text, '^\s*\d+[.)]?\s*', '')) AS entry FROM {R.LINES} WHERE regexp_matches(text, '(?i)systematic|license|trash')")
def ext19_indicator_entries(spark, d):
    hit = R.lines(spark, d).where(F.col("text").rlike("(?i)systematic|license|trash"))
    return hit.select("id", F.trim(F.regexp_replace("text", r"^\s*\d+[.)]?\s*", "")).alias("entry")).distinct()


@query("SELECT doc_id, list_slice(list_filter(['trash', 'license', 'idiot', 'the', 'de', 'que', 'und'], lambda w: contains(lower(text), w)), 1, 5)::VARCHAR AS keywords FROM documents")
def ext21_keywords(spark, d):
    low = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    names = F.array(*map(F.lit, ["trash", "license", "idiot", "the", "de", "que", "und"]))
    return low.select("doc_id", F.concat(F.lit("["), F.array_join(F.slice(F.filter(names, lambda w: F.contains("low", w)), 1, 5), ", "), F.lit("]")).alias("keywords"))


@query(f"SELECT paper_id, bool_or(contains(text, 'the')) AS a, bool_or(contains(text, 'ing')) AS b, CASE WHEN bool_or(contains(text, 'the')) AND bool_or(contains(text, 'ing')) THEN 'both' WHEN bool_or(contains(text, 'the')) THEN 'first' WHEN bool_or(contains(text, 'ing')) THEN 'second' ELSE 'neither' END AS relation FROM {R.TURNS} GROUP BY 1")
def ext12_relation(spark, d):
    g = R.turns(spark, d).groupBy("paper_id").agg(F.bool_or(F.col("text").contains("the")).alias("a"), F.bool_or(F.col("text").contains("ing")).alias("b"))
    return g.withColumn("relation", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").when(F.col("b"), "second").otherwise("neither"))


# ---------------------------------------------------------------- exports, ranking, repair

@query(f"WITH n AS (SELECT a.author_id AS a1, b.author_id AS a2, p.year FROM {R.PAPER_AUTHORS} a JOIN {R.PAPER_AUTHORS} b ON a.paper_id = b.paper_id AND a.author_id < b.author_id JOIN {R.DATED} p ON p.paper_id = a.paper_id) SELECT x.s_name AS first, y.s_name AS second, year, count(*) AS n FROM n JOIN supplier x ON x.s_suppkey = a1 JOIN supplier y ON y.s_suppkey = a2 GROUP BY ALL ORDER BY year, n DESC, first, second")
def snk5_edge_export(spark, d):
    s = table(spark, d, "supplier")
    n = network.author_pairs(R.paper_authors(spark, d)).join(R.dated(spark, d).select("paper_id", "year"), "paper_id").groupBy("a1", "a2", "year").agg(F.count("*").alias("n"))
    named = n.join(s.select(F.col("s_suppkey").alias("a1"), F.col("s_name").alias("first")), "a1").join(s.select(F.col("s_suppkey").alias("a2"), F.col("s_name").alias("second")), "a2")
    return named.groupBy("first", "second", "year").agg(F.sum("n").alias("n")).select("first", "second", "year", "n").orderBy("year", F.desc("n"), "first", "second")


@query(f"SELECT id, coalesce(nullif(title, ''), '-') || ' | ' || conference AS passage FROM {R.PAPERS}")
def ir8_passage(spark, d):
    return R.papers(spark, d).select("id", F.concat_ws(" | ", F.coalesce(F.nullif("title", F.lit("")), F.lit("-")), "conference").alias("passage"))


@query("SELECT user_id, max(event_id) AS event_id, count(*) AS seen FROM events GROUP BY 1")
def ups11_manifest(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("seen"))


@query("SELECT doc_id, count(*) AS versions, max(v) AS status FROM (SELECT doc_id, 'a_found' AS v FROM documents UNION ALL SELECT doc_id, 'b_labelled' FROM labels) GROUP BY 1")
def inc2_manifest(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.lit("a_found").alias("v"))
    return found.union(table(spark, d, "labels").select("doc_id", F.lit("b_labelled"))).groupBy("doc_id").agg(F.count("*").alias("versions"), F.max("v").alias("status"))


@query(f"SELECT count(*) AS sections, count(*) FILTER (WHERE heading NOT IN ('user', 'assistant')) AS unmapped, round(avg(length(text)), 1) AS mean_size FROM {R.TURNS}")
def qua9_report(spark, d):
    t = R.turns(spark, d)
    return t.agg(F.count("*").alias("sections"), F.count_if(~F.col("heading").isin("user", "assistant")).alias("unmapped"), F.round(F.avg(F.length("text")), 1).alias("mean_size"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)")
def qua10_presence(spark, d):
    there = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return table(spark, d, "documents").select("doc_id").join(there, "doc_id", "left_anti")


@query(rf"SELECT id, line, regexp_matches(rtrim(text), '(?i)(^|\s)({'|'.join(quality.CONNECTORS)})$') OR regexp_matches(rtrim(text), '[&;,(]$') AS connector, len(regexp_extract_all(text, '\(')) > len(regexp_extract_all(text, '\)')) AS open_citation FROM {R.LINES}")
def qua2_line_flags(spark, d):
    return R.lines(spark, d).select("id", "line", quality.trailing_connector("text").alias("connector"), quality.open_citation("text").alias("open_citation"))

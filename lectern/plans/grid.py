"""Review, export, extraction and repair queries over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction, network, quality, search, sections, similarity, taxonomy, upserts
from ..sources import sinks
from ..sources.tables import table, top_layer
from . import roles as R
from .registering import registry
from .corpus import DEFAULTS, RULES, _label_sql

FOUND, SQL, query = registry()


# ---------------------------------------------------------------- sources and sinks

@query("SELECT p_partkey, p_type, CASE WHEN p_type ILIKE '%steel%' THEN 'steel' WHEN p_type ILIKE 's%' THEN 'small' ELSE 'base' END AS profile FROM part")
def src7_profile_of_name(spark, d):
    profiles = spark.createDataFrame([(1, "(?i).*steel.*", "steel"), (2, "(?i)s.*", "small")], "rank int, pattern string, profile string")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    hit = p.join(F.broadcast(profiles), F.expr("p_type rlike concat('^', pattern, '$')"), "left")  # two profiles
    return hit.groupBy("p_partkey", "p_type").agg(F.coalesce(F.min_by("profile", "rank"), F.lit("base")).alias("profile"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, sha256(text) AS digest, strlen(text)::BIGINT AS size FROM documents")
def src13_register(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug("source").alias("slug"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query("SELECT c.conv_id, c.turn, d.doc_id IS NOT NULL AS matched FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id")
def src14_import_matched(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("hit"))
    return table(spark, d, "conversations").select("conv_id", "turn").join(ids, "conv_id", "left").select("conv_id", "turn", F.col("hit").isNotNull().alias("matched"))


@query(f"""WITH l AS ({_label_sql()}) SELECT p.id, conference, coalesce(string_agg(label, '; ' ORDER BY label) FILTER (WHERE dimension = 'tone'), '') AS tone_labels, coalesce(max(centrality) FILTER (WHERE dimension = 'tone'), 1) AS tone_score,
 coalesce(string_agg(label, '; ' ORDER BY label) FILTER (WHERE dimension = 'rights'), '') AS rights_labels, coalesce(max(centrality) FILTER (WHERE dimension = 'rights'), 1) AS rights_score FROM {R.PAPERS} p LEFT JOIN l ON l.id = p.id GROUP BY ALL""")
def snk3_flat_labels(spark, d):
    p = R.papers(spark, d)
    return sinks.flat_labels(p.select("id", "conference"), taxonomy.classify(p, RULES, DEFAULTS), ["tone", "rights"])


@query(f"WITH l AS ({_label_sql()}) SELECT p.id, conference, dimension, label, centrality FROM l JOIN {R.PAPERS} p ON p.id = l.id ORDER BY p.id, dimension, label")
def snk4_tall_labels(spark, d):
    p = R.papers(spark, d)
    return taxonomy.classify(p, RULES, DEFAULTS).join(p.select("id", "conference"), "id").select("id", "conference", "dimension", "label", "centrality").orderBy("id", "dimension", "label")


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderpriority, o_orderkey")
def snk7_papers_csv(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").orderBy("o_orderstatus", "o_orderpriority", "o_orderkey")


@query(r"SELECT '| ' || concat_ws(' | ', CAST(id AS VARCHAR), regexp_replace(replace(title, '|', '\|'), '\s*\n\s*', ' ', 'g'), conference) || ' |' AS value FROM " + R.PAPERS)
def snk8_markdown_rows(spark, d):
    return sinks.markdown_rows(R.papers(spark, d), ["id", "title", "conference"])


@query(f"SELECT paper_id AS id, '# ' || CAST(paper_id AS VARCHAR) || E'\\n\\n**Authors:** A, B\\n\\n' || string_agg('## ' || heading || E'\\n\\n' || text, E'\\n\\n' ORDER BY order_index, heading, text) AS value FROM {R.TURNS} GROUP BY paper_id")
def snk9_markdown_papers(spark, d):
    rows = R.turns(spark, d).groupBy(F.col("paper_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("order_index", "heading", "text"))).alias("sections"))
    return sinks.markdown_papers(rows.select("id", F.col("id").cast("string").alias("title"), F.array(F.lit("A"), F.lit("B")).alias("authors"), "sections"))


@query("SELECT source AS review_id, count(*) AS papers FROM documents WHERE lang = 'en' GROUP BY 1 ORDER BY papers DESC, review_id")
def snk10_review_manifest(spark, d):
    docs = table(spark, d, "documents")
    members = docs.where("lang = 'en'").select(F.col("source").alias("review_id"), F.col("doc_id").alias("paper_id"))
    return sinks.reviews(members, docs.select(F.col("doc_id").alias("id"), "n_chars"))[1]


@query("SELECT doc_id AS paper_id, 'toxic' AS property_id, CAST(toxic AS VARCHAR) AS value, CASE WHEN toxic = 1 THEN 'flagged' ELSE '' END AS supporting_text FROM labels")
def snk12_evidence_rows(spark, d):
    item = F.array(F.struct(F.lit("flagged").alias("supporting_text")))
    obs = table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), F.lit("toxic").alias("property_id"), F.col("toxic").cast("string").alias("value"), F.when(F.col("toxic") == 1, item).alias("evidence"))
    return sinks.evidence_csv(obs)


@query("SELECT field, value FROM (SELECT CAST(min(n_chars) AS VARCHAR) a, CAST(max(n_chars) AS VARCHAR) b FROM documents), LATERAL (VALUES ('shortest', a), ('longest', b)) t(field, value)")
def snk13_definition_rows(spark, d):
    one = table(spark, d, "documents").agg(F.min("n_chars").cast("string").alias("a"), F.max("n_chars").cast("string").alias("b"))
    return one.selectExpr("stack(2, 'shortest', a, 'longest', b) as (field, value)")


@query("SELECT p_brand AS column, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'canonical' WHEN max(p_size) >= 50 THEN 'extracted' ELSE 'unknown' END AS kind, CASE WHEN max(p_size) >= 50 THEN 'big' ELSE p_brand END AS label FROM part GROUP BY p_brand")
def snk14_dictionary(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_size >= 50").select(F.col("p_brand").alias("property_id"), F.lit("big").alias("label")).distinct()
    return sinks.dictionary(p.select(F.col("p_brand").alias("column")).distinct(), known, ["Brand#11", "Brand#12"])


@query(f"SELECT paper_id, to_json({{'sections': list({{'order_index': order_index, 'heading': heading, 'text': text}} ORDER BY order_index)}})::VARCHAR AS data_json FROM {R.TURNS} GROUP BY 1")
def snk16_collections(spark, d):
    return sinks.collections(R.turns(spark, d), "paper_id")


# ---------------------------------------------------------------- projections, filters

@query(f"SELECT id, line, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM {R.LINES} WHERE (starts_with(text, '#') OR length(text) > 15) AND length(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))) > 12")
def flt17_candidate_headers(spark, d):
    l = R.lines(spark, d).withColumn("k", T.title_key("text"))
    return l.where((F.col("text").startswith("#") | (F.length("text") > 15)) & (F.length("k") > 12)).select("id", "line", "k")


@query("SELECT n_nationkey, n_name, n_regionkey, 0 AS volume FROM nation")
def prj3_evolve_schema(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n if "volume" in n.columns else n.withColumn("volume", F.lit(0))


@query(f"SELECT paper_id, string_agg('### ' || heading || E'\\n' || text, E'\\n\\n' ORDER BY order_index, heading, text) AS document FROM {R.TURNS} GROUP BY 1")
def prj7_document(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("order_index", "heading", "text")))
    block = F.transform(rows, lambda r: F.concat(F.lit("### "), r["heading"], F.lit("\n"), r["text"]))
    return R.turns(spark, d).groupBy("paper_id").agg(F.array_join(block, "\n\n").alias("document"))


# ---------------------------------------------------------------- joins

@query("""WITH a AS (SELECT item_id, text AS t FROM benchmark), b AS (SELECT doc_id, text AS t FROM documents), m AS (
 SELECT item_id, doc_id, 1 AS tier FROM a JOIN b ON a.t = b.t UNION ALL SELECT item_id, doc_id, 2 FROM a JOIN b ON regexp_replace(lower(split_part(a.t, '.', 1)), '[^a-z0-9]', '', 'g') = regexp_replace(lower(split_part(b.t, '.', 1)), '[^a-z0-9]', '', 'g'))
 SELECT item_id, doc_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY tier, doc_id) n FROM m) WHERE n = 1""")
def jn12_cascade(spark, d):
    a, b = table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text")
    keys = [F.col("text"), T.alnum_key(F.split_part("text", F.lit("."), F.lit(1)))]
    # of the documents with a key only the smallest id can win, so each tier joins one row a key
    tiers = [a.select("item_id", k.alias("k")).join(b.groupBy(k.alias("k")).agg(F.min("doc_id").alias("doc_id")), "k").select("item_id", "doc_id", F.lit(i + 1).alias("tier")) for i, k in enumerate(keys)]
    best = F.min_by(F.struct("doc_id", "tier"), F.struct("tier", "doc_id"))
    return reduce(lambda x, y: x.union(y), tiers).groupBy("item_id").agg(best.alias("x")).select("item_id", "x.*")


@query(f"""WITH o AS (SELECT paper_id, order_index, heading, coalesce(sum(length(text) + 2) OVER (PARTITION BY paper_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(text) + 2 AS n FROM {R.TURNS})
 SELECT paper_id, order_index, heading FROM o WHERE s <= 200 AND 200 < s + n""")
def jn18_containing_section(spark, d):
    o = sections.offsets(R.turns(spark, d), "paper_id", "order_index", "text")
    return o.where((F.col("start") <= 200) & (F.lit(200) < F.col("start") + F.length("text") + 2)).select("paper_id", "order_index", "heading")


@query("SELECT l_orderkey, o_orderkey IS NULL AS unresolved, n > 1 AS duplicate FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = l_orderkey")
def jn25_resolve_list(spark, d):
    asked = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count("*") > 1).alias("duplicate"))
    known = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("hit"))
    return asked.join(known, "l_orderkey", "left").select("l_orderkey", F.col("hit").isNull().alias("unresolved"), "duplicate")


# ---------------------------------------------------------------- aggregation, sorts, sets

@query(f"SELECT paper_id, list(heading ORDER BY order_index, heading)::VARCHAR AS headings FROM {R.TURNS} GROUP BY 1")
def agg15_ordered_lists(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("order_index", "heading")))
    return R.turns(spark, d).groupBy("paper_id").agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["heading"]), ", "), F.lit("]")).alias("headings"))


@query(rf"""SELECT sum(a)::BIGINT AS open_lines, count(*) FILTER (WHERE a > 0) AS papers_open, sum(b)::BIGINT AS stray, count(*) FILTER (WHERE b > 5) AS papers_stray FROM (
 SELECT id, sum((len(regexp_extract_all(text, '\(')) > len(regexp_extract_all(text, '\)')))::INT) AS a, sum(len(regexp_extract_all(text, '\s[,.;:!?]'))) AS b FROM {R.LINES} GROUP BY id)""")
def agg14_totals(spark, d):
    g = R.lines(spark, d).groupBy("id").agg(F.sum(quality.open_citation("text").cast("long")).alias("a"), F.sum(quality.stray_blanks("text").cast("long")).alias("b"))
    return g.agg(F.sum("a").alias("open_lines"), F.count_if(F.col("a") > 0).alias("papers_open"), F.sum("b").alias("stray"), F.count_if(F.col("b") > 5).alias("papers_stray"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'de') > 0 AS german FROM documents GROUP BY 1 ORDER BY german DESC, n DESC, source")
def srt3_mixed_sort(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.bool_or(F.col("lang") == "de").alias("german")).orderBy(F.desc("german"), F.desc("n"), "source")


@query("SELECT item_id, len(list_distinct(string_split(text, ' ')))::INTEGER AS different FROM benchmark")
def set5_ordered_distinct(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(F.array_distinct(F.split("text", " "))).alias("different"))


@query("SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY (user_id % 2) DESC, event_id) n FROM events) WHERE n = 1")
def set7_layered_union(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "user_id")
    return e.groupBy("event_type").agg(F.min_by(F.struct("event_id", "user_id"), F.struct(-(F.col("user_id") % 2), F.col("event_id"))).alias("x")).select("event_type", "x.*")


# ---------------------------------------------------------------- text

@query("SELECT doc_id, CASE WHEN contains(upper(source), 'SRC1') THEN 'SRC1' WHEN contains(upper(source), 'SRC2') THEN 'SRC2' ELSE 'none' END AS conference FROM documents")
def str6_conference(spark, d):
    return table(spark, d, "documents").select("doc_id", T.conference_in("source", ["SRC1", "SRC2"], "none").alias("conference"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'introduction' WHEN 'assistant' THEN 'results' ELSE 'other' END AS label FROM conversations")
def str9_heading_labels(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sections.heading_label("role", {"introduction": ["user"], "results": ["assistant"]}).alias("label"))


@query(rf"SELECT doc_id, regexp_matches(split_part(text, chr(10), 1), '(?i)(?:\b(?:{'|'.join(T.DANGLING)})|-)\s*$') AS dangling FROM documents")
def str45_dangling(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dangling(T.first_line("text")).alias("dangling"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\.{4,}', '...', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g') AS text FROM documents")
def str17_squeeze(spark, d):
    return table(spark, d, "documents").select("doc_id", T.squeeze_artifacts("text").alias("text"))


@query()
def str24_repeated_suffix(spark, d):
    return R.papers(spark, d).select("id", T.strip_repeated_suffix("title").alias("title"))


@query(r"""WITH m AS (SELECT doc_id, text, length(regexp_extract(text, '(?is)^(.*?)(trash|idiot)', 1)) + 1 AS pos, length(regexp_extract(text, '(?i)trash|idiot')) AS n FROM documents WHERE regexp_matches(text, '(?i)trash|idiot'))
 SELECT doc_id, CASE WHEN pos - 40 > 1 THEN '...' ELSE '' END || substr(text, greatest(pos - 40, 1)::BIGINT, (least(pos + n - 1 + 40, length(text)) - greatest(pos - 40, 1) + 1)::BIGINT) || CASE WHEN pos + n - 1 + 40 < length(text) THEN '...' ELSE '' END AS snippet FROM m""")
def str38_context(spark, d):
    return table(spark, d, "documents").select("doc_id", T.context("text", "(?i)trash|idiot", 40).alias("snippet")).where("snippet is not null")


@query("SELECT c_custkey, CAST(floor(c_acctbal / greatest(1, c_nationkey)) AS BIGINT) AS per_nation, CASE WHEN c_nationkey = 0 THEN 0 ELSE CAST(floor(c_custkey * 100.0 / (c_nationkey * 1000.0)) AS BIGINT) END AS pct FROM customer")
def mth2_guarded(spark, d):
    c = table(spark, d, "customer")
    pct = F.floor(F.col("c_custkey") * 100.0 / (F.col("c_nationkey") * 1000.0))
    return c.select("c_custkey", F.floor(F.col("c_acctbal") / F.greatest(F.lit(1), "c_nationkey")).alias("per_nation"), F.when(F.col("c_nationkey") == 0, F.lit(0).cast("long")).otherwise(pct).alias("pct"))


@query("SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de FROM documents GROUP BY 1")
def map2_appended(spark, d):
    m = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    return m.select("source", *[F.coalesce(F.try_element_at("m", F.lit(x)), F.lit(0)).alias(x) for x in ("en", "de")])


# ---------------------------------------------------------------- search and taxonomy

@query()
def ir10_definition_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower("p_type").alias("kind"))
    s = F.greatest(similarity.partial_ratio(F.lit("small steel"), "name"), similarity.partial_ratio(F.lit("small steel"), "kind"))
    return p.select("p_partkey", F.round(s, 2).alias("score")).where("score > 60").orderBy(F.desc("score"), "p_partkey")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS flagged FROM documents")
def tax9_id_flag(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("hit"))
    return table(spark, d, "documents").select("doc_id").join(ids, "doc_id", "left").select("doc_id", F.col("hit").isNotNull().alias("flagged"))


@query(f"SELECT dimension || '.' || label AS id, dimension, label, count(*) AS papers FROM ({_label_sql()}) GROUP BY ALL")
def tax6_definitions(spark, d):
    """Definitions of the labels that papers have, upserted over the rules' own list."""
    used = taxonomy.classify(R.papers(spark, d), RULES, DEFAULTS).groupBy("dimension", "label").agg(F.count("*").alias("papers"))
    new = used.select(F.concat_ws(".", "dimension", "label").alias("id"), "dimension", "label", "papers", F.lit(2).alias("version"))
    listed = [(f"{dim}.{label}", dim, label, 0, 1) for dim, labels in RULES.items() for label in labels]
    old = spark.createDataFrame(listed, "id string, dimension string, label string, papers long, version int").join(F.broadcast(new.select("id")), "id", "left_semi")  # a row for each label
    return upserts.upsert(old, new, ["id"], "version").select("id", "dimension", "label", "papers")


# ---------------------------------------------------------------- extraction

@query(f"""SELECT paper_id, concat_ws('; ', CASE WHEN bool_or(contains(lower(text), 'tion')) THEN 'tion' END, CASE WHEN bool_or(contains(lower(text), 'ing')) THEN 'ing' END, CASE WHEN bool_or(contains(lower(text), 'keit')) THEN 'keit' END) AS matched FROM {R.TURNS} GROUP BY 1""")
def ext8_matched_keywords(spark, d):
    words = ["tion", "ing", "keit"]
    hits = R.turns(spark, d).groupBy("paper_id").agg(*[F.bool_or(F.lower("text").contains(w)).alias(w) for w in words])
    return hits.select("paper_id", F.concat_ws("; ", *[F.when(F.col(w), F.lit(w)) for w in words]).alias("matched"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> '' AND regexp_matches(y, '(?i)\b(trash|idiot|license)\b')) AS s FROM documents)
, c AS (SELECT doc_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(s, lambda u: [u])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END)[:3] AS c FROM s WHERE len(s) > 0) SELECT doc_id, array_to_string(c, ' | ') AS callouts FROM c""")
def ext10_callouts(spark, d):
    hits = F.filter(T.sentences("text"), lambda s: s.rlike(r"(?i)\b(trash|idiot|license)\b"))
    return table(spark, d, "documents").select("doc_id", F.slice(F.array_distinct(hits), 1, 3).alias("c")).where(F.size("c") > 0).select("doc_id", F.array_join("c", " | ").alias("callouts"))


@query(r"SELECT doc_id, array_to_string(list_slice(list_distinct(list_transform(regexp_extract_all(lower(text), '\b(trash|idiot|moron|scum)\b'), lambda x: upper(x[1]) || x[2:])), 1, 99), ', ') = '' AS none, len(list_distinct(regexp_extract_all(lower(text), '\b(trash|idiot|moron|scum)\b')))::INTEGER AS terms FROM documents")
def ext11_terms(spark, d):
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(trash|idiot|moron|scum)\b"), F.lit(1)))
    titled = F.array_join(F.transform(found, F.initcap), ", ")
    return table(spark, d, "documents").select("doc_id", (titled == "").alias("none"), F.size(found).alias("terms"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)moron|idiot') THEN 'insult' WHEN regexp_matches(text, '(?i)trash|scum') THEN 'scorn' WHEN regexp_matches(text, '(?i)licen') THEN 'legal' ELSE 'other' END AS paradigm FROM documents")
def ext14_paradigm(spark, d):
    chain = [("(?i)moron|idiot", "insult"), ("(?i)trash|scum", "scorn"), ("(?i)licen", "legal")]
    return table(spark, d, "documents").select("doc_id", F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(v)) for p, v in chain], F.lit("other")).alias("paradigm"))


@query(f"SELECT paper_id, coalesce(string_agg(text, chr(10) ORDER BY order_index) FILTER (WHERE heading = 'system'), max_by(text, order_index)) AS refs FROM {R.TURNS} GROUP BY 1")
def ext15_reference_text(spark, d):
    own = F.array_sort(F.collect_list(F.when(F.col("heading") == "system", F.struct("order_index", "text"))))
    joined = F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda r: r["text"]), "\n"))
    return R.turns(spark, d).groupBy("paper_id").agg(F.coalesce(joined, F.max_by("text", "order_index")).alias("refs"))


@query("SELECT doc_id, coalesce(nullif(array_to_string(list_filter(['trash', 'idiot', 'license'], lambda w: contains(lower(text), w)), ', '), ''), 'not specified') AS found FROM documents")
def ext20_names_searched(spark, d):
    names = F.array(*map(F.lit, ["trash", "idiot", "license"]))
    low = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.coalesce(F.nullif(F.array_join(F.filter(names, lambda w: F.contains("low", w)), ", "), F.lit("")), F.lit("not specified")).alias("found"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> '') AS s FROM documents)
 SELECT doc_id, array_to_string(list_filter(string_split_regex(concat_ws(' ', s[1], list_filter(s, lambda y: regexp_matches(y, '(?i)result|show|find'))[1]), '\s+'), lambda w: w <> '')[:50], ' ') AS summary FROM s""")
def ext22_summary(spark, d):
    s = T.sentences("text")
    finding = F.get(F.filter(s, lambda x: x.rlike("(?i)result|show|find")), F.lit(0))
    return table(spark, d, "documents").select("doc_id", T.first_words(F.concat_ws(" ", F.get(s, F.lit(0)), finding), 50).alias("summary"))


@query("SELECT doc_id, CASE WHEN quality IN (0, 1) AND n_chars >= 100 THEN 'valid' WHEN quality IN (0, 1) THEN 'too_short' ELSE 'unresolved' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def ext25_constraints(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    allowed = F.col("quality").isin(0, 1)
    return both.select("doc_id", F.when(allowed & (F.col("n_chars") >= 100), "valid").when(allowed, "too_short").otherwise("unresolved").alias("status"))


# ---------------------------------------------------------------- audit and repair

@query(rf"SELECT id, line FROM (SELECT id, line, text, row_number() OVER (PARTITION BY id ORDER BY line) a, row_number() OVER (PARTITION BY id ORDER BY line DESC) b FROM {R.LINES}) WHERE NOT ((a <= 3 OR b <= 3) AND regexp_matches(trim(text), '^\d{{1,4}}$|(?i)licensed under'))")
def qua7_furniture(spark, d):
    return sections.without_furniture(R.lines(spark, d), "(?i)licensed under").select("id", "line")


@query("SELECT source, avg(length(trim(text))) < 50 AS unusable FROM documents GROUP BY 1")
def qua8_usability(spark, d):
    return table(spark, d, "documents").groupBy("source").agg((F.avg(F.length(F.trim("text"))) < 50).alias("unusable"))


@query("SELECT count(*) FILTER (WHERE n_chars <> length(text)) AS remaining FROM documents")
def qua11_post_condition(spark, d):
    return table(spark, d, "documents").agg(F.count_if(F.col("n_chars") != F.length("text")).alias("remaining"))


@query("SELECT c.conv_id, c.turn, coalesce(d.source, c.role) AS conference FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id")
def ups8_sync_fields(spark, d):
    master = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "source")
    return table(spark, d, "conversations").select("conv_id", "turn", "role").join(master, "conv_id", "left").select("conv_id", "turn", F.coalesce("source", "role").alias("conference"))


@query("SELECT doc_id, regexp_replace(text, '^The ', 'A ') AS text FROM documents")
def ups10_header_rewrite(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\AThe ", "A ").alias("text"))


@query("SELECT lang AS review_id, count(*) AS papers FROM (SELECT lang, doc_id FROM documents UNION SELECT 'toxic', doc_id FROM labels WHERE toxic = 1) u WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = u.doc_id AND quality = 0) GROUP BY 1")
def ups12_membership(spark, d):
    docs, l = table(spark, d, "documents"), table(spark, d, "labels")
    current = docs.select(F.col("lang").alias("review_id"), F.col("doc_id").alias("paper_id"))
    added = l.where("toxic = 1").select(F.lit("toxic").alias("review_id"), F.col("doc_id").alias("paper_id"))
    bad = l.where("quality = 0").select(F.col("doc_id").alias("paper_id"))
    removed = bad.join(current.union(added), "paper_id").select("review_id", "paper_id").distinct()
    return upserts.members(current, added, removed).groupBy("review_id").agg(F.count("*").alias("papers"))

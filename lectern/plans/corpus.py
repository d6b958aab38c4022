"""Search, sectioning, text, taxonomy, extraction, audit and upsert queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction, network, quality, search, sections, similarity, taxonomy, upserts
from ..sources.tables import page_links, page_metadata, table
from . import roles as R
from .registering import registry

FOUND, SQL, query = registry()


TOKENS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"


def tok(x: str) -> str:
    return TOKENS.format(x)


# ---------------------------------------------------------------- sources

@query(r"""SELECT page_id, regexp_extract(html, 'href="([^"]*)"', 1) AS href, len(regexp_extract_all(html, 'href="([^"]*)"'))::BIGINT AS n_links, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS h1 FROM pages""")
def src9_page_metadata(spark, d):
    p = table(spark, d, "pages")
    return page_metadata(p).join(p.select("page_id", F.regexp_extract("html", r'href="([^"]*)"', 1).alias("href")), "page_id").select("page_id", "href", "n_links", "h1")


@query(r"""SELECT DISTINCT page_id, href FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) WHERE href <> url""")
def src10_page_links(spark, d):
    return page_links(table(spark, d, "pages"))


# ---------------------------------------------------------------- search

_BM25 = f"""WITH t AS (SELECT id, {tok('title')} AS a, {tok('body')} AS b, conference FROM {R.PAPERS}),
 c AS (SELECT id, conference, len(a) + len(b) AS l, len(list_filter(a, lambda x: x = 'trash')) * 8.0 + len(list_filter(b, lambda x: x = 'trash')) AS t0, len(list_filter(a, lambda x: x = 'thing')) * 8.0 + len(list_filter(b, lambda x: x = 'thing')) AS t1 FROM t),
 g AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM c),
 s AS (SELECT id, conference, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / m)), 3) AS score FROM c, g WHERE t0 > 0 OR t1 > 0)"""


@query(_BM25 + " SELECT id, score FROM s ORDER BY score DESC, id LIMIT 50")
def ir3_bm25_search(spark, d):
    return search.search(R.papers(spark, d), "id", ["title", "body"], "Trash, thing!", 50).select("id", "score")


@query(_BM25 + ", r AS (SELECT *, row_number() OVER (PARTITION BY conference ORDER BY score DESC, id) n FROM s) SELECT conference, id, score FROM r WHERE n = 1 AND conference ILIKE '%src1%' ORDER BY score DESC, id LIMIT 20")
def ir5_search_by_group(spark, d):
    return search.search(R.papers(spark, d), "id", ["title", "body"], "trash thing", 20, conference="src1", group="conference").select("conference", "id", "score")


@query(f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tok('title')}) AS term FROM {R.PAPERS}) GROUP BY ALL")
def snk2_postings(spark, d):
    p = search.postings(R.papers(spark, d).select("id", "title"), "id", ["title"])
    return p.select("id", "term", "tf")


@query()
def ir4_snippet(spark, d):
    p = table(spark, d, "documents").where(F.lower("text").contains("trash"))
    return p.select("doc_id", search.snippet(F.col("text"), ["trash", "thing"]).alias("snippet"))


@query("""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v FROM u WHERE vec_id = (SELECT min(vec_id) FROM u))
 SELECT vec_id, round(list_cosine_similarity(u.v, q.v), 6) AS score FROM u, q ORDER BY score DESC, vec_id LIMIT 10""")
def ir6_cosine_top(spark, d):
    e = table(spark, d, "embeddings")
    return search.nearest(e, "vec_id", "embedding", e.orderBy("vec_id").limit(1), 10)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS size FROM embeddings")
def ir7_vector_size(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 4).alias("size"))


@query(_BM25.replace("= 'trash'", "= 'trash'") + f""", p AS (SELECT id, {tok("concat_ws(' | ', title, body)")} AS w FROM {R.PAPERS}),
 h AS (SELECT s.id, score, round_even(((list_contains(w, 'trash'))::INTEGER + (list_contains(w, 'thing'))::INTEGER + (list_contains(w, 'idiot'))::INTEGER) / 3.0::DOUBLE, 4) AS rerank_score FROM s JOIN p ON p.id = s.id ORDER BY score DESC, s.id LIMIT 40)
 SELECT id, score, rerank_score FROM h ORDER BY rerank_score DESC, score DESC, id LIMIT 15""")
def ir9_rerank(spark, d):
    p = R.papers(spark, d)
    hits = search.search(p, "id", ["title", "body"], "trash thing", 40)
    return search.rerank(hits, "trash thing idiot", F.concat_ws(" | ", "title", "body"), "id").select("id", "score", "rerank_score")


@query("SELECT count(*) AS scanned, count(*) FILTER (WHERE contains(lower(text), 'moron') OR contains(lower(text), 'clown')) AS matched FROM documents")
def ir11_keyword_scan(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").agg(F.count("*").alias("scanned"), F.count_if(low.contains("moron") | low.contains("clown")).alias("matched"))


# ---------------------------------------------------------------- sections

@query("SELECT l_orderkey, l_partkey AS start, greatest(l_partkey, coalesce(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1, 1000000)) AS stop FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def win1_next_start(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("start")).distinct()
    return sections.ends_before_next(s, "l_orderkey", "start", F.lit(1000000).cast("long")).withColumnRenamed("end", "stop")


@query("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) n FROM documents) WHERE n = 1")
def win2_top_of_group(spark, d):
    best = F.max_by(F.struct("doc_id", "n_chars"), F.struct(F.col("n_chars"), -F.col("doc_id")))
    return table(spark, d, "documents").groupBy("source").agg(best.alias("x")).select("source", "x.*")


@query(f"SELECT id, line, last_value(CASE WHEN starts_with(text, 'The') THEN text END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS header FROM {R.LINES}")
def win3_carried_header(spark, d):
    return sections.carried(R.lines(spark, d), F.col("text").startswith("The"), F.col("text"), "header").select("id", "line", "header")


@query(rf"""WITH f AS (SELECT id, line, text, regexp_matches(trim(text), '^#{{1,4}}\s+\S') AS h FROM {R.LINES}),
 r AS (SELECT *, sum(h::INT) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM f),
 s AS (SELECT id, section::BIGINT AS section, coalesce(max(CASE WHEN h THEN regexp_extract(trim(text), '^#{{1,4}}\s+(.+)$', 1) END), 'Abstract / Intro') AS heading, trim(coalesce(string_agg(CASE WHEN NOT h THEN text END, chr(10) ORDER BY line), ''), E' \n\t\r') AS text FROM r GROUP BY ALL)
 SELECT * FROM s WHERE text <> ''""")
def win4_markdown_sections(spark, d):
    return sections.markdown_sections(R.lines(spark, d))


@query(rf"""WITH f AS (SELECT id, line, text, regexp_matches(text, '(?i)^\s*(\d+(\.\d+)*[.\s]\s*)?(Abstract|Introduction|Methods|Results|Discussion|References)\s*:?\s*$') AS h FROM {R.LINES}),
 s AS (SELECT *, sum(h::INTEGER) OVER (PARTITION BY id ORDER BY line) AS section FROM f), g AS (SELECT id, section, max(regexp_extract(text, '(?i)(Abstract|Introduction|Methods|Results|Discussion|References)\s*:?\s*$', 1)) FILTER (h) AS t, regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (NOT h), ''), '^\s+|\s+$', '', 'g') AS text FROM s GROUP BY ALL)
 SELECT id, section::BIGINT AS section, CASE WHEN t IS NULL THEN 'Full Text' ELSE upper(t[1]) || lower(t[2:]) END AS heading, text FROM g WHERE text <> ''""")
def win5_keyword_sections(spark, d):
    return sections.keyword_sections(R.lines(spark, d), ["Abstract", "Introduction", "Methods", "Results", "Discussion", "References"])


@query(f"SELECT paper_id, author_id, row_number() OVER (PARTITION BY paper_id ORDER BY author_order, author_id)::INTEGER AS place FROM {R.PAPER_AUTHORS}")
def win8_ordinals(spark, d):
    return R.paper_authors(spark, d).select("paper_id", "author_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("author_order", "author_id")).alias("place"))


@query(f"SELECT paper_id, order_index, coalesce(sum(length(text) + 2) OVER (PARTITION BY paper_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM {R.TURNS}")
def win9_offsets(spark, d):
    return sections.offsets(R.turns(spark, d), "paper_id", "order_index", "text").select("paper_id", "order_index", "start")


@query(rf"SELECT id, line FROM (SELECT id, line, text, lead(text) OVER (PARTITION BY id ORDER BY line) AS nxt FROM {R.LINES}) WHERE trim(text) <> '' AND NOT regexp_matches(rtrim(text), '[.!?:;\"'')\]]$') AND regexp_matches(ltrim(nxt), '^\p{{Ll}}')")
def win10_mid_breaks(spark, d):
    return quality.mid_breaks(R.lines(spark, d)).select("id", "line")


@query(f"SELECT id, line FROM (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY line) a, row_number() OVER (PARTITION BY id ORDER BY line DESC) b FROM {R.LINES}) WHERE a <= 3 OR b <= 3")
def win12_edge_lines(spark, d):
    return sections.edge_lines(R.lines(spark, d)).select("id", "line")


@query(f"""SELECT id, entry::BIGINT AS entry, string_agg(trim(text), ' ' ORDER BY line) AS text FROM (SELECT id, line, text, sum((trim(text) = '' OR starts_with(text, 'The'))::INT) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS entry FROM {R.LINES}) WHERE trim(text) <> '' GROUP BY ALL""")
def win13_entries(spark, d):
    return sections.entries(R.lines(spark, d), "^The")


@query(f"""WITH RECURSIVE o AS (SELECT id, line AS page FROM {R.LINES} WHERE starts_with(text, 'The')),
 t(id, start) AS (SELECT id, min(page) FROM o GROUP BY 1 UNION ALL SELECT t.id, (SELECT min(page) FROM o WHERE o.id = t.id AND o.page > t.start + 1) FROM t WHERE EXISTS (SELECT 1 FROM o WHERE o.id = t.id AND o.page > t.start + 1)) SELECT id, start::BIGINT AS start FROM t""")
def win14_gap_boundaries(spark, d):
    pages = R.lines(spark, d).select("id", F.col("line").alias("page"), F.col("text").startswith("The").alias("opens"))
    return sections.gap_boundaries(pages)


@query(f"SELECT id, coalesce(CASE WHEN contains(lower(title), 'the') THEN 'article' WHEN contains(lower(title), 'der') THEN 'artikel' END, ['x', 'y', 'z'][id % 3 + 1]) AS lens FROM {R.PAPERS}")
def win17_cyclic_lens(spark, d):
    return R.papers(spark, d).select("id", taxonomy.lens(F.col("title"), {"article": ["the"], "artikel": ["der"]}, ["x", "y", "z"], F.col("id")).alias("lens"))


# ---------------------------------------------------------------- text

@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS title_key, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS alnum, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def str14_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.title_key("p_name").alias("title_key"), T.alnum_key("p_type").alias("alnum"), T.slug("p_type").alias("slug"))


@query("SELECT p_partkey, p_size AS start_page, p_size + p_partkey % 9 AS end_page FROM part")
def str1_page_range(spark, d):
    c = F.concat(F.lit("Proc., pp. "), F.col("p_size"), F.lit("–"), F.col("p_size") + F.col("p_partkey") % 9)
    return table(spark, d, "part").select("p_partkey", T.page_range(c, F.lit("")).alias("r")).select("p_partkey", "r.start_page", F.col("r.end_page").cast("long").alias("end_page"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 + 1 >= 6 THEN 'Full Paper' WHEN p_partkey % 9 + 1 >= 3 THEN 'Short Paper' ELSE 'Poster' END AS paper_type FROM part")
def str2_paper_type(spark, d):
    p = table(spark, d, "part").withColumn("last", F.col("p_size") + F.col("p_partkey") % 9)
    return p.select("p_partkey", T.paper_type("p_name", F.lit("x"), "p_size", "last").alias("paper_type"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) >= 2000 UNION ALL SELECT o_orderkey, 2026 FROM orders WHERE year(o_orderdate) < 2000")
def dte2_year_of_name(spark, d):
    name = F.concat(F.lit("proc-"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".pdf"))
    return table(spark, d, "orders").select("o_orderkey", T.year_in(name, 2026).alias("year"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INTEGER AS words, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS first FROM documents")
def str41_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("words"), T.squeeze(T.first_line("text")).alias("first"))


@query("SELECT s_suppkey, CASE WHEN contains(s_name, '#') THEN replace(split_part(s_name, '#', 2), '|', '') ELSE s_name END AS tail FROM supplier")
def str28_name_tail(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_name").contains("#"), F.replace(F.split_part("s_name", F.lit("#"), F.lit(2)), F.lit("|"), F.lit(""))).otherwise(F.col("s_name")).alias("tail"))


@query("SELECT doc_id, CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '...' ELSE text END AS cut FROM documents")
def str39_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate("text", 180).alias("cut"))


@query(r"SELECT doc_id, regexp_replace(replace(text, '|', '\|'), '\s*\n\s*', ' ', 'g') AS cell FROM documents")
def str43_markdown_cell(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cell("text").alias("cell"))


@query(r"SELECT doc_id, len(s)::INTEGER AS sentences, s[1] AS first FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> '') AS s FROM documents)")
def str37_sentences(spark, d):
    s = T.sentences("text")
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("sentences"), F.get(s, F.lit(0)).alias("first"))


@query()
def str18_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_paragraphs("text").alias("text"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def hsh1_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


# ---------------------------------------------------------------- taxonomy

RULES = {"tone": {"insult": ["idiot", "moron", "loser"], "scorn": ["trash", "scum", "worthless"]}, "rights": {"license": ["licensed under", "license"], "contact": ["@mail"]}}
DEFAULTS = {"tone": "neutral"}


def _label_sql() -> str:
    parts = []
    for dim, labels in RULES.items():
        for label, p in labels.items():
            pattern = "(?i)(" + "|".join(p) + ")"
            hits = "(" + " + ".join(f"len(regexp_extract_all(body, '(?i){x}'))" for x in p) + ")"
            parts.append(f"SELECT id, '{dim}' AS dimension, '{label}' AS label, CASE WHEN regexp_matches(title, '{pattern}') THEN 5 WHEN {hits} >= 3 THEN 4 WHEN {hits} >= 1 THEN 3 ELSE 1 END AS centrality, 0.9::DOUBLE AS confidence FROM p WHERE regexp_matches(title || ' ' || body, '{pattern}')")
        if dim in DEFAULTS:
            every = "(?i)(" + "|".join(x for p in labels.values() for x in p) + ")"
            parts.append(f"SELECT id, '{dim}', '{DEFAULTS[dim]}', 1, 0.5::DOUBLE FROM p WHERE NOT regexp_matches(title || ' ' || body, '{every}')")
    return f"WITH p AS {R.PAPERS} " + " UNION ALL ".join(parts)


@query(_label_sql())
def tax2_labels(spark, d):
    return taxonomy.classify(R.papers(spark, d), RULES, DEFAULTS)


@query(f"SELECT label, count(*) AS n FROM ({_label_sql()}) GROUP BY 1 ORDER BY n DESC, label")
def tax7_label_counts(spark, d):
    return taxonomy.classify(R.papers(spark, d), RULES, DEFAULTS).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query(f"SELECT id, label, confidence, unnest(CASE WHEN dimension = 'tone' THEN ['tone', 'voice'] ELSE [dimension] END) AS dimension, centrality FROM ({_label_sql()})")
def tax5_mirrored(spark, d):
    return taxonomy.mirrored(taxonomy.classify(R.papers(spark, d), RULES, DEFAULTS), "tone", "voice")


def _snippet_sql(p: str, around: int = 40) -> str:
    """The context of the first match of a pattern in body; null without one."""
    at, n = f"(length(regexp_extract(body, '(?is)^(.*?)({p})', 1)) + 1)", f"length(regexp_extract(body, '(?i)({p})'))"
    return (f"CASE WHEN regexp_matches(body, '(?i)({p})') THEN CASE WHEN {at} - {around} > 1 THEN '...' ELSE '' END || substr(body, greatest({at} - {around}, 1)::BIGINT, (least({at} + {n} - 1 + {around}, length(body)) - greatest({at} - {around}, 1) + 1)::BIGINT)"
            f" || CASE WHEN {at} + {n} - 1 + {around} < length(body) THEN '...' ELSE '' END END")


@query(f"WITH p AS {R.PAPERS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{f}' AS family, '{label}' AS label, coalesce({', '.join(_snippet_sql(p) for p in ps)}) AS snippet FROM p" for f, labels in RULES.items() for label, ps in labels.items()) + ") WHERE snippet IS NOT NULL")
def tax7_concepts(spark, d):
    return taxonomy.concepts(R.papers(spark, d), RULES, "body")


# ---------------------------------------------------------------- extraction

@query("SELECT l.doc_id AS paper_id, p.p AS property_id, 2 AS version FROM labels l CROSS JOIN (VALUES ('quality'), ('toxic')) p(p) WHERE NOT (p.p = 'toxic' AND toxic = 1)")
def ext26_missing_cells(spark, d):
    l = table(spark, d, "labels")
    props = spark.createDataFrame([("quality", 2), ("toxic", 2)], "property_id string, version int")
    seen = l.select(F.col("doc_id").alias("paper_id"), F.lit("toxic").alias("property_id"), F.lit(2).alias("version"), F.when(F.col("toxic") == 1, "extracted").otherwise("inferred").alias("status"))
    return extraction.missing(l.select(F.col("doc_id").alias("paper_id")), props, seen)


@query(f"SELECT paper_id, order_index FROM (SELECT *, max(heading = 'system') OVER (PARTITION BY paper_id) AS s FROM {R.TURNS}) WHERE heading = 'system' OR NOT s")
def ext2_candidate_sections(spark, d):
    return extraction.candidates(R.turns(spark, d), ["system"]).select("paper_id", "order_index")


_OFFER = r"CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])that($|[^\p{L}\p{N}])') THEN {'v': 'that', 'c': 0.9::DOUBLE} WHEN contains(lower(text), 'tion') THEN {'v': 'tion', 'c': 0.8::DOUBLE} END"


@query(f"SELECT paper_id, min_by({_OFFER}, order_index).v AS value, min(order_index) AS order_index, min_by({_OFFER}, order_index).c AS confidence FROM {R.TURNS} WHERE {_OFFER} IS NOT NULL GROUP BY 1")
def ext3_first_value(spark, d):
    return extraction.first_value(R.turns(spark, d), "p", ["that"], ["tion"]).select("paper_id", "value", "order_index", "confidence")


@query(f"SELECT p.paper_id, v.v AS value, CASE WHEN v IS NULL THEN 'not_present' ELSE 'extracted' END AS status FROM (SELECT DISTINCT paper_id FROM {R.TURNS}) p LEFT JOIN (SELECT paper_id, min_by({_OFFER}, order_index) AS v FROM {R.TURNS} WHERE {_OFFER} IS NOT NULL GROUP BY 1) x USING (paper_id)")
def ext5_with_absent(spark, d):
    t = R.turns(spark, d)
    return extraction.with_absent(t.select("paper_id").distinct(), extraction.first_value(t, "p", ["that"], ["tion"]), "p").select("paper_id", "value", "status")


@query("SELECT doc_id AS paper_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels")
def ext6_grid(spark, d):
    l = table(spark, d, "labels")
    tall = l.select(F.col("doc_id").alias("paper_id"), F.explode(F.array(F.struct(F.lit("quality").alias("property_id"), F.col("quality").cast("string").alias("value")), F.struct(F.lit("toxic").alias("property_id"), F.col("toxic").cast("string").alias("value")))).alias("x")).select("paper_id", "x.*")
    return extraction.grid(tall, ["quality", "toxic"])


@query(rf"""WITH o AS (SELECT paper_id, order_index, heading, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY paper_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(length(text) + 2) OVER (PARTITION BY paper_id) - 2 AS total FROM {R.TURNS}),
 h AS (SELECT *, start + length(regexp_extract(text, '(?is)^(.*?)\bthat\b', 1)) AS pos, regexp_extract(text, '(?i)\bthat\b') AS term FROM o WHERE regexp_matches(text, '(?i)\bthat\b'))
 SELECT paper_id, round(arg_min(pos * 100.0::DOUBLE / greatest(total, 1), pos), 1) AS percent, arg_min(heading, pos) AS heading, arg_min(term, pos) AS term FROM h GROUP BY 1""")
def ext7_first_location(spark, d):
    return extraction.first_location(R.turns(spark, d), r"(?i)\bthat\b")


@query("SELECT d.doc_id, coalesce(CASE toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END, 'unknown') AS value FROM documents d LEFT JOIN labels USING (doc_id)")
def ext23_lookup(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("v"))
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("v", F.lit("unknown")).alias("value"))


# ---------------------------------------------------------------- audit and upserts

@query(rf"""SELECT a.*, b.* FROM (SELECT count(*) AS papers, count(*) FILTER (WHERE trim(body) = '') AS blank, count(*) FILTER (WHERE length(trim(text)) < 150) AS short FROM {R.PAPERS}) a,
 (SELECT sum((len(regexp_extract_all(text, '\(')) > len(regexp_extract_all(text, '\)')))::INT)::BIGINT AS open_citations, sum((regexp_matches(rtrim(text), '(?i)(^|\s)({"|".join(quality.CONNECTORS)})$') OR regexp_matches(rtrim(text), '[&;,(]$'))::INT)::BIGINT AS connectors, sum(len(regexp_extract_all(text, '\s[,.;:!?]')))::BIGINT AS stray_blanks FROM {R.LINES}) b""")
def qua1_audit(spark, d):
    return quality.audit(R.papers(spark, d), R.lines(spark, d))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(th at|tha t|wi th|wit h|fr om|fro m)\b'))::INTEGER AS splits FROM documents")
def qua6_split_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"(?i)\b(th at|tha t|wi th|wit h|fr om|fro m)\b")).alias("splits"))


@query("SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) n FROM events) WHERE n = 1")
def ups1_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return upserts.upsert(e.where("event_id % 2 = 0"), e, ["user_id"], "event_id")


@query("SELECT display_name, id >= 0 AS numbered FROM (SELECT DISTINCT event_type AS display_name, 0 AS id FROM events)")
def ups2_add_names(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("display_name"))
    known = e.groupBy().agg(F.min("display_name").alias("display_name")).withColumn("id", F.lit(1).cast("long"))
    made = upserts.add_names(known, e)
    return made.select("display_name", (F.col("id") >= 0).alias("numbered"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role <> 'user' UNION ALL SELECT conv_id, turn, text FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role <> 'user')")
def ups3_replace_children(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", "role")
    return upserts.replace_children(c.where("role = 'user'").drop("role"), c.where("role <> 'user'").drop("role"), "conv_id")


@query("SELECT doc_id, 1 AS quality, quality <> 1 AS changed FROM labels")
def ups4_update_changed(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return upserts.update_where_changed(l, l.withColumn("quality", F.lit(1)), "doc_id", "quality")


@query("SELECT DISTINCT l_orderkey, CASE WHEN l_suppkey = 2 THEN 1 ELSE l_suppkey END AS l_suppkey FROM lineitem")
def ups5_rekey(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    merges = spark.createDataFrame([(2, 1)], "old_key long, new_key long")
    return upserts.rekey(l, merges, "l_suppkey", ["l_orderkey", "l_suppkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def ups7_cascade(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return upserts.surviving(l, table(spark, d, "orders").where("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def inc1_pending(spark, d):
    done = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "complete").otherwise("open").alias("status"))
    return upserts.pending(table(spark, d, "documents").select("doc_id"), done, "doc_id")


# ---------------------------------------------------------------- fuzzy matching and citations

_CITE = f"""WITH t AS (SELECT item_id AS target_id, list_slice(list_filter({tok('text')}, lambda x: length(x) > 4), 1, 6) AS k FROM benchmark),
 i AS (SELECT target_id, unnest(list_distinct(k)) AS token FROM t WHERE len(list_distinct(k)) >= 3),
 l AS (SELECT doc_id AS line_id, unnest(list_distinct(list_filter({tok('text')}, lambda x: length(x) > 4))) AS token FROM documents),
 m AS (SELECT line_id, target_id, count(*) AS common FROM l JOIN i USING (token) GROUP BY ALL HAVING count(*) >= 3)"""


@query(_CITE + " SELECT line_id, min(target_id) AS target_id, min_by(common, target_id) AS common FROM m GROUP BY 1")
def ana2_citations(spark, d):
    cited = table(spark, d, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("title"))
    return network.citation_links(cited, table(spark, d, "documents").select(F.col("doc_id").alias("line_id"), "text"))


#: Documents as volumes: of every nine lines the first is a paper's header, the second opens its references and the eighth shuts them.
_VOLUME = f"""(SELECT id, line, CASE line % 9 WHEN 1 THEN '# ' || text WHEN 2 THEN CASE WHEN line % 2 = 0 THEN 'References' ELSE '## References' END WHEN 8 THEN '## Appendix' ELSE text || ' In Proceedings of X' END AS text,
 CAST(2000 + id % 30 AS INTEGER) AS year FROM {R.LINES})"""


def _volumes(spark, d):
    case = F.expr("CASE line % 9 WHEN 1 THEN concat('# ', text) WHEN 2 THEN CASE WHEN line % 2 = 0 THEN 'References' ELSE '## References' END WHEN 8 THEN '## Appendix' ELSE concat(text, ' In Proceedings of X') END")
    return R.lines(spark, d).select("id", "line", case.alias("text"), (2000 + F.col("id") % 30).cast("int").alias("year"))


@query(f"""WITH v AS {_VOLUME},
 m AS (SELECT *, trim(text, ' ') AS t, CASE WHEN lower(trim(text, ' ')) = 'references' OR starts_with(lower(trim(text, ' ')), '## references') THEN 2 WHEN starts_with(trim(text, ' '), '# ') OR (starts_with(trim(text, ' '), '## ') AND NOT contains(lower(text), 'references')) THEN 1 END AS mark FROM v),
 s AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS state, coalesce(last_value(CASE WHEN starts_with(t, '# ') AND length(t) > 10 AND NOT starts_with(lower(t), '# references') THEN line END IGNORE NULLS) OVER w, 0) AS citing FROM m WINDOW w AS (PARTITION BY id ORDER BY line)),
 r AS (SELECT id, line, citing, t, year FROM s WHERE state = 2 AND coalesce(mark, 0) <> 2 AND length(t) >= 20 AND contains(lower(t), 'proceedings of')),
 i AS (SELECT item_id AS target_id, 2000 + item_id % 40 AS year, unnest(list_distinct(list_slice(list_filter({tok('text')}, lambda x: length(x) > 4), 1, 6))) AS token FROM benchmark),
 n AS (SELECT target_id FROM i GROUP BY 1 HAVING count(*) >= 3),
 l AS (SELECT id, line, year, unnest(list_distinct(list_filter({tok('t')}, lambda x: length(x) > 4))) AS token FROM r),
 c AS (SELECT id, line, target_id, count(*) FROM l JOIN i ON i.token = l.token AND i.year <= l.year WHERE target_id IN (FROM n) GROUP BY ALL HAVING count(*) >= 3),
 f AS (SELECT id, line, min(target_id) AS target_id FROM c GROUP BY ALL)
 SELECT f.id, citing, target_id, min(f.line) AS line, min_by(substr(t, 1, 150), f.line) AS context FROM f JOIN r ON r.id = f.id AND r.line = f.line GROUP BY ALL""")
def ana2_reference_blocks(spark, d):
    cited = table(spark, d, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("title"), (2000 + F.col("item_id") % 40).alias("year"))
    return network.block_citations(cited, _volumes(spark, d))


def _heads(spark, d):
    """The first sentence of each document as a header line of one volume: block, line, text."""
    return table(spark, d, "documents").select(F.lit(0).alias("block"), F.col("doc_id").alias("line"), F.get(T.sentences("text"), F.lit(0)).alias("text"))


def _registry(spark, d):
    """Registered papers: the first sentence of a benchmark passage is the title, the whole its abstract."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("paper_id"), F.lit(0).alias("block"), F.get(T.sentences("text"), F.lit(0)).alias("title"), F.col("text").alias("abstract"))


@query()
def jn13_fuzzy_best(spark, d):
    return similarity.best_match(_registry(spark, d).withColumnRenamed("title", "text"), _heads(spark, d), "paper_id", "line", "text", 80.0)

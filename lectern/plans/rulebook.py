"""Types, conferences, headings, sections, audits, page records and finding texts under their whole rules, as queries.

Where the given tables lack what a rule looks at, it is laid around their own texts by expressions that Spark and
DuckDB read alike, so that every branch has rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as X
from ..operators import extraction, quality, sections
from ..sources import pages
from ..sources.tables import table
from . import roles as R
from .people import _list, _strip
from .registering import registry

FOUND, SQL, query = registry()


def _docs(spark, d, **columns):
    """documents with columns by expressions over doc_id, source and text."""
    rows = table(spark, d, "documents")
    return rows.select("doc_id", "text", *[F.expr(x).alias(n) for n, x in columns.items()])


def _select(**columns) -> str:
    return "(SELECT doc_id, text, " + ", ".join(f"{x} AS {n}" for n, x in columns.items()) + " FROM documents)"


# ---------------------------------------------------------------- pages

_PAGE = """concat(CASE page_id % 4 WHEN 0 THEN '<meta name="DC.title" content=" A &amp; B&#233; x&#x27;y &eacute; &nothing; ' WHEN 2 THEN '<meta name="DC.title" content="Poster on &lt;b&gt; ' ELSE '<meta name="x" content="' END, page_id, ' ">',
 CASE WHEN page_id % 3 > 0 THEN '<meta name="DC.creator" content="Lind, Bo "><meta name="DC.creator" content="M&uuml;ller, A.">' ELSE '' END, CASE WHEN page_id % 2 = 0 THEN '<meta name="DCTERMS.issued" content="2019-05-01">' ELSE '' END,
 CASE page_id % 5 WHEN 0 THEN '<meta name="DCTERMS.bibliographicCitation" content="In X &amp; Y, pp. 10-19. Z">' WHEN 1 THEN '<meta name="DCTERMS.bibliographicCitation" content="X, p. 7">' ELSE '' END, CASE WHEN page_id % 7 = 0 THEN '<a href="https://doi.org/10.1/ab">' ELSE '' END,
 CASE WHEN page_id % 3 = 1 THEN '<META name="description" content=" We &#8211; do ">' ELSE '' END, CASE WHEN page_id % 3 = 2 THEN '<a href="/bitstream/1/9/a_12-13.pdf?x=1">' ELSE '' END,
 CASE page_id % 6 WHEN 0 THEN '<meta name="DC.description" content="Long Paper"><meta name="DC.description" content="other">' WHEN 1 THEN '<meta name="DC.description" content="Practice-Oriented Paper">' ELSE '' END, CASE WHEN page_id % 4 = 3 THEN replace(html, '<title>', '<nil>') ELSE html END)"""


def _plain(x: str) -> str:
    known = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&#233;", "é"), ("&#x27;", "''"), ("&eacute;", "é"), ("&uuml;", "ü"), ("&#8211;", "–"), ("&amp;", "&")]
    for a, b in known:
        x = f"replace({x}, '{a}', '{b}')"
    return _strip(x)


def _tag(name: str, value: str = '[^"]+') -> str:
    return f'<meta\\s+name="{name}"\\s+content="({value})"'


@query(f"""WITH h AS (SELECT page_id, {_PAGE} AS html FROM pages),
 r AS (SELECT page_id, {_plain(f"coalesce(nullif(regexp_extract(html, '{_tag('DC\\.title')}', 1), ''), regexp_extract(html, '<title>([^<]+)</title>', 1))")} AS title,
  list_transform(regexp_extract_all(html, '{_tag('DC\\.creator')}', 1), lambda x: {_plain('x')}) AS authors, coalesce(nullif(regexp_extract(html, '<meta\\s+name="DCTERMS\\.issued"\\s+content="(\\d{{4}})[^"]*"', 1), '')::INTEGER, 2000) AS year,
  {_plain(f"nullif(regexp_extract(html, '{_tag('DCTERMS\\.bibliographicCitation')}', 1), '')")} AS c0, nullif(regexp_extract(html, 'https?://doi\\.org/([^"]+)', 1), '') AS doi, {_plain(f"nullif(regexp_extract(html, '(?i){_tag('(?:DCTERMS\\.abstract|DC\\.description\\.abstract|description)')}', 1), '')")} AS a0,
  'http://base' || nullif(regexp_extract(html, 'href="([^"]*bitstream/1/[^"]+\\.pdf[^"]*)"', 1), '') AS pdf_url, list_transform(regexp_extract_all(html, '{_tag('DC\\.description')}', 1), lambda x: {_plain('x')}) AS descriptions FROM h),
 p AS (SELECT *, nullif(c0, '') AS citation, nullif(a0, '') AS abstract, CASE page_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 7 ELSE CASE WHEN page_id % 3 = 2 THEN 12 END END AS start_page, CASE page_id % 5 WHEN 0 THEN 19 WHEN 1 THEN 7 ELSE CASE WHEN page_id % 3 = 2 THEN 13 END END AS end_page FROM r WHERE title <> '')
 SELECT page_id, title, array_to_string(authors, '; ') AS authors, year, citation, doi, abstract, pdf_url, array_to_string(descriptions, '; ') AS descriptions, page_id % 6 = 1 AS practice, start_page, end_page, CASE WHEN page_id % 6 = 0 THEN 'Full Paper' WHEN page_id % 6 = 1 AND end_page - start_page >= 5 THEN 'Full Paper' WHEN page_id % 6 = 1 THEN 'Short Paper'
  WHEN contains(lower(title), 'symposium') THEN 'Symposium' WHEN contains(lower(title), 'poster') THEN 'Poster' WHEN end_page - start_page >= 5 THEN 'Full Paper' WHEN end_page - start_page >= 2 THEN 'Short Paper' WHEN end_page - start_page >= 0 THEN 'Poster' ELSE 'Short Paper' END AS paper_type FROM p""")
def src9_page_records(spark, d):
    own = table(spark, d, "pages").select("page_id", F.expr(_PAGE).alias("html"))
    got = pages.page_records(own, "http://base", 2000)
    return got.withColumns({c: F.array_join(c, "; ") for c in ("authors", "descriptions")})


# ---------------------------------------------------------------- types, conferences, headings

_PAPER = dict(title="CASE doc_id % 11 WHEN 0 THEN 'A Symposium on it' WHEN 1 THEN 'Our symposia' ELSE 'Plain' END", section="CASE WHEN doc_id % 13 = 0 THEN ' Symposia ' ELSE 'Papers' END", kind="CASE doc_id % 17 WHEN 0 THEN 'symposium' WHEN 1 THEN 'Poster' END",
              author="CASE doc_id % 7 WHEN 0 THEN 'Bo Lind (co-chair)' WHEN 1 THEN 'Bo (Organizers)' ELSE 'Bo Lind' END", first="CASE doc_id % 5 WHEN 0 THEN concat('x ', text) WHEN 1 THEN concat(text, ' in this symposium we') ELSE concat(substr(text, 1, 700), ' This symposium addresses all') END",
              abstract="CASE WHEN doc_id % 19 = 0 THEN concat(substr(text, 1, 390), ' In this symposium') ELSE '' END", pages="doc_id % 9")


@query(f"""SELECT doc_id, lower(coalesce(kind, '')) = 'symposium' OR lower(trim(section)) IN ('symposia', 'symposium') OR regexp_matches(title, '(?i)\\b(?:symposium|symposia)\\b') OR regexp_matches(author, '{X.CHAIRED}') OR regexp_matches(substr(first, 1, 800), '{X.CHAIRED}')
 OR regexp_matches(substr(first, 1, 800), '{X.SYMPOSIUM}') OR regexp_matches(substr(abstract, 1, 400), '{X.SYMPOSIUM}') AS chaired FROM {_select(**_PAPER)}""")
def str5_chaired(spark, d):
    return _docs(spark, d, **_PAPER).select("doc_id", X.chaired("title", "section", "kind", F.array("author"), "first", "abstract").alias("chaired"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(substr(first, 1, 800), '{X.CHAIRED}') OR regexp_matches(author, '{X.CHAIRED}') OR regexp_matches(substr(first, 1, 1200), '{X.SYMPOSIUM}') OR regexp_matches(abstract, '{X.SYMPOSIUM}') OR contains(lower(title), 'symposium') OR lower(coalesce(kind, '')) = 'symposium' THEN 'Symposium'
 WHEN pages >= 6 THEN 'Full Paper' WHEN pages >= 3 THEN 'Short Paper' ELSE 'Poster' END AS paper_type FROM {_select(**_PAPER)}""")
def str4_type_of_pages(spark, d):
    return _docs(spark, d, **_PAPER).select("doc_id", X.type_of_pages("pages", "first", "title", "abstract", "author", "kind").alias("paper_type"))


_VENUES = {"CSCL": ("10.22318/cscl", "computer-supported collaborative learning"), "ICLS": ("10.22318/icls", "international conference of the learning sciences")}
_CITED = dict(citation="CASE doc_id % 8 WHEN 0 THEN concat('X. In Y (Ed.), Proceedings of the 3rd ', CASE WHEN doc_id % 3 = 0 THEN 'cscl' ELSE 'ICLS' END, ' meeting') WHEN 1 THEN 'at Cscl 2019' WHEN 2 THEN 'ICLS2020 book' WHEN 3 THEN 'the Computer-Supported Collaborative Learning book' WHEN 4 THEN 'International Conference of the Learning Sciences' WHEN 5 THEN substr(text, 1, 60) END",
              doi="CASE doc_id % 10 WHEN 0 THEN '10.22318/CSCL2019.1' WHEN 1 THEN 'https://doi.org/10.22318/icls.7' END", fallback="CASE doc_id % 3 WHEN 0 THEN 'the cscl' WHEN 1 THEN 'ICLS' ELSE source END")


@query(f"""SELECT doc_id, CASE WHEN contains(lower(coalesce(doi, '')), '10.22318/cscl') THEN 'CSCL' WHEN contains(lower(coalesce(doi, '')), '10.22318/icls') THEN 'ICLS' WHEN regexp_extract(coalesce(citation, ''), '(?i)\\bin\\s+.*?proceedings\\s+of.*?\\b(cscl|icls)\\b', 1) <> '' THEN upper(regexp_extract(citation, '(?i)\\bin\\s+.*?proceedings\\s+of.*?\\b(cscl|icls)\\b', 1))
 WHEN regexp_matches(citation, '(?i)\\bcscl\\s*\\d{{4}}\\b|\\bcomputer-supported collaborative learning\\b') THEN 'CSCL' WHEN regexp_matches(citation, '(?i)\\bicls\\s*\\d{{4}}\\b|\\binternational conference of the learning sciences\\b') THEN 'ICLS' WHEN contains(lower(fallback), 'cscl') THEN 'CSCL' ELSE 'ICLS' END AS conference FROM {_select(**_CITED)}""")
def str6_conference_rules(spark, d):
    return _docs(spark, d, **_CITED).select("doc_id", X.conference_of("citation", "doi", "fallback", _VENUES).alias("conference"))


_ALIASES = {"introduction": ["introduction", "background", "background and introduction"], "method": ["method", "methods", "research design"], "results": ["results", "findings"], "conclusion": ["conclusion"]}
_HEADS = "CASE doc_id % 9 WHEN 0 THEN '2.1 Background and Introduction' WHEN 1 THEN ' Methods' WHEN 2 THEN 'Results and Findings: more' WHEN 3 THEN '3 - Method, results' WHEN 4 THEN 'Research  Design' WHEN 5 THEN 'research design' WHEN 6 THEN '' WHEN 7 THEN concat('Conclusion of ', source) ELSE substr(text, 1, 40) END"


@query(f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN h IN ({_list(a)}) OR len(list_intersect(string_split_regex(h, '\\s+'), [{_list(a)}])) > 0 THEN '{r}' END" for r, a in _ALIASES.items())}], lambda x: x IS NOT NULL), '; ') AS roles
 FROM (SELECT doc_id, {_strip("regexp_replace(lower(" + _strip('heading') + "), '^[\\d.\\s\\-:]+', '')")} AS h FROM {_select(heading=_HEADS)})""")
def str11_roles(spark, d):
    return _docs(spark, d, heading=_HEADS).select("doc_id", F.array_join(X.roles_of("heading", _ALIASES), "; ").alias("roles"))


_GROUP = "CASE doc_id % 6 WHEN 0 THEN ' Long Paper Sessions ' WHEN 1 THEN 'DEMOS' WHEN 2 THEN 'posters and late breaking results' WHEN 3 THEN 'late posters' WHEN 4 THEN source ELSE 'practice-oriented papers' END"


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Long Papers' WHEN 1 THEN 'Interactive Tools and Demos' WHEN 2 THEN 'Posters' WHEN 3 THEN 'Late Posters' WHEN 4 THEN upper(source[1]) || lower(source[2:]) ELSE 'Practise-Oriented Papers' END AS toc_group FROM {_select(heading=_GROUP, source='source')}")
def str12_toc_groups(spark, d):
    return _docs(spark, d, heading=_GROUP).select("doc_id", X.toc_group("heading").alias("toc_group"))


_SHOWN = dict(heading="CASE doc_id % 8 WHEN 0 THEN '1. Introduction to it' WHEN 1 THEN '* Results' WHEN 2 THEN 'Methods: how we did all of this in the rooms of many schools' WHEN 3 THEN 'Poster 3: how we did all of this in the rooms of many schools' WHEN 4 THEN 'What now?' WHEN 5 THEN 'Abstract and Introduction' WHEN 6 THEN '' ELSE substr(text, 1, 50) END",
              norm="CASE doc_id % 3 WHEN 0 THEN 'Methodology & Context' WHEN 1 THEN 'of rooms' ELSE '' END", ab="doc_id % 23 = 0", intro="doc_id % 29 = 0")


@query(f"""WITH h AS (SELECT *, {_strip("regexp_replace(" + _strip("regexp_replace(" + _strip('heading') + ", '^[0-9]+[.\\s\\-]+', '')") + ", '^[●*\\-]\\s*', '')")} AS h, {_strip('heading')} AS raw FROM {_select(**_SHOWN)}),
 w AS (SELECT *, length(h) > 35 OR ends_with(h, ':') OR ends_with(h, '(') OR contains(h, '.') OR contains(h, '?') AS wordy, {_strip("split_part(h, ':', 1)")} AS head FROM h)
 SELECT doc_id, CASE WHEN ab THEN 'Abstract' WHEN intro OR lower(raw) IN ('abstract & introduction', 'abstract and introduction') THEN 'Introduction' WHEN wordy AND contains(h, ':') AND length(split_part(h, ':', 1)) <= 30 AND length(head) >= 3 AND NOT starts_with(lower(head), 'poster') THEN head
 WHEN wordy THEN CASE doc_id % 3 WHEN 0 THEN 'Method' WHEN 1 THEN 'Of Rooms' ELSE 'Main Body' END WHEN h <> '' THEN h ELSE CASE doc_id % 3 WHEN 0 THEN 'Method' ELSE 'Main Body' END END AS name FROM w""")
def str13_display_names(spark, d):
    return _docs(spark, d, **_SHOWN).select("doc_id", X.display_name("heading", "norm", "ab", "intro", {"methodology & context": "Method"}).alias("name"))


# ---------------------------------------------------------------- sections

#: Documents whose every fifth line is a heading of some kind.
_LINED = "array_join(transform(split(text, chr(10)), (x, i) -> CASE (i + doc_id) % 10 WHEN 1 THEN '2.1 Methods and more' WHEN 3 THEN 'III Results' WHEN 5 THEN 'Discussion.' WHEN 6 THEN ' Limitations' WHEN 8 THEN '(3) References' WHEN 9 THEN '' ELSE x END), chr(10))"
_LINED_SQL = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1 + doc_id) % 10 WHEN 1 THEN '2.1 Methods and more' WHEN 3 THEN 'III Results' WHEN 5 THEN 'Discussion.' WHEN 6 THEN ' Limitations' WHEN 8 THEN '(3) References' WHEN 9 THEN '' ELSE x END), chr(10))"
_CANON = f"""l AS (SELECT doc_id AS id, unnest(range(len(string_split(t, chr(10))))) AS line, {_strip('unnest(string_split(t, chr(10)))')} AS s FROM (SELECT doc_id, {_LINED_SQL} AS t FROM documents)),
 k AS (SELECT *, CASE WHEN length(s) <= 60 AND NOT ends_with(s, '.') THEN CASE {' '.join(f"WHEN regexp_matches({_strip("regexp_replace(s, '^(?:[0-9IVX]+(?:\\.[0-9]+)*|\\([0-9]+\\))\\s*', '')")}, '(?i)^(?:{p})\\b') THEN '{n}'" for n, p in sections.CANONICAL.items())} END END AS c FROM l WHERE s <> ''),
 h AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY id ORDER BY line), 'Abstract & Introduction') AS heading FROM k),
 r AS (SELECT id, heading, line, s FROM h WHERE c IS NULL UNION ALL SELECT doc_id, 'Abstract & Introduction', -1, '### Abstract' || chr(10) || source || chr(10) || chr(10) FROM documents WHERE doc_id % 2 = 0),
 x AS (SELECT id, heading, {_strip("string_agg(s, chr(10) || chr(10) ORDER BY line)")} AS text FROM r GROUP BY ALL)"""


def _lined(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.expr(_LINED).alias("text"))
    lines = rows.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows, lines, rows.where("id % 2 = 0").select("id", F.col("source").alias("abstract"))


@query(f"WITH {_CANON} SELECT id, list_position([{_list(sections.ORDER)}], heading)::INTEGER AS order_index, heading, lower(heading) AS normalized, text FROM x")
def win6_canonical_buckets(spark, d):
    _, lines, abstracts = _lined(spark, d)
    return sections.canonical_sections(lines, abstracts)


@query(f"""WITH {_CANON}, n AS (SELECT id, heading, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM x), t AS (SELECT doc_id AS id, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS tot FROM (SELECT doc_id, {_LINED_SQL} AS t FROM documents)),
 g AS (SELECT t.id, any_value(tot) AS tot, {', '.join(f"coalesce(sum(n) FILTER (heading = '{h}'), 0) AS n{k}" for k, h in enumerate(sections.ORDER))} FROM t LEFT JOIN n ON n.id = t.id GROUP BY t.id),
 p AS (SELECT *, n0 + n1 + n2 + n3 + n4 > 200 AND n1 + n2 + n3 < 0.15 * (n0 + n1 + n2 + n3 + n4) AS poor, floor(tot * 0.32::DOUBLE) AS s0, floor(tot * 0.18::DOUBLE) AS s1, floor(tot * 0.28::DOUBLE) AS s2, floor(tot * 0.14::DOUBLE) AS s3 FROM g)
 SELECT id, u.h AS heading, u.w::BIGINT AS words FROM p, LATERAL (VALUES ('{sections.ORDER[0]}', CASE WHEN poor THEN greatest(50, s0) ELSE n0 END), ('{sections.ORDER[1]}', CASE WHEN poor THEN greatest(30, s1) ELSE n1 END), ('{sections.ORDER[2]}', CASE WHEN poor THEN greatest(50, s2) ELSE n2 END),
  ('{sections.ORDER[3]}', CASE WHEN poor THEN greatest(30, s3) ELSE n3 END), ('{sections.ORDER[4]}', CASE WHEN poor THEN greatest(20, tot - s0 - s1 - s2 - s3) ELSE n4 END)) u(h, w)""")
def agg17_section_words(spark, d):
    rows, lines, abstracts = _lined(spark, d)
    return sections.section_words(sections.canonical_sections(lines, abstracts), rows)


_HASHED = "array_join(transform(split(text, chr(10)), (x, i) -> CASE i % 4 WHEN 1 THEN concat('##  ', substr(x, 1, 20)) WHEN 3 THEN CASE WHEN i % 8 = 3 THEN '## Empty' ELSE '### deeper' END ELSE x END), chr(10))"


@query(f"""WITH l AS (SELECT doc_id AS id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
 t AS (SELECT id, i, CASE i % 4 WHEN 1 THEN '##  ' || substr(x, 1, 20) WHEN 3 THEN CASE WHEN i % 8 = 3 THEN '## Empty' ELSE '### deeper' END ELSE x END AS x FROM l),
 g AS (SELECT *, sum((regexp_matches(x, '^##\\s+'))::INTEGER) OVER (PARTITION BY id ORDER BY i) AS k, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM t),
 p AS (SELECT id, k, {_strip("string_agg(x, chr(10) ORDER BY i)")} AS p FROM g GROUP BY ALL),
 b AS (SELECT id, k, {_strip("substr(split_part(p, chr(10), 1), 4)")} AS heading, {_strip("CASE WHEN instr(p, chr(10)) > 0 THEN substr(p, instr(p, chr(10))) ELSE '' END")} AS text FROM p WHERE starts_with(p, '## '))
 SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INTEGER AS order_index, heading, text FROM b WHERE text <> ''""")
def win7_hash_sections(spark, d):
    return sections.hash_sections(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(_HASHED).alias("text")))


# ---------------------------------------------------------------- audits

_PARAS = dict(body="replace(replace(text, ' the ', CASE doc_id % 3 WHEN 0 THEN concat(' (', chr(10), chr(10)) WHEN 1 THEN concat(' &', chr(10), chr(10), '2019 ') ELSE concat(chr(10), chr(10)) END), ', ', CASE doc_id % 2 WHEN 0 THEN concat(',', chr(10), chr(10)) ELSE ' , ' END)", label="CASE doc_id % 5 WHEN 0 THEN 'references & back matter' ELSE 'results' END")
_FAULTS = f"""p AS (SELECT doc_id, label, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM {_select(**_PARAS)}),
 e AS (SELECT doc_id, label, unnest(range(len(p) - 1)) AS para, unnest(p[:len(p) - 1]) AS a, unnest(p[2:]) AS b FROM p),
 f AS (SELECT *, CASE WHEN len(regexp_extract_all(a, '\\(')) > len(regexp_extract_all(a, '\\)')) THEN 'open_bracket' WHEN (ends_with(a, '&') OR ends_with(a, ';')) AND regexp_matches(substr(b, 1, 30), '\\b(?:19|20)\\d{{2}}\\b') THEN 'split_citation'
  WHEN regexp_matches(a, '[&;,\\-–—]$') OR regexp_replace(lower(string_split_regex(a, '\\s+')[-1]), '[^a-z]', '', 'g') IN ({_list(quality.CONNECTORS)}) THEN 'connector' END AS x,
  CASE WHEN NOT regexp_matches(a, '[.!?:"”’)]$') AND label <> 'references & back matter' AND (regexp_matches(b, '^\\p{{Ll}}') OR starts_with(b, 'et al.') OR starts_with(b, 'p.') OR starts_with(b, 'pp.') OR starts_with(b, ',') OR starts_with(b, ';') OR starts_with(b, ')')) THEN 'mid_sentence' END AS m FROM e),
 q AS (SELECT doc_id, para, x AS fault FROM f WHERE x IS NOT NULL UNION ALL SELECT doc_id, para, m FROM f WHERE m IS NOT NULL)"""


def _paragraphs(spark, d):
    return _docs(spark, d, **_PARAS).select(F.col("doc_id").alias("id"), F.lit(1).alias("section"), "label", F.col("body").alias("text"))


@query(f"WITH {_FAULTS} SELECT doc_id AS id, 1 AS section, para::INTEGER AS para, fault FROM q")
def qua3_paragraph_faults(spark, d):
    return quality.paragraph_faults(_paragraphs(spark, d))


_SPLIT = r"(?i)\b(th at|wi th|fr om|th e|an d)\b"


@query(f"""WITH {_FAULTS}, s AS (SELECT doc_id, len(regexp_extract_all(body, '\\s+[,;:.)]')) AS stray, len(regexp_extract_all(body, '{_SPLIT}')) AS split FROM {_select(**_PARAS)}),
 g AS (SELECT s.doc_id, any_value(stray) AS stray, any_value(split) AS split, count(*) FILTER (fault IN ('open_bracket', 'split_citation')) AS c, count(*) FILTER (fault = 'connector') AS k, count(*) FILTER (fault = 'mid_sentence') AS m FROM s LEFT JOIN q ON q.doc_id = s.doc_id GROUP BY s.doc_id)
 SELECT sum(c)::BIGINT AS citations, sum(k)::BIGINT AS connector, sum(m)::BIGINT AS mid_sentence, sum(stray)::BIGINT AS stray, sum(split)::BIGINT AS split, count(*) FILTER (c > 0) AS papers_citations, count(*) FILTER (k > 0) AS papers_connector, count(*) FILTER (m > 0) AS papers_mid_sentence,
  count(*) FILTER (stray > 0) AS papers_stray, count(*) FILTER (split > 0) AS papers_split, count(*) FILTER (c > 0 OR m > 5 OR split > 0) AS flagged FROM g""")
def agg14_fault_totals(spark, d):
    p = _paragraphs(spark, d)
    return quality.fault_totals(quality.paragraph_faults(p), p, _SPLIT)


_FIELDS = ["title", "source", "lang"]


@query(f"""WITH p AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, CASE doc_id % 4 WHEN 0 THEN ' ' ELSE source END AS source, CASE WHEN doc_id % 6 > 0 THEN lang END AS lang, CASE doc_id % 3 WHEN 0 THEN 'complete' ELSE 'pending' END AS status, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE substr(text, 1, 160) END AS abstract FROM documents),
 t AS (SELECT conv_id AS id, replace(repeat(text, 4), '. ', chr(10)) AS text FROM conversations), l AS (SELECT id, length(text) AS n, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM t),
 s AS (SELECT id, count(*) AS n, count(*) FILTER (n > 400) AS long, count(*) FILTER (n > 400 AND len(l) > 5 AND len(list_filter(l[:len(l) - 1], lambda x: NOT regexp_matches(x, '[.!?:]$'))) / (len(l) - 1.0) > 0.4) AS bad FROM l GROUP BY 1),
 a AS (SELECT p.*, coalesce(s.n, 0) AS n, coalesce(long, 0) AS long, coalesce(bad, 0) AS bad, p.id IN (SELECT doc_id FROM labels) AS lab FROM p LEFT JOIN s ON s.id = p.id),
 c AS (SELECT count(*) AS papers, count(*) FILTER (trim(title) <> '') AS f1, count(*) FILTER (trim(source) <> '') AS f2, count(*) FILTER (trim(coalesce(lang, '')) <> '') AS f3, count(*) FILTER (id % 7 = 0) AS na, count(*) FILTER (trim(coalesce(abstract, '')) = '') AS ma, count(*) FILTER (length(trim(abstract)) BETWEEN 1 AND 149) AS sa,
  count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n BETWEEN 3 AND 4) AS n3, count(*) FILTER (n >= 5 OR n = 0) AS n5, sum(long) AS sc, sum(bad) AS sb, count(*) FILTER (status = 'complete' AND id % 2 = 1) AS mp, count(*) FILTER (status = 'complete' AND id % 5 > 0) AS mm, count(*) FILTER (id % 10 < 9) AS ip, count(*) FILTER (lab) AS lp FROM a)
 SELECT u.m AS metric, u.v::DOUBLE AS value FROM c, LATERAL (VALUES ('papers', papers), ('populated title', f1), ('populated source', f2), ('populated lang', f3), ('without authors', na), ('missing abstracts', ma), ('short abstracts', sa), ('1 section', n1), ('2 sections', n2), ('3 to 4 sections', n3), ('5 or more, or no sections', n5),
  ('sections checked', sc), ('fragmented sections', sb), ('missing pdf', mp), ('missing md', mm), ('indexed papers', ip), ('labelled papers', lp), ('percent title', round(f1 * 100.0::DOUBLE / papers, 2)), ('percent source', round(f2 * 100.0::DOUBLE / papers, 2)), ('percent lang', round(f3 * 100.0::DOUBLE / papers, 2)),
  ('percent fragmented', round(sb * 100.0::DOUBLE / greatest(sc, 1), 2)), ('percent indexed', round(ip * 100.0::DOUBLE / papers, 2)), ('percent labelled', round(lp * 100.0::DOUBLE / papers, 2))) u(m, v)""")
def qua1_full_audit(spark, d):
    docs = table(spark, d, "documents")
    papers = docs.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 6 > 0, F.col("lang")).alias("lang"),
                         F.when(F.col("doc_id") % 3 == 0, "complete").otherwise("pending").alias("status"), F.expr("CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE substr(text, 1, 160) END").alias("abstract"))
    ids = lambda where: docs.where(where).select(F.col("doc_id").alias("paper_id"))
    texts = R.turns(spark, d).select("paper_id", F.expr("replace(repeat(text, 4), '. ', chr(10))").alias("text"))
    files = ids("doc_id % 2 = 0").withColumn("kind", F.lit("pdf")).unionByName(ids("doc_id % 5 = 0").withColumn("kind", F.lit("md")))
    return quality.full_audit(papers, ids("doc_id % 7 > 0"), texts, files, ids("doc_id % 10 < 9"), table(spark, d, "labels").select(F.col("doc_id").alias("paper_id")), _FIELDS)


# ---------------------------------------------------------------- finding texts

_SENT = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: " + _strip("y") + "), lambda y: y <> '')"


def _sent(x: str) -> str:
    return _SENT.replace("{0}", x)


def _uniq(x: str) -> str:
    return f"list_reduce(list_prepend([]::VARCHAR[], list_transform({x}, lambda u: [u])), lambda da, db: CASE WHEN list_contains(da, db[1]) THEN da ELSE da || db END)"


def _hits(x: str, p: str) -> str:
    return f"list_filter(list_transform(list_filter(regexp_extract_all({x}, '[^.!?]*[.!?]'), lambda y: regexp_matches(y, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({p})($|[^\\p{{L}}\\p{{N}}_])')), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: y <> '')"


_FIRST, _SECOND = "trash|idiot|licensed", "the|der|les|los"


@query(f"""WITH h AS (SELECT doc_id, {_uniq(_hits('text', _FIRST) + ' || ' + _hits('text', 'scum|' + 'moron'))}[:3] AS c, array_to_string(list_filter({_sent('substr(text, 1, doc_id % 400)')}, lambda y: length(y) > 25)[:2], ' ') AS t FROM documents)
 SELECT doc_id, CASE WHEN len(c) > 0 THEN 'Callouts: ' || array_to_string(list_transform(c, lambda y: '"' || y || '"'), ' | ') WHEN t <> '' THEN 'Context: "' || CASE WHEN length(t) > 200 THEN substr(t, 1, 195) || '...' ELSE t END || '"' ELSE 'None.' END AS callouts FROM h""")
def ext10_callout_texts(spark, d):
    return _docs(spark, d, abstract="substr(text, 1, CAST(doc_id % 400 AS INT))").select("doc_id", X.callouts("text", "abstract", [_FIRST, "scum|moron"], "Callouts: ", "Context: ", "None.").alias("callouts"))


def _titles(x: str) -> str:
    return f"list_transform({x}, lambda y: upper(y[1]) || lower(y[2:]))"


@query(f"""WITH h AS (SELECT doc_id, {_uniq(_titles("regexp_extract_all(text, '(?i)\\b(trash|idiot|scum|moron)\\b', 1)"))} AS tools, {_uniq(_titles("regexp_extract_all(text, '(?i)\\b(licensed|version|by|with)\\b', 1)"))} AS meth, {_hits('text', 'idiot|licensed')}[1] AS a, {_hits('text', _SECOND)}[1] AS b,
  list_filter({_sent('substr(text, 1, doc_id % 300)')}, lambda y: length(y) > 20)[-1] AS c FROM documents),
 f AS (SELECT *, concat_ws(' ', a, CASE WHEN b IS NOT NULL AND (a IS NULL OR NOT contains(a, b)) THEN b END) AS f FROM h), g AS (SELECT *, CASE WHEN f <> '' THEN f ELSE coalesce(c, 'D3') END AS g FROM f)
 SELECT doc_id, '**Framework/Tool**: ' || CASE WHEN len(tools) > 0 THEN array_to_string(tools, ', ') ELSE 'D1' END || '. **Method**: ' || CASE WHEN len(meth) > 0 THEN array_to_string(meth, ', ') ELSE 'D2' END || '. **Key Findings**: ' || CASE WHEN length(g) > 220 THEN substr(g, 1, 215) || '...' ELSE g END AS framework FROM g""")
def ext11_framework_texts(spark, d):
    return _docs(spark, d, abstract="substr(text, 1, CAST(doc_id % 300 AS INT))").select("doc_id", X.framework_text("text", "abstract", "trash|idiot|scum|moron", "licensed|version|by|with", ["idiot|licensed", _SECOND], ("D1", "D2", "D3")).alias("framework"))


_FACETS = [("Low", "trash|scum|licensed", "trash|idiot", "Uses plain Entries", "gives none"), ("High", "version|idiot", "licensed|apache", "goes far", "stays near")]


@query(f"""WITH f AS (SELECT doc_id, {', '.join(f"CASE WHEN NOT regexp_matches(text, '(?i)\\b({c})\\b') THEN '{n}' WHEN len(regexp_extract_all(text, '(?i)\\b({t})\\b')) > 0 THEN array_to_string({_uniq(f"list_transform(regexp_extract_all(text, '(?i)\\b({t})\\b'), lambda y: lower(y))")}, ', ') ELSE '{s}' END AS f{k}" for k, (_, c, t, s, n) in enumerate(_FACETS))} FROM documents)
 SELECT doc_id, '**Low**: ' || upper(f0[1]) || lower(f0[2:]) || '. **High**: ' || upper(f1[1]) || lower(f1[2:]) || '.' AS relation FROM f""")
def ext12_facet_texts(spark, d):
    return _docs(spark, d).select("doc_id", X.facets("text", _FACETS).alias("relation"))


_CHAIN = [(r"\b(trash|idiot)\b", "Scorn", "It scorns."), (r"\blicensed\b.*\bversion\b", "Legal", "It licenses."), (r"\s(der|die)\s[a-z\s\-]*\s(und|ist)\s", "German", "It is German."), (r"\sthe\s", "English", "It is English.")]
_TOPIC = "of|by|licensed"


@query(f"""WITH p AS (SELECT id, title, body, title || '. ' || body AS w, list_filter({_sent('body')}, lambda y: regexp_matches(y, '(?i)\\b({_TOPIC})\\b')) AS a, list_filter({_sent("title || '. ' || body")}, lambda y: regexp_matches(y, '(?i)\\b({_TOPIC})\\b'))[1] AS f FROM {R.PAPERS}),
 b AS (SELECT *, trim(replace(coalesce(list_filter(a, lambda y: length(y) = list_max(list_transform(a, lambda z: length(z))))[1], f, title), chr(10), ' ')) AS q0 FROM p), q AS (SELECT *, CASE WHEN length(q0) > 190 THEN substr(q0, 1, 187) || '...' ELSE q0 END AS quote,
  CASE {' '.join(f"WHEN regexp_matches(w, '(?i){c}') THEN '{n}'" for c, n, _ in _CHAIN)} ELSE 'Other' END AS paradigm, CASE {' '.join(f"WHEN regexp_matches(w, '(?i){c}') THEN '{t}'" for c, _, t in _CHAIN)} ELSE 'It is other.' END AS focus FROM b)
 SELECT id, paradigm, quote, '**' || paradigm || '**: ' || focus || ' Evidence: "' || quote || '"' AS value FROM q""")
def ext14_paradigm_quotes(spark, d):
    kind, quote, value = X.paradigm("title", "body", _CHAIN, ("Other", "It is other."), _TOPIC)
    return R.papers(spark, d).select("id", kind.alias("paradigm"), quote.alias("quote"), value.alias("value"))


_FAMILIES = [("trash", "trash|trashes"), ("idiot", "idiot|idiots"), ("legal", "licensed|license")]


@query(f"""SELECT doc_id, coalesce(nullif(concat_ws(', ', CASE WHEN doc_id % 9 = 0 OR regexp_matches(text, '(?i)\\b(trash|trashes)\\b') THEN 'trash' END, CASE WHEN regexp_matches(text, '(?i)\\b(idiot|idiots)\\b') THEN 'idiot' END,
 CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR regexp_matches(text, '(?i)\\b(licensed|license)\\b') THEN 'legal' END), ''), 'none') AS matched FROM documents""")
def ext8_keyword_families(spark, d):
    listed = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("hit"))
    rows = table(spark, d, "documents").join(listed, "doc_id", "left")
    return rows.select("doc_id", X.matched_keywords("text", _FAMILIES, {"trash": F.col("doc_id") % 9 == 0, "legal": F.col("hit")}, "none").alias("matched"))


_KEYS = ["Trash", "of the", "der", "Licensed", "les", "por", "que"]


@query(f"""WITH p AS (SELECT id, lower(title || ' ' || body) AS low, list_filter(['Education Research', upper(substr(conference, 1, 1)) || lower(substr(conference, 2)), CASE WHEN id % 3 = 0 THEN 'Der' END], lambda k: k IS NOT NULL AND lower(k) <> 'education research') || list_filter([{_list(_KEYS)}], lambda k: contains(lower(title || ' ' || body), lower(k))) AS k FROM {R.PAPERS})
 SELECT id, array_to_string(list_filter(list_transform(k, lambda x, i: CASE WHEN list_position(list_transform(k, lambda z: lower(z)), lower(x)) = i THEN x END), lambda x: x IS NOT NULL)[:5], '; ') AS keywords FROM p""")
def ext21_five_keywords(spark, d):
    given = F.array(F.lit("education research"), F.concat("conference", F.lit(" ")), F.when(F.col("id") % 3 == 0, F.lit(" der")))
    return R.papers(spark, d).select("id", F.array_join(X.five_keywords("title", "body", given, _KEYS, "Education Research"), "; ").alias("keywords"))


_FIND, _REL = ["tion", "ung"], ["ing", "keit", "ment"]


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


@query(f"""WITH p AS (SELECT id, title, body, {_sent('body')} AS s, list_filter(string_split_regex(body, '\\s+'), lambda w: w <> '') AS bw FROM {R.PAPERS}), o AS (SELECT *, coalesce(s[1], title) AS o, coalesce(list_filter(s[2:], lambda y: {_any('y', _FIND)})[1], s[2]) AS f FROM p),
 r AS (SELECT *, list_filter(s, lambda y: {_any('y', _REL)} AND y <> o AND (f IS NULL OR y <> f))[1] AS r FROM o), c AS (SELECT *, {_strip("concat_ws(' ', '**RQ/Objective**: ' || o, '**Finding**: ' || f, '**Relevance**: ' || r)")} AS c FROM r), w AS (SELECT *, list_filter(string_split_regex(c, '\\s+'), lambda w: w <> '') AS cw FROM c)
 SELECT id, CASE WHEN len(cw) > 60 THEN array_to_string(cw[:52], ' ') || '...' WHEN len(cw) < 35 AND len(bw) > 35 THEN array_to_string(bw[:50], ' ') || '...' ELSE c END AS summary FROM w""")
def ext22_summary_rules(spark, d):
    return R.papers(spark, d).select("id", X.short_summary("title", "body", _FIND, _REL).alias("summary"))


_JOURNALS = ["educational review", "annual review"]
_REFERENCE = "CASE doc_id % 6 WHEN 0 THEN concat('[3] X, Y. “A review of ', substr(regexp_replace(text, '[^A-Za-z ]', ''), 1, 30), '” Z.') WHEN 1 THEN concat('Y, X. (2001a). ', substr(regexp_replace(text, '[^A-Za-z ]', ''), 1, 40), ' reviews. Journal') WHEN 2 THEN concat('4. Y 2019. Reviews of ', source, ' rooms. P') WHEN 3 THEN 'X. \"Annual Review of rooms\" (1999). Rooms and educational review. Q' WHEN 4 THEN concat('plain review text ', source) ELSE '(2010). Weber, X. and so on. 2011. A title here. Z' END"
_REFERENCE_SQL = _REFERENCE.replace("'[^A-Za-z ]', '')", "'[^A-Za-z ]', '', 'g')")
_TITLE_SQL = f"""t AS (SELECT doc_id, {_strip("regexp_replace(" + _REFERENCE_SQL + ", '^(?:\\[\\d+\\]|\\d+\\.)\\s*', '')")} AS r FROM documents),
 q AS (SELECT *, {_strip("regexp_extract(r, '[\"“'']([^\"”'']{8,250})[\"”'']', 1)")} AS q, regexp_replace(regexp_extract(r, '\\(\\d{{4}}[a-z]?\\)[.,]?\\s*([^.?!]{{8,250}}[.?!])', 1), '^[ .?!]+|[ .?!]+$', '', 'g') AS a, regexp_replace(regexp_extract(r, '\\b(?:19\\d\\d|20\\d\\d)[a-z]?[.,]?\\s+([^.?!]{{8,250}}[.?!])', 1), '^[ .?!]+|[ .?!]+$', '', 'g') AS y FROM t),
 c AS (SELECT doc_id, CASE WHEN length(q) > 10 AND NOT contains(lower(q), 'educational review') AND NOT contains(lower(q), 'annual review') THEN q WHEN a <> '' AND NOT regexp_matches(a, '^[A-Z][a-z]+,\\s+[A-Z]\\.') THEN a WHEN y <> '' THEN y ELSE r END AS title FROM q)""".replace("{{", "{").replace("}}", "}")


@query(f"WITH {_TITLE_SQL} SELECT doc_id, title, regexp_matches(title, '(?i)\\breviews?\\b') AND (NOT contains(lower(title), 'educational review') OR regexp_matches(replace(lower(title), 'educational review', ''), '\\breviews?\\b')) AND (NOT contains(lower(title), 'annual review') OR regexp_matches(replace(lower(title), 'annual review', ''), '\\breviews?\\b')) AS review FROM c")
def ext17_cited_titles(spark, d):
    rows = _docs(spark, d, ref=_REFERENCE).select("doc_id", X.cited_title("ref", _JOURNALS).alias("title"))
    return rows.select("doc_id", "title", X.names_review("title", _JOURNALS).alias("review"))


_NAMES = ["the", "and & or", "der", "les", "of"]


@query(f"""WITH s AS (SELECT paper_id, order_index, k, unnest(['the', 'and & or', 'der', 'les', 'of']) AS n, unnest([0, 1, 2, 3, 4]) AS j FROM (SELECT paper_id, order_index, heading || ' ' || text AS k FROM {R.TURNS})),
 f AS (SELECT paper_id, n, min(order_index * 10 + j) AS pos FROM s WHERE regexp_matches(k, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || n || '($|[^\\p{{L}}\\p{{N}}_])') GROUP BY ALL)
 SELECT p.paper_id, coalesce(string_agg(n, '; ' ORDER BY pos), 'Not specified') AS found FROM (SELECT DISTINCT paper_id FROM {R.TURNS}) p LEFT JOIN f ON f.paper_id = p.paper_id GROUP BY 1""")
def ext20_first_seen_names(spark, d):
    blobs = F.transform(F.array_sort(F.collect_list(F.struct("order_index", F.concat_ws(" ", "heading", "text").alias("b")))), lambda r: r["b"])
    return R.turns(spark, d).groupBy("paper_id").agg(blobs.alias("b")).select("paper_id", F.array_join(X.first_seen(F.col("b"), _NAMES, "Not specified"), "; ").alias("found"))


# ---------------------------------------------------------------- reference sections, clean texts, wrapped titles

_TURN_HEAD = "CASE WHEN paper_id % 3 = 0 AND order_index % 2 = 1 THEN 'Works Cited' ELSE heading END"
_TURN_TEXT = "CASE WHEN paper_id % 3 = 1 AND order_index = 1 THEN concat(text, chr(10), ' ## References', chr(10), 'X') ELSE text END"


@query(f"""WITH s AS (SELECT paper_id, order_index, {_TURN_HEAD} AS heading, {_TURN_TEXT} AS text FROM {R.TURNS}),
 g AS (SELECT paper_id, string_agg(text, chr(10) ORDER BY order_index) FILTER (heading = 'Works Cited') AS own, string_agg(text, chr(10) ORDER BY order_index) AS whole, arg_max(text, order_index) AS last FROM s GROUP BY 1)
 SELECT paper_id, CASE WHEN own IS NOT NULL THEN own WHEN regexp_matches(whole, '{extraction.REFERENCE_LINE}') THEN substr(whole, length(regexp_extract(whole, '(?s)^(.*?){extraction.REFERENCE_LINE}', 1)) + 1) ELSE last END AS refs FROM g""")
def ext15_reference_tiers(spark, d):
    t = R.turns(spark, d)
    return extraction.reference_text(t.select("paper_id", "order_index", F.expr(_TURN_HEAD).alias("heading"), F.expr(_TURN_TEXT).alias("text")))


@query(f"""WITH s AS (SELECT doc_id, {_REFERENCE_SQL} AS a, CASE WHEN doc_id % 2 = 0 THEN '7. Survey of it, by Weber' ELSE 'Abstract review of it all' END AS b FROM documents),
 k AS (SELECT doc_id, list_filter([a, b, a], lambda r: length(r) >= 15 AND regexp_matches(r, '(?i){"|".join(extraction.REVIEW_MARKS)}') AND NOT contains(r, 'Abstract')) AS k FROM s)
 SELECT doc_id, array_to_string({_uniq("list_transform(k, lambda r: trim(regexp_replace(r, '^(?:\\[\\d+\\]|\\d+\\.)\\s*', '')))")}, '; ') AS reviews FROM k""")
def ext19_review_references(spark, d):
    rows = _docs(spark, d, a=_REFERENCE, b="CASE WHEN doc_id % 2 = 0 THEN '7. Survey of it, by Weber' ELSE 'Abstract review of it all' END")
    return rows.select("doc_id", extraction.review_references(F.array("a", "b", "a"), without=["Abstract"]).alias("r")).select("doc_id", F.array_join("r", "; ").alias("reviews"))


_BLOCKS = "concat(replace(replace(text, '. ', concat(' .', chr(13), chr(10), ' ', chr(10))), ' of ', concat('-', chr(10), '  ')), CASE doc_id % 4 WHEN 0 THEN concat(chr(10), chr(10), 'mail x@y.edu') WHEN 1 THEN concat(chr(10), chr(10), 'Abstract: too short') ELSE '' END)"


@query(f"""WITH b AS (SELECT doc_id, replace(replace({_BLOCKS}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
 p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda p: {_strip('p')}), lambda p: p <> '' AND NOT (contains(p, '@') AND regexp_matches(p, '\\.edu|\\.org|\\.com|\\.ac\\.|\\.net')) AND NOT (starts_with(lower(p), 'abstract:') AND len(string_split_regex(p, '\\s+')) < 35)) AS p FROM b),
 j AS (SELECT doc_id, array_to_string(list_filter(list_transform(p, lambda p: {_strip("regexp_replace(regexp_replace(replace(regexp_replace(p, '([\\p{L}\\p{N}_]+)-\\n\\s*([\\p{L}\\p{N}_]+)', '\\1-\\2', 'g'), chr(10), ' '), '[ \\t]+', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g')")}), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM p)
 SELECT doc_id, text FROM j WHERE text <> ''""")
def str19_clean_blocks(spark, d):
    return sections.clean_blocks(_docs(spark, d, body=_BLOCKS).select("doc_id", F.col("body").alias("text")))


_WRAPPED = "CASE {i} % 3 WHEN 0 THEN concat('12 ', substr(x, 1, 30), ' {i} of the') WHEN 1 THEN concat('  ', substr(regexp_replace(x, '[^A-Za-z]', ''), 1, 20), ' rooms', CASE {i} % 2 WHEN 0 THEN ' ....... 34' ELSE '' END) ELSE x END"
_ROWS = "(SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents)"


@query(f"""WITH l AS (SELECT doc_id, i, {_WRAPPED.format(i='i').replace("'[^A-Za-z]', '')", "'[^A-Za-z]', '', 'g')").replace("' i of the'", "' ' || i || ' of the'")} AS t FROM {_ROWS}), n AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l),
 o AS (SELECT doc_id, i, {_strip("regexp_replace(" + _strip('t') + ", '^\\d+\\s*', '')")} AS own, {_strip("regexp_extract(nxt, '^(.*?[^.\\s])\\s*\\.{3,}\\s*\\d+', 1)")} AS rest FROM n)
 SELECT doc_id * 100000 + i AS paper_id, regexp_replace(own || ' ' || rest, '\\s+', ' ', 'g') AS title FROM o WHERE i % 3 = 0 AND rest <> '' AND regexp_matches(own, ' of the$')""")
def win16_joined_titles(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    lines = each.select(F.col("doc_id").alias("block"), F.col("i").alias("line"), F.expr(_WRAPPED.replace("' {i} of the'", "' ', {i}, ' of the'").format(i="i")).alias("text"))
    titles = lines.where("line % 3 = 0").select((F.col("block") * 100000 + F.col("line")).alias("paper_id"), "block", F.lower(F.substring("text", F.lit(4), F.length("text"))).alias("title"))
    return sections.joined_titles(titles, lines)

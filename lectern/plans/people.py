"""Titles, authors and abstracts that need repair, as queries over documents.

The given tables have no damaged headers, so each document's own words are laid out as one: the number of the
document modulo twelve chooses the damage, by the same expressions in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import people as P
from ..operators import repair
from ..sources.tables import table
from .registering import registry

FOUND, SQL, query = registry()


# ---------------------------------------------------------------- damaged headers, in both dialects

def _heads(get: str) -> dict[str, str]:
    """Expressions over doc_id and aw (the ASCII words of a text); get(k) is word k from 0 or null."""
    def w(k):
        return f"lower(coalesce({get.format(k=k, k1=k + 1)}, 'word{'abcdefghijklmnopqrstuvwxyz'[k % 26]}'))"

    def cap(k):
        return f"concat(upper(substr({w(k)}, 1, 1)), substr({w(k)}, 2))"

    def name(k):
        return f"concat({cap(k)}, 'a ', {cap(k + 1)}, 'b')"
    phrase = "concat(" + ", ' ', ".join([cap(0), *map(w, range(1, 7))]) + ")"
    page = f"concat('12 ', {phrase}, ' .... 7', chr(10), 'CSCL 2021', chr(10), {name(8)}, ', ', {name(10)}, chr(10), {name(12)}, ' (University of ', {w(3)}, '), x@y.edu, ', {name(8)}, '**', chr(10), 'Abstract: ', {w(2)}, ' ', {w(4)})"
    broken = f"concat({phrase}, ' for', chr(10), 'Germany', chr(10), {name(14)})"
    titles = [phrase, f"concat('Title: ', {phrase}, ':.')", f"concat({phrase}, ' ', {name(8)}, ', ', {name(10)})", f"concat({phrase}, ' 602 ', {name(8)})",
              f"concat('Weber, X. (2019). ', {phrase}, '. doi:10.1234/abc')", f"substr({w(0)}, 1, 2)", f"concat({phrase}, ' ', {name(8)}, ' (co-chair)')", phrase,
              f"concat({phrase}, ' - ', {name(8)})", f"concat({phrase}, '; vol. 7 pp. 3')", f"concat({phrase}, ' ', {w(5)}, ' ', {w(6)})", f"concat({phrase}, ' (2011) press, ', {w(9)})"]
    authors = [f"concat({name(8)}, ', ', {name(10)})", f"concat('Authors: ', {name(8)}, ', University of ', {w(3)}, ', ', {name(10)}, ', a@b.edu, ', {name(8)})", f"concat({name(8)}, ', ', {name(10)})",
               "''", "''", "cast(NULL AS {text})", f"concat({name(8)}, ', Chicago')", f"concat('using ', {w(7)}, ' with ', {w(8)}, ', ', {name(10)})", f"concat({name(8)}, ', ', {name(10)})",
               f"concat({name(8)}, ', R2 D2')", f"concat('using ', {w(7)}, ' for ', {w(8)})", "''"]
    sections = {3: page, 4: page, 5: page, 10: page, 11: broken}
    pick = lambda xs: "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {x}" for k, x in (enumerate(xs) if isinstance(xs, list) else xs.items())) + " END"
    return {"title": pick(titles), "authors": pick(authors), "section": pick(sections)}


def _list(words: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in words)


_DUCK = _heads("aw[{k1}]")
HEADS = f"(SELECT doc_id AS id, aw, {_DUCK['title']} AS title, {_DUCK['authors'].format(text='VARCHAR')} AS authors, {_DUCK['section']} AS section FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS aw FROM documents))"


def heads(spark, d):
    """(id, aw, title, authors, section) of every document."""
    own = _heads("get(aw, {k})")
    rows = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("aw"))
    return rows.select(F.col("doc_id").alias("id"), "aw", F.expr(own["title"]).alias("title"), F.expr(own["authors"].format(text="STRING")).alias("authors"), F.expr(own["section"]).alias("section"))


# ---------------------------------------------------------------- the rules in SQL, from the same fixed values

def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{P.EDGES}', '', 'g')"


def _ref(x: str) -> str:
    return (f"({x} = '' OR regexp_matches(lower({x}), '{P.MARKER}') OR regexp_matches(lower({x}), '{P.LINK}') OR regexp_matches({x}, '{P.CITED_NAME}') OR regexp_matches(lower({x}), '{P.BACK_MATTER}')"
            f" OR (regexp_matches(lower({x}), '{P.YEAR}') AND (regexp_matches({x}, '{P.PAREN_YEAR}') OR regexp_matches(lower({x}), '{P.PUBLISHED}') OR contains({x}, ','))))")


def _holds(x: str, words: list[str]) -> str:
    return f"len(list_filter([{_list(words)}], lambda kw: contains({x}, kw))) > 0"


def _parts(x: str, marks: str = ",") -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[{marks}]'), lambda pc: {_strip('pc')}), lambda pc: pc <> '')"


def _distinct(x: str) -> str:
    return f"list_reduce(list_prepend([]::VARCHAR[], list_transform({x}, lambda dx: [dx])), lambda da, db: CASE WHEN list_contains(da, db[1]) THEN da ELSE da || db END)"


def _untailed(source: str, column: str, out: str) -> str:
    """Two stages of CTEs that cut trailing names off `column` of `source`, into `out`."""
    return f"""{out}1 AS (SELECT *, CASE WHEN length({column}) < 20 THEN {column} ELSE {_strip(f"regexp_replace({column}, '{P.CHAIR}', '')")} END AS u FROM {source}),
 {out}2 AS (SELECT *, {_strip(f"regexp_extract(u, '{P.TRAILING}', 1)")} AS th, regexp_extract(u, '{P.TRAILING}', 2) AS tn FROM {out}1),
 {out} AS (SELECT * EXCLUDE ({column}, u, th, tn), CASE WHEN length({column}) < 20 THEN {column} WHEN tn <> '' AND len(list_filter(string_split_regex(lower(tn), '\\s+'), lambda kw: kw IN ({_list(P.TITLE_WORDS)}))) > 0 THEN u
   WHEN tn <> '' AND length(th) >= 10 AND NOT regexp_matches(th, '{P.LEADS_ON}') AND (contains(tn, ',') OR contains(tn, ' and ') OR contains(tn, '&')) THEN th ELSE {_strip(f"regexp_replace(u, '{P.PAGE_AND_NAME}', '')")} END AS {column} FROM {out}2)"""


def _unrepeated(source: str, column: str, out: str) -> str:
    low = lambda x: f"lower(array_to_string({x}, ' '))"
    return f"""{out}1 AS (SELECT *, string_split_regex({column}, '\\s+') AS ws FROM {source}),
 {out}2 AS (SELECT *, list_filter(range(len(ws) // 2, 1, -1), lambda k: contains({low('ws[:len(ws) - k]')}, {low('ws[len(ws) - k + 1:]')}) OR contains(regexp_replace({low('ws[:len(ws) - k]')}, '(self-|non-|pre-|co-)', '', 'g'), regexp_replace({low('ws[len(ws) - k + 1:]')}, '^(self-|non-|pre-|co-)', '')))[1] AS rk FROM {out}1),
 {out} AS (SELECT * EXCLUDE ({column}, ws, rk), CASE WHEN rk IS NULL THEN {column} ELSE array_to_string(ws[:len(ws) - rk], ' ') END AS {column} FROM {out}2)"""


def _names(x: str) -> str:
    words = r"\b(" + "|".join(P.AFFILIATIONS) + r")\b"
    return _distinct(f"list_filter({x}, lambda nm: length(nm) >= 2 AND NOT regexp_matches(lower(nm), '{words}') AND NOT regexp_matches(lower(nm), '@|http|\\d'))")


# ---------------------------------------------------------------- queries

@query(f"SELECT id, {_ref('t')} AS artifact FROM (SELECT id, {_strip('title')} AS t FROM {HEADS})")
def str20_artifact_lines(spark, d):
    return heads(spark, d).select("id", P.reference_line("title").alias("artifact"))


@query(f"WITH h AS (SELECT id, {_strip('title')} AS t FROM {HEADS}), {_untailed('h', 't', 'o')} SELECT id, t AS title FROM o")
def str21_trailing_authors(spark, d):
    return heads(spark, d).select("id", P.without_trailing_authors(P.strip("title")).alias("title"))


@query(f"""WITH h AS (SELECT id, regexp_replace({_strip('title')}, '(?i)^title:\\s*', '') AS t0, regexp_replace({_strip('authors')}, '(?i)^authors:\\s*', '') AS a0,
   list_filter(list_transform(string_split(coalesce(section, ''), chr(10)), lambda ln: {_strip('ln')}), lambda ln: ln <> '')[:20] AS raw FROM {HEADS}),
 l0 AS (SELECT id, {_strip('t0')} AS t, {_strip('a0')} AS a, list_filter(list_transform(raw, lambda ln: {_strip("regexp_replace(" + _strip("regexp_replace(ln, '\\.{3,}\\s*\\d+$', '')") + ", '^\\d+\\s*', '')")}),
   lambda ln: ln <> '' AND NOT regexp_matches(lower(ln), '^(cscl|icls|isls)\\s*\\d+') AND NOT starts_with(lower(ln), 'proceedings') AND NOT starts_with(lower(ln), '©') AND NOT {_ref('ln')}) AS ls FROM h),
 l1 AS (SELECT *, coalesce(list_position(list_transform(ls, lambda ln: starts_with(lower(ln), 'abstract')), true), 0) AS ab FROM l0),
 l2 AS (SELECT * EXCLUDE (ls), CASE WHEN ab > 0 THEN ls[:ab - 1] ELSE ls END AS ls FROM l1),
 l3 AS (SELECT *, coalesce(list_position(list_transform(ls, lambda ln: contains(ln, '@') OR {_holds('lower(ln)', P.HEADER_PLACES)} OR regexp_matches(ln, '{P.ROLES}')), true), 0) AS sg FROM l2),
 l4 AS (SELECT *, CASE WHEN sg > 0 THEN sg - 1 ELSE len(ls) END AS n FROM l3),
 l5 AS (SELECT *, CASE WHEN n > 1 AND regexp_matches(ls[n], '\\p{{Lu}}') AND contains(ls[n], ',') AND NOT {_holds('lower(ls[n])', P.HEADER_TITLE_WORDS)} THEN n - 1 ELSE n END AS k FROM l4),
 l6 AS (SELECT *, {_strip("regexp_replace(regexp_replace(array_to_string(ls[:k], ' '), '(\\w+)-\\s+(\\w+)', '\\1-\\2', 'g'), '\\s+', ' ', 'g')")} AS ht,
   {_distinct("list_filter(list_transform(list_filter(" + _parts("array_to_string(ls[k + 1:], ', ')", ',;') + ", lambda ck: NOT contains(ck, '@') AND NOT " + _holds('lower(ck)', P.NAME_PLACES) + "), lambda ck: " + _strip("regexp_replace(" + _strip("regexp_replace(ck, '\\s*\\([^)]*\\)', '', 'g')") + ", '\\*+$', '')") + "), lambda ck: ck <> '' AND len(string_split_regex(ck, '\\s+')) BETWEEN 2 AND 4)")} AS hn FROM l5),
 l7 AS (SELECT *, CASE WHEN ht <> '' AND NOT {_ref('ht')} AND length(ht) <= 200 THEN ht END AS rt, length(t) > 150 OR {_ref('t')} OR regexp_matches(t, '{P.PAREN_YEAR}') OR regexp_matches(t, '{P.BIBLIOGRAPHIC}') AS dirty FROM l6),
 s1 AS (SELECT * EXCLUDE (t), CASE WHEN rt IS NOT NULL AND NOT regexp_matches(rt, '{P.UNFINISHED}') AND NOT ends_with(rt, '-') AND len(string_split_regex(rt, '\\s+')) > 2 AND (dirty OR length(t) < 5) THEN rt ELSE t END AS t FROM l7),
 s2 AS (SELECT * EXCLUDE (t), CASE WHEN dirty AND (rt IS NULL OR {_ref('t')}) THEN {_strip("regexp_replace(" + _strip("regexp_replace(" + _strip("split_part(t, ';', 1)") + ", '\\(?\\b(19\\d\\d|20\\d\\d)\\b.*$', '')") + ", '(?i)\\b(doi:|https?://|vol\\.|pp\\.).*$', '')")} ELSE t END AS t FROM s1),
 {_untailed('s2', 't', 's3')},
 s4 AS (SELECT *, {_parts('a')} AS p FROM s3), s5 AS (SELECT *, coalesce(p[1], '') AS f FROM s4),
 s6 AS (SELECT *, f <> '' AND ends_with(lower(t), lower(f)) AS en FROM s5),
 s7 AS (SELECT *, f <> '' AND NOT en AND NOT regexp_matches(f, '\\d|@') AND NOT {_holds('lower(f)', P.FIRST_PLACES)} AND len(list_filter(string_split_regex(f, '\\s+'), lambda w: lower(w) IN ({_list(P.SUBTITLE_WORDS)}))) > 0
   AND len(list_filter(string_split_regex(f, '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}.') AND lower(w) NOT IN ({_list(P.SUBTITLE_WORDS)}))) = 0 AS sb FROM s6),
 s8 AS (SELECT * EXCLUDE (t, a), CASE WHEN en THEN regexp_replace(substr(t, 1, length(t) - length(f)), '[ :,\\t-]+$', '') WHEN sb AND NOT contains(lower(t), lower(f)) THEN {_strip("t || ' ' || f")} ELSE t END AS t, CASE WHEN sb THEN array_to_string(p[2:], ', ') ELSE a END AS a FROM s7),
 s9 AS (SELECT id, {_strip("split_part(t, ';', 1)")} AS t, CASE WHEN a = '' THEN coalesce(array_to_string(hn, ', '), '') ELSE a END AS a FROM s8),
 {_unrepeated('s9', 't', 'z1')}, {_untailed('z1', 't', 'z2')}
 SELECT id, regexp_replace(t, '[\\s:;,.]+$', '') AS fixed_title, array_to_string({_names(_parts('a'))}, ', ') AS fixed_authors FROM z2""")
def str22_repaired_headers(spark, d):
    return repair.repaired(heads(spark, d), "title", "authors", "section").select("id", "fixed_title", "fixed_authors")


@query(f"SELECT id, array_to_string({_names(_parts('authors'))}, '; ') AS authors FROM {HEADS}")
def str23_sanitised_authors(spark, d):
    return heads(spark, d).select("id", F.array_join(P.sanitised(P.split_names("authors")), "; ").alias("authors"))


@query(f"""WITH h AS (SELECT id, regexp_replace({_strip('title')}, '(?i)^title:\\s*', '') AS t FROM {HEADS}), {_unrepeated('h', 't', 'o')} SELECT id, t AS title FROM o""")
def str24_repeated_suffix_titles(spark, d):
    return heads(spark, d).select("id", P.without_repeat(F.regexp_replace(P.strip("title"), r"(?i)^title:\s*", "")).alias("title"))


#: Authors of a header with pieces of its title among them.
_PIECES = {"duck": "[array_to_string(aw[4:7], ' '), array_to_string(aw[6:7], ' '), 'of ' || coalesce(aw[3], 'x'), coalesce(aw[2], 'y') || ' ' || coalesce(aw[9], 'z') || '.', array_to_string(aw[2:4], ' '), 'and ' || coalesce(aw[12], 'q') || ' Roe;', 'Drexel Group']",
           "spark": "array(array_join(slice(aw, 4, 4), ' '), array_join(slice(aw, 6, 2), ' '), concat('of ', coalesce(get(aw, 2), 'x')), concat(coalesce(get(aw, 1), 'y'), ' ', coalesce(get(aw, 8), 'z'), '.'), array_join(slice(aw, 2, 3), ' '), concat('and ', coalesce(get(aw, 11), 'q'), ' Roe;'), 'Drexel Group')"}
_PLAIN = lambda x: _strip(f"regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g')")
_SPILL_STAGES = f"""h AS (SELECT id, array_to_string(aw[1:7], ' ') AS title, {_PIECES['duck']} AS names FROM {HEADS}),
 e AS (SELECT id, title, {_strip('unnest(names)')} AS a, unnest(range(len(names))) AS i FROM h),
 m AS (SELECT id, title, i, {_strip("regexp_replace(regexp_replace(a, '(?i)^(?:and|&)\\s+', ''), '[;,.]+$', '')")} AS a FROM e),
 n AS (SELECT *, {_PLAIN('a')} AS an, {_PLAIN('title')} AS tn FROM m),
 v AS (SELECT *, string_split_regex(an, '\\s+') AS aw, string_split_regex(tn, '\\s+') AS tw FROM n),
 s AS (SELECT *, length(a) >= 3 AND length(title) >= 5 AND an <> '' AND tn <> '' AND (ends_with(tn, an) OR (len(aw) >= 2 AND len(tw) >= 2 AND aw[-2:] = tw[-2:]) OR (contains(tn, an) AND (regexp_matches(a, '{P.CONNECTOR_START}') OR len(aw) >= 3))) AS spill,
   length(lower(a)) < 2 OR regexp_matches(lower(a), '@|http|\\d') OR {_holds('lower(a)', P.AFFILIATIONS + P.MORE_AFFILIATIONS)} AS nobody FROM v)"""


def _pieces(spark, d):
    return heads(spark, d).select("id", F.array_join(F.slice("aw", 1, 7), " ").alias("title"), F.expr(_PIECES["spark"]).alias("names"))


@query(f"WITH {_SPILL_STAGES} SELECT id, i::INTEGER AS i, spill FROM s")
def str25_title_spill(spark, d):
    return _pieces(spark, d).select("id", "title", F.posexplode("names").alias("i", "a")).select("id", "i", P.spilled(P.trimmed_name("a"), "title").alias("spill"))


@query(f"WITH {_SPILL_STAGES}, k AS (SELECT id, {_distinct('list(a ORDER BY i)')} AS names FROM s WHERE a <> '' AND NOT spill AND NOT nobody GROUP BY id) SELECT h.id, coalesce(array_to_string(k.names, '; '), '') AS authors FROM h LEFT JOIN k ON k.id = h.id")
def str26_clean_authors(spark, d):
    return _pieces(spark, d).select("id", F.array_join(P.clean_authors("title", "names"), "; ").alias("authors"))


_LINES_OF = f"list_filter(list_transform(string_split(coalesce(section, ''), chr(10)), lambda ln: {_strip('ln')}), lambda ln: ln <> '')"


@query(f"""WITH l AS (SELECT id, {_LINES_OF} AS ls FROM {HEADS}), b AS (SELECT *, coalesce(list_position(list_transform(ls, lambda ln: regexp_matches(lower(ln), '^abstract:?')), true), 0) AS ab FROM l)
 SELECT id, CASE WHEN ab > 1 THEN array_to_string(list_filter(flatten(list_transform(ls[2:ab - 1], lambda ln: {_parts('ln', ',;')})), lambda pc: NOT regexp_matches(pc, '\\d|@') AND NOT contains(lower(pc), 'university') AND len(string_split_regex(pc, '\\s+')) >= 2), '; ') ELSE '' END AS authors FROM b""")
def str29_author_lines(spark, d):
    return heads(spark, d).select("id", F.array_join(P.author_lines(P.text_lines("section")), "; ").alias("authors"))


#: The same headers with two lines of text and a heading after the abstract.
_LONGER = f"(SELECT id, CASE WHEN id % 3 = 0 THEN section ELSE section || chr(10) || 'more ' || coalesce(aw[20], 'x') || chr(10) || coalesce(aw[21], 'y') || chr(10) || CASE id % 4 WHEN 0 THEN '1. Start' WHEN 1 THEN 'Methods' ELSE 'Keywords: z' END || chr(10) || 'rest' END AS section FROM {HEADS})"


@query(f"""WITH l AS (SELECT id, {_LINES_OF} AS ls FROM {_LONGER}), b AS (SELECT *, coalesce(list_position(list_transform(ls, lambda ln: regexp_matches(ln, '(?i)^abstract:?')), true), 0) AS ab FROM l),
 c AS (SELECT id, ab, {_strip("regexp_replace(ls[ab], '(?i)^abstract:?', '')")} AS f, ls[ab + 1:] AS r FROM b), e AS (SELECT *, coalesce(list_position(list_transform(r, lambda ln: regexp_matches(ln, '{P.AFTER_ABSTRACT}')), true), 0) AS st FROM c)
 SELECT id, CASE WHEN ab > 0 THEN {_strip("array_to_string(list_filter([f], lambda x: x <> '') || CASE WHEN st > 0 THEN r[:st - 1] ELSE r END, ' ')")} END AS abstract FROM e""")
def str30_abstract_lines(spark, d):
    more = F.expr("CASE WHEN id % 3 = 0 THEN section ELSE concat(section, chr(10), 'more ', coalesce(get(aw, 19), 'x'), chr(10), coalesce(get(aw, 20), 'y'), chr(10), CASE id % 4 WHEN 0 THEN '1. Start' WHEN 1 THEN 'Methods' ELSE 'Keywords: z' END, chr(10), 'rest') END")
    return heads(spark, d).withColumn("section", more).select("id", P.abstract_lines(P.text_lines("section")).alias("abstract"))


_MARKED = "CASE doc_id % 4 WHEN 0 THEN concat('Abstract: ', text, chr(10), 'Keywords: x') WHEN 1 THEN concat('Figure of ', text, chr(10), chr(10), replace(text, chr(10), ' - ')) WHEN 2 THEN concat('x', chr(10), 'abstract - short', chr(10), 'Introduction', chr(10), chr(10), text) ELSE text END"


@query(f"""WITH m AS (SELECT doc_id, {_MARKED} AS x FROM documents), b AS (SELECT doc_id, {_strip(f"regexp_extract(x, '{P.ABSTRACT}', 1)")} AS blk, list_filter(list_transform(string_split(x, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: length(p) > 100 AND NOT regexp_matches(p, '{P.NO_ABSTRACT}'))[1] AS par FROM m),
 c AS (SELECT doc_id, CASE WHEN length(blk) > 60 THEN substr(blk, 1, 1500) ELSE substr(par, 1, 1500) END AS raw FROM b)
 SELECT doc_id, CASE WHEN raw IS NOT NULL THEN {_strip("regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(coalesce(raw, ''), chr(10)), lambda ln: " + _strip('ln') + "), lambda ln: ln <> ''), ' '), '(\\b\\w+)\\s+-\\s*(\\w+\\b)', '\\1-\\2', 'g'), '\\s+', ' ', 'g')")} END AS abstract FROM c""")
def str31_found_abstract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_MARKED).alias("x")).select("doc_id", P.found_abstract("x").alias("abstract"))


@query(f"""WITH l AS (SELECT id, {_LINES_OF}[:10] AS ls FROM {HEADS}), c AS (SELECT id, list_filter(list_transform(list_filter(ls, lambda ln: regexp_matches(ln, '{P.AUTHOR_MARKS}')),
 lambda ln: regexp_replace(regexp_replace(regexp_replace(ln, '[\\w.-]+@[\\w.-]+', '', 'g'), '\\([^)]*\\)', '', 'g'), '^[\\s,;]+|[\\s,;]+$', '', 'g')), lambda ln: ln <> '' AND length(ln) < 100)[1] AS a FROM l) SELECT id, coalesce(a, 'Committee') AS authors FROM c""")
def str32_found_authors(spark, d):
    return heads(spark, d).select("id", P.found_authors("section", "Committee").alias("authors"))

"""Tiered extraction, references, theory use and match explanations, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction
from ..sources.tables import table
from . import roles as R
from .registering import registry

FOUND, SQL, query = registry()

#: Definitions by term lists alone, as the JSON documents that they are stored as.
DEFINITIONS = ['{"id": "wording", "version": "2", "label": "Wording", "query": {"candidate_sections": ["user"]}, "constraints": {"allowed_values": ["with", "that"]}}',
               '{"id": "endings", "version": "2", "label": "Endings", "query": {"candidate_sections": ["none"], "heading_terms": ["SYST"], "text_terms": ["Tion", "keit"]}, "extraction": {"inference_allowed": true}}',
               '{"id": "focus", "version": "2", "label": "Focus", "query": {"text_terms": ["qqq"]}, "constraints": {"allowed_values": ["zz.z"]}, "extraction": {"inference_allowed": true}}',
               '{"id": "absent", "version": "2", "query": {"text_terms": ["qqq"]}}']


def properties(spark):
    return extraction.definitions(spark.createDataFrame([(x,) for x in DEFINITIONS], "definition string"))


def sections(spark, d):
    return R.turns(spark, d).withColumn("roles", F.array("heading"))


def earlier(spark, d):
    """Observations of an earlier run: of each three papers one is fresh, one of an old version, one only inferred."""
    p = R.turns(spark, d).select("paper_id").distinct().select("paper_id", F.explode(F.array(F.lit("wording"), F.lit("focus"))).alias("property_id"))
    third = F.col("paper_id") % 3
    return p.select("paper_id", "property_id", F.when(third == 1, "1").otherwise("2").alias("version"), F.lit("kept").alias("value"), F.when(third == 2, "inferred").otherwise("extracted").alias("status"),
                    F.lit("by hand").alias("method"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("order_index"), F.lit("e").alias("evidence"))


_TIERS = f"""p(property_id, label, cand, terms, vals, infer) AS (VALUES ('wording', 'Wording', ['user'], []::VARCHAR[], ['with', 'that'], false), ('endings', 'Endings', ['system'], ['tion', 'keit'], []::VARCHAR[], true),
   ('focus', 'Focus', []::VARCHAR[], ['qqq'], ['zz\\.z'], true), ('absent', 'absent', []::VARCHAR[], ['qqq'], []::VARCHAR[], false)),
 s AS (SELECT p.*, t.*, len(cand) = 0 OR list_contains(cand, heading) AS w, list_filter(vals, lambda v: regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || v || '($|[^\\p{{L}}\\p{{N}}_])'))[1] AS v, list_filter(terms, lambda v: contains(lower(text), v))[1] AS k FROM p, {R.TURNS} t),
 c AS (SELECT *, w OR NOT bool_or(w) OVER (PARTITION BY paper_id, property_id) AS cnd FROM s),
 g AS (SELECT paper_id, property_id, any_value(label) AS label, any_value(infer) AS infer, min(order_index) FILTER (v IS NOT NULL OR k IS NOT NULL) AS hit, min(order_index) AS lead FROM c WHERE cnd GROUP BY ALL),
 x AS (SELECT g.*, h.v, h.k, h.text AS ht, l.text AS lt FROM g LEFT JOIN c h ON h.paper_id = g.paper_id AND h.property_id = g.property_id AND h.order_index = g.hit JOIN c l ON l.paper_id = g.paper_id AND l.property_id = g.property_id AND l.order_index = g.lead),
 n AS (SELECT paper_id, property_id, '2' AS version, CASE WHEN hit IS NOT NULL THEN coalesce(v, k) WHEN infer AND lt <> '' THEN 'Inferred: ' || label || ' from passage context' END AS value,
   CASE WHEN hit IS NOT NULL THEN 'extracted' WHEN infer AND lt <> '' THEN 'inferred' ELSE 'not_present' END AS status, CASE WHEN hit IS NOT NULL AND v IS NOT NULL THEN 'controlled_vocabulary_match' WHEN hit IS NOT NULL THEN 'keyword_match' WHEN infer AND lt <> '' THEN 'prompted_analysis' ELSE 'rule_fallback' END AS method,
   CASE WHEN hit IS NOT NULL AND v IS NOT NULL THEN 0.9 WHEN hit IS NOT NULL THEN 0.8 WHEN infer AND lt <> '' THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN hit IS NOT NULL THEN hit WHEN infer AND lt <> '' THEN lead END AS order_index, CASE WHEN hit IS NOT NULL THEN substr(ht, 1, 200) WHEN infer AND lt <> '' THEN substr(lt, 1, 300) END AS evidence FROM x)"""


@query(f"""WITH {_TIERS} SELECT * EXCLUDE (reused), reused FROM (SELECT *, false AS reused FROM n WHERE NOT (paper_id % 3 = 0 AND property_id IN ('wording', 'focus'))
 UNION ALL SELECT paper_id, property_id, '2', 'kept', 'extracted', 'by hand', 1.0, 0, 'e', true FROM n WHERE paper_id % 3 = 0 AND property_id IN ('wording', 'focus'))""")
def ext1_tiers_with_reuse(spark, d):
    t = sections(spark, d)
    return extraction.extract(t.select("paper_id").distinct(), t, properties(spark), earlier(spark, d))


@query(f"WITH {_TIERS} SELECT paper_id, property_id, value, evidence FROM n WHERE status = 'inferred'")
def ext4_inferred(spark, d):
    t, p = sections(spark, d), properties(spark)
    cells = t.select("paper_id").distinct().crossJoin(p.select("property_id"))  # the grid itself
    return extraction.evaluated(cells, t, p).where("status = 'inferred'").select("paper_id", "property_id", "value", "evidence")


@query(f"WITH {_TIERS} SELECT property_id, status, count(*) AS cells FROM n GROUP BY ALL")
def ext27_term_definitions(spark, d):
    t, p = sections(spark, d), properties(spark)
    return extraction.evaluated(extraction.stale_cells(t, p, earlier(spark, d).where("false")), t, p).groupBy("property_id", "status").agg(F.count("*").alias("cells"))


# ---------------------------------------------------------------- references

#: A document's lines as references, with blank lines, entry starts, and acknowledgements early or late.
_REFS = ("concat(CASE doc_id % 3 WHEN 0 THEN concat('## References', chr(10)) WHEN 1 THEN 'Bibliography ' ELSE '' END, replace(replace(text, '. ', concat('.', chr(10), CASE doc_id % 4 WHEN 0 THEN 'Weber, X. ' WHEN 1 THEN '[3] ' WHEN 2 THEN chr(10) ELSE '' END)), ', ', concat(',', chr(10), '   ')),"
         " CASE doc_id % 5 WHEN 0 THEN concat(chr(10), '## Acknowledgements', chr(10), 'We thank all of you here') WHEN 1 THEN ' Acknowledgement to all of you' WHEN 2 THEN concat(chr(10), 'Smith-Jones, Anna and more text') ELSE '' END)")


@query(rf"""WITH r AS (SELECT doc_id, regexp_replace({_REFS}, '{extraction.REFERENCES}', '') AS t FROM documents),
 a AS (SELECT doc_id, CASE WHEN regexp_matches(t, '{extraction.THANKS_LINE}') THEN regexp_extract(t, '(?s)^(.*?){extraction.THANKS_LINE}', 1) ELSE t END AS t FROM r),
 b AS (SELECT doc_id, CASE WHEN regexp_matches(t, '{extraction.THANKS}') AND length(regexp_extract(t, '(?s)^(.*?){extraction.THANKS}', 1)) > length(t) * 0.7 THEN regexp_extract(t, '(?s)^(.*?){extraction.THANKS}', 1) ELSE t END AS t FROM a),
 l AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10))))) AS i, regexp_replace(unnest(string_split(t, chr(10))), '^\s+|\s+$', '', 'g') AS s FROM b),
 g AS (SELECT *, sum(CASE WHEN s = '' OR regexp_matches(s, '{extraction.ENTRY.replace("'", "''")}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
 e AS (SELECT doc_id, k, trim(regexp_replace(string_agg(s, ' ' ORDER BY i) FILTER (s <> ''), '\s+', ' ', 'g')) AS entry FROM g GROUP BY ALL)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS pos, entry FROM e WHERE length(entry) > 15""")
def ext16_split_references(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_REFS).alias("t")).select("doc_id", F.posexplode(extraction.split_references("t")).alias("pos", "entry"))


# ---------------------------------------------------------------- theory use

_CUES = [(["analy", "zum"], "Uses it to analyse, in {section}."), (["inform", "framework", "tion "], "Builds on it in {section}."), (["contradiction", "der "], "Finds contradictions with it in {section}."), (["design", "les "], "Designs with it in {section}.")]
_EDGES = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_STRONG, _ACRONYM, _CONTEXT, _WEAK = rf"(?i){_EDGES[0]}(with|pour|por)\s+\p{{L}}", _EDGES[0] + "(The|Les|Los|Die)" + _EDGES[1], ["ing", "keit", "ment"], f"(?i){_EDGES[0]}(that|und|est|una){_EDGES[1]}"


def _case(x: str) -> str:
    when = " ".join("WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + f" THEN '{text}'" for words, text in _CUES)
    return f"CASE {when} ELSE 'Applies it in {{section}}.' END"


@query(rf"""WITH s AS (SELECT paper_id, order_index, coalesce(nullif(heading, ''), 'Main Text') AS heading, unnest(range(len(x))) AS i, trim(replace(unnest(x), chr(10), ' ')) AS s FROM (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> '') AS x FROM {R.TURNS})),
 c AS (SELECT *, CASE WHEN regexp_matches(s, '{_STRONG}') OR (regexp_matches(s, '{_ACRONYM}') AND (contains(lower(s), 'ing') OR contains(lower(s), 'keit') OR contains(lower(s), 'ment'))) THEN 0 WHEN regexp_matches(s, '{_WEAK}') THEN 1 END AS k FROM s),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY k, order_index, i) n FROM c WHERE k IS NOT NULL) WHERE n = 1),
 p AS (SELECT paper_id, arg_min(heading, order_index) AS title, arg_min(text, order_index) AS abstract FROM {R.TURNS} GROUP BY 1)
 SELECT p.paper_id, CASE k WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' ELSE 'none' END AS strength, CASE WHEN k IS NULL THEN 'Mentioned only.' ELSE replace(CASE k WHEN 0 THEN {_case('s')} ELSE 'Draws on it in {{section}}.' END, '{{section}}', heading) || ' Evidence: "' || substr(s, 1, 180) || CASE WHEN length(s) > 180 THEN '...' ELSE '' END || '"' END AS usage,
 coalesce(s, nullif(substr(abstract, 1, 200), ''), title) AS evidence FROM p LEFT JOIN f ON f.paper_id = p.paper_id""")
def ext13_theory_usage(spark, d):
    t = R.turns(spark, d)
    papers = t.groupBy("paper_id").agg(F.min_by("heading", "order_index").alias("title"), F.min_by("text", "order_index").alias("abstract"))
    return extraction.theory_usage(papers, t, _STRONG, _ACRONYM, _CONTEXT, _WEAK, _CUES, "Applies it in {section}.", "Draws on it in {section}.", "Mentioned only.")


# ---------------------------------------------------------------- explanations

_KEYS = ["the", "and", "der", "les", "por", "licen"]


def _snip(k: str) -> str:
    """The first sentence of xs with k, cut around it when long."""
    s = f"list_filter(xs, lambda y: regexp_matches(y, '(?i){_EDGES[0]}{k}{_EDGES[1]}'))[1]"
    at = f"(length(regexp_extract({s}, '(?is)^(.*?{_EDGES[0]}){k}{_EDGES[1]}', 1)) + 1)"
    return (f"CASE WHEN length(trim({s})) <= 160 THEN '\"' || trim({s}) || '\"' WHEN {s} IS NOT NULL THEN '\"' || CASE WHEN {at} - 40 > 1 THEN '...' ELSE '' END || substr({s}, greatest({at} - 40, 1)::BIGINT, (least({at} + {len(k)} - 1 + 80, length({s})) - greatest({at} - 40, 1) + 1)::BIGINT)"
            f" || CASE WHEN {at} + {len(k)} - 1 + 80 < length({s}) THEN '...' ELSE '' END || '\"' END")


@query(rf"""WITH p AS (SELECT id, title, body, list_filter(string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> '') AS xs FROM {R.PAPERS}),
 m AS (SELECT id, list_filter([{', '.join(f"'{k}'" for k in _KEYS)}], lambda k: regexp_matches(title, '(?i){_EDGES[0]}' || k || '{_EDGES[1]}')) AS t, list_filter([{', '.join(f"'{k}'" for k in _KEYS)}], lambda k: regexp_matches(body, '(?i){_EDGES[0]}' || k || '{_EDGES[1]}')) AS a,
   list_filter([{', '.join(_snip(k) for k in _KEYS)}], lambda x: x IS NOT NULL) AS e FROM p),
 d AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(e, lambda x: [x])), lambda u, v: CASE WHEN list_contains(u, v[1]) THEN u ELSE u || v END)[:2] AS ev, list_filter([CASE WHEN len(t) > 0 THEN 'Title explicitly mentions ' || array_to_string(list_transform(t, lambda k: '''' || k || ''''), ', ') END,
   CASE WHEN len(a) > 0 THEN 'Abstract discusses ' || array_to_string(list_transform(a, lambda k: '''' || k || ''''), ', ') END], lambda x: x IS NOT NULL) AS parts FROM m)
 SELECT id, CASE WHEN len(parts) = 0 THEN 'Matches target keywords in paper text.' ELSE array_to_string(parts, '; ') || '.' || CASE WHEN len(ev) > 0 THEN ' Evidence: ' || array_to_string(ev, ' ') ELSE '' END END AS explanation FROM d""")
def ext9_match_explanation(spark, d):
    return R.papers(spark, d).select("id", extraction.match_explanation("title", "body", _KEYS).alias("explanation"))

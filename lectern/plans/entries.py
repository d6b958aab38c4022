"""Small column functions under their own names: keys, names, slugs, rounding, ordered joins, label defaults and centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import network, taxonomy
from ..sources.tables import table
from . import roles as R
from .people import HEADS, heads
from .registering import registry

FOUND, SQL, query = registry()


# ---------------------------------------------------------------- keys and names

@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM documents")
def str15_alnum_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.alnum_key("text").alias("k"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents")
def str16_squeezed(spark, d):
    return table(spark, d, "documents").select("doc_id", T.squeeze("text").alias("t"))


#: Names of one to four words, plain or turned round, with one comma or two.
_NAME = "CASE id % 5 WHEN 0 THEN concat(a, ', ', b, ' ', c) WHEN 1 THEN concat(b, ' ', c, ' ', a) WHEN 2 THEN a WHEN 3 THEN concat(a, ', ', b, ', ', c) ELSE concat(' ', b, '  ', a, ' ') END"
_CAP = "concat(upper(substr({0}, 1, 1)), lower(substr({0}, 2)))"
_NAMES = f"(SELECT id, {_NAME} AS name FROM (SELECT id, {_CAP.format("coalesce(aw[1], 'x')")} AS a, {_CAP.format("coalesce(aw[2], 'y')")} AS b, {_CAP.format("coalesce(aw[3], 'z')")} AS c FROM {HEADS}))"


def _names(spark, d):
    parts = {"a": "coalesce(get(aw, 0), 'x')", "b": "coalesce(get(aw, 1), 'y')", "c": "coalesce(get(aw, 2), 'z')"}
    return heads(spark, d).select("id", *[F.expr(_CAP.format(x)).alias(n) for n, x in parts.items()]).select("id", F.expr(_NAME).alias("name"))


@query(f"SELECT id, CASE WHEN len(string_split(name, ',')) = 2 THEN trim(split_part(name, ',', 2)) || ' ' || split_part(name, ',', 1) ELSE name END AS name FROM {_NAMES}")
def str27_flipped_names(spark, d):
    return _names(spark, d).select("id", T.flip_name("name").alias("name"))


@query(f"SELECT id, CASE WHEN len(p) > 1 THEN array_to_string(p[:len(p) - 1], ' ') ELSE p[1] END AS given, p[-1] AS family FROM (SELECT id, string_split_regex(trim(name), '\\s+') AS p FROM {_NAMES})")
def str28_given_and_family(spark, d):
    return _names(spark, d).select("id", T.given_name("name").alias("given"), T.family_name("name").alias("family"))


@query(f"SELECT id, CASE WHEN len(p) > 1 THEN p[-1] || ', ' || array_to_string(list_transform(p[:len(p) - 1], lambda x: upper(x[1]) || '.'), ' ') ELSE p[1] END AS apa FROM (SELECT id, string_split_regex(trim(name), '\\s+') AS p FROM {_NAMES})")
def str33_apa_names(spark, d):
    return _names(spark, d).select("id", T.apa_name("name").alias("apa"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(trim(substr(text, 1, 60), ' ')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def str36_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(F.substring("text", 1, 60)).alias("slug"))


@query("SELECT doc_id, CASE WHEN contains(upper(f), 'SRC1') THEN 'SRC1' WHEN contains(upper(f), 'SRC2') THEN 'SRC2' ELSE 'none' END AS conference, coalesce(nullif(regexp_extract(f, '(20\\d{2})', 1), '')::INTEGER, 1999) AS year FROM (SELECT doc_id, source || CASE WHEN doc_id % 3 > 0 THEN '-20' || (10 + doc_id % 17) ELSE '-old' END || '.md' AS f FROM documents)")
def str7_file_names(spark, d):
    name = F.concat("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("-20"), 10 + F.col("doc_id") % 17)).otherwise("-old"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", name.alias("f")).select("doc_id", T.conference_in("f", ["SRC1", "SRC2"], "none").alias("conference"), T.year_in("f", 1999).alias("year"))


# ---------------------------------------------------------------- numbers and joins

@query("SELECT c_custkey, round_even(c_acctbal::DOUBLE / 7, 2) AS half_even, abs(c_acctbal)::DOUBLE AS size, round(c_custkey * 100.0::DOUBLE / greatest(c_nationkey, 1), 1) AS percent FROM customer")
def mth1_rounding(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.bround(F.col("c_acctbal").cast("double") / 7, 2).alias("half_even"), F.abs("c_acctbal").cast("double").alias("size"), F.round(F.col("c_custkey") * 100.0 / F.greatest("c_nationkey", F.lit(1)), 1).alias("percent"))


@query(f"SELECT d.doc_id, count(t.paper_id) AS sections, coalesce(sum(length(t.text)), 0)::BIGINT AS letters FROM documents d LEFT JOIN {R.TURNS} t ON t.paper_id = d.doc_id GROUP BY 1")
def agg5_counts_and_lengths(spark, d):
    per = R.turns(spark, d).groupBy(F.col("paper_id").alias("doc_id")).agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("letters"))
    return table(spark, d, "documents").select("doc_id").join(per, "doc_id", "left").fillna(0, ["sections", "letters"])


@query(f"SELECT paper_id, string_agg(author_id::VARCHAR, '; ' ORDER BY author_order, author_id) AS authors FROM {R.PAPER_AUTHORS} GROUP BY 1")
def agg8_ordered_authors(spark, d):
    own = R.paper_authors(spark, d).withColumn("author", F.col("author_id").cast("string"))
    return own.groupBy("paper_id").agg(network.ordered_join("author", ["author_order", "author_id"], "; ").alias("authors"))


# ---------------------------------------------------------------- labels

_MARKS = ["trash", "idiot", "licensed"]


@query(f"SELECT id, CASE WHEN regexp_matches(title, '(?i)({'|'.join(_MARKS)})') THEN 5 WHEN h >= 3 THEN 4 WHEN h >= 1 THEN 3 ELSE 1 END AS centrality FROM (SELECT id, title, {' + '.join(f"len(regexp_extract_all(body, '(?i){m}'))" for m in _MARKS)} AS h FROM {R.PAPERS})")
def tax4_centrality(spark, d):
    return R.papers(spark, d).select("id", taxonomy.centrality("title", "body", _MARKS).alias("centrality"))


@query(f"SELECT id, CASE WHEN hit THEN 'scorn' ELSE 'plain' END AS label, CASE WHEN hit THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT id, regexp_matches(title || ' ' || body, '(?i)(trash|idiot)') AS hit FROM {R.PAPERS})")
def tax3_default_labels(spark, d):
    return taxonomy.classify(R.papers(spark, d), {"tone": {"scorn": ["trash", "idiot"]}}, {"tone": "plain"}).select("id", "label", "confidence")

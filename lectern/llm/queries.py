"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, language_id, merkle, ngram_join, packing, piece_sampling, quality_rules, secret_scan, sharding, syncmers, toxicity, vector_dedup, weak_quality


#: Folder of the public tokenizers' files; a parameter, never copied here.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's score; the strings as digests."""
    return secret_scan.findings(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text_key")


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every document, as digests, and their decoding."""
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    encoded = piece_sampling.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, samples=3)
    slim = encoded.withColumn("n_pieces", F.size("ids")).withColumn("ids_hash", F.xxhash64("ids"))
    return piece_sampling.decode(slim, model, keep_ids=False).withColumn("round_trip", F.crc32("decoded") == F.col("text_crc32")).drop("decoded")


def op3_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return syncmers.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three quarters of the labels."""
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from heuristic labellers, EM and a hashed linear scorer."""
    return weak_quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in token-budget batches of sixteen optimal length buckets."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in forty shards of near equal bytes."""
    return sharding.histogram_sort(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose word 5-gram sets have a Jaccard similarity of 0.8 or more."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of embeddings with a cosine of 0.95 or more."""
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by character models learned from two thirds of the documents."""
    return language_id.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op11_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and a verdict by its n-grams; documents labelled good are the target."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.rules(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


def op12_bitmap_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and trial of the proof for every document, under one root."""
    return merkle.manifest(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def op13_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of five positives of every hundredth embedding."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scans, op2_sampled_pieces, op3_closed_syncmers, op4_ftrl_toxicity, op5_weak_quality, op6_length_buckets, op7_histogram_sort, op8_ngram_join, op9_cap_filters, op10_kneser_ney_language, op11_likelihood_ratio, op12_bitmap_merkle, op13_inverted_multi_index)}


#: All pairs of sets that share an n-gram, and reachability over the links.
OP8_SQL = r"""WITH RECURSIVE
 w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
 e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
 SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

#: Every vector against every other.
OP9_SQL = """WITH RECURSIVE
 v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
 ok AS (SELECT * FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
 r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.vec_id),
 n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
 SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(root) AS component_id, r.vec_id = min(root) AS kept FROM r LEFT JOIN n ON n.vec_id = r.vec_id GROUP BY r.vec_id"""


#: Windows, lines and hashed n-grams as rows; logarithms as whole numbers.
OP11_SQL = r"""WITH
 w AS (SELECT row_number() OVER () AS rid, doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 x AS (SELECT rid, array_to_string(w[i:i + 2], ' ') AS g, i FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM x) WHERE c > 1) GROUP BY 1),
 d AS (SELECT rid, count(*) - count(DISTINCT s) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS s FROM w) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY 1),
 h AS (SELECT rid, doc_id, list_transform(w, lambda x: ('0x' || substr(md5(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 1, 7))::BIGINT) AS h FROM w),
 g AS (SELECT rid, doc_id, unnest(list_transform(h, lambda x: x % 65536) || list_transform(range(1, len(h)), lambda i: (h[i] * 31 + h[i + 1] + 7) % 65536)) AS b FROM h),
 c AS (SELECT b, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)) AS target FROM g GROUP BY 1),
 z AS (SELECT sum(raw) AS n_raw, sum(target) AS n_target FROM c),
 l AS (SELECT b, CASE WHEN n_target = 0 THEN 0 ELSE floor(ln((target + 20.0::DOUBLE) / (raw * (n_target::DOUBLE / n_raw::DOUBLE) + 20.0::DOUBLE)) * 65536 + 0.5)::BIGINT END AS l FROM c, z),
 s AS (SELECT rid, sum(l)::BIGINT AS total, count(*) AS n FROM g JOIN l ON l.b = g.b GROUP BY 1),
 o AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed, coalesce(total, 0) AS total, coalesce(n, 0) AS n
  FROM w LEFT JOIN r ON r.rid = w.rid LEFT JOIN d ON d.rid = w.rid LEFT JOIN s ON s.rid = w.rid)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND total >= -6554 * n AS kept, CASE WHEN n > 0 THEN total::DOUBLE / n / 65536 ELSE 0.0 END AS score FROM o"""

#: Every level of every source's tree in turn; proofs from the levels; folding level by level.
OP12_SQL = r"""WITH RECURSIVE
 f AS (SELECT doc_id, source, text, row_number() OVER () AS rid,
   coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
   coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
     lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 2 = 0, false) AS bad FROM documents),
 l AS (SELECT rid, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
   CASE WHEN bad AND text IS NOT NULL THEN sha256(head || octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '')) ELSE sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS edited FROM f),
 p AS (SELECT *, coalesce('s' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM l),
 t(grp, lvl, slot, h, n) AS (SELECT grp, 0, slot, leaf, count(*) OVER (PARTITION BY grp) FROM p
   UNION ALL SELECT grp, lvl + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY grp, lvl, slot // 3),
 sub AS (SELECT grp, h AS subroot, lvl AS top, row_number() OVER (ORDER BY grp) - 1 AS place FROM t WHERE n = 1),
 u(lvl, slot, h, n) AS (SELECT 0, place, subroot, count(*) OVER () FROM sub
   UNION ALL SELECT lvl + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY lvl, slot // 3),
 nodes AS (SELECT grp, lvl, slot, h FROM t UNION ALL SELECT '*', lvl, slot, h FROM u),
 sib AS (SELECT x.grp, x.lvl, x.slot, coalesce(string_agg(y.h, '' ORDER BY y.slot) FILTER (y.slot < x.slot), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.slot) FILTER (y.slot > x.slot), '') AS r
   FROM nodes x JOIN nodes y ON y.grp = x.grp AND y.lvl = x.lvl AND y.slot // 3 = x.slot // 3 GROUP BY ALL),
 w(rid, lvl, top, utop, grp, slot, place, cur, proof, h) AS (SELECT rid, 0, sub.top, (SELECT max(lvl) FROM u), p.grp, slot, place, CASE WHEN sub.top = 0 THEN '*' ELSE p.grp END, '', edited FROM p JOIN sub ON sub.grp = p.grp
   UNION ALL SELECT rid, w.lvl + 1, top, utop, w.grp, w.slot, place, CASE WHEN w.lvl + 1 < top THEN w.grp ELSE '*' END, proof || sib.l || sib.r, sha256(sib.l || h || sib.r) FROM w JOIN sib ON w.lvl < top + utop AND sib.grp = w.cur
     AND sib.lvl = CASE WHEN w.lvl < top THEN w.lvl ELSE w.lvl - top END AND sib.slot = CASE WHEN w.lvl < top THEN w.slot // (3 ** w.lvl)::BIGINT ELSE place // (3 ** (w.lvl - top))::BIGINT END)
 SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM u WHERE n = 1) AS verified
 FROM w JOIN p ON p.rid = w.rid JOIN sub ON sub.grp = p.grp WHERE w.lvl = w.top + w.utop"""


#: Every anchor against every row.
OP13_SQL = """WITH
 r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.v) = len(b.v)),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, other_id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5),
 n AS (SELECT p.rid, p.other, p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.other_id NULLS LAST) AS rank
   FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
 SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def oracle_sql() -> dict:
    """SQL for the exact joins; classifiers, samplers, sketches and searches have none."""
    return {"op8_ngram_join": OP8_SQL, "op9_cap_filters": OP9_SQL, "op11_likelihood_ratio": OP11_SQL, "op12_bitmap_merkle": OP12_SQL, "op13_inverted_multi_index": OP13_SQL}

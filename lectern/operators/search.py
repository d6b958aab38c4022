"""Full-text and vector search: tokens, postings, fielded BM25, snippets, cosine, reranking."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75
#: Weight of a hit in each field, as declared.
WEIGHTS = {"title": 8.0, "abstract": 5.0, "authors": 6.0, "section": 3.0, "body": 1.0}


def query_terms(query: str) -> list[str]:
    """Distinct words of a query with two or more characters; none means no result."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return list(dict.fromkeys(t for t in re.findall(r"[^\W_]+", plain) if len(t) > 1))


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(term, key, field, tf): the inverted index, one row per term, document and field."""
    each = reduce(DataFrame.unionAll, [docs.select(key, F.lit(f).alias("field"), F.explode(tokens(f)).alias("term")) for f in fields])
    return each.groupBy("term", key, "field").agg(F.count("*").alias("tf"))


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25(docs: DataFrame, key: str, fields: list[str], query: str, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with any query term and their `score`, rounded to three digits.

    One scan and no explosion: a document's term counts and length are computed in place, the
    corpus figures (documents, mean length, document frequencies) are one global aggregate of one
    row, which is joined back.
    """
    terms, weights = query_terms(query), weights or WEIGHTS
    words = {f: tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    counted = docs.select(key, *[c.alias(f"_{f}") for f, c in words.items()])
    for i, t in enumerate(terms):
        hits = reduce(Column.__add__, [_times(f"_{f}", t) * weights[f] for f in fields])
        counted = counted.withColumn(f"_t{i}", hits)
    counted = counted.select(key, reduce(Column.__add__, [F.size(f"_{f}") for f in fields]).alias("_len"), *[f"_t{i}" for i in range(len(terms))])
    if not terms:
        return counted.where("false").select(key, F.lit(0.0).alias("score"))
    corpus = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_t{i}") > 0).cast("int")).alias(f"_d{i}") for i in range(len(terms))])
    parts = []
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"_t{i}")
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg"))))
    hit = reduce(Column.__or__, [F.col(f"_t{i}") > 0 for i in range(len(terms))])
    # corpus is one row by construction
    return counted.where(hit).crossJoin(F.broadcast(corpus)).select(key, F.round(reduce(Column.__add__, parts), 3).alias("score"))


def search(docs: DataFrame, key: str, fields: list[str], query: str, limit: int = 50, min_year: int | None = None, max_year: int | None = None,
           conference: str | None = None, paper_type: str | None = None, section: str | None = None, group: str | None = None,
           sort_by: str = "relevance", descending: bool = True, limit_before_dedupe: bool = False) -> DataFrame:
    """Ranked, filtered search; with `group`, the best row of each group (deduplicated before the limit)."""
    hits = bm25(docs, key, fields, query).join(docs, key)
    if min_year is not None:
        hits = hits.where(F.col("year") >= min_year)
    if max_year is not None:
        hits = hits.where(F.col("year") <= max_year)
    for name, wanted in (("conference", conference), ("paper_type", paper_type)):
        if wanted:
            hits = hits.where(F.col(name).ilike(f"%{wanted}%"))
    if section:
        hits = hits.where(F.col("normalized_section") == section)
    order = [F.desc("score"), *([F.desc("year")] if "year" in docs.columns else []), F.asc(key)]
    if sort_by == "year":
        order = [F.desc("year") if descending else F.asc("year"), *order]
    if limit_before_dedupe:
        hits = hits.orderBy(*order).limit(limit)
    if group:
        best = Window.partitionBy(group).orderBy(*order)
        hits = hits.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
    return hits.orderBy(*order).limit(limit)


def snippet(text, terms: list[str], width: int = 25) -> Column:
    """`width` blank-separated words around the first hit, hits marked with <b>."""
    words = F.split(F.trim(text), r"\s+")
    pattern = "(?iu)^[^\\p{L}\\p{N}]*(" + "|".join(re.escape(t) for t in terms) + ")[^\\p{L}\\p{N}]*$"
    at = F.array_position(F.transform(words, lambda w: w.rlike(pattern)), True)
    start = F.greatest(at - width // 2, F.lit(1)).cast("int")
    cut = F.slice(words, start, width)
    marked = F.array_join(F.transform(cut, lambda w: F.when(w.rlike(pattern), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " ")
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("...")).otherwise(""), marked, F.when(start + width <= F.size(words), F.lit("...")).otherwise("")))


def normalised(vector) -> Column:
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / size)


def cosine(a, b) -> Column:
    """Inner product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, key: str, vector: str, query: DataFrame, k: int) -> DataFrame:
    """The k rows of vectors with the largest cosine to the single vector of `query`."""
    unit = vectors.select(key, normalised(F.col(vector).cast("array<double>")).alias("_v"))
    wanted = query.select(normalised(F.col(vector).cast("array<double>")).alias("_q")).limit(1)
    return unit.crossJoin(F.broadcast(wanted)).select(key, F.round(cosine("_v", "_q"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def scored_by(load, query: str, passage) -> Column:
    """The score of each passage by a scorer of the user's own.

    load() -> score, called once in each Python worker; score(query, passages) -> numbers, called with a list of passages,
    one Arrow batch at a time.  load must be importable or picklable; its name and module tell it from others.  Null
    passages count as empty.
    """
    name = (getattr(load, "__module__", ""), getattr(load, "__qualname__", repr(load)))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sys

        loaded = sys.__dict__.setdefault("_loaded_scorers", {})  # lives as long as the worker, and needs no installed package
        if name not in loaded:
            loaded[name] = load()
        for passages in batches:
            yield pd.Series(loaded[name](query, [p or "" for p in passages]), dtype="float64")
    return run(passage)


def rerank(hits: DataFrame, query: str, passage: Column, key: str, k: int = 15, load=None) -> DataFrame:
    """Second stage over a short list, then the first score.

    The second score is the share of query terms in the passage, or what the user's scorer says (see `scored_by`).
    """
    if load is not None:
        score = F.bround(scored_by(load, query, passage), 4)
    else:
        terms = query_terms(query)
        score = F.bround(F.size(F.array_intersect(tokens(passage), F.array(*map(F.lit, terms)))) / F.greatest(F.lit(len(terms)), F.lit(1)), 4)
    return hits.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), F.desc("score"), key).limit(k)


# ---------------------------------------------------------------- search on stored postings

def build_index(docs: DataFrame, key: str, fields: list[str], path: str, buckets: int = 256, keep: tuple[str, ...] = ()) -> None:
    """Writes the postings of docs, a folder for each bucket of terms, and the corpus figures.

    A posting is (term, key, one count a field, the document's length, the columns `keep` to filter by): a search
    reads only the buckets of its own terms and no text.
    """
    each = docs.select(key, *keep, *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"_{n}") for n, f in enumerate(fields)])
    size = reduce(Column.__add__, [F.size(f"_{n}") for n in range(len(fields))])
    tagged = F.concat(*[_tagged(f"_{n}", n) for n in range(len(fields))])
    rows = each.select(key, *keep, size.alias("len"), F.explode(tagged).alias("w"))
    counted = rows.groupBy("w.term", key, "len", *keep).agg(*[F.count_if(F.col("w.f") == n).alias(f"tf_{f}") for n, f in enumerate(fields)])
    counted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    each.agg(F.count("*").alias("n"), F.avg(size).alias("avg_len")).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/corpus")


def _tagged(words: str, n: int) -> Column:
    return F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(n).alias("f")))


def search_index(spark, path: str, key: str, fields: list[str], query: str, limit: int = 50, where: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score): the best `limit` documents by BM25 from the postings of the query's terms alone.

    `where` filters on the columns kept in the index before anything is scored, while document frequencies and
    lengths stay those of the whole corpus.  The same figures as `bm25`.
    """
    terms, weights = query_terms(query), weights or WEIGHTS
    corpus = spark.read.parquet(f"{path}/corpus").first()
    rows = spark.read.parquet(f"{path}/postings")
    if not terms:
        return rows.where("false").select(key, F.lit(0.0).alias("score"))
    wanted = spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(corpus.buckets)) for t in terms])).first()[0]
    own = rows.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))  # pruned to the buckets, then pushed to the scan
    df = own.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    hits = own if where is None else own.where(where)
    tf = reduce(Column.__add__, [F.col(f"tf_{f}") * weights[f] for f in fields])
    idf = F.greatest(F.log((F.lit(corpus.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(corpus.avg_len)))
    scored = hits.join(F.broadcast(df), "term").groupBy(key).agg(F.round(F.sum(part), 3).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(limit)

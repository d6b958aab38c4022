"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lowered.  Features of a text are the sets of its words, word
pairs and pairs with one word between them, hashed to 2**20 coordinates; a feature counts once
however often it occurs, so length alone moves no score.  The learner sees a bounded, documented
sample of labelled rows (`bound`) in one task, in an order given by a hash, `epochs` times; the L1
penalty leaves a few hundred weights, which are broadcast (never more than 2**20).
Scores use texts alone, whole texts, and every row.

Cases: null and empty texts score the bias and are learned from like others; a text of any length is
one row (the sample's texts meet in one task, so `bound` and the longest texts bound its memory); of documents that share an
id the text that sorts first is learned from, with the larger label, and rows that repeat get equal scores; with labels of one
kind, or none, the scores are the bias alone; a score equal to the threshold is predicted 1.  Empty
tables give no rows.  Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, bounded_sample, learned_from, mix, steps, word_hashes
from .linear import BITS, Ftrl, dense, sigmoid

U = np.uint64
KINDS = (U(0x51), U(0x52), U(0x53))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document number, feature) of all words, neighbouring pairs and skip pairs of each text."""
    h, at = word_hashes(column, PUNCTUATION)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    docs, found = [doc], [mix(h ^ KINDS[0])]
    for gap, kind in ((1, KINDS[1]), (2, KINDS[2])):
        same = doc[:-gap] == doc[gap:] if len(doc) > gap else np.empty(0, bool)
        pair = mix(h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:] ^ kind) if len(doc) > gap else h[:0]
        docs.append(doc[:-gap][same] if len(doc) > gap else doc[:0])
        found.append(pair[same])
    return np.concatenate(docs), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


def _train(alpha: float, l1: float, l2: float, epochs: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("doc_id", "ascending")])
        rows, targets = [], table.column("target").to_pylist()
        for batch in table.select(["text"]).to_batches():
            for part in steps(batch):
                doc, f = features(part.column("text"))
                both = np.unique((doc << BITS) | f)
                cuts = np.searchsorted(both >> BITS, np.arange(part.num_rows + 1))
                both = (both & ((1 << BITS) - 1)).astype(np.int32)
                rows += [both[a:b].copy() for a, b in zip(cuts[:-1], cuts[1:])]
        model = Ftrl(alpha=alpha, l1=l1, l2=l2)
        for _ in range(epochs):
            for x, y in zip(rows, targets):
                model.learn(x, 1.0, y)
        idx, w = model.compact()
        return pa.table({"feature": pa.array(idx, pa.int64()), "weight": pa.array(w)})
    return run


def train(labelled: DataFrame, bound: int = 16000, alpha: float = 4.0, l1: float = 3.0, l2: float = 0.0, epochs: int = 4):
    """labelled(doc_id, text, target 0/1) -> (features, weights), fitted on about `bound` rows; the bias is feature 2**20."""
    rows = bounded_sample(labelled.where("target is not null"), "doc_id", bound).select(
        F.lit(0).alias("one"), "doc_id", F.xxhash64("doc_id", F.lit("order")).alias("turn"), F.lower(F.col("text").cast("string")).alias("text"), F.col("target").cast("double").alias("target"))
    got = rows.groupBy("one").applyInArrow(_train(alpha, l1, l2, epochs), "feature long, weight double").toArrow()
    return got.column("feature").to_numpy(), got.column("weight").to_numpy()


def _score(shared):
    def run(batches):
        w = dense(shared.value)
        for batch in batches:
            for part in steps(batch):
                doc, f = features(part.column("text"))
                some = w[f] != 0
                hit = np.unique((doc[some] << BITS) | f[some])
                total = np.bincount(hit >> BITS, w[hit & ((1 << BITS) - 1)], part.num_rows) + w[-1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sigmoid(total))], names=["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3, **options) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> (doc_id, held_out, score, predicted), a row per row.

    Several labels of one doc_id: toxic if any says so.  A null doc_id is never learned from.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("target")).where(learned_from("doc_id", modulus, held_out))
    known = bounded_sample(known.where("target is not null"), "doc_id", options.pop("bound", 16000))
    # at most about `bound` ids: small enough to broadcast whatever the corpus
    rows = plain.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("target").alias("target"))
    shared = spark.sparkContext.broadcast(train(rows, bound=1 << 62, **options))
    lowered = plain.select("doc_id", F.lower("text").alias("text"))
    return lowered.mapInArrow(_score(shared), "doc_id long, score double").select(
        "doc_id", (~learned_from("doc_id", modulus, held_out) & F.col("doc_id").isNotNull()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

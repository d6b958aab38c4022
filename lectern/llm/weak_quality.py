"""Quality from weak labels: heuristic labellers, EM for their accuracies, a hashed linear scorer.

Eight overlapping labellers vote good, bad or abstain on each text.  Most look for one kind of junk
and abstain without it (symbol share, capitals, table cells, few different words, repeated
neighbours, exclamation); two also know natural text (different words for each sentence, prose).  Votes depend on
rates, never on length limits.  Spark counts every vote pattern of the corpus (at most 3**8); EM
over those counts estimates each labeller's accuracy, given that it votes, and the share of good
texts, without any curated label.  The posterior of a text's pattern is its training label for a logistic scorer
(FTRL) over hashed word shapes, shape pairs and repetition marks, as shares of the text's words; it
is fitted on all documents and scores every whole text: a hash deals the documents into shards of about `bound`, each shard
fits a scorer of its own, and the scorer is their mean, weighted by their documents (in whole units, so that the order of the
sum does not matter).  A text is kept
at `keep_at` or more.  The labellers are taken as independent given the quality of a text; where they are
not (stutter and variety both see repetition) the posterior is surer than it should be.  The start of EM, that a bad
vote outweighs a good one, and the bounds of the accuracies are choices, not estimates.

Cases: null or blank texts have no votes and no features: they score 0 and go.  A text of any length is
one row; what leaves it for its shard is its vote pattern and its few distinct features, never the text.  Rows that repeat
count as often as they occur, in one shard if they agree in id and text, and get equal scores; with votes of one kind the posterior is the prior
moved by them alone; a score equal to `keep_at` is kept.  Empty tables give no rows.  Other columns,
whatever their names, are kept by `keep_good` and left out by `quality`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BLANK, _BYTE_CODE, _LOWER, durable, hash_runs, mix, steps, utf8
from .linear import BITS, Ftrl, dense, sigmoid

U = np.uint64
LABELLERS = ("symbols", "capitals", "cells", "variety", "stutter", "shouting", "sentences", "prose")
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Bounds of a labeller's estimated accuracy.
ACCURACY = (0.55, 0.999)
#: Units of a weight of 1 when the shards' weights are added up.
UNITS = 1 << 24

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
#: Byte classes of word shapes: letters by case, digits, any other byte as itself.
_SHAPE = np.array([97 if b >= 128 or chr(b).islower() else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else b for b in range(256)], np.uint8)


def _share(flags, offsets):
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Texts:
    """Word and byte figures of a slice of texts, computed once for labellers and features."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        self.rows = len(offsets) - 1
        word = ~_BLANK[data]
        self.words, self.at = hash_runs(_BYTE_CODE[_LOWER[data]], word, offsets)
        self.doc = np.repeat(np.arange(self.rows), np.diff(self.at))
        shape = _SHAPE[data]
        fresh = np.ones(len(data), bool)
        fresh[1:] = (shape[1:] != shape[:-1]) | ~word[:-1]
        fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
        kept = np.concatenate(([0], np.cumsum(fresh)))
        self.shapes, at = hash_runs(_BYTE_CODE[shape[fresh]], word[fresh], kept[offsets])
        assert len(self.shapes) == len(self.words)
        self.n = np.diff(self.at)
        self.letters, self.upper = _share(_ALPHA[data], offsets), _share(_UPPER[data], offsets)
        self.filled, self.symbols = _share(word, offsets), _share(_SYMBOL[data], offsets)
        self.bars, self.bangs, self.ends = (_share(np.isin(data, [ord(c) for c in chars]), offsets) for chars in ("|", "!", ".!?"))
        pair = (self.doc.astype(U) << U(40)) ^ (self.words & U((1 << 40) - 1))
        self.variety = np.bincount((np.unique(pair) >> U(40)).astype(np.int64), minlength=self.rows)
        same = (self.words[1:] == self.words[:-1]) & (self.doc[1:] == self.doc[:-1]) if len(self.words) else np.empty(0, bool)
        self.again = np.concatenate(([False], same)) if len(self.words) else same
        self.stutter = np.bincount(self.doc[self.again], minlength=self.rows)

    def votes(self) -> np.ndarray:
        """rows x labellers: BAD, ABSTAIN or GOOD."""
        n, filled = np.maximum(self.n, 1), np.maximum(self.filled, 1)
        # the share of different words that a natural text of n words may fall to shrinks with n
        expected = n ** -0.25
        out = np.full((self.rows, len(LABELLERS)), ABSTAIN, np.int8)

        symbols, capitals, bars, different = self.symbols / filled, self.upper / np.maximum(self.letters, 1), self.bars / n, self.variety / n
        length, letters = self.variety / np.maximum(self.ends, 0.5), self.letters / filled
        out[symbols > 0.06, 0] = BAD
        out[capitals > 0.4, 1] = BAD
        out[bars > 0.15, 2] = BAD
        out[different < 0.55 * expected, 3] = BAD
        out[self.stutter / n > 0.2, 4] = BAD
        out[self.bangs / n > 0.2, 5] = BAD
        out[(length > 2) & (n / np.maximum(self.ends, 0.5) < 40) & (symbols < 0.03), 6] = GOOD
        out[(n / np.maximum(self.ends, 0.5) > 80) | (length < 1.5), 6] = BAD
        out[(letters > 0.92) & (capitals < 0.3) & (different > 0.8 * expected), 7] = GOOD
        out[letters < 0.8, 7] = BAD
        out[self.n == 0] = ABSTAIN
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number, feature, value): shares of hashed shapes, shape pairs and repeats."""
        inner = self.doc[1:] == self.doc[:-1] if len(self.doc) else np.empty(0, bool)
        pairs = mix(self.shapes[:-1] * U(0x9E3779B97F4A7C15) + self.shapes[1:])[inner] if len(self.doc) else self.shapes
        seen = np.unique((self.doc.astype(U) << U(40)) ^ (self.words & U((1 << 40) - 1)), return_index=True)[1]
        repeat = np.ones(len(self.doc), bool)
        repeat[seen] = False
        marks = [(self.again, 1), (repeat, 2)]
        doc = np.concatenate([self.doc, self.doc[:-1][inner] if len(self.doc) else self.doc, *(self.doc[m] for m, _ in marks)])
        f = np.concatenate([mix(self.shapes ^ U(7)), mix(pairs ^ U(8)), *(np.full(int(m.sum()), mix(np.array([k], U))[0]) for m, k in marks)])
        both, count = np.unique((doc << BITS) | (f >> U(64 - BITS)).astype(np.int64), return_counts=True)
        d = both >> BITS
        return d, both & ((1 << BITS) - 1), count * 4.0 / self.n[d]


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (3 ** np.arange(votes.shape[1]))


def _map_seen(batches):
    for batch in batches:
        for part in steps(batch):
            t = Texts(part.column("text"))
            d, f, v = t.features()
            cuts = pa.array(np.searchsorted(d, np.arange(t.rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("turn"), pa.array(_pattern(t.votes())), pa.array(t.n), pa.ListArray.from_arrays(cuts, pa.array(f, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(v))],
                                             names=["turn", "pattern", "n_words", "features", "shares"])


def fit_label_model(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over pattern counts -> (posterior of good by pattern, accuracy of each labeller, share of good).

    The start believes any bad vote; a labeller is never held to be worse than ACCURACY[0].  A vote of a labeller with accuracy a moves the log odds
    by log(a / (1 - a)); an abstention does not.  Each accuracy has two pseudo-votes.
    """
    if not counts:
        return {}, np.full(len(LABELLERS), 0.5), 0.5
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    yes, no = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    good = sigmoid(2.0 * yes.sum(1) - 6.0 * no.sum(1))
    for _ in range(rounds):
        agree = (weight * good) @ yes + (weight * (1 - good)) @ no
        accuracy = np.clip((agree + 1) / (weight @ (yes + no) + 2), *ACCURACY)
        prior = float(np.clip((weight * good).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        new = sigmoid(np.log(prior / (1 - prior)) + (yes - no) @ np.log(accuracy / (1 - accuracy)))
        moved, good = np.abs(new - good).max(), new
        if moved < 1e-9:
            break
    return dict(zip(patterns.tolist(), good.tolist())), accuracy, prior


def _train(posterior: dict[int, float], epochs: int):
    """The scorer of one shard: its weights, times its documents."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("turn").combine_chunks()
        features, shares = (table.column(c).combine_chunks() for c in ("features", "shares"))
        cuts, f, v = features.offsets.to_numpy() - features.offsets[0].as_py(), features.flatten().to_numpy(), shares.flatten().to_numpy()
        goal = [posterior.get(p, 0.5) for p in table.column("pattern").to_pylist()]
        rows = [(f[a:b], v[a:b], y) for a, b, y in zip(cuts[:-1], cuts[1:], goal) if b > a]
        model = Ftrl(alpha=1.0, l1=0.05, l2=0.01)
        for _ in range(epochs):
            for x, share, y in rows:
                model.learn(x, share, y)
        idx, w = model.compact()
        return pa.table({"feature": pa.array(idx, pa.int64()), "weight": pa.array(np.rint(w * len(rows) * UNITS).astype(np.int64))})
    return run


def _score(shared):
    def run(batches):
        w = dense(shared.value)
        for batch in batches:
            for part in steps(batch):
                t = Texts(part.column("text"))
                d, f, v = t.features()
                total = np.bincount(d, w[f] * v, t.rows) + w[-1]
                score = np.where(t.n > 0, sigmoid(total), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(_pattern(t.votes()))], names=["doc_id", "score", "pattern"])
    return run


def _fit(docs: DataFrame, bound: int, epochs: int):
    """(weights, posterior by vote pattern), learned from the texts of docs(doc_id, text)."""
    keyed = docs.select("text", F.xxhash64("doc_id", "text", F.lit("order")).alias("turn"))
    seen = durable(keyed.mapInArrow(_map_seen, "turn long, pattern long, n_words long, features array<int>, shares array<double>").where("n_words > 0").drop("n_words"))
    counts = {r.pattern: r.c for r in seen.groupBy("pattern").agg(F.count("*").alias("c")).collect()}
    posterior, _, _ = fit_label_model(counts)
    many = sum(counts.values())
    dealt = seen.withColumn("shard", F.pmod(F.xxhash64("turn", F.lit("shard")), F.lit(max(-(-many // bound), 1))))
    got = dealt.groupBy("shard").applyInArrow(_train(posterior, epochs), "feature long, weight long").groupBy("feature").agg(F.sum("weight").alias("weight")).orderBy("feature").toArrow()
    return (got.column("feature").to_numpy(), got.column("weight").to_numpy() / (UNITS * max(many, 1))), posterior


def quality(docs: DataFrame, bound: int = 8000, epochs: int = 8, keep_at: float = 0.5) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score, label_posterior, keep), a row per row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    w, posterior = _fit(plain, bound, epochs)
    scored = plain.mapInArrow(_score(plain.sparkSession.sparkContext.broadcast(w)), "doc_id long, score double, pattern long")
    known = plain.sparkSession.createDataFrame([(p, y) for p, y in posterior.items()] or [(-1, 0.5)], "pattern long, label_posterior double")
    # at most 3**8 patterns: a bounded table
    return scored.join(F.broadcast(known), "pattern", "left").select("doc_id", "score", "label_posterior", (F.col("score") >= keep_at).alias("keep"))


def _keep(shared, keep_at: float, name: str):
    def run(batches):
        w = dense(shared.value)
        for batch in batches:
            for part in steps(batch, name):
                t = Texts(part.column(name))
                d, f, v = t.features()
                score = np.where(t.n > 0, sigmoid(np.bincount(d, w[f] * v, t.rows) + w[-1]), 0.0)
                out = part.filter(pa.array(score >= keep_at))
                if out.num_rows:
                    yield out
    return run


def keep_good(docs: DataFrame, bound: int = 8000, epochs: int = 8, keep_at: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores keep_at or more, with all their columns: one pass, no join."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    w, _ = _fit(plain, bound, epochs)
    shared = docs.sparkSession.sparkContext.broadcast(w)
    return docs.mapInArrow(_keep(shared, keep_at, "text"), docs.schema)

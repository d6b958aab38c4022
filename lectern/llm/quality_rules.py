"""Quality rules: base counts of each text, then a log-likelihood ratio of hashed n-grams.

Two multinomials over `BUCKETS` buckets of hashed words and word pairs are counted: one over all documents
(the raw corpus), one over the trusted ones (the target).  A bucket's ratio is its count in the target over the count
that its share of the raw corpus makes one expect there, `PRIOR` added to both: rare buckets lie near 1 and
neither a small target nor a small corpus moves the others.  Its logarithm is kept as a whole number of
1/65,536 nats; a text's score is the sum over its n-grams divided by their number, and the text is kept if it reaches
`threshold`.  Sums and
comparison are in whole numbers, so the verdict on a text is the same in any order, batch and cluster, and
every document gets one: nothing is drawn at random.

The raw corpus is counted over all documents whole, the target over the whole texts of all trusted ones, in one pass.
Up to `bound` trusted ids are broadcast to the texts; where there are more, nothing that grows with them is, and the texts
are shuffled once to meet them, hashed by id (rows without an id, which can't be trusted, stay where they are).  The
driver gets bucket counts, and the table of logarithms that is broadcast has `BUCKETS` entries whatever the corpus.

Words are runs of anything but 0x20 and 0x09-0x0D; n-grams are of words with A-Z lowered, hashed by the first
28 bits of their md5.  Repeated lines and word windows are counted case by case as they stand; windows are
compared by 64-bit hashes within one text.

Cases.  A null text counts as empty: no words, hence base_failed.  A text of any length is scored whole.  Rows
that repeat are scored alike and counted each; a repeated id is trusted if any row of `trusted` has it, a null id
never.  A score equal to the threshold is kept.  Without any trusted text all logarithms are 0, and
the base alone decides.  Empty tables give no rows.  Other columns, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BLANK, _BYTE_CODE, _LOWER, hash_runs, run_hashes, steps, utf8

#: Buckets of the two multinomials.
BUCKETS = 1 << 16
#: Units of a kept logarithm in one nat.
UNITS = 1 << 16
#: Occurrences that are added to a bucket's count in the target and to the expected one.
PRIOR = 20.0
#: Least score of a kept text, in nats an n-gram.  Texts like the trusted ones lie about 0; it is reached when one n-gram in seven is half as likely in the target as in the corpus.
THRESHOLD = -0.1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CACHED = 1 << 20


class Words:
    """The words of a column of texts: where they stand, and their hashes."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        edge, word = np.zeros(len(self.data) + 1, bool), ~_BLANK[self.data]
        edge[self.offsets] = True
        self.word = word
        before, after = np.append(False, word[:-1]), np.append(word[1:], False)
        if len(word):
            self.starts = np.flatnonzero(word & (edge[:-1] | ~before))
            self.ends = np.flatnonzero(word & (edge[1:] | ~after)) + 1
        else:
            self.starts = self.ends = np.empty(0, np.int64)
        self.at = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def repeats(self, width: int = 3) -> np.ndarray:
        """Words of each text in windows of `width` words that the text has twice or more."""
        hashes, _ = hash_runs(_BYTE_CODE[self.data], self.word, self.offsets)
        windows = run_hashes(hashes, width)
        inside = np.flatnonzero(self.doc[:len(windows)] == self.doc[width - 1:]) if len(windows) else np.empty(0, np.int64)
        key, doc = windows[inside], self.doc[inside]
        order = np.lexsort((key, doc))
        same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.append(same, False) | np.append(False, same) if len(order) else np.empty(0, bool)
        hit = np.zeros(len(hashes) + width, bool)
        for k in range(width):
            hit[inside[order[twice]] + k] = True
        return np.bincount(self.doc[hit[:len(hashes)]], minlength=len(self.at) - 1)

    def buckets(self, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each word, bucket of the pair that begins at each word or -1)."""
        low = _LOWER[self.data]
        hashes, _ = hash_runs(_BYTE_CODE[low], self.word, self.offsets)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(known) > _CACHED:
            known.clear()
        raw, starts, ends = low.tobytes(), self.starts[first].tolist(), self.ends[first].tolist()
        numbers = np.empty(len(distinct), np.int64)
        for i, h in enumerate(distinct.tolist()):
            n = known.get(h)
            if n is None:
                n = known[h] = int(md5(raw[starts[i]:ends[i]], usedforsecurity=False).hexdigest()[:7], 16)
            numbers[i] = n
        word = numbers[back]
        pair = np.full(len(word), -1)
        if len(word) > 1:
            pair[:-1] = np.where(self.doc[:-1] == self.doc[1:], (word[:-1] * 31 + word[1:] + 7) % BUCKETS, -1)
        return word % BUCKETS, pair


def repeated_lines(text: str | None) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, known = np.zeros((2, BUCKETS), np.int64), {}
    for batch in batches:
        for part in steps(batch):
            words = Words(part.column("text"))
            trusted = part.column("trusted").to_numpy(zero_copy_only=False)[words.doc]
            word, pair = words.buckets(known)
            for counted, some in enumerate((slice(None), trusted)):
                w, p = word[some], pair[some]
                total[counted] += np.bincount(w, minlength=BUCKETS) + np.bincount(p[p >= 0], minlength=BUCKETS)
    used = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(t[used]) for t in total)], names=["bucket", "raw", "target"])


def counts(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """marked(text, trusted) -> how often each bucket occurs in all texts, and in the trusted ones: BUCKETS rows reach the driver."""
    got = marked.select("text", "trusted").mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    raw[got.column("bucket").to_numpy()], target[got.column("bucket").to_numpy()] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    return raw, target


def marked(docs: DataFrame, ids: DataFrame, bound: int) -> DataFrame:
    """docs(doc_id, text), ids(doc_id), distinct and not null -> (text, trusted), a row per row of docs."""
    flags = ids.withColumn("trusted", F.lit(True))
    flags = flags.hint("broadcast" if ids.limit(bound + 1).count() <= bound else "shuffle_hash")
    met = docs.where("doc_id is not null").join(flags, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    return met.union(docs.where("doc_id is null").select("text", F.lit(False).alias("trusted")))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each bucket the logarithm of its count in target over that expected from raw, shrunk by PRIOR, in whole UNITS."""
    if not target.sum():
        return np.zeros(len(raw), np.int64)
    expected = raw * (target.sum() / raw.sum())
    return np.floor(np.log((target + PRIOR) / (expected + PRIOR)) * UNITS + 0.5).astype(np.int64)


def _judge(shared, threshold: float):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    least = int(np.floor(threshold * UNITS + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        table = np.append(shared.value, 0)  # -1, no pair, weighs nothing
        for batch in batches:
            for part in steps(batch):
                w = Words(part.column("text"))
                n, repeats = np.diff(w.at), w.repeats()
                word, pair = w.buckets(known)
                total = np.zeros(len(word) + 1, np.int64)
                np.cumsum(table[word] + table[pair], out=total[1:])
                total, grams = total[w.at[1:]] - total[w.at[:-1]], np.maximum(2 * n - 1, 0)
                failed = (n < 50) | (100 * repeats > 50 * n)
                columns = [part.column("doc_id"), n, w.sums(w.word & ((w.data & 0xC0) != 0x80)), w.sums(_SYMBOL[w.data]), [repeated_lines(t) for t in part.column("text").to_pylist()],
                           repeats, failed, ~failed & (total >= least * grams), np.where(grams > 0, total / np.maximum(grams, 1) / UNITS, 0.0)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) if isinstance(x, list) else pa.array(x) for x in columns], names=names)
    return run


def rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, bound: int = 10_000) -> DataFrame:
    """docs(doc_id, text), trusted(doc_id) -> a verdict on each row of docs.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score); score is
    in nats an n-gram, 0 without any.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    raw, target = counts(marked(plain, ids, bound))
    ratios = log_ratios(target, raw)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    return plain.mapInArrow(_judge(shared, threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; rows are joined back by a place of their own."""
    from .common import durable, free_name

    place = free_name(docs, "place")
    rows = durable(docs.withColumn(place, F.monotonically_increasing_id()))
    plain = rows.select("doc_id", "text", place)
    verdicts = rules(plain.select(F.col(place).alias("doc_id"), "text"), plain.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col(place).alias("doc_id")), threshold)
    good = verdicts.where("kept").select(F.col("doc_id").alias(place))
    return rows.join(good, place, "left_semi").drop(place)

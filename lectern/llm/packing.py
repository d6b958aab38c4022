"""Optimal length buckets: least padding for a given number of buckets, and token-budget batches.

Lengths are word counts.  A document longer than `max_tokens` goes on as parts of at most that
length, so the global histogram has at most max_tokens + 1 bins whatever the corpus.  It is counted
by Spark; a dynamic programme over its bins (convex-hull form, exact integers) chooses the
`buckets` borders with the least total padding.  Each bucket's sequences are then numbered without
gaps and cut into batches whose padded size stays within `token_budget`.  Nothing but the histogram
reaches the driver, and a bucket may hold any share of the rows.  Texts are read once; what follows reads a
checkpointed table of word counts.

Cases: null and empty texts are sequences of length 0 in the lowest bucket; a text of any length goes on in
parts; rows that repeat, also with null ids, have places of their own; of borders with equal padding the
lower ones are taken.  An empty table gives no rows.  Other columns are left out.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, numbered


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n): the number of blank-separated words of each text."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.cast("long").alias("n"))


def sequences(counts: DataFrame, max_tokens: int) -> DataFrame:
    """(doc_id, part, start, n_tokens): every document as one sequence, or as parts of max_tokens."""
    parts = counts.select("doc_id", "n", F.explode(F.expr(f"sequence(0L, greatest(n - 1, 0L) div {max_tokens})")).alias("part"))
    start = F.col("part") * max_tokens
    return parts.select("doc_id", F.col("part").cast("int").alias("part"), start.alias("start"), F.least(F.col("n") - start, F.lit(max_tokens)).cast("long").alias("n_tokens"))


def best_borders(histogram: dict[int, int], buckets: int) -> list[int]:
    """Ascending bucket borders (the longest length of each) that minimise total padding.

    least[j] for k buckets is min over i < j of least'[i] + border_j * (rows i..j) - tokens i..j;
    for fixed i that is a line in border_j with slope -rows_before_i, so a monotone hull finds it.
    """
    lengths = sorted(histogram)
    rows, tokens = [0], [0]
    for x in lengths:
        rows.append(rows[-1] + histogram[x])
        tokens.append(tokens[-1] + histogram[x] * x)
    n = len(lengths)
    if n <= buckets:
        return lengths
    least = [0] + [lengths[j - 1] * rows[j] - tokens[j] for j in range(1, n + 1)]
    came = [[0] * (n + 1)]
    for _ in range(1, buckets):
        hull: deque = deque()
        new, frm = [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            m, c = -rows[j - 1], least[j - 1] + tokens[j - 1]
            while len(hull) > 1:
                (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                if (c - c1) * (m1 - m2) > (c2 - c1) * (m1 - m):
                    break
                hull.pop()
            hull.append((m, c, j - 1))
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            new[j] = hull[0][0] * x + hull[0][1] + x * rows[j] - tokens[j]
            frm[j] = hull[0][2]
        least = new
        came.append(frm)
    out, j = [], n
    for frm in reversed(came):
        if j:
            out.append(lengths[j - 1])
            j = frm[j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65536, max_tokens: int = 8192, cell_rows: int = 500_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, part, start, n_tokens, bucket, border, batch, slot, padding)."""
    seq = sequences(durable(word_counts(docs)), max_tokens)
    histogram = {r.n_tokens: r.c for r in seq.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()}
    borders = best_borders(histogram, buckets)
    bucket, border = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, b in reversed(list(enumerate(borders))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(k)).otherwise(bucket)
        border = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(border)
    room = F.greatest(F.lit(1), F.expr(f"{token_budget}L div greatest(border, 1L)"))
    placed = numbered(seq.withColumns({"bucket": bucket, "border": border}), "bucket", ["doc_id", "part", "n_tokens"], "place", cell_rows)
    return placed.select("doc_id", "part", "start", "n_tokens", "bucket", "border", F.floor(F.col("place") / room).cast("long").alias("batch"),
                         F.pmod("place", room).cast("long").alias("slot"), (F.col("border") - F.col("n_tokens")).alias("padding"))

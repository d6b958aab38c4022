"""Embedding near-duplicates by spherical-cap filters (random product codes, list-decoded).

Vectors are classed by equality first, so a large group of copies is one vector with a weight.
A filter is a direction built as a product: the rotated space is cut into parts, each with
its own small code of random unit vectors, and any choice of one code word for each part gives a
direction.  With 100 words and two parts that is 10,000 filters from 200 inner products.  Each
vector is list-decoded to *all* directions whose inner product exceeds the cap height: partial sums
over the parts are kept only while the best words of the remaining parts can still lift them over
it.  Vectors that share a filter are compared exactly in double precision.  A pair is counted in
the smallest filter of the smallest code that both exceed, so no pair counts twice, and a filter
holding more than `block_rows` vectors is compared in pairs of blocks.  Tasks return, for each
vector, how many partners it found and one link to its local class, never a list of all pairs.

The number of filters grows with the number of vectors so that a filter holds a constant number of
unrelated ones.  As long as a code of independent directions (one part) can be decoded at a bounded cost
(`PART` numbers), it is taken: the directions of a product go together, so the same number of them misses
far more pairs.  Beyond that a filter may hold `FULL` vectors, and then products of `blocks` parts begin,
with as many codes as they need.  The cap height is the exact tail of an inner product of unit vectors of the table's
dimension, so a vector exceeds `per_code` filters of a code on average at any size.  Recall is
computed, not assumed: for each dimension the driver decodes random pairs at the asked cosine with the
very codes in use, and adds codes (then filters a code) until the product of their miss rates, each
raised to its 95 % confidence limit, is at most `miss`.  A pair of a higher cosine is missed less often.

Cases.  Null, empty or zero vectors and those with null or non-finite components link with nothing.  Vectors of
different lengths never link.  A cosine of exactly the threshold, as double precision gives it, links.  Rows that repeat link with each
other and are counted each; vectors are the vertices, so rows that share an id but not a vector are apart, and
each row has the links and the class of its own vector.  Rows with a null id link and are counted like others; a
class's id is the smallest that is not null, or null if there is none, and such a row is never kept.  An empty table gives
no rows.  Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable
from .ngram_join import Classes


def sound(column) -> F.Column:
    """Whether a vector has a direction: components present and finite, not all of them zero."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return column.isNotNull() & (F.size(column) > 0) & whole & F.exists(column, lambda x: x != 0)


def unit(rows) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cap_height(dim: int, share: float) -> float:
    """The inner product that a random unit vector exceeds with probability `share` (at most 0.5)."""
    if dim < 2 or share >= 0.5:
        return 0.0
    # the angle to a fixed direction has density sin ** (dim - 2)
    angle = np.linspace(0, math.pi / 2, 200_001)
    density = np.sin(angle) ** (dim - 2)
    below = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return float(np.cos(np.interp(share, below / (2 * below[-1]), angle)))


#: Numbers in the words of one part at most; vectors in a filter before codes become products.
PART, FULL = 1 << 20, 2048


def shape(n: int, dim: int, per_code: float, bucket: int, blocks: int) -> tuple[int, int]:
    """(words, parts) of the codes for n vectors."""
    need, most = per_code * max(n, 1) / bucket, PART // dim
    if need <= most or per_code * n / max(bucket, FULL) <= most:
        return max(4, min(most, math.ceil(need))), 1
    return max(4, math.ceil(need ** (1 / blocks))), blocks


class ProductCode:
    """Random product codes for one dimension: rotations `first` to `codes`, `blocks` parts of `words` words."""

    def __init__(self, dim: int, words: int, per_code: float, codes: int, blocks: int, seed: int = 7, first: int = 0):
        blocks = min(blocks, dim)
        self.parts, self.words = [p for p in np.array_split(np.arange(dim), blocks)], words
        self.height = cap_height(dim, per_code / words ** blocks)
        self.rotations, self.books = [], []
        for c in range(first, codes):
            r = np.random.RandomState((seed * 1000003 + dim * 101 + c) % (1 << 31))
            self.rotations.append(np.linalg.qr(r.standard_normal((dim, dim)))[0])
            book = []
            for p in self.parts:
                w = r.standard_normal((words, len(p)))
                book.append(w / np.sqrt((w * w).sum(axis=1, keepdims=True)) * math.sqrt(len(p) / dim))
            self.books.append(book)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector all filters whose direction it exceeds, ascending."""
        out: list[list[np.ndarray]] = [[] for _ in range(len(x))]
        for c, (turn, book) in enumerate(zip(self.rotations, self.books)):
            y = x @ turn
            if len(book) == 1:
                for a in range(0, len(x), 128):
                    for i, hit in enumerate(y[a:a + 128] @ book[0].T >= self.height, a):
                        out[i].append(np.flatnonzero(hit) + c * self.words)
                continue
            scores = [y[:, p] @ w.T for p, w in zip(self.parts, book)]
            order = [np.argsort(-s, axis=1) for s in scores]
            for i in range(len(x)):
                rest = sum(s[i].max() for s in scores)
                sums, ids = np.zeros(1), np.zeros(1, np.int64)
                for s, o in zip(scores, order):
                    down = s[i][o[i]]
                    rest -= down[0]
                    many = np.searchsorted(-down, sums + rest - self.height, "right")
                    at = np.repeat(np.arange(len(sums)), many)
                    k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    sums, ids = sums[at] + down[k], ids[at] * self.words + o[i][k]
                out[i].append(ids + c * self.words ** len(self.parts))
        return [np.sort(np.concatenate(f)) for f in out]


def enough(dim: int, words: int, per_code: float, codes: int, blocks: int, cosine: float, miss: float, pairs: int = 1000, most: int = 16) -> tuple[float, int, float]:
    """(filters a code, codes, computed miss rate) for which pairs at `cosine` are missed at a rate of `miss` or less.

    Nothing under the given per_code and codes is taken; a height of zero ends the search for more filters.
    """
    while True:
        wide, rate, c = per_code >= 0.5 * words ** min(blocks, dim), 1.0, 0
        while (c < codes or rate > miss) and c < (10 * most if wide else max(most, codes)):
            r = np.random.RandomState((dim * 7919 + c) % (1 << 31))
            x = unit(r.standard_normal((pairs, dim)))
            z = r.standard_normal((pairs, dim))
            z -= (z * x).sum(axis=1, keepdims=True) * x
            y = unit(cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * unit(z)) if dim > 1 else x
            found = ProductCode(dim, words, per_code, c + 1, blocks, first=c).decode(np.concatenate([x, y]))
            lost = sum(len(np.intersect1d(a, b, True)) == 0 for a, b in zip(found[:pairs], found[pairs:]))
            rate *= min(1.0, (lost + 3 + 2 * math.sqrt(lost)) / pairs)
            c += 1
        if rate <= miss or wide:
            return per_code, c, rate
        per_code *= 2


def _decode(plans: dict[int, tuple[int, float, int, int]]):
    def run(batches):
        known: dict[int, ProductCode] = {}
        for batch in batches:
            for b in range(0, batch.num_rows, 1024):
                part = batch.slice(b, 1024)
                rows = part.column("embedding").to_pylist()
                found: list = [None] * len(rows)
                for dim in {len(r) for r in rows}:
                    at = [i for i, r in enumerate(rows) if len(r) == dim]
                    code = known.setdefault(dim, None) or known.update({dim: ProductCode(dim, *plans[dim])}) or known[dim]
                    for i, f in zip(at, code.decode(unit([rows[i] for i in at]))):
                        found[i] = f
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int64()))], names=[*part.schema.names, "filters"])
    return run


def _compare(cosine: float, tile: int = 512):
    """Of one filter (or two blocks of it): partners that each vector gains there, and its local class."""
    def run(table: pa.Table) -> pa.Table:
        none = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if table.num_rows < 2:
            return none
        mine = table.column("filter")[0].as_py()
        reps, weight, side = (table.column(c).to_numpy() for c in ("rep", "weight", "side"))
        filters = [f[:np.searchsorted(f, mine)] for f in map(np.asarray, table.column("filters").to_pylist())]
        x = unit(table.column("embedding").to_pylist())
        # vectors with the same smallest filter before this one are compared there, so only tiles
        # of different first filters, or with none, can hold pairs to count here
        first = np.array([int(f[0]) if len(f) else -1 for f in filters])
        order = np.lexsort((reps, first))
        reps, weight, side, x, first = reps[order], weight[order], side[order], x[order], first[order]
        filters = [filters[i] for i in order]
        names = np.unique(np.concatenate(filters)) if filters else np.empty(0, np.int64)
        links, classes = np.zeros(len(reps), np.int64), Classes(len(reps))
        cuts = sorted({*range(0, len(reps), tile), *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(reps)})
        tiles = list(zip(cuts[:-1], cuts[1:]))

        def member(a, b):
            m = np.zeros((b - a, len(names)), np.float32)
            for i in range(a, b):
                m[i - a, np.searchsorted(names, filters[i])] = 1
            return m
        across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        bigger = [(a, b) for a, b in tiles]
        if len(bigger) > 4 * (len(reps) // tile + 1):  # many small runs of first filters: plain tiles
            bigger = [(a, min(a + tile, len(reps))) for a in range(0, len(reps), tile)]
        for p, (a, b) in enumerate(bigger):
            left = member(a, b)
            for c, d in bigger[p:]:
                if first[a] >= 0 and (first[a:b] == first[a]).all() and (first[c:d] == first[a]).all():
                    continue
                hit = x[a:b] @ x[c:d].T >= cosine
                if across:
                    hit &= side[a:b, None] != side[None, c:d]
                if a == c:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                hit &= left @ member(c, d).T == 0
                links[a:b] += hit @ weight[c:d]
                if a != c:
                    links[c:d] += weight[a:b] @ hit
                for i, j in zip(*(k.tolist() for k in np.nonzero(hit))):
                    classes.join(a + i, c + j)
        roots = np.array([classes.find(i) for i in range(len(reps))])
        low = reps.copy()
        np.minimum.at(low, roots, reps)
        keep = links > 0
        return pa.table({"rep": pa.array(reps[keep]), "links": pa.array(links[keep]), "root": pa.array(low[roots][keep])})
    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, per_code: float = 8.0, codes: int = 4, bucket: int = 48,
                 blocks: int = 2, block_rows: int = 4096, miss: float = 1e-6) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row per row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(sound(F.col("embedding")))
    # a vertex is a distinct vector, whatever ids its rows have; its number is fixed by the checkpoint
    classes = durable(good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    dims = {r.dim: r.c for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("c")).collect()}
    plans = {}
    for d, n in dims.items():
        words, parts = shape(n, d, per_code, bucket, blocks)
        plans[d] = (words, *(enough(d, words, per_code, codes, parts, cosine, miss)[:2] if n > 1 else (per_code, 1)), parts)
    decoded = classes.select("rep", "weight", "embedding").mapInArrow(
        _decode(plans), "rep long, weight long, embedding array<double>, filters array<long>")
    spread = decoded.select("*", F.size("embedding").alias("dim"), F.explode("filters").alias("filter"))
    big = (spread.groupBy("dim", "filter").count().where(F.col("count") > block_rows)
           .select("dim", "filter", F.ceil(F.col("count") / block_rows).cast("int").alias("many")))
    dealt = spread.join(big, ["dim", "filter"], "left").withColumn("block", F.expr("cast(pmod(xxhash64(rep), coalesce(many, 1)) as int)"))
    pairs = F.expr("transform(sequence(0, coalesce(many, 1) - 1), b -> struct(least(b, block) as low, greatest(b, block) as high))")
    dealt = dealt.select("rep", "weight", "embedding", "filters", "dim", "filter", "block", F.explode(pairs).alias("pair"))
    dealt = dealt.select("*", "pair.*").withColumn("side", F.col("low") != F.col("block"))
    found = durable(dealt.groupBy("dim", "filter", "low", "high").applyInArrow(_compare(cosine), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    member = classes.join(links, "rep", "left").join(parts.withColumnRenamed("v", "rep"), "rep", "left")
    lowest = member.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    known = member.join(lowest, "component", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("lowest", "least").alias("component"))
    linked = good.join(known, "embedding").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    bare = rows.where(~F.coalesce(sound(F.col("embedding")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(bare).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

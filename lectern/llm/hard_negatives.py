"""Hard negatives from an inverted multi-index: certified top lists of inner products.

Vectors are scaled to whole numbers and cut into two halves; each half has a codebook, and a pair of
codes is a cell.  A cell's score for an anchor is at most the sum of two half scores, each the half's
product with the centre plus its length times the code's radius.  Radii cover all rows, so the sum is a
bound, and cells are visited from the largest sum down by a heap over the two sorted lists of half scores.  A list of
the best rows is certain when the next sum is below its last score; a list of the best rows of a window
[80 % of a positive, the positive] also when the next sum is below the window.

On a cluster, neighbouring cells form shards of at most `shard_rows` rows (larger cells are dealt to several), and
anchors meet shards in tiles of one shard and at most `anchors` anchors.  Each anchor first asks its best
shard, then, knowing how good its list is, the other shards whose best cell can still matter; for negatives it
asks the shards whose best cell reaches the lowest window.  In a tile the heap visits
cells.  So vectors are copied by tile, never by pair, and only lists of a few rows leave a tile.

The codebooks are fitted on at most about twice `sample` rows; every row is indexed, and the codebooks decide only
how much is visited, never what is found: the result is exact.  Scores are whole numbers, added in doubles
below 2**53 and in 64-bit integers above.

Cases.  Rows with a null label, vector or component, or a component that is not finite, take no part, nor do
rows with a scaled component beyond 2**26, whose scores might not fit into a long.  Vectors of another length than the
anchor's have no score with it; empty vectors score 0 with each other.  A null vec_id is no anchor, counts as the
largest and comes back as null (2**63-1, the largest id, is taken for null too).  Ties go by vec_id.  Rows that repeat are rows: a
repeated anchor has its results as often, and its copies are among its other rows.  Of rows equal in
label and vector only the first `keep` by vec_id can be in any list, and only those are indexed.  An anchor
without positives, or a positive of 0 or less without rows in its window, gives no rows; so does an empty table.  Other columns, whatever their
names, are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, durable

NO_ID = (1 << 63) - 1
#: Largest scaled component, in size.
MOST = 1 << 26
#: Added to bounds, which are sums of doubles; scores are whole.
SLACK = 1.0


# ---------------------------------------------------------------- rows

def scaled(rows: DataFrame) -> DataFrame:
    """rows(vec_id, embedding, label) -> (vec_id, label, v): the rows that take part, components as whole numbers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    plain = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).where("label is not null and x is not null")
    fine = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * 256 > MOST))
    label = F.when((F.col("vec_id") % 7 == 0) & (F.col("vec_id") != NO_ID), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return plain.where(fine).select("vec_id", label.alias("label"), F.transform("x", lambda c: F.floor(c * 256).cast("int")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, shorter ones filled up with 0."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    out, size = np.zeros((len(column), width), np.int64), np.diff(ends)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1], size)] = flat
    return out


def sizes(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


# ---------------------------------------------------------------- the index

def codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres of about equal clusters (Lloyd's rounds from evenly spaced points in lexicographic order)."""
    points = np.unique(points, axis=0).astype(float)
    centres = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)]
    for _ in range(rounds):
        near = nearest(points, centres)[0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, distance to it) of each point."""
    at = np.argmin((centres**2).sum(1) - 2 * (points @ centres.T), axis=1)
    return at, np.sqrt(((points - centres[at])**2).sum(1))


def _coded(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, first, second = books.value
        cut = first.shape[1]
        for b in batches:
            v = matrix(b.column("v"), width).astype(float)
            (i, r), (j, s) = nearest(v[:, :cut], first), nearest(v[:, cut:], second)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (i, j, r, s))], [*b.schema.names, "i", "j", "r", "s"])
    return run


class Plan:
    """Centres, radii, cells and the shards that hold them: plain arrays, at most codes**2 cells."""

    def __init__(self, plan: dict):
        self.__dict__.update(plan)

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest half scores of an anchor with each code of the first and of the second half."""
        a, b = q[:self.first.shape[1]].astype(float), q[self.first.shape[1]:].astype(float)
        return self.first @ a + np.sqrt(a @ a) * self.r, self.second @ b + np.sqrt(b @ b) * self.s

    def shards(self, q: np.ndarray) -> np.ndarray:
        """The largest possible score in each run of cells (a run is one shard, or a cell dealt to several)."""
        u, w = self.halves(q)
        return np.maximum.reduceat(u[self.i] + w[self.j], self.runs) + SLACK


def _layout(cells: list, shard_rows: int) -> dict:
    """Runs of neighbouring cells of at most shard_rows rows; a larger cell is a run of its own, dealt to several shards."""
    runs, base, parts, held = [], [], [], 0
    for k, c in enumerate(cells):
        share = -(-c.n // shard_rows)
        if not runs or held + c.n > shard_rows:
            base.append(base[-1] + parts[-1] if base else 0)
            runs.append(k)
            parts.append(share)
            held = 0
        held += c.n
    return {"runs": np.array(runs), "base": np.array(base), "parts": np.array(parts)}


def build(index: DataFrame, sample: int, cell_rows: int, most_codes: int, shard_rows: int):
    """(coded rows with their shard, plan) for index(vec_id, label, v), which must have rows."""
    spark = index.sparkSession
    n, width = index.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(2, width)
    codes = int(min(most_codes, max(2, round((n / cell_rows) ** 0.5))))
    some = matrix(bounded_sample(index, "vec_id", sample).select("v").toArrow().column("v").combine_chunks(), width)
    first, second = codebook(some[:, :width // 2], codes), codebook(some[:, width // 2:], codes)
    books = spark.sparkContext.broadcast((width, first, second))
    coded = durable(index.mapInArrow(_coded(books), "vec_id long, label long, v array<int>, i long, j long, r double, s double"))
    # at most most_codes**2 cells
    cells = coded.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).orderBy("i", "j").collect()
    plan = {"width": width, "first": first, "second": second, "i": np.array([c.i for c in cells]), "j": np.array([c.j for c in cells]), "r": np.zeros(len(first)), "s": np.zeros(len(second)), **_layout(cells, shard_rows)}
    for c in cells:
        plan["r"][c.i], plan["s"][c.j] = max(plan["r"][c.i], c.r), max(plan["s"][c.j], c.s)
    run = np.searchsorted(plan["runs"], np.arange(len(cells)), "right") - 1
    where = spark.createDataFrame([(c.i, c.j, int(plan["base"][k]), int(plan["parts"][k])) for c, k in zip(cells, run)], "i long, j long, base long, parts long")
    shard = (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("shard")
    return coded.join(F.broadcast(where), ["i", "j"]).select(shard, "i", "j", "vec_id", "label", "v"), spark.sparkContext.broadcast(plan)


# ---------------------------------------------------------------- asking shards

ASK = "anchor long, vec_id long, label long, v array<int>, windows array<struct<score:long,least:long>>, shard long"


def _asks(shared, seed: bool):
    """(shard) rows of each anchor: its best run's shards, or all others that can still matter (`least`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(shared.value)
        for b in batches:
            v, least, skip = matrix(b.column("v"), plan.width), b.column("least").to_pylist(), b.column("skip_best").to_pylist()
            for k in range(b.num_rows):
                bound = plan.shards(v[k])
                best = int(np.argmax(bound))
                if seed:
                    runs = np.array([best])
                else:
                    runs = np.flatnonzero(bound >= (-np.inf if least[k] is None else least[k]))
                    runs = runs[runs != best] if skip[k] else runs
                shards = np.concatenate([plan.base[r] + np.arange(plan.parts[r]) for r in runs]) if len(runs) else np.empty(0, np.int64)
                if len(shards):
                    one = b.slice(k, 1).select(["anchor", "vec_id", "label", "v", "windows"])
                    many = one.take(pa.array(np.zeros(len(shards), np.int64)))
                    yield pa.RecordBatch.from_arrays([*many.columns, pa.array(shards)], [*many.schema.names, "shard"])
    return run


def visit(u: np.ndarray, w: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs from the largest sum down: the multi-sequence heap."""
    a, b = np.argsort(-u, kind="stable"), np.argsort(-w, kind="stable")
    heap, seen = [(-(u[a[0]] + w[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        bound, x, y = heapq.heappop(heap)
        yield -bound, int(a[x]), int(b[y])
        for p in ((x + 1, y), (x, y + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (-(u[a[p[0]]] + w[b[p[1]]]), *p))


class Shard:
    """The rows of a shard by cell."""

    def __init__(self, rows: pa.Table, plan: Plan):
        rows = rows.combine_chunks()
        i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
        order = np.lexsort((j, i))
        v = matrix(rows.column("v").combine_chunks(), plan.width)[order]
        exact = float(np.abs(v).max(initial=0)) ** 2 * plan.width < 2**50
        self.v, self.exact = v.astype(float) if exact else v, exact
        self.id, self.label, self.size = (x[order] for x in (rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), sizes(rows.column("v").combine_chunks())))
        key = i[order] * len(plan.second) + j[order]
        cells, at = np.unique(key, return_index=True)
        self.cells = {int(k): (int(a), int(z)) for k, a, z in zip(cells, at, [*at[1:], len(key)])}
        self.i, self.j, self.plan = np.unique(i), np.unique(j), plan

    def scores(self, q: np.ndarray, a: int, z: int) -> np.ndarray:
        small = self.exact and float(np.abs(q).max(initial=0)) ** 2 * len(q) < 2**50
        return (self.v[a:z] @ q.astype(float)).astype(np.int64) if small else self.v[a:z].astype(np.int64) @ q

    def best(self, q: np.ndarray, size: int, label: int, same: bool, windows: list[tuple[int, int]], keep: int) -> list[list[tuple[int, int]]]:
        """For each window (score, least) the first `keep` of (score, vec_id) between least and score."""
        u, w = self.plan.halves(q)
        lists, last = [[] for _ in windows], [lo for _, lo in windows]
        for bound, x, y in visit(u[self.i], w[self.j]):
            if bound + SLACK < min(last):
                break
            cell = self.cells.get(int(self.i[x]) * len(self.plan.second) + int(self.j[y]))
            if cell is None:
                continue
            a, z = cell
            score = self.scores(q, a, z)
            fit = np.flatnonzero(((self.label[a:z] == label) == same) & (self.size[a:z] == size) & (score >= min(last)))
            for k, (top, _) in enumerate(windows):
                hit = fit[(score[fit] <= top) & (score[fit] >= last[k])]
                hit = hit[np.lexsort((self.id[a + hit], -score[hit]))[:keep]]
                if len(hit):
                    lists[k] = sorted([*lists[k], *((int(-score[t]), int(self.id[a + t])) for t in hit)])[:keep]
                    if len(lists[k]) == keep:
                        last[k] = max(last[k], -lists[k][-1][0])
        return [[(-s, i) for s, i in x] for x in lists]


def _tile(shared, same: bool, keep: int):
    """Asks and rows of one tile -> the first `keep` rows of each anchor and window."""
    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asks.num_rows and rows.num_rows:
            plan = Plan(shared.value)
            shard, v = Shard(rows, plan), matrix(asks.column("v").combine_chunks(), plan.width)
            size = sizes(asks.column("v").combine_chunks())
            for k, x in enumerate(asks.select(["anchor", "label", "windows"]).to_pylist()):
                got = shard.best(v[k], int(size[k]), x["label"], same, [(w["score"], w["least"]) for w in x["windows"]], keep)
                out += [(x["anchor"], n, i, s) for n, found in enumerate(got) for s, i in found]
        names = ["anchor", "window", "other", "score"]
        return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(names)})
    return run


def asked(asks: DataFrame, rows: DataFrame, shared, same: bool, keep: int, tiles: int) -> DataFrame:
    """(anchor, window, other, score): the lists of every tile, the first `keep` of each anchor and window."""
    tile = F.pmod(F.xxhash64("anchor", F.lit("tile")), F.lit(tiles)).alias("tile")
    asks = asks.select("*", tile)
    copies = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"))
    found = asks.groupBy("shard", "tile").cogroup(copies.groupBy("shard", "tile")).applyInArrow(_tile(shared, same, keep), "anchor long, window long, other long, score long")
    return first_of(found, keep)


def first_of(found: DataFrame, keep: int) -> DataFrame:
    by = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "other")
    return found.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= keep).drop("_n")


# ---------------------------------------------------------------- mining

def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, sample: int = 4096, cell_rows: int = 256, most_codes: int = 256, shard_rows: int = 16384, anchors: int = 16384) -> DataFrame:
    """rows(vec_id, embedding, label) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors have a vec_id divisible by `every`; positives are an anchor's first other rows of its label, negatives the
    first rows of other labels with low * positive_score <= 100 * negative_score <= 100 * positive_score.
    """
    spark, clean = rows.sparkSession, scaled(rows)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    keep = positives + 1
    alike = Window.partitionBy("label", "v").orderBy("vec_id")
    index = durable(clean.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= max(keep, negatives)).drop("_n"))
    if index.isEmpty():
        return spark.createDataFrame([], out)
    coded, shared = build(index, sample, cell_rows, most_codes, shard_rows)
    asking = clean.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)).groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"))
    asking = durable(asking.withColumn("anchor", F.monotonically_increasing_id()))
    tiles = max(1, -(-asking.count() // anchors))
    every_score = F.array(F.struct(F.lit(2**62).alias("score"), F.lit(-2**62).alias("least")))
    base = asking.select("anchor", "vec_id", "label", "v", every_score.alias("windows"))

    # positives: the best shard, then the others that can still matter
    near = durable(asked(base.withColumns({"least": F.lit(None).cast("long"), "skip_best": F.lit(False)}).mapInArrow(_asks(shared, True), ASK), coded, shared, True, keep, tiles))
    worst = near.groupBy("anchor").agg(F.when(F.count("*") >= keep, F.min("score")).alias("least"))
    more = base.join(worst, "anchor", "left").withColumn("windows", F.array(F.struct(F.lit(2**62).alias("score"), F.coalesce("least", F.lit(-2**62)).alias("least")))).withColumn("skip_best", F.lit(True))
    far = asked(more.mapInArrow(_asks(shared, False), ASK), coded, shared, True, keep, tiles)
    lists = first_of(near.unionByName(far), keep).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "other"))).alias("found"))
    # one entry of the list is the anchor itself, unless `keep` others come before it
    own = F.expr("aggregate(transform(v, x -> cast(x as long)), 0L, (a, x) -> a + x * x)")
    listed = asking.join(lists, "anchor").withColumn("self", F.array_position("found", F.struct((-own).alias("minus"), F.col("vec_id").alias("other"))))
    others = F.when(F.col("self") > 0, F.concat(F.slice("found", 1, F.greatest(F.col("self") - 1, F.lit(0)).cast("int")), F.expr("slice(found, cast(self + 1 as int), size(found))"))).otherwise(F.col("found"))
    listed = durable(listed.select("anchor", "vec_id", "label", "v", "copies", F.slice(others, 1, positives).alias("positives")))

    # negatives: one window for each positive, in one visit
    windows = F.expr(f"transform(positives, p -> struct(-p.minus AS score, cast(ceil({low} * cast(-p.minus as decimal(38,0)) / 100) as long) AS least))")
    lowest = F.array_min(F.transform("windows", lambda w: w["least"]))
    wanted = listed.where(F.size("positives") > 0).select("anchor", "vec_id", "label", "v", windows.alias("windows")).withColumns({"least": lowest, "skip_best": F.lit(False)})
    found = asked(wanted.mapInArrow(_asks(shared, False), ASK), coded, shared, False, negatives, tiles)
    by = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "other")
    ranked = found.withColumn("rank", F.row_number().over(by)).withColumnRenamed("score", "negative_score")
    each = listed.select("anchor", F.col("vec_id").alias("anchor_id"), "copies", F.posexplode("positives").alias("window", "p"))
    both = each.withColumn("window", F.col("window").cast("long")).join(ranked, ["anchor", "window"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    null_id = lambda c: F.nullif(c, F.lit(NO_ID))
    return both.select("anchor_id", null_id(F.col("p.other")).alias("positive_id"), F.col("rank").cast("int").alias("rank"), null_id(F.col("other")).alias("negative_id"), (-F.col("p.minus")).alias("positive_score"), "negative_score")

"""Helpers that several operators share: lineage cuts, word hashes over Arrow text, components."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step looks at; a longer document is a step of its own.
STEP_BYTES = 1 << 20


# ---------------------------------------------------------------- lineage

def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; one is set only where none is configured."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        local = sc.master == "local" or sc.master.startswith("local[")
        known = tempfile.mkdtemp(prefix="spark-checkpoints-") if local else (
            spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def durable(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder: survives lost executors, cuts lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# ---------------------------------------------------------------- names

def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


# ---------------------------------------------------------------- text as arrays

def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES):
    """Slices of the batch with about `limit` bytes of text each, in order."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.RandomState(20240607).randint(0, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP_BYTES + 4096)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Besides blanks, ASCII punctuation and control bytes: what remains is letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(array: pa.Array, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lowered) and where each document's begin.

    Words are maximal runs of bytes that are not blank (0x20 and 0x09-0x0D, if not told otherwise),
    so any UTF-8 text works.
    """
    data, offsets = utf8(array)
    return hash_runs(_BYTE_CODE[_LOWER[data]], ~blank[data], offsets)


def hash_runs(codes: np.ndarray, word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of true `word` flags over 64-bit codes, and where each document's begin."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (edge[:-1] | ~before))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (edge[1:] | ~after)) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` neighbouring word hashes."""
    m = len(h) - width + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j:m + j]
    return mix(out)


def fold_key(h: int, k: int) -> int:
    """One step of `uniform`'s hash, for plain integers."""
    mask = (1 << 64) - 1
    h = (h + k * 0x9E3779B97F4A7C15 + 1) & mask
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
    return h ^ (h >> 31)


def fold_keys(h, k):
    """One step of `uniform`'s hash; integers stay integers, arrays advance together."""
    if isinstance(h, int) and not isinstance(k, np.ndarray):
        return fold_key(h, int(k))
    h = np.uint64(h) if isinstance(h, int) else h
    k = k.astype(np.uint64) if isinstance(k, np.ndarray) else np.uint64(int(k) % (1 << 64))
    with np.errstate(over="ignore"):
        return mix(h + (k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))


def uniform(*keys, seed=0x243F6A8885A308D3):
    """Doubles in (0, 1) that depend on the integer keys alone (counter-based)."""
    h = seed
    for k in keys:
        h = fold_keys(h, k)
    if isinstance(h, int):
        return ((h >> 12) + 0.5) / (1 << 52)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


# ---------------------------------------------------------------- training rows

def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` of the rows, or all if there are no more, chosen by a hash of key and text.

    Rows that agree in both fall in or out together; should that give far too many, twice the bound is taken.
    """
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(_lot(rows, key) < F.lit(int((1 << 30) * bound / n))).limit(2 * bound)


def _lot(rows: DataFrame, key: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key), *([F.col("text")] if "text" in rows.columns else []), F.lit("sample")), F.lit(1 << 30))


def learned_from(key: str, modulus: int, held_out: int) -> F.Column:
    """Whether a row may be learned from: crc32(key as text) mod modulus is not `held_out`."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus)) != held_out, F.lit(False))


# ---------------------------------------------------------------- components

def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges(src, dst); component is the smallest vertex reached.

    Alternating large-star and small-star steps: every step is two joins on vertices and a
    distinct, the number of edges never grows, and the rounds are about the logarithm of the
    longest chain.  A hub's edges are only joined with one row, its minimum, so AQE may split it.
    """
    both = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    e, seen = durable(both), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(src, dst) as decimal(38,0))"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        round_ = e.union(e.select("dst", "src")).toDF("src", "dst")
        low = round_.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = round_.join(low, "src").where("dst > src and dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.explode(F.array(
            F.struct(F.col("src"), F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
        e = durable(small.select("e.src", "e.dst").where("src <> dst").distinct())
    stars = e.groupBy("src").agg(F.min("dst").alias("component"))
    roots = e.select("dst").distinct().select("dst", F.col("dst").alias("component"))
    return stars.union(roots).toDF("v", "component").groupBy("v").agg(F.min("component").alias("component"))


# ---------------------------------------------------------------- numbering

def numbered(df: DataFrame, group: str, order: list[str], name: str, cell_rows: int = 500_000) -> DataFrame:
    """df with a gapless number from 0 in each group, whatever the size of the group.

    Rows are dealt into cells of about `cell_rows` rows by a hash of the order columns; each cell is
    numbered by itself and starts where the cells before it end.  The table of starts has a row for
    each cell (one for each `cell_rows` rows, and one for each group), and is all that is broadcast;
    the groups, of which there must be a bounded number, are counted on the driver.  Where so many rows agree in all
    order columns that they would fill several cells, rows are dealt by their place in a checkpoint
    as well; only then may rows that do not agree be numbered differently in another run.
    """
    from pyspark.sql import Window

    cell, start, size, salt = (free_name(df, x) for x in ("cell", "start", "cell_rows", "salt"))
    counts = {r[0]: r[1] for r in df.groupBy(group).agg(F.count("*")).collect()}
    cells = F.lit(1)
    for g, n in counts.items():
        if n > cell_rows:
            cells = F.when(F.col(group) == g, F.lit(-(-n // cell_rows))).otherwise(cells)

    def deal(rows, *more):
        dealt = rows.withColumn(cell, F.pmod(F.xxhash64(*order, *more), cells))
        return dealt, durable(dealt.groupBy(group, cell).agg(F.count("*").alias(size)))
    dealt, sizes = deal(df)
    if (sizes.agg(F.max(size)).first()[0] or 0) > 4 * cell_rows:
        dealt, sizes = deal(durable(df.withColumn(salt, F.monotonically_increasing_id())), salt)
    before = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, cell, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    inner = Window.partitionBy(group, cell).orderBy(*order)
    return (dealt.withColumn(name, F.row_number().over(inner) - 1).join(F.broadcast(starts), [group, cell])
            .withColumn(name, (F.col(name) + F.col(start)).cast("long")).drop(cell, start, salt))

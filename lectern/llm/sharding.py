"""Histogram sort: documents in key order, cut into shards of near equal bytes, exchanged once.

The key of a document is (64-bit hash of its text, doc_id), so equal texts lie side by side.  The
shard borders are found by probing: each round counts exact bytes in the cells between equally
spaced candidate borders inside every interval that still holds a border (4096 cells an interval;
one aggregation of a slim table, at most 4096 rows for each border to the driver), and takes the
candidate nearest to the wanted share.  A border is done when it is within `tolerance` of a shard's
bytes; else the cell around it is probed more finely, down to single hashes and then to single
document ids.  So a group of equal texts is split only where the balance of bytes asks for it,
and no document is ever split.

Cases: a null text has no bytes and counts as empty, an empty table gives no rows; a document may be
larger than a shard and is then alone or with few.  Rows that agree in text and doc_id, also in a null one,
stay in one shard, and every one of them has its own slot.  Other columns are left out by `histogram_sort`;
`write_shards` keeps all, and puts underscores before its own two names where the documents have them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, numbered

#: Bits of the key that each round of probes looks at: 64 of the hash, then 64 of the id.
ROUNDS = (12, 12, 12, 12, 12, 4)
_SIGN = -(1 << 63)


def _key() -> dict[str, F.Column]:
    """Size and key (hash, id) of a document; both keys order like unsigned numbers bit by bit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {"size": (F.octet_length(text) + F.lit(16)).cast("long"), "h": F.xxhash64(text).bitwiseXOR(F.lit(_SIGN)),
            "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_SIGN)).bitwiseXOR(F.lit(_SIGN))}


def slim(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h, d): what placing needs of a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("text_crc32"), *(c.alias(n) for n, c in _key().items()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def borders(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The first key (hash, id), as unsigned numbers, of every shard but the first."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = [total * (j + 1) / shards for j in range(shards - 1)]
    slack, done = tolerance * total / shards, {}
    #: border number -> (hash prefix, id prefix, bytes before the cell)
    still = {j: (0, 0, 0) for j in range(shards - 1)}
    bits = 0
    for width in (*ROUNDS, *ROUNDS):
        if not still or not total:
            break
        on_id, had = bits >= 64, bits - 64 * (bits >= 64)
        bits += width
        shift = 64 - had - width
        column = F.col("d" if on_id else "h")
        probe = F.shiftrightunsigned(column, shift)
        open_cells = {(a, b) for a, b, _ in still.values()}
        if on_id:
            inside = reduce(lambda x, y: x | y, [(F.col("h") == _signed(a)) & (F.shiftrightunsigned("d", 64 - had) == _signed(b) if had else F.lit(True)) for a, b in open_cells])
            counted = rows.where(inside).groupBy("h", probe.alias("p"))
        else:
            inside = F.shiftrightunsigned("h", 64 - had).isin([_signed(a) for a, _ in open_cells]) if had else F.lit(True)
            counted = rows.where(inside).groupBy(F.lit(0).cast("long").alias("h"), probe.alias("p"))
        cells = sorted(((r.h % (1 << 64)) if on_id else 0, r.p % (1 << 64), r.b) for r in counted.agg(F.sum("size").alias("b")).collect())
        for j, (a, b, below) in list(still.items()):
            low, at = ((b if on_id else a) << width), below
            mine = [(p, n) for h, p, n in cells if p >> width == low >> width and (not on_id or h == a)]
            for p, n in mine:
                if at + n >= wanted[j]:
                    break
                at += n
            before, after = abs(at - wanted[j]), abs(at + n - wanted[j])
            if min(before, after) <= slack or bits == 128:
                edge = (p + (after < before)) << shift
                done[j] = (a + (edge >> 64), edge % (1 << 64)) if on_id else (edge, 0)
                del still[j]
            else:
                still[j] = (a, p, at) if on_id else (p, 0, at)
    return sorted(done.values())


def _shard(cuts: list[tuple[int, int]], h: str, d: str) -> F.Column:
    """The number of borders at or below a key."""
    out = F.lit(0)
    for a, b in cuts:
        if a < 1 << 64:
            x, y = (F.col(c).bitwiseXOR(F.lit(_SIGN)) for c in (h, d))
            out = out + ((x > a - (1 << 63)) | ((x == a - (1 << 63)) & (y >= b - (1 << 63)))).cast("int")
    return out


def histogram_sort(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, cell_rows: int = 500_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    rows = durable(slim(docs))
    cuts = borders(rows, shards, tolerance)
    placed = numbered(rows.withColumn("shard", _shard(cuts, "h", "d")), "shard", ["h", "d", "size"], "slot", cell_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.005, cell_rows: int = 500_000) -> None:
    """The documents themselves with shard and slot, a folder for each shard; texts move once, unjoined."""
    cuts = borders(durable(slim(docs)), shards, tolerance)
    names = {n: free_name(docs, n) for n in (*_key(), "shard", "slot")}
    keyed = docs.withColumns({names[n]: c for n, c in _key().items()})
    keyed = keyed.withColumn(names["shard"], _shard(cuts, names["h"], names["d"]))
    placed = numbered(keyed, names["shard"], [names[n] for n in _key()], names["slot"], cell_rows)
    placed.drop(*(names[n] for n in _key())).write.partitionBy(names["shard"]).parquet(path)

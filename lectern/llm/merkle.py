"""Merkle manifest of a dataset: a subroot for each source, one root, and a proof for each row.

Every row of documents is a leaf: the sha256 of doc_id, source, lang, n_chars and text, each written as `-`
if null, else as its UTF-8 byte count, a colon and its value.  The leaves of a source stand by doc_id; every
three neighbours become the digest of their joined hexadecimal digests, until one is left, the subroot.  The
subroots stand by source (null first, then bytewise) and become the root in the same way.

Where a leaf stands comes from bitmaps, not from a sort of the rows.  The ids of a source are bits of 64-bit
words, 64 words to a container, merged from all tasks by OR; a directory of counts says how many rows come
before each word and each container, added up over a radix tree whose nodes have at most 8,192 children, so
that no window grows with the source.  A row's slot is its container's start, its word's start and the number
of bits below its own.

Slots then key the arrays in which levels are reduced: 81 neighbours, four levels, are one row, so a source
of 10**11 rows takes six rounds.  The way back adds, to each node's siblings, those of the block it is in.

Cases.  A null doc_id stands before all others.  Rows of one source and doc_id stand by leaf digest (its first
60 bits), rows that agree in that as well in any order, as they are the same row; each is a leaf of its own
with its own proof.  Empty and null texts differ.  A row without siblings at any level has the sha256 of the empty
string as proof.  An empty table has no rows and no root.  Columns besides the five are ignored, whatever
their names.  Ids may repeat or be null in a third of the rows: their ranks come from the same bitmaps over
digests and places, so no group of ties is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Neighbours that one node is made of.
ARITY = 3
#: Levels that one row of the keyed arrays holds, and its slots.
LEVELS = 4
BLOCK = ARITY**LEVELS
#: Bits of an id below its container: 64 words of 64 bits.
LOW = 12
#: Bits of a container's number that one level of the radix directory resolves.
STEP = 13


# ---------------------------------------------------------------- leaves

def field(x: Column) -> Column:
    """A value as it goes into a leaf."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256))


def tampered(doc_id: Column) -> Column:
    """Whether the trial of the proofs edits this row: 2 divides the crc32 of its decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


# ---------------------------------------------------------------- ranks from bitmaps

def ranked(rows: DataFrame, group: list[str], key: str) -> tuple[DataFrame, bool]:
    """(rows with slot, total and tied, whether any are tied): where a long key stands in its group.

    slot counts the rows of the group with a smaller key, total all rows of the group; a null key is below all
    others.  tied rows share their key with another row of the group, and have the first slot of the key.
    The group columns must not be null.
    """
    hi = F.coalesce(F.shiftright(key, LOW), F.lit(-(1 << (63 - LOW)) - 1))
    word = F.coalesce(F.shiftright(key, 6).bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    bit = F.coalesce(F.col(key).bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    placed = rows.withColumns({"_hi": hi, "_word": word, "_bit": bit})
    words = placed.groupBy(*group, "_hi", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"), F.count("*").alias("n"))
    sets = words.groupBy(*group, "_hi").agg(F.array_sort(F.collect_list(F.struct("_word", "bits", "n"))).alias("_words"), F.sum("n").alias("_n"),
                                            F.sum(F.col("n") - F.bit_count("bits")).alias("_more"))
    sets = durable(sets)
    repeats = (sets.agg(F.max("_more")).first()[0] or 0) > 0
    starts = _starts(sets.select(*group, "_hi", "_n"), group)
    # popcount directory: rows of the container before each of its words
    listed = F.expr("transform(_words, (x, i) -> struct(x._word AS w, x.bits AS bits, aggregate(slice(_words, 1, i), 0L, (a, y) -> a + y.n) AS before))")
    index = sets.select(*group, "_hi", listed.alias("_words")).join(starts, [*group, "_hi"])
    if repeats:
        extra = placed.groupBy(*group, "_hi", "_word", "_bit").agg((F.count("*") - 1).alias("more")).where("more > 0")
        extra = extra.groupBy(*group, "_hi").agg(F.collect_list(F.struct("_word", "_bit", "more")).alias("_extra"))
        index = index.join(extra, [*group, "_hi"], "left")
    met = placed.join(index, [*group, "_hi"])
    own = F.expr("filter(_words, x -> x.w = _word)[0]")
    below = F.bit_count(F.expr("_own.bits & ~shiftleft(-1L, _bit)"))
    slot = F.col("_start") + F.col("_own.before") + below
    tied = F.lit(False)
    if repeats:
        slot += F.coalesce(F.expr("aggregate(filter(_extra, x -> x._word = _word and x._bit < _bit), 0L, (a, x) -> a + x.more)"), F.lit(0))
        tied = F.coalesce(F.expr("exists(_extra, x -> x._word = _word and x._bit = _bit)"), F.lit(False))
    out = met.withColumn("_own", own).select(*rows.columns, slot.cast("long").alias("slot"), F.col("_total").alias("total"), tied.alias("tied"))
    return out, repeats


def _starts(sets: DataFrame, group: list[str]) -> DataFrame:
    """(group, _hi, _start, _total): rows of the group before each container, over a radix tree of sums."""
    levels = [sets]
    for _ in range(3):
        levels.append(levels[-1].groupBy(*group, F.shiftright("_hi", STEP).alias("_hi")).agg(F.sum("_n").alias("_n")))
    top = levels.pop().withColumn("_up", F.lit(0))
    whole = Window.partitionBy(*group)
    done = _before(top, [*group, "_up"]).withColumn("_total", F.sum("_n").over(whole)).drop("_up", "_n")
    while levels:
        own = _before(levels.pop().withColumn("_up", F.shiftright("_hi", STEP)), [*group, "_up"]).drop("_n").withColumnRenamed("_start", "_own")
        done = own.join(done.withColumnRenamed("_hi", "_up"), [*group, "_up"]).withColumn("_start", F.col("_start") + F.col("_own")).drop("_own", "_up")
    return done


def _before(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """_start: the sum of the siblings before each node; a parent has at most 2**STEP children (and one for nulls)."""
    earlier = Window.partitionBy(*parent).orderBy("_hi").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def slots(rows: DataFrame, group: list[str], keys: list[tuple[str, Column]]) -> DataFrame:
    """rows with slot (gapless from 0 in each group) and total; ties of one key are ranked by the next.

    Each key is a long column and an expression that is equal for the same rows and never null.  No two rows of
    a group may agree in the last key.
    """
    (key, twin), *rest = keys
    out, repeats = ranked(rows, group, key)
    if not repeats or not rest:
        return out.drop("tied")
    out = durable(out)
    tied = out.where("tied").withColumn(f"_twin{len(rest)}", twin).withColumnsRenamed({"slot": f"_slot{len(rest)}", "total": f"_total{len(rest)}"}).drop("tied")
    again = slots(tied, [*group, f"_twin{len(rest)}"], rest)
    again = again.select(*rows.columns, (F.col(f"_slot{len(rest)}") + F.col("slot")).alias("slot"), F.col(f"_total{len(rest)}").alias("total"))
    return out.where("not tied").drop("tied").unionByName(again)


# ---------------------------------------------------------------- levels in keyed arrays

def depth(n: int) -> int:
    """Levels above n nodes until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def joined(digests: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def raised(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes and each level above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([joined(below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def siblings(tree: list[list[bytes]], place: int) -> list[tuple[bytes, bytes]]:
    """For each level, the digests left and right of the node in its run, joined."""
    out = []
    for level in tree[:-1]:
        run = place - place % ARITY
        out.append((b"".join(level[run:place]), b"".join(level[place + 1:run + ARITY])))
        place //= ARITY
    return out


def climbed(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The digest at the end of a path of siblings."""
    for left, right in path:
        digest = sha256((left.hex() + digest.hex() + right.hex()).encode()).digest()
    return digest


PATH = "array<struct<left:binary,right:binary>>"


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(grp, slot, total, items): the nodes of each block, in the order of their slots."""
    items = F.array_sort(F.collect_list(F.struct(F.pmod("slot", F.lit(BLOCK)).cast("int").alias("place"), "digest", *payload)))
    return nodes.groupBy("grp", F.expr(f"slot div {BLOCK}").alias("slot")).agg(F.max("total").alias("total"), items.alias("items"))


def _raise(round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = [raised([x["digest"] for x in items.as_py()], min(LEVELS, max(0, depth(total.as_py()) - LEVELS * round_)))[-1][0]
                    for items, total in zip(b.column("items"), b.column("total"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("slot"), b.column("total"), pa.array(tops, pa.binary())], ["grp", "slot", "total", "digest"])
    return run


def climb(nodes: DataFrame, payload: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each round, (grp, digest) of each group's last node) for nodes(grp, slot, total, digest, payload)."""
    rounds, most = [], None
    while True:
        blocks = durable(_blocks(nodes, list(payload) if not rounds else []))
        most = depth(blocks.agg(F.max("total")).first()[0] or 0) if most is None else most
        nodes = blocks.select("grp", "slot", "total", F.expr("transform(items, x -> struct(x.digest AS digest))").alias("items")).mapInArrow(
            _raise(len(rounds)), "grp string, slot long, total long, digest binary")
        rounds.append(blocks)
        if LEVELS * len(rounds) >= most:
            return rounds, nodes.select("grp", "digest")


def _pieces(batches: Iterator[pa.RecordBatch], blocks: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some thousand nodes, which is what a task holds as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, blocks):
            yield b.slice(i, blocks)


def _paths(round_: int, blocks: pa.RecordBatch):
    """(row, item, siblings up to the root) of each item of each block."""
    for row, (items, total, above) in enumerate(zip(blocks.column("items"), blocks.column("total"), blocks.column("above"), strict=True)):
        items, above = items.as_py(), [(x["left"], x["right"]) for x in above.as_py()]
        tree = raised([x["digest"] for x in items], min(LEVELS, max(0, depth(total.as_py()) - LEVELS * round_)))
        for x in items:
            yield row, x, siblings(tree, x["place"]) + above


def _descend(round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            grp, slot, out = b.column("grp").to_pylist(), b.column("slot").to_pylist(), []
            for row, x, path in _paths(round_, b):
                out.append({"grp": grp[row], "slot": slot[row] * BLOCK + x["place"], "above": [{"left": a, "right": z} for a, z in path]})
            kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("grp", pa.string()), ("slot", pa.int64()), ("above", kind)]))
    return run


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """rounds[0] with the path (`above`) of each block, given (grp, above) of each group's last node."""
    above = above.withColumn("slot", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, 0, -1):
        both = rounds[k].join(above, ["grp", "slot"])
        above = both.mapInArrow(_descend(k), f"grp string, slot long, above {PATH}")
    return rounds[0].join(above, ["grp", "slot"])


# ---------------------------------------------------------------- the manifest

def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs.

    Proofs are tried on rows edited as `tampered` says: their line breaks are gone.  folded_root is what the
    edited leaf and the original siblings give.
    """
    five = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    bare = F.when(tampered(five[0]) & (F.instr("text", "\n") > 0), leaf(*five[:4], F.replace(five[4], F.lit("\n"), F.lit(""))))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), field(F.col("source")).alias("grp"), leaf(*five).alias("digest"), bare.alias("edited"))
    leaves = durable(leaves.withColumn("place", F.monotonically_increasing_id()))
    bits = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    keys = [("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), ("bits", F.hex("digest")), ("place", F.col("place").cast("string"))]
    placed = slots(leaves.withColumn("bits", bits), ["grp"], keys)
    rounds, subroots = climb(placed, ("doc_id", "edited"))
    subroots = durable(subroots)
    # sources in order: null (`-`) first, then the bytes after the count
    name = F.when(F.col("grp") != "-", F.expr("substring(grp, instr(grp, ':') + 1)"))
    ordered = durable(subroots.withColumn("_name", name).orderBy(F.col("_name").asc_nulls_first()).drop("_name"))
    tops = slots(ordered.select(F.lit("").alias("grp"), F.col("grp").alias("source_key"), "digest", F.monotonically_increasing_id().alias("at")), ["grp"], [("at", F.lit(""))])
    upper, roots = climb(tops, ("source_key",))
    none = upper[-1].select("grp").distinct().withColumn("above", F.expr(f"cast(array() as {PATH})"))
    way = descend(upper, none).mapInArrow(_way, f"grp string, above {PATH}")
    proofs = descend(rounds, way).join(subroots.select("grp", F.lower(F.hex("digest")).alias("subroot")), "grp")
    out = proofs.select("total", "items", "above", "subroot").mapInArrow(_proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = roots.select(F.lower(F.hex("digest")).alias("root"))  # one row, or none for an empty table
    return out.crossJoin(F.broadcast(root)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _way(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source's grp, siblings from its subroot to the root)."""
    kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
    for b in _pieces(batches):
        out = [{"grp": x["source_key"], "above": [{"left": a, "right": z} for a, z in path]} for _, x, path in _paths(0, b)]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("grp", pa.string()), ("above", kind)]))


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"]
    for b in _pieces(batches):
        subroot, out = b.column("subroot").to_pylist(), []
        for row, x, path in _paths(0, b):
            proof = sha256("".join(a.hex() + z.hex() for a, z in path).encode()).hexdigest()
            out.append((x["doc_id"], x["digest"].hex(), subroot[row], proof, climbed(x["edited"] or x["digest"], path).hex()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(columns)], names)

r"""Document fingerprints from closed syncmers, in DataFrame expressions only.

The alphabet is units: a blank-separated word of at most LONGEST code points is one, and in longer runs
without a blank (base64, minified code), and in runs with characters of scripts that put no blanks
between words (APART), every code point is one.  A k-mer of K units is a closed syncmer when the
smallest hash among its inner S-mers stands at its first or last S-mer.  That depends on the k-mer alone,
so shared passages give the same anchors wherever they stand, and no run of K - S + 1 k-mers is without
one.  K - 1 blank units pad both ends, so short texts have anchors too and a text's beginning and end count.

A fingerprint is the array of a text's anchors, (place, hash) in order of place; as a string it shows its
SHOWN smallest distinct hashes in hex.  The likeness of two fingerprints is the Jaccard index of their whole
sets of hashes, and `passages` finds by the places what two texts share where.

Rows meet their successor (descending doc_id) in blocks of about BLOCK rows.  Blocks are cut from a count of
ids in at most CELLS equal cells between the smallest and the largest; sparse cells are joined, full
ones split, and an id that repeats beyond 4 BLOCK rows (or the null id) is split by the hash of its texts.  One row
for each block goes on to the block before.

Cases: a null text counts as empty, and empty texts have the padding's anchors, so all are alike.  A very long
text is one row of one task, with about 60 bytes for each of its units at once.  Rows of equal id follow each other by the hash of their text, then the text; a null id comes last;
rows that agree in both (which lie in one block) are neighbours.  One document is its own successor.  An
empty table gives no rows.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

K, S, SHOWN, LONGEST = 5, 2, 64, 24
#: Scripts without blanks between words.
APART = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_WORD = r"[^\x20\x09-\x0D]"
_PLAIN = r"[^\x20\x09-\x0D" + "".join(rf"\p{{Is{x}}}" for x in APART) + "]"
UNIT = rf"(?<!{_WORD}){_PLAIN}{{1,{LONGEST}}}(?!{_WORD})|{_WORD}"
#: Rows of a block, cells of the count of ids, and blocks in a block of blocks.
BLOCK, CELLS, FAR = 512, 1 << 12, 1 << 16
_PAD = ", ".join(["0L"] * (K - 1))


def _anchors(text: str) -> str:
    """SQL for the anchors of a text: array of (place, hash), by place from 0 (the first pad unit)."""
    last = K - S
    at_first = " and ".join(f"x <= g[i + {j}]" for j in range(1, last + 1))
    at_last = " and ".join(f"g[i + {last}] <= {f'g[i + {j}]' if j else 'x'}" for j in range(last - 1, -1, -1))
    whole = ", ".join(["x", *(f"g[i + {j}]" for j in sorted({*range(S, last, S), last}))])
    found = f"array_compact(transform(slice(g, 1, size(g) - {K - 1}), (x, i) -> case when ({at_first}) or ({at_last}) then struct(i as place, xxhash64({whole}) as hash) end))"
    units = f"concat(array({_PAD}), transform(regexp_extract_all({text}, r'{UNIT}', 0), x -> xxhash64(x)), array({_PAD}))"
    pairs = "zip_with(w, slice(w, 2, size(w)), (a, b) -> xxhash64(a, b))"
    return f"element_at(transform(array({units}), w -> element_at(transform(array({pairs}), g -> {found}), 1)), 1)"


def _hashes(anchors: str) -> str:
    return f"transform({anchors}, a -> a.hash)"


def likeness(a: str, b: str) -> F.Column:
    """Jaccard index of two arrays of hashes, 0 to 1."""
    return F.expr(f"size(array_intersect({a}, {b})) / size(array_union({a}, {b}))")


def shown(hashes: str) -> F.Column:
    """A fingerprint as a string: its smallest distinct hashes."""
    return F.expr(f"array_join(transform(slice(sort_array(array_distinct({hashes})), 1, {SHOWN}), x -> lpad(lower(hex(x)), 16, '0')), '')")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_chars, anchors array<(place, hash)>, fingerprint).

    A place counts units from K - 1 before the text's first.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = plain.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.expr(_anchors("text")).alias("anchors"))
    return found.select("*", shown(_hashes("anchors")).alias("fingerprint"))


def passages(prints: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """Shared passages of stated pairs(a, b) of fingerprints: (a, b, shift, anchors, first, last).

    Anchors that both have, place in b less place in a the same, `least` or more of them; first and
    last are their places in a.  Only the stated pairs meet, so no anchor of all documents is gathered.
    """
    spots = prints.select("doc_id", F.explode("anchors").alias("x")).select("doc_id", "x.place", "x.hash")
    left = pairs.join(spots.toDF("a", "place_a", "hash"), "a")
    both = left.join(spots.toDF("b", "place_b", "hash"), ["b", "hash"])
    runs = both.groupBy("a", "b", (F.col("place_b") - F.col("place_a")).alias("shift"))
    return runs.agg(F.count("*").alias("anchors"), F.min("place_a").alias("first"), F.max("place_a").alias("last")).where(F.col("anchors") >= least)


def with_blocks(rows: DataFrame, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """rows(doc_id, text_hash, ...) with `block`: higher ids in higher blocks of about `block` rows, nulls below 0.

    The driver sees a row for each cell (at most `cells`), and for each id that has four blocks' rows
    and a 65,536th of all.
    """
    per_id = rows.groupBy("doc_id").count()
    n, nulls, low, high = per_id.agg(F.sum("count"), F.sum(F.when(F.col("doc_id").isNull(), F.col("count"))), F.min("doc_id"), F.max("doc_id")).first()
    known = per_id.where("doc_id is not null")
    # the place of a text's hash among equal parts of all hashes
    part = lambda many: f"shiftright((shiftright(text_hash, 32) + 2147483648L) * {many}L, 32)"
    below = -(-(nulls or 0) // block)
    if low is None:
        return rows.withColumn("block", F.expr(f"{part(below)} - {below}L"))
    hot = {r.doc_id: -(-r["count"] // block) for r in known.where(F.col("count") > max(4 * block, n >> 16)).collect()}
    width = (high - low) // cells + 1
    cell = f"cast((cast(doc_id as decimal(20, 0)) - {low}BD) div {width}BD as int)"
    rest = F.when(F.col("doc_id").isin(list(hot)), 0).otherwise(F.col("count")) if hot else F.col("count")
    counts = known.groupBy(F.expr(cell).alias("cell")).agg(F.sum(rest).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
    # of each cell: the number of its first block, its smallest id, and the width of its blocks in ids
    cuts, at, held = {}, 0, 0
    for r in sorted(counts):
        many = max(1, -(-r.n // block))
        if held and (many > 1 or held + r.n > block):
            at, held = at + 1, 0
        cuts[r.cell] = (at, r.low, (r.high - r.low) // many + 1)
        at, held = (at + many, 0) if many > 1 else (at, held + r.n)
    used = [cuts.get(i, (0, 0, 1)) for i in range(max(cuts) + 1)]
    base, start, step = (f"get(cast(split('{','.join(map(str, x))}', ',') as array<bigint>), {cell})" for x in zip(*used))
    # a hot id's parts lie between the lower and the higher ids of its block
    before = " + ".join(["0L", *(f"case when doc_id > {i}L then {hot[i] + 1}L when doc_id = {i}L then 1L + {part(hot[i])} else 0L end" for i in sorted(hot))])
    own = f"{base} + (doc_id - {start}) div {step}"
    return rows.withColumn("block", F.expr(f"case when doc_id is null then {part(below)} - {below}L else {own} + {before} end"))


def _below(heads: DataFrame) -> DataFrame:
    """(block, below): the next lower block of each block, or the highest for the lowest.

    Blocks are ordered inside blocks of blocks; only the edges of those are ordered as a whole.
    """
    blocks = heads.select("block", F.expr(f"floor(block / {FAR})").alias("far"))
    near = Window.partitionBy("far").orderBy(F.col("block").desc())
    below = blocks.select("block", "far", F.lead("block").over(near).alias("below"))
    edges = blocks.groupBy("far").agg(F.max("block").alias("top"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    far = edges.select("far", F.lead("top").over(Window.orderBy(F.col("far").desc())).alias("far_below"), F.max("top").over(whole).alias("top"))
    return below.join(far, "far").select("block", F.coalesce("below", "far_below", "top").alias("below"))


def _edit(rows: DataFrame) -> DataFrame:
    """rows(text, next_text) with the edited text's digest and hashes, null where next_text is."""
    kept = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, length(text) div 2)")))
    return kept.withColumn("edited_hashes", F.expr(_hashes(_anchors("edited")))).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def _compared(rows: DataFrame) -> DataFrame:
    hashed = rows.withColumn("own", F.expr(_hashes("anchors")))
    return hashed.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited_sha256", shown("own").alias("fingerprint"), shown("edited_hashes").alias("edited_fingerprint"),
                         likeness("own", "edited_hashes").alias("near_edited"), likeness("own", "next").alias("near_next"),
                         "block", "head", "text", "anchors", F.col("next_text").isNull().alias("end"))


def edited_pairs(docs: DataFrame, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """Each document against its edited text and against the next document (descending doc_id).

    The edited text is the text whose last half (rounded down) is replaced by as many first code
    points of the next document.  Texts move once, to their blocks; what leaves them is digests and
    likenesses, and the texts and anchors of each block's first and last row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    w = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc(), F.col("text").desc())
    led = with_blocks(plain, block, cells).withColumn("next_text", F.lead("text").over(w)).withColumn("head", F.row_number().over(w) == 1)
    found = led.withColumn("anchors", F.expr(_anchors("text")))
    found = found.withColumn("next", F.lead(F.expr(_hashes("anchors"))).over(w))
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    edge = lambda c: F.when(F.col("end") | F.col("head"), F.col(c)).alias(c)
    known = durable(_compared(_edit(found)).select(*out, "block", "head", "end", edge("text"), edge("anchors")))
    heads = known.where("head").select("block", F.col("text").alias("next_text"), F.expr(_hashes("anchors")).alias("next"))
    ends = known.where("end").select("doc_id", "block", "head", "text", "anchors").join(_below(heads), "block")
    last = _compared(_edit(ends.join(heads.withColumnRenamed("block", "below"), "below")))
    return known.where("not end").select(*out).unionByName(last.select(*out))

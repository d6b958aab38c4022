"""Exact n-gram Jaccard self join by prefix trees, and the classes of documents it links.

A document's set is its distinct word n-grams (A-Z lowered, words are `[^\\x20\\x09-\\x0D]+`); with
fewer words than n the whole sequence is one n-gram; without words the set is empty and linked
with nothing.  Two documents link when 100 * |intersection| >= percent * |union|.

Plan, every step linear in the corpus but the last:

1. each task turns its documents into sets; documents with the same set become one *text*, whose 64-bit
   name is its vertex all through (ids come back at the end, so equal or null ids do no harm).
   The same pass adds up, over steps of `held_entries`, n-grams that several texts of a step hold;
   those above a `HEAVY`-th of all entries, or an eighth of a range, are heavy;
2. n-grams travel in packed blocks (delta-coded, grouped by the top bits of their hash) to the
   partition that owns their hash range, which counts exact document frequencies; only n-grams
   in two or more texts travel on, back to their text (with very many ranges in two hops, coarse
   then fine, so that blocks stay large).  A heavy n-gram, which may be in every document, is never
   gathered: its entries go by text from the start, with the sum of the first pass as its place in
   the order (any order that all texts share is right);
3. sets are ordered globally, rare n-grams first.  Two linked texts must share an n-gram among the
   first |set| - ceil(percent * |set|) + 1, so a text whose prefix holds only n-grams of its own
   is done.  The others meet the smallest text of each shared prefix n-gram (a star, never all
   pairs) and the stars' connected components bound what can be linked at all;
4. a task takes a component, stores its ordered sets in a trie and probes it with each set.  The
   overlap along a path is shared by all sets below it; a subtree is left when the n-grams that
   remain on either side cannot reach the overlap needed, or when all of its texts are known to be
   in the probing text's class already, so a large group of copies costs one link per member;
5. a component above `block_tokens` is cut into blocks: each block is joined in itself, one text per
   class and block is joined across blocks, and then every text outside its component's main class
   is probed against every block, which leaves no pair of different classes unseen.

Blocks hold 64-bit hashes.

Cases: null text counts as empty, and empty texts (also blanks only) are linked with nothing and all
stay.  A text of any length is one set.  Rows whose ids are equal or null are kept, each with the class of
its own text; a null id names a class only where all ids of the class are null.  Of equal sizes and
equal ids the order decides nothing but work.  Empty tables give empty tables.  Other columns are
left out by `ngram_components` and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable, free_name, mix, run_hashes, steps, word_hashes

U = np.uint64


# ---------------------------------------------------------------- sets

def _sets(column: pa.Array, width: int):
    """The sorted distinct n-gram hashes of each text."""
    h, at = word_hashes(column)
    grams = run_hashes(h, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        n = b - a
        if n >= width:
            yield np.unique(grams[a:b - width + 1])
        elif n:
            short = h[a:b]
            whole = run_hashes(short, n) if n > 1 else mix(short)
            yield whole ^ U(n)
        else:
            yield h[:0]


def _set_key(s: np.ndarray) -> int:
    """An order-free 64-bit name of a set."""
    total = (s * U(0x9E3779B97F4A7C15) ^ (s >> U(29))).sum(dtype=U) + U(len(s) * 0x9E37)
    return int(mix(np.array([total], U)).view(np.int64)[0])


#: Texts of a step that must hold an n-gram before it counts towards being heavy.
SEEN = 8
#: An n-gram with more than this part of all entries is heavy; so at most about HEAVY are (8 MB).
HEAVY = 1 << 20
_SIZES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("gram", pa.int64()), ("c", pa.int64())])


def _map_sizes(width: int, held: int):
    """A row for each document, and rows (gram, c) for n-grams that several texts of a step hold."""
    def seen(sets):
        grams, count = np.unique(np.concatenate(sets), return_counts=True)
        often = count >= SEEN
        columns = [pa.nulls(int(often.sum()), pa.int64())] * 4 + [pa.array(grams[often].view(np.int64)), pa.array(count[often])]
        return pa.RecordBatch.from_arrays(columns, schema=_SIZES)

    def run(batches):
        known: dict[int, np.ndarray] = {}
        total = 0
        for batch in batches:
            for part in steps(batch):
                n, key = [], []
                for s in _sets(part.column("text"), width):
                    n.append(len(s))
                    key.append(_set_key(s))
                    if len(s) and key[-1] not in known:
                        known[key[-1]] = s
                        total += len(s)
                rest = [pa.nulls(part.num_rows, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), *rest], schema=_SIZES)
                if total >= held:
                    yield seen(list(known.values()))
                    known, total = {}, 0
        if known:
            yield seen(list(known.values()))
    return run


def set_sizes(docs: DataFrame, width: int = 5, held_entries: int = 2_000_000) -> DataFrame:
    """(doc_id, text_key, n, key): size of each document's set and a name that equal sets share.

    Rows with a `gram` instead say how many texts of one step hold it.
    """
    text = F.col("text").cast("string")
    keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return keep.mapInArrow(_map_sizes(width, held_entries), ", ".join(f"{f.name} long" for f in _SIZES))


# ---------------------------------------------------------------- packed blocks

def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers, byte planes compressed one after the other."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, count: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw, count * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, count).T).view(kind).ravel()


_BLOCK = pa.schema([("part", pa.int32()), ("m", pa.int64()), ("d", pa.int64()), ("key", pa.binary()), ("n", pa.binary()),
                    ("gram", pa.binary()), ("doc", pa.binary()), ("df", pa.binary())])
_BLOCK_DDL = "part int, m long, d long, key binary, n binary, gram binary, doc binary, df binary"


def _block(part: int, keys, sizes, grams, docs, df=None):
    """One block: texts (key, size) and their (n-gram, text) entries sorted by n-gram."""
    used, local = np.unique(docs, return_inverse=True)
    deltas = np.diff(grams, prepend=grams[:0].dtype.type(0))
    return {"part": part, "m": len(grams), "d": len(used), "key": keys[used].tobytes(), "n": _pack(sizes[used].astype(np.uint32)),
            "gram": _pack(deltas), "doc": _pack(local.astype(np.uint32)), "df": None if df is None else _pack(df.astype(np.uint32))}


def _open(blocks: list[dict]):
    """The entries of many blocks: (keys, sizes) of distinct texts, n-grams, text numbers, dfs."""
    keys, sizes, grams, docs, dfs, base = [], [], [], [], [], 0
    for b in blocks:
        keys.append(np.frombuffer(b["key"], np.int64))
        sizes.append(_unpack(b["n"], b["d"], np.uint32))
        grams.append(np.cumsum(_unpack(b["gram"], b["m"], U), dtype=U))
        docs.append(_unpack(b["doc"], b["m"], np.uint32).astype(np.int64) + base)
        if b["df"] is not None:
            dfs.append(_unpack(b["df"], b["m"], np.uint32))
        base += b["d"]
    keys, sizes = np.concatenate(keys), np.concatenate(sizes).astype(np.int64)
    texts, place = np.unique(np.rec.fromarrays([keys, sizes]), return_inverse=True)
    return texts.f0, texts.f1, np.concatenate(grams), place[np.concatenate(docs)], np.concatenate(dfs) if dfs else None


def _spread(grams: np.ndarray, parts: int) -> np.ndarray:
    """The hash range that an n-gram falls in."""
    return ((grams >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _by_text(keys: np.ndarray, parts: int) -> np.ndarray:
    """The hash range that a text falls in."""
    return _spread(mix(keys.view(U)), parts)


def _dealt(part, keys, sizes, grams, docs, df=None) -> list[dict]:
    """Blocks of the entries, one for each number in `part`."""
    if not len(part):
        return []
    order = np.lexsort((grams, part))
    part, grams, docs, df = part[order], grams[order], docs[order], None if df is None else df[order]
    names, cuts = np.unique(part, return_index=True)
    return [_block(p, keys, sizes, grams[a:b], docs[a:b], None if df is None else df[a:b])
            for p, a, b in zip(names.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(part)])]


def _map_blocks(width: int, parts: int, held: int, heavy):
    """Tasks' (n-gram, text) entries in blocks, one for each hash range and `held` entries.

    heavy is a broadcast pair: sorted heavy n-grams and their counts.  Their entries have `df` already
    and go by the range of their text.
    """
    def flush(sets, sizes, keys):
        heavies, counts = heavy.value
        grams = np.concatenate(sets)
        docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(grams, kind="stable")
        grams, docs = grams[order], docs[order]
        cuts = np.searchsorted(_spread(grams, parts), np.arange(parts + 1))
        k, z = np.array(keys, np.int64), np.array(sizes)
        extra = []
        if len(heavies):
            i = np.minimum(np.searchsorted(heavies, grams), len(heavies) - 1)
            hot = heavies[i] == grams
            extra = _dealt(_by_text(k, parts)[docs[hot]], k, z, grams[hot], docs[hot], counts[i[hot]])
            grams, docs = grams[~hot], docs[~hot]
            cuts = np.searchsorted(_spread(grams, parts), np.arange(parts + 1))
        rows = extra + [_block(p, k, z, grams[a:b], docs[a:b]) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.RecordBatch.from_pylist(rows, schema=_BLOCK)

    def run(batches):
        sets, keys, known, total = [], [], set(), 0
        for batch in batches:
            for part in steps(batch):
                for s in _sets(part.column("text"), width):
                    if len(s) and (name := (_set_key(s), len(s))) not in known:
                        known.add(name)
                        sets.append(s)
                        keys.append(name[0])
                        total += len(s)
                if total >= held:
                    yield flush(sets, [len(s) for s in sets], keys)
                    sets, keys, known, total = [], [], set(), 0
        if sets:
            yield flush(sets, [len(s) for s in sets], keys)
    return run


def _regroup(parts: int, held: int, by_text: bool):
    """Blocks of coarse ranges in blocks of `parts` fine ones, `held` entries at a time."""
    def flush(rows):
        out = []
        for known in (False, True):
            some = [r for r in rows if (r["df"] is not None) == known]
            if some:
                keys, sizes, grams, docs, df = _open(some)
                out += _dealt(_by_text(keys, parts)[docs] if by_text or known else _spread(grams, parts), keys, sizes, grams, docs, df)
        return pa.RecordBatch.from_pylist(out, schema=_BLOCK)

    def run(batches):
        rows, total = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                total += row["m"]
                if total >= held:
                    yield flush(rows)
                    rows, total = [], 0
        if rows:
            yield flush(rows)
    return run


def _shared(parts: int):
    """Of a hash range: the n-grams that two or more texts have, in blocks by text; heavy ones pass."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out, light = [r for r in rows if r["df"] is not None], [r for r in rows if r["df"] is None]
        if light:
            keys, sizes, grams, docs, _ = _open(light)
            order = np.lexsort((docs, grams))
            grams, docs = grams[order], docs[order]
            first = np.ones(len(grams), bool)
            first[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
            grams, docs = grams[first], docs[first]
            begin = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            df = np.repeat(np.diff(np.append(begin, len(grams))), np.diff(np.append(begin, len(grams))))
            keep = df > 1
            grams, docs, df = grams[keep], docs[keep], df[keep]
            out += _dealt(_by_text(keys, parts)[docs], keys, sizes, grams, docs, df)
        for r in out:
            r["part"] = int(_by_text(np.frombuffer(r["key"], np.int64)[:1], parts)[0])
        return pa.Table.from_pylist(out, schema=_BLOCK)
    return run


def _ordered(percent: int):
    """Of a range of texts: those whose prefix has an n-gram of another text, rare n-grams first."""
    def run(table: pa.Table) -> pa.Table:
        keys, sizes, grams, docs, df = _open(table.to_pylist())
        order = np.lexsort((grams, df, docs))
        grams, docs, df = grams[order], docs[order], df[order]
        # a heavy n-gram of a text comes from every task that has the text
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
        grams, docs, df = grams[first], docs[first], df[first]
        cuts = np.searchsorted(docs, np.arange(len(keys) + 1))
        out = {"key": [], "n": [], "prefix": [], "grams": [], "dfs": []}
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            n = int(sizes[i])
            prefix = n - -(-percent * n // 100) + 1 - (n - (b - a))
            if prefix > 0 and b > a:
                for name, x in (("key", int(keys[i])), ("n", n), ("prefix", min(prefix, b - a)), ("grams", grams[a:b].view(np.int64)), ("dfs", df[a:b].astype(np.int32))):
                    out[name].append(x)
        return pa.table([pa.array(out["key"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["prefix"], pa.int32()),
                         pa.array(out["grams"], pa.list_(pa.int64())), pa.array(out["dfs"], pa.list_(pa.int32()))], names=list(out))
    return run


# ---------------------------------------------------------------- the trie

class _Node:
    """A run of n-gram ranks that all sets below share, then children by their first rank."""

    __slots__ = ("run", "kids", "ends", "small", "large", "left", "one")

    def __init__(self, run, member, size):
        self.run, self.kids, self.ends = run, {}, [member]
        self.small = self.large = size
        self.left, self.one = len(run), member

    def cut(self, at: int) -> None:
        """Split the run: what follows `at` becomes a child."""
        low = _Node.__new__(_Node)
        low.run, low.kids, low.ends = self.run[at:], self.kids, self.ends
        low.small, low.large, low.left, low.one = self.small, self.large, self.left - at, self.one
        self.run, self.kids, self.ends = self.run[:at], {int(low.run[0]): low}, []


class Classes:
    """Union-find over row numbers; a class is named by its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Trie:
    """Ordered sets; `probe` links a set with every class of stored sets that it is similar to."""

    def __init__(self, sizes, percent: int, classes: Classes):
        self.roots: dict[int, _Node] = {}
        self.sizes, self.percent, self.classes = sizes, percent, classes

    def insert(self, member: int, run: np.ndarray) -> None:
        size, kids, node = self.sizes[member], self.roots, None
        while True:
            below = kids.get(int(run[0]))
            if below is None:
                kids[int(run[0])] = _Node(run, member, size)
                return
            node = below
            m = min(len(run), len(node.run))
            same = node.run[:m] == run[:m]
            m = m if same.all() else int(np.argmin(same))
            if m < len(node.run):
                node.cut(m)
            node.small, node.large, node.left = min(node.small, size), max(node.large, size), max(node.left, len(run))
            if node.one >= 0 and self.classes.find(node.one) != self.classes.find(member):
                node.one = -1
            run, kids = run[m:], node.kids
            if not len(run):
                node.ends.append(member)
                return

    def _enough(self, overlap: int, a: int, b: int) -> bool:
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def probe(self, member: int, run: np.ndarray) -> None:
        size, find = self.sizes[member], self.classes.find
        stack = [(k, 0, 0) for k in self.roots.values()]
        while stack:
            node, have, at = stack.pop()
            if node.one >= 0 and find(node.one) == find(member):
                continue
            if 100 * node.large < self.percent * size or self.percent * node.small > 100 * size:
                continue
            if not self._enough(have + min(len(run) - at, node.left), size, max(node.small, -(-self.percent * size // 100))):
                continue
            place = np.searchsorted(run[at:], node.run)
            inside = place < len(run) - at
            have += int((run[at:][place[inside]] == node.run[inside]).sum())
            at += int(np.searchsorted(run[at:], node.run[-1], "right"))
            for other in node.ends:
                if self._enough(have, size, self.sizes[other]):
                    self.classes.join(member, other)
            stack += [(k, have, at) for k in node.kids.values()]


def _ranked(table: pa.Table) -> list[np.ndarray]:
    """Each row's n-grams as ranks of the global order (rare first) among those of the table."""
    lists = table.column("grams").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    df = table.column("dfs").combine_chunks()
    df = pa.concat_arrays(df.chunks) if isinstance(df, pa.ChunkedArray) else df
    grams, dfs = lists.flatten().to_numpy(), df.flatten().to_numpy()
    known, first, place = np.unique(grams, return_index=True, return_inverse=True)
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known.view(U), dfs[first]))] = np.arange(len(known))
    return np.split(rank[place], np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _join_table(percent: int):
    """(doc, other): each stored or probing text of a block with its class's smallest member.

    Rows with `probe` are only compared with stored rows, and only those of other classes (`class`).
    """
    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        ids = table.column("doc").to_numpy()
        sizes, known, probe = (table.column(c).to_numpy() for c in ("n", "class", "probe"))
        runs, classes = _ranked(table), Classes(table.num_rows)
        first: dict[int, int] = {}
        for i in np.argsort(ids, kind="stable").tolist():
            j = first.setdefault(int(known[i]), i)
            classes.join(i, j)
        trie = Trie(sizes.tolist(), percent, classes)
        by_size = np.lexsort((ids, sizes))
        queries = bool(probe.any())
        for i in (by_size[~probe[by_size]]).tolist():
            if not queries:
                trie.probe(i, runs[i])
            trie.insert(i, runs[i])
        for i in (by_size[probe[by_size]]).tolist():
            trie.probe(i, runs[i])
        low: dict[int, int] = {}
        for i, d in enumerate(ids.tolist()):
            low[r] = min(low.get(r := classes.find(i), d), d)
        roots = np.array([low[classes.find(i)] for i in range(len(ids))], np.int64)
        return pa.table({"doc": pa.array(ids), "other": pa.array(roots)})
    return run


# ---------------------------------------------------------------- the join

def link_texts(texts: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """(doc, component) for the texts(doc, n, prefix, grams, dfs) that are linked with others."""
    entry = texts.select("doc", F.explode(F.expr("slice(grams, 1, prefix)")).alias("gram"))
    hub = entry.groupBy("gram").agg(F.min("doc").alias("hub"), F.count("*").alias("c")).where("c > 1")
    near = connected_components(entry.join(hub, "gram").select(F.col("doc").alias("src"), F.col("hub").alias("dst")))
    held = durable(texts.join(near, texts.doc == near.v).select("doc", "n", "grams", "dfs", F.col("component").alias("comp")))
    parts = held.groupBy("comp").agg(F.sum(F.size("grams")).alias("w")).select("comp", F.ceil(F.col("w") / block_tokens).cast("int").alias("blocks"))
    fixed = F.struct(F.col("doc").alias("class"), F.lit(False).alias("probe"))
    whole = held.join(parts, "comp").withColumn("block", F.expr("cast(pmod(xxhash64(doc), blocks) as int)"))
    ddl, join = "doc long, other long", _join_table(percent)
    inside = whole.select("comp", "block", "blocks", "doc", "n", "grams", "dfs", fixed.alias("x")).select("*", "x.*").drop("x")
    links = inside.groupBy("comp", "block").applyInArrow(join, ddl)
    if parts.where("blocks > 1").limit(1).count() == 0:
        return links.select(F.col("doc"), F.col("other").alias("component"))
    links = durable(links)
    wide = durable(whole.where("blocks > 1").join(links.select("doc", F.col("other").alias("root")), "doc"))
    hubs = wide.where("doc = root")
    many = hubs.groupBy("comp").agg(F.ceil(F.sum(F.size("grams")) / block_tokens).cast("int").alias("many"))
    among = (hubs.join(many, "comp").withColumn("block", F.expr("cast(pmod(xxhash64(doc, 1), many) as int)"))
             .select("comp", "block", "doc", "n", "grams", "dfs", F.col("doc").alias("class"), F.lit(False).alias("probe")))
    edges = links.union(durable(among.groupBy("comp", "block").applyInArrow(join, ddl))).toDF("src", "dst")
    now = connected_components(edges)
    known = durable(wide.join(now, wide.doc == now.v, "left").select(*[wide[c] for c in wide.columns], F.coalesce(now.component, wide.doc).alias("class")))
    main = known.groupBy("comp", "class").count().groupBy("comp").agg(F.max_by("class", F.struct("count", "class")).alias("main"))
    minor = known.join(main, "comp").where("class <> main")
    size = minor.groupBy("comp").agg(F.ceil(F.sum(F.size("grams")) / block_tokens).cast("int").alias("chunks"))
    fields = ["comp", "block", "chunk", "doc", "n", "grams", "dfs", "class", "probe"]
    stored = (known.join(size, "comp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .withColumn("probe", F.lit(False)).select(*fields))
    asked = (minor.join(size, "comp").withColumn("chunk", F.expr("cast(pmod(xxhash64(doc, 2), chunks) as int)"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("probe", F.lit(True)).select(*fields))
    across = durable(stored.union(asked).groupBy("comp", "block", "chunk").applyInArrow(join, ddl))
    done = connected_components(edges.union(across.toDF("src", "dst")))
    return done.select(F.col("v").alias("doc"), "component")


def classes(docs: DataFrame, width: int = 5, percent: int = 80, parts: int | None = None, held_entries: int = 2_000_000,
            block_tokens: int = 2_000_000, parts_at_once: int = 1024, heavy_entries: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_key, n, comp): a row per row; comp names the row's class."""
    spark = docs.sparkSession
    passed = durable(set_sizes(docs, width, held_entries))
    sizes = passed.where("gram is null").select("doc_id", "text_key", "n", "key")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / held_entries))
    # a task's blocks thin out as ranges grow in number: beyond parts_at_once, entries go in two hops
    coarse = parts if parts <= parts_at_once else math.ceil(math.sqrt(parts))
    parts = coarse * math.ceil(parts / coarse)
    many = heavy_entries or max(held_entries // 8, total // HEAVY)
    hot = passed.where("gram is not null").groupBy("gram").agg(F.sum("c").alias("c")).where(F.col("c") >= many).toArrow()
    grams, counts = hot.column("gram").to_numpy().view(U), hot.column("c").to_numpy()
    order = np.argsort(grams)
    heavy = spark.sparkContext.broadcast((grams[order], np.minimum(counts[order], (1 << 31) - 1)))

    def gathered(blocks: DataFrame, by_text: bool) -> DataFrame:
        if coarse < parts:
            blocks = blocks.repartition(coarse, "part").mapInArrow(_regroup(parts, held_entries, by_text), _BLOCK_DDL)
        return blocks.repartition(parts, "part").groupBy("part")
    plain = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = plain.mapInArrow(_map_blocks(width, coarse, held_entries, heavy), _BLOCK_DDL)
    shared = gathered(blocks, False).applyInArrow(_shared(coarse), _BLOCK_DDL)
    ordered = gathered(shared, True).applyInArrow(_ordered(percent), "key long, n long, prefix int, grams array<long>, dfs array<int>")
    linked = link_texts(durable(ordered.withColumnRenamed("key", "doc")), percent, block_tokens)
    return sizes.join(linked.withColumnRenamed("doc", "key"), "key", "left").select("doc_id", "text_key", "n", F.coalesce("component", "key").alias("comp"))


def ngram_components(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id), one row per row of docs."""
    rows = durable(classes(docs, **options))
    low = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("low"))
    return (rows.join(low, "comp", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id (null ids last), then text hash.

    Of rows that agree in both, the one with the smallest hash over all columns stays.  Rows without
    words all stay.  Columns stay as they are.
    """
    rows = durable(classes(docs, **options).where("n > 0"))
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = rows.groupBy("comp").agg(F.min(name).alias("best"))
    a, b, c = (free_name(docs, x) for x in ("gone_id", "gone_key", "gone_many"))
    each = (rows.join(best, "comp").groupBy(F.col("doc_id").alias(a), F.col("text_key").alias(b))
            .agg(F.count("*").alias(c), F.first(name.eqNullSafe(F.col("best"))).alias("stays")))
    marked = durable(each.where(f"not stays or {c} > 1"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(F.col("text").cast("string")) == F.col(b))
    left = docs.join(marked.select(a, b), same, "left_anti")
    twice = marked.where("stays").select(a, b)
    if not twice.limit(1).count():
        return left
    again = docs.join(twice, same).groupBy(a, b).agg(F.min_by(F.struct(*(docs[x] for x in docs.columns)), F.xxhash64(*(docs[x] for x in docs.columns))).alias(c))
    return left.unionByName(again.select(f"{c}.*"))

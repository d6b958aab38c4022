"""Language identification by interpolated Kneser-Ney character models.

A text is read as lowered letters; every run of other characters is one blank.  One model for each language
predicts a character from the ORDER - 1 before it.  Spark counts the character n-grams of all labelled texts;
absolute discounts come from the counts of counts, lower orders use continuation counts, and the last resort is uniform,
all of them figures of all n-grams.  The model has every n-gram that was counted.  Up to HELD of them in all are broadcast: for each order
one sorted array of n-gram hashes with a column of probabilities for each language, and one of
context hashes with back-off weights, so a single binary search serves all languages; each slice
of text looks up its distinct n-grams only.  More of them stay a table: texts are dealt into cells, a cell's distinct n-grams get
their probabilities by joins, order by order, and a cell's texts meet these in one task (`Spread`).  Both give the same probabilities.
A caller who wants a small model may set `bound`, the most n-grams of an order and language, by count; what the others' probability comes to is
left to the order below then, so that the probabilities after every context add up to 1.  The language with the lowest cross-entropy a character wins.

A tenth of the labelled texts, and one text at least of every language with two, calibrates rejection: a text whose cross-entropy exceeds its language's by more
standard errors than any calibration text (times `slack`), and by more a character than three times the spread between
calibration texts, is marked rejected; languages with few such texts take no narrower limits than others.  The predicted
language stays a learned value; `und` is for null texts and texts without a letter.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, free_name, learned_from, mix, steps, utf8

U = np.uint64
ORDER = 5
#: Calibration texts that settle limits.
SETTLED = 20
#: Least and largest discount.
DISCOUNT = (0.1, 0.95)
#: Most n-grams, of all orders and languages, of a model that is broadcast (about 100 MB), and text bytes of a cell where it is not.
HELD, CELL_BYTES = 1 << 21, 1 << 24
#: Text bytes of a slice here: a letter takes some hundred bytes while a slice is scored.
SLICE_BYTES = 1 << 18
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """code point -> lowered letter, or 32 for anything else."""
    if "low" not in _TABLES:
        low = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                t = s.lower()
                low[c] = ord(t) if len(t) == 1 else c
        _TABLES["low"] = low
    return _TABLES["low"]


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters with ORDER - 1 blanks before each text, positions to predict, their text number)."""
    texts = pc.fill_null(column, "").to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    low = _letters()[flat]
    keep = low != 32
    if len(low):
        keep[1:] |= (low[:-1] != 32) & (doc[1:] == doc[:-1])
    doc, low = doc[keep], low[keep]
    at = np.arange(len(low)) + (doc + 1) * (ORDER - 1)
    out = np.full(len(low) + len(texts) * (ORDER - 1), 32, np.uint32)
    out[at] = low
    return out, at, doc


def gram_hashes(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position."""
    h = np.full(len(at), n, U)
    for back in range(n - 1, -1, -1):
        h = h * U(0xD6E8FEB86659FD93) + chars[at - back].astype(U) + U(1)
    return mix(h)


def code_points(grams: list[str], n: int) -> np.ndarray:
    """The characters of n-grams, a row each."""
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)


def _map_grams(batches):
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            rows = batch.filter(pc.equal(batch.column("lang"), lang))
            for part in steps(rows):
                chars, at, _ = characters(part.column("text"))
                if not len(at):
                    continue
                _, first, count = np.unique(gram_hashes(chars, at, ORDER), return_index=True, return_counts=True)
                grams = np.stack([chars[at[first] - b] for b in range(ORDER - 1, -1, -1)], 1)
                text = np.ascontiguousarray(grams).tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), pa.array([text[i:i + ORDER] for i in range(0, len(text), ORDER)]), pa.array(count, pa.int64())], names=["lang", "gram", "c"])


def discount(once, twice):
    """The absolute discount of n-grams of which so many occur once and twice."""
    return np.clip(once / np.maximum(once + 2 * twice, 1), *DISCOUNT)


class Model:
    """Kneser-Ney models of several languages in sorted hash arrays."""

    def __init__(self, langs: list[str], grams: list[str], which: np.ndarray, counts: np.ndarray):
        """From the ORDER-grams of each language and their counts; nothing is left out."""
        self.langs, self.probs, self.backs = langs, [], []
        flat = code_points(grams, ORDER)
        self.base = 1.0 / max(len(np.unique(flat)) + 1, 2)
        for n in range(ORDER, 0, -1):
            # flat/which/counts: the n-gram types of each language with (continuation) counts
            off = np.array([discount((counts[which == k] == 1).sum(), (counts[which == k] == 2).sum()) for k in range(len(langs))])
            context = gram_hashes(flat.ravel(), np.arange(len(flat)) * n + n - 2, n - 1) if n > 1 and len(flat) else np.zeros(len(flat), U)
            ck, ci = np.unique(context, return_inverse=True)
            total = np.zeros((len(ck), len(langs)))
            np.add.at(total, (ci, which), counts)
            self.add(n, flat, which, (counts - off[which]) / total[ci, which])
            if n > 1:  # types of the next lower order, counted by the characters before them
                lower = np.ascontiguousarray(flat[:, 1:])
                key = gram_hashes(lower.ravel(), np.arange(len(lower)) * (n - 1) + n - 2, n - 1) ^ mix(which.astype(U) + U(1)) if len(lower) else np.empty(0, U)
                _, first, counts = np.unique(key, return_index=True, return_counts=True)
                flat, which, counts = lower[first], which[first], counts.astype(float)

    @classmethod
    def of(cls, langs: list[str], characters: int, weights: pa.Table) -> Model:
        """From weights(n, lang, gram, p), the stored n-grams of all orders, and the number of different characters."""
        model, order = cls([], [], np.empty(0, np.int64), np.empty(0)), pa.array(langs, pa.string())
        model.langs, model.base, model.probs, model.backs = langs, 1.0 / max(characters + 1, 2), [], []
        for n in range(ORDER, 0, -1):
            t = weights.filter(pc.equal(weights.column("n"), n))
            letters = np.frombuffer(utf8(t.column("gram").combine_chunks())[0].tobytes().decode().encode("utf-32-le"), np.uint32).reshape(-1, n)
            model.add(n, letters, pc.index_in(t.column("lang").combine_chunks(), order).to_numpy(zero_copy_only=False), t.column("p").to_numpy())
        return model

    def add(self, n: int, flat: np.ndarray, which: np.ndarray, p: np.ndarray) -> None:
        """The next order: its n-grams, their languages and discounted probabilities; a context's back-off weight is what they leave."""
        ends = np.arange(len(flat)) * n + n - 1
        gram = gram_hashes(flat.ravel(), ends, n) if len(flat) else np.empty(0, U)
        context = gram_hashes(flat.ravel(), ends - 1, n - 1) if n > 1 and len(flat) else np.zeros(len(flat), U)
        for keys, table in ((gram, self.probs), (context, self.backs)):
            known, at = np.unique(keys, return_inverse=True)
            sums = np.zeros((len(known), len(self.langs)))
            np.add.at(sums, (at, which), p)
            table.append((known, sums if table is self.probs else np.maximum(1.0 - sums, 0.0)))

    def log_probs(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of each language's probability of the character at each position."""
        p = np.full((len(at), len(self.langs)), self.base)
        for n in range(1, ORDER + 1):
            (gk, gp), (ck, cb) = self.probs[ORDER - n], self.backs[ORDER - n]
            if not len(gk):
                continue
            context = gram_hashes(chars, at - 1, n - 1) if n > 1 else np.zeros(len(at), U)
            j = np.minimum(np.searchsorted(ck, context), len(ck) - 1)
            known = ck[j] == context
            p *= np.where(known[:, None], cb[j], 1.0)
            gram = gram_hashes(chars, at, n)
            i = np.minimum(np.searchsorted(gk, gram), len(gk) - 1)
            p += np.where((gk[i] == gram)[:, None], gp[i], 0.0)
        return np.log(p)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean log probability by language, characters, letters) of each text."""
        chars, at, doc = characters(column)
        rows = len(column)
        n = np.bincount(doc, minlength=rows)
        letters = np.bincount(doc[chars[at] != 32], minlength=rows)
        _, first, place = np.unique(gram_hashes(chars, at, ORDER), return_index=True, return_inverse=True)
        logs = self.log_probs(chars, at[first])
        mean = np.stack([np.bincount(doc, logs[place, k], rows) for k in range(len(self.langs))], 1) if len(self.langs) else np.zeros((rows, 0))
        return mean / np.maximum(n, 1)[:, None], n, letters


class Looked(Model):
    """The probabilities of known ORDER-grams alone: (gram, logs), logs by language."""

    def __init__(self, langs: list[str], known: pa.Table):
        self.langs = langs
        flat = code_points(known.column("gram").to_pylist(), ORDER)
        keys = gram_hashes(flat.ravel(), np.arange(len(flat)) * ORDER + ORDER - 1, ORDER)
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], known.column("logs").combine_chunks().flatten().to_numpy().reshape(-1, len(langs))[order]

    def log_probs(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.logs[np.searchsorted(self.keys, gram_hashes(chars, at, ORDER))]


def _map_asked(cell: str):
    """(cell, gram): the ORDER-grams of each cell's texts in a slice."""
    def run(batches):
        for batch in batches:
            for part in steps(batch):
                chars, at, doc = characters(part.column("text"))
                if not len(at):
                    continue
                cells = part.column(cell).to_numpy()[doc]
                _, first = np.unique(gram_hashes(chars, at, ORDER) ^ mix(cells.astype(U) + U(1)), return_index=True)
                grams = np.stack([chars[at[first] - b] for b in range(ORDER - 1, -1, -1)], 1)
                text = np.ascontiguousarray(grams).tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays([pa.array(cells[first], pa.int32()), pa.array([text[i:i + ORDER] for i in range(0, len(text), ORDER)])], names=["cell", "gram"])
    return run


class Spread:
    """Kneser-Ney models of more n-grams than one broadcast may have: weights(n, lang, gram, p) stay a table."""

    def __init__(self, langs: list[str], characters: int, weights: DataFrame, level: dict | None = None):
        self.langs, self.characters, self.weights, self.level = langs, characters, weights, level

    def logs(self, grams: DataFrame) -> DataFrame:
        """grams(gram), different ORDER-grams -> (gram, logs): natural log of each language's probability of its last character."""
        sums = F.array(*[F.sum(F.when(F.col("lang") == x, F.col("p")).otherwise(0.0)) for x in self.langs])
        none = F.array_repeat(F.lit(0.0), len(self.langs))
        lower = None
        for n in range(1, ORDER + 1):
            own, context = self.weights.where(F.col("n") == n), F.substring("gram", 1, n - 1).alias("context")
            asked = grams.select(F.substring("gram", ORDER - n + 1, n).alias("gram")).distinct().select("gram", context, F.substring("gram", 2, n - 1).alias("end"))
            asked = asked.join(own.groupBy("gram").agg(sums.alias("own")), "gram", "left").join(own.groupBy(context).agg(sums.alias("taken")), "context", "left")
            asked = asked.join(lower, "end") if n > 1 else asked.withColumn("low", F.array_repeat(F.lit(1.0 / max(self.characters + 1, 2)), len(self.langs)))
            left = F.zip_with(F.coalesce("taken", none), "low", lambda t, low: F.greatest(1 - t, F.lit(0.0)) * low)
            p = F.zip_with(left, F.coalesce("own", none), lambda x, y: x + y)
            # each order is a table of its own, so the next one's joins begin from rows
            lower = durable(asked.select(F.col("gram").alias("end"), p.alias("low")))
        return lower.select(F.col("end").alias("gram"), F.transform("low", lambda x: F.log(x)).alias("logs"))

    def apply(self, docs: DataFrame, emit: Callable, schema) -> DataFrame:
        """emit(model, level, part) over slices of docs, dealt into cells of about CELL_BYTES of text."""
        cell, langs, level = free_name(docs, "cell"), self.langs, self.level
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        cells = 1 + size // CELL_BYTES
        lot = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if kind in ("bigint", "int", "string")])
        dealt = docs.withColumn(cell, F.pmod(lot, F.lit(cells)).cast("int")).repartition(cells, cell)
        asked = durable(dealt.mapInArrow(_map_asked(cell), "cell int, gram string").distinct())
        known = asked.join(self.logs(asked.select("gram").distinct()), "gram")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            model = Looked(langs, right)
            return pa.Table.from_batches([emit(model, level, part) for batch in left.drop_columns([cell]).to_batches() for part in steps(batch, limit=SLICE_BYTES)])
        return dealt.groupBy(cell).cogroup(known.groupBy("cell")).applyInArrow(run, schema)


def _share(spark: SparkSession, model: Model | Spread, level: dict):
    """The model and its limits for `_apply`: broadcast, or the table that texts are joined with."""
    if isinstance(model, Spread):
        return Spread(model.langs, model.characters, model.weights, level)
    return spark.sparkContext.broadcast((model, level))


def _apply(docs: DataFrame, shared, emit: Callable, schema) -> DataFrame:
    """emit(model, level, part) -> record batch, over all slices of docs."""
    if isinstance(shared, Spread):
        return shared.apply(docs, emit, schema)

    def run(batches):
        model, level = shared.value
        for batch in batches:
            for part in steps(batch, limit=SLICE_BYTES):
                out = emit(model, level, part)
                if out.num_rows:
                    yield out
    return docs.mapInArrow(run, schema)


def _scores(model: Model, level: dict, part: pa.RecordBatch) -> pa.RecordBatch:
    """The columns of part but its text, and lang_pred, score, cross_entropy, rejected."""
    mean, n, letters = model.score(part.column("text"))
    names = np.array([*model.langs, "und"], object)
    if len(model.langs):
        best = np.where(letters > 0, mean.argmax(1), len(model.langs))
        top = mean.max(1)
        share = 1 / np.exp(20 * (mean - top[:, None])).sum(1)
        own = np.array([level[x] for x in model.langs])[np.minimum(best, len(model.langs) - 1)]
        odd = (-top - own[:, 0]) * np.sqrt(np.maximum(n, 1)) > own[:, 1]
        odd &= -top - own[:, 0] > own[:, 2]
    else:
        best, share, odd, top = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.zeros(part.num_rows, bool), np.zeros(part.num_rows)
    und = letters == 0
    return pa.RecordBatch.from_arrays([*part.drop_columns(["text"]).columns, pa.array(names[best].tolist(), pa.string()), pa.array(np.where(und, 0.0, share)),
                                       pa.array(np.where(und, 0.0, -top)), pa.array(und | odd)],
                                      names=[*(c for c in part.schema.names if c != "text"), "lang_pred", "score", "cross_entropy", "rejected"])


def _weights(types: DataFrame, bound: int | None) -> tuple[list[str], int, DataFrame, int]:
    """types(lang, gram, c) of ORDER-grams -> (languages, different characters, (n, lang, gram, p) of the stored n-grams, their number).

    A level is a sixteenth of a doubling of the count: 0 holds the counts of 1, and 16 those of 2.  Levels and
    discounts are some rows a language.  Every n-gram is stored, unless a caller sets `bound`.
    """
    spark, stored, langs, characters, size = types.sparkSession, None, [], 0, 0
    for n in range(ORDER, 0, -1):
        types = durable(types)
        levels: dict[str, dict[int, int]] = {}
        level = F.floor(F.log2("c") * 16).cast("int")
        for r in types.groupBy("lang", level.alias("level")).agg(F.count("*").alias("many")).collect():
            levels.setdefault(r.lang, {})[r.level] = r.many
        rules = []
        for lang, many in levels.items():
            least, have = max(many) + 1, 0
            for k in sorted(many, reverse=True):
                if bound is not None and have + many[k] > bound:
                    break
                least, have = k, have + many[k]
            size += have
            rules.append((lang, float(discount(many.get(0, 0), many.get(16, 0))), least))
        # a row for each learned language
        known = F.broadcast(spark.createDataFrame(rules, "lang string, off double, least int"))
        context = Window.partitionBy("lang", F.substring("gram", 1, n - 1))
        weighed = types.withColumn("total", F.sum("c").over(context)).join(known, "lang").where(level >= F.col("least"))
        weighed = weighed.select(F.lit(n).alias("n"), "lang", "gram", ((F.col("c") - F.col("off")) / F.col("total")).alias("p"))
        stored = weighed if stored is None else stored.union(weighed)
        langs = sorted(levels)
        if n > 1:
            types = types.groupBy("lang", F.substring("gram", 2, n - 1).alias("gram")).agg(F.count("*").alias("c"))
        else:
            # a blank stands before every text, whether one is predicted or not
            characters = types.where("gram <> ' '").agg(F.countDistinct("gram")).first()[0] + bool(langs)
    return langs, characters, stored, size


def train(labelled: DataFrame, slack: float = 2.5, bound: int | None = None):
    """labelled(doc_id, text, lang) -> (model, {lang: (mean cross-entropy, limit, least excess a character)})."""
    turn = F.xxhash64("doc_id", "text", F.lit("fold"))
    heads = labelled.groupBy("lang").agg(F.when(F.min(turn) < F.max(turn), F.min(turn)).alias("head"), F.max(turn).alias("last"))
    # a row for each learned language
    labelled = labelled.join(F.broadcast(heads), "lang").withColumn("turn", turn)
    fold = F.coalesce(F.col("turn") == F.col("head"), F.lit(False)) | (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10)) == 0) & (F.col("turn") != F.col("last"))
    counted = labelled.where(~fold).select("lang", "text").mapInArrow(_map_grams, "lang string, gram string, c long")
    langs, characters, weights, size = _weights(counted.groupBy("lang", "gram").agg(F.sum("c").alias("c")), bound)
    model = Model.of(langs, characters, weights.toArrow()) if size <= HELD else Spread(langs, characters, durable(weights))
    level = {x: (0.0, np.inf, 0.0) for x in langs}
    if langs:
        shared = _share(labelled.sparkSession, model, level)
        kept = _apply(labelled.where(fold).select("lang", "text", F.length("text").alias("n")), shared, _scores, "lang string, n int, lang_pred string, score double, cross_entropy double, rejected boolean")
        held = durable(kept.where("lang = lang_pred and n > 0").select("lang", "n", "cross_entropy"))
        means = held.groupBy("lang").agg((F.sum(F.col("cross_entropy") * F.col("n")) / F.sum("n")).alias("mean"))
        away = F.col("cross_entropy") - F.col("mean")
        # a row for each learned language, both times
        figures = held.join(F.broadcast(means), "lang").groupBy("lang").agg(
            F.first("mean").alias("mean"), F.sqrt(F.sum(away * away * F.col("n")) / F.sum("n")).alias("spread"), F.max(away * F.sqrt("n")).alias("most"), F.count("*").alias("many")).collect()
        if isinstance(shared, Broadcast):  # the limits are known, so the executors need not keep a second model
            shared.unpersist()
        many = {r.lang: r.many for r in figures}
        for r in figures:
            level[r.lang] = (r["mean"], slack * max(1.0, r.most), 3 * r.spread)
        # where no language is settled, the one with the most texts sets the least limit, and none from under three
        enough = min(SETTLED, max(3, *many.values(), 0)) if many else SETTLED
        widest = [max((level[x][k] for x in many if many[x] >= enough), default=(np.inf, 0.0)[k - 1]) for k in (1, 2)]
        for x in many:
            if many[x] < SETTLED:
                level[x] = (level[x][0], max(level[x][1], widest[0]), max(level[x][2], widest[1]))
    return model, level


def _fit(docs: DataFrame, learn: F.Column, bound: int | None):
    """Shared model from all texts of docs(doc_id, text, lang) that may be learned from."""
    known = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    return _share(docs.sparkSession, *train(known, bound=bound))


def languages(docs: DataFrame, modulus: int = 3, held_out: int = 1, bound: int | None = None) -> DataFrame:
    """docs(doc_id, text, lang) -> (doc_id, held_out, lang_pred, score, cross_entropy, rejected), a row per row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shared = _fit(plain, learned_from("doc_id", modulus, held_out), bound)
    scored = _apply(plain.select("doc_id", "text"), shared, _scores, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
    return scored.select("doc_id", (~learned_from("doc_id", modulus, held_out) & F.col("doc_id").isNotNull()).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def _kept(model: Model, level: dict, part: pa.RecordBatch) -> pa.RecordBatch:
    return part.filter(pc.invert(_scores(model, level, part.select(["text"])).column("rejected")))


def keep_known(docs: DataFrame, bound: int | None = None) -> DataFrame:
    """The rows of docs whose text some learned language explains, with all their columns: one pass."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shared = _fit(plain, F.lit(True), bound)
    return _apply(docs, shared, _kept, docs.schema)

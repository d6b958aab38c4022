"""Secret scan: candidate strings, then a random forest that removes false positives.

Candidates are runs of 16 or more characters that credentials are written in, values of any characters
from four on that a credential word, an assignment and quotes point at, and whole private-key blocks.
The forest (Spark ML) looks at what a candidate is: its length, make-up and character transitions, how well words
of the language cover it, its path, and the words around it.  It is trained from labelled findings.  Where
no curated ones exist they come from what the forest does not see (CUES): whether a credential word points at the string, whether an
issuer's fixed format matches, or whether it is a UUID, a named digest or a data URI.  Such labels
are noisy (a placeholder is pointed at as well), and the forest, which knows only the string and its surroundings, corrects
them: a pointed-at string must also look like the ones that are usually pointed at.

Every whole text is scanned.  The lexicon comes from the word counts of all documents, and the forest is fitted on all
labelled candidates, dealt over tasks of about `bound` rows each; nothing is drawn from either.  (Spark ML proposes split points
itself, from the quantiles of some 10,000 rows; which of them a tree takes, and its shares, come from all rows, each tree's drawn
with replacement as in any random forest.)  Of the word counts the WORDS most frequent ones are kept, the size of the lexicon.
The fitted trees go to the tasks as arrays, so scoring and redacting shuffle nothing.

Cases: null and empty texts have no candidates; rows that repeat give repeated findings; null paths count
as empty.  Features of very long candidates take time in proportion to their length.  A score equal to the cut is a secret.
Where fewer than FEW candidates have one of the labels, no forest is fitted and the plain rule (pointed at, with a digit,
not made of words; or an issuer's format) decides.  An empty table gives no rows.  `findings` leaves other columns out, `redact` keeps
them all, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder, durable, free_name, steps

RUN = re.compile(r"[A-Za-z0-9_+/=\-][A-Za-z0-9_+/=\-.~!]{14,}[A-Za-z0-9_+/=\-]")
KEYS = re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:(?!-----)[\s\S]){1,20000}-----END [A-Z ]{0,24}PRIVATE KEY-----")
KEYWORD = re.compile(r"(?i)token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private")
ASSIGNED = re.compile(r"(?:=>|[=:])\s*[\"'`]?$")
POINTER = re.compile(r"[\w.\-]*[\"'`]?\s*(?:=>|[=:])?\s*[\"'`]?$")
#: What may precede a value: an assignment or a quote, and before that a credential word.
MARK = re.compile(r"=>|[=:\"'`]")
NAMED = re.compile(r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|auth(?!or)|bearer|credential|private)[\w.\-]{0,8}[\"'`]?\s{0,2}$")
QUOTED = re.compile(r"([\"'`])((?:(?!\1)[^\r\n]){4,256})\1")
BARE = re.compile(r"(?=[^\s\"'`,;]*\d)[^\s\"'`,;]{4,}")
GAP = re.compile(r"\s{0,2}")
MIXED = re.compile(r"(?=\S*\d)(?=\S*[^\W\d_])\S{8,}$")
#: Public formats of issued credentials.
ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36,}$|xox[abprs]-[A-Za-z0-9-]{10,}$|AIza[A-Za-z0-9_-]{35}$|[sr]k_live_[A-Za-z0-9]{16,}$"
                    r"|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$|-----BEGIN ")
#: Strings that look random and are no secrets.
BENIGN = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
NAMED_BENIGN = re.compile(r"(?i)(?:sha-?\d*|md5|digest|checksum|commit|integrity|revision|uuid|base64,)[\"'`\s:=\-]{0,4}$")


class Found:
    """A candidate's place in its text, read like a match."""

    def __init__(self, text: str, a: int, b: int):
        self.text, self.a, self.b = text, a, b

    def __getitem__(self, _: int) -> str:
        return self.text[self.a:self.b]

    def start(self) -> int:
        return self.a

    def span(self) -> tuple[int, int]:
        return self.a, self.b


class Candidates:
    """Values that a credential word or an assignment points at, and long runs outside them, in order."""

    def pointed(self, text: str) -> list[tuple[int, int]]:
        out, end = [], 0
        for m in MARK.finditer(text):
            if m.start() < end:
                continue
            quote = m[0] in "\"'`"
            named = NAMED.search(text[max(0, m.start() - 28):m.start()])
            if quote and not named:
                continue
            at = m.start() if quote else GAP.match(text, m.end()).end()
            v = QUOTED.match(text, at)
            if v and (named or MIXED.match(v[2])):
                out.append(v.span(2))
            elif named and not quote and (v := BARE.match(text, at)):
                out.append(v.span())
            else:
                continue
            end = out[-1][1] + 1
        return out

    def finditer(self, text: str):
        known, spans = self.pointed(text), []
        for m in RUN.finditer(text):
            a, b = m.span()
            for c, d in known:
                if d <= a or c >= b:
                    continue
                spans.append((a, c))
                a = max(a, d)
            spans.append((a, b))
        blocks = [m.span() for m in KEYS.finditer(text)] if "-----BEGIN " in text else []
        loose = [(a, b) for a, b in [*known, *((a, b) for a, b in spans if b - a >= 16)] if not any(c < b and a < d for c, d in blocks)]
        for a, b in sorted([*blocks, *loose]):
            yield Found(text, a, b)


CANDIDATE = Candidates()
#: Characters of context on either side.
AROUND = 48
FEATURES = ("length", "digits", "upper", "lower", "marks", "hex", "entropy", "changes", "letter_run", "surprise", "coverage",
            "path_depth", "path_test", "path_suffix", "left_letters", "right_letters", "left_known", "right_known")
#: What labels are made of; the forest does not see these.
CUES = ("named", "assigned", "quoted", "issued", "benign")
#: Candidates of each label without which no forest is fitted.
FEW = 30
#: Words of the lexicon: the most frequent ones of all documents.
WORDS = 5000
_KIND = np.full(129, 3)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128] = 0, 1, 2, 2
_HEX = np.zeros(129, bool)
_HEX[[*range(48, 58), *range(65, 71), *range(97, 103)]] = True
_LETTER = np.zeros(129, np.int64)
_LETTER[65:91] = _LETTER[97:123] = np.arange(1, 27)


class Lexicon:
    """Frequent words of the texts and their letter transitions."""

    def __init__(self, words: dict[str, int]):
        self.words, self.search = set(words), ahocorasick.Automaton()
        pairs = np.full((27, 27), 0.5)
        for w, c in words.items():
            self.search.add_word(w, len(w))
            ids = [ord(x) - 96 if "a" <= x <= "z" else 0 for x in f" {w} "]
            for a, b in zip(ids, ids[1:]):
                pairs[a, b] += c
        self.search.make_automaton()
        self.cost = -np.log(pairs / pairs.sum(1, keepdims=True))

    def coverage(self, s: str) -> float:
        """Largest share of the characters of s that words of three letters or more can cover."""
        ends, best = [0], [0]
        for end, n in self.search.iter(s.lower()) if self.words else ():
            have = best[bisect_right(ends, end + 1 - n) - 1] + n
            if have > best[-1]:
                if ends[-1] == end + 1:
                    best[-1] = have
                else:
                    ends.append(end + 1)
                    best.append(have)
        return best[-1] / len(s)

    def known(self, words: list[str]) -> float:
        return sum(w.lower() in self.words for w in words) / len(words) if words else 0.0


def describe(s: str, left: str, right: str, path: str, lexicon: Lexicon) -> list[float]:
    """The features and cues of a candidate, in the order of FEATURES and CUES."""
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, low = len(codes), np.minimum(codes, 128)
    kinds, ids = _KIND[low], _LETTER[low]
    counts = np.bincount(kinds, minlength=4) / n
    share = np.unique(codes, return_counts=True)[1] / n
    gaps = np.flatnonzero(np.concatenate(([True], ids == 0, [True])))
    # the words around leave out the name and the marks that point at the string: those are cues
    near_left, near_right = re.findall(r"[^\W\d_]+", POINTER.sub("", left)[-24:]), re.findall(r"[^\W\d_]+", right.lstrip("\"'`, ;")[:24])
    return [float(x) for x in (
        n, *counts, _HEX[low].mean(), -(share * np.log2(share)).sum(), (kinds[1:] != kinds[:-1]).sum() / n, (np.diff(gaps).max() - 1) / n,
        lexicon.cost[ids[:-1], ids[1:]].mean() if n > 1 else 0.0, lexicon.coverage(s),
        path.count("/"), bool(re.search(r"(?i)test|example|sample|mock", path)), bool(re.search(r"\.\w{1,5}$", path)),
        sum(map(len, near_left)) / 24, sum(map(len, near_right)) / 24, lexicon.known(near_left), lexicon.known(near_right),
        bool(KEYWORD.search(left[-24:])), bool(ASSIGNED.search(left)), left[-1:] in "\"'`" and left != "" and right[:1] == left[-1:],
        bool(ISSUED.match(s)), bool(BENIGN.match(s) or NAMED_BENIGN.search(left[-24:])))]


class Trees:
    """A fitted forest as arrays: the mean of its trees' shares of label 1."""

    def __init__(self, nodes: list):
        many = max(r.id for _, r in nodes) + 1
        shape = (max(t for t, _ in nodes) + 1, many)
        self.feature, self.at = np.zeros(shape, np.int64), np.full(shape, np.inf)
        self.left, self.right, self.share = np.tile(np.arange(many), (shape[0], 1)), np.tile(np.arange(many), (shape[0], 1)), np.zeros(shape)
        for t, r in nodes:
            self.share[t, r.id] = r.impurityStats[1] / max(sum(r.impurityStats), 1e-300)
            if r.leftChild >= 0:
                self.feature[t, r.id], self.at[t, r.id] = r.split.featureIndex, r.split.leftCategoriesOrThreshold[0]
                self.left[t, r.id], self.right[t, r.id] = r.leftChild, r.rightChild

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.share)):
            node = np.zeros(len(x), np.int64)
            while True:
                new = np.where(x[rows, self.feature[t, node]] <= self.at[t, node], self.left[t, node], self.right[t, node])
                if (new == node).all():
                    break
                node = new
            total += self.share[t, node]
        return total / len(self.share)


def _plainly(cues: dict, x: dict):
    """The rule without a forest; cues and features as columns or arrays of numbers."""
    named = (cues["named"] == 1) & (cues["assigned"] == 1) & (cues["benign"] == 0)
    return (cues["issued"] == 1) | (named & (x["digits"] > 0) & (x["entropy"] > 2.2) & (x["coverage"] < 0.8))


def decide(values: np.ndarray, trees: Trees | None, cut: float = 0.5, far: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(score, is_secret) of candidates with FEATURES and CUES.

    A pointed-at string is a secret from `cut` on, one that a credential word is merely near from
    `far` on, and one in an issuer's format always.
    """
    x, cues = dict(zip(FEATURES, values.T)), dict(zip(CUES, values.T[len(FEATURES):]))
    plain = _plainly(cues, x)
    if trees is None:
        return plain.astype(float), plain
    score = np.maximum(trees.score(values), cues["issued"])
    pointed = (cues["named"] == 1) & (cues["assigned"] == 1) & ((x["digits"] > 0) | (cues["quoted"] == 1))
    hit = (cues["benign"] == 0) & np.where(pointed, score >= cut, (cues["named"] == 1) & (score >= far))
    return score, hit | (cues["issued"] == 1)


_SPOT = "doc_id long, text_key long, start int, length int, sha256 string"


def _described(text: str, path: str, lexicon: Lexicon):
    """(start, end, features and cues) of each candidate of a text."""
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        yield a, b, describe(m[0], text[max(0, a - AROUND):a], text[b:b + AROUND], path, lexicon)


def _map_candidates(shared):
    import hashlib

    def run(batches):
        lexicon = shared.value
        for batch in batches:
            for part in steps(batch):
                out = []
                for i, key, path, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_key", "path", "text"))):
                    for a, b, f in _described(text or "", path or "", lexicon):
                        out.append((i, key, a, b - a, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest(), f))
                cols = list(zip(*out)) or [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["doc_id", "text_key", "start", "length", "sha256", "features"])
    return run


def _map_scores(trees):
    def run(batches):
        for batch in batches:
            lists = batch.column("features")
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES) + len(CUES))
            score, hit = decide(values, trees.value)
            rest = batch.drop_columns(["features"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score), pa.array(hit)], names=[*rest.schema.names, "score", "is_secret"])
    return run


def _map_words(batches):
    for batch in batches:
        for part in steps(batch):
            text = pc.utf8_lower(pc.fill_null(part.column("text"), "")).to_pylist()
            words = Counter(w for t in text for w in re.findall(r"[a-z]{3,12}", t))
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "c"])


def _path(docs: DataFrame) -> F.Column:
    return next((F.col(c).cast("string") for c in ("path", "source") if c in docs.columns), F.lit(""))


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _path(docs).alias("path"), F.xxhash64(text).alias("text_key"))


def silver(candidates: DataFrame) -> DataFrame:
    """candidates with `label`: 1 where CUES speak for a secret, 0 where none does, null where they disagree."""
    c = {n: F.col("features")[len(FEATURES) + i] for i, n in enumerate(CUES)}
    digits = F.col("features")[FEATURES.index("digits")]
    pointed = (c["named"] == 1) & (c["assigned"] == 1) & ((c["quoted"] == 1) | (digits > 0))
    for_it = (c["issued"] == 1) | (pointed & (c["benign"] == 0))
    return candidates.withColumn("label", F.when(for_it, 1.0).when((c["benign"] == 1) & (c["named"] == 0) | (c["named"] == 0) & (c["issued"] == 0), 0.0))


def train(findings: DataFrame, trees: int = 32, depth: int = 6, seed: int = 11, bound: int = 8000) -> Trees | None:
    """findings(features, label) -> the forest, or None with fewer than FEW rows of a label.

    All rows are fitted, in tasks of about `bound` rows.  Both labels weigh the same; the trees are read back from
    the saved model in the shared folder.
    """
    slim = F.slice("features", 1, len(FEATURES))
    rows = findings.where("label is not null").select(array_to_vector(slim).alias("features"), F.col("label").cast("double"))
    many = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if min(many.get(0.0, 0), many.get(1.0, 0)) < FEW:
        return None
    rows = rows.repartition(-(-sum(many.values()) // bound)).withColumn("weight", F.when(F.col("label") == 1, 1.0 / many[1.0]).otherwise(1.0 / many[0.0]) * min(many.values()))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(rows)
    spark = findings.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    forest.save(path)
    return Trees([(r.treeID, r.nodeData) for r in spark.read.parquet(f"{path}/data").collect()])


def _learned(docs: DataFrame, labelled: DataFrame | None, bound: int):
    """(candidates of all documents, broadcast lexicon, broadcast forest)."""
    spark, plain = docs.sparkSession, _plain(docs)
    words = plain.select("text").mapInArrow(_map_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "word").limit(WORDS)
    lexicon = spark.sparkContext.broadcast(Lexicon({r.word: r.c for r in words.collect()}))
    found = durable(plain.mapInArrow(_map_candidates(lexicon), f"{_SPOT}, features array<double>"))
    marked = durable(found.join(labelled.select("doc_id", "start", "label"), ["doc_id", "start"])) if labelled is not None else silver(found)
    return found, lexicon, spark.sparkContext.broadcast(train(marked, bound=bound))


def findings(docs: DataFrame, labelled: DataFrame | None = None, bound: int = 8000) -> DataFrame:
    """docs(doc_id, text[, path or source]) -> (doc_id, text_key, start, length, sha256, score, is_secret).

    One row per candidate; start is a 0-based code point.  labelled(doc_id, start, label), if given,
    holds curated findings and replaces the silver labels.  A task of the fit reads about `bound` of them.
    """
    found, _, trees = _learned(docs, labelled, bound)
    return found.mapInArrow(_map_scores(trees), f"{_SPOT}, score double, is_secret boolean")


def _map_redact(lexicon, trees, mark: str):
    def clean(text: str, path: str) -> str:
        spots = list(_described(text, path, lexicon.value))
        if spots:
            _, hit = decide(np.array([f for _, _, f in spots]), trees.value)
            for (a, b, _), bad in zip(spots[::-1], hit[::-1].tolist()):
                text = text[:a] + mark + text[b:] if bad else text
        return text

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                new = [t and clean(t, p or "") for t, p in zip(part.column("text").to_pylist(), part.column("path").to_pylist())]
                rest = part.drop_columns(["text", "path"])
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), *rest.columns], names=["text", *rest.schema.names])
    return run


def redact(docs: DataFrame, labelled: DataFrame | None = None, bound: int = 8000, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found secret replaced by `mark`, n_chars adjusted if there; columns stay."""
    _, lexicon, trees = _learned(docs, labelled, bound)
    rest = free_name(docs, "rest")
    path = _path(docs)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("text").cast("string").alias("text"), path.alias("path"), F.struct(*others).alias(rest) if others else F.lit(0).alias(rest))
    new = rows.mapInArrow(_map_redact(lexicon, trees, mark), f"text string, `{rest}` {rows.schema[rest].dataType.simpleString()}")
    columns = {c: F.col("text") if c == "text" else F.col(rest)[c] for c in docs.columns}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("text").isNull(), columns["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*(c.alias(n) for n, c in columns.items()))

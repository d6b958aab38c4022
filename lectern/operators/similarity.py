"""Fuzzy matching: Indel ratio and partial ratio after an exact count filter on pairs of letters."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import alnum_key, title_key
from ..llm.common import durable
from .sections import heading_label, markdown_sections


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one big-integer row (bit-parallel)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def indel(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel similarity, 0 to 100: 100 * 2 * LCS / (|a| + |b|)."""
    return pd.Series([indel(x or "", y or "") for x, y in zip(a, b)])


def window_best(a: str, b: str, floor: float = 0.0) -> float:
    """Best Indel similarity of the shorter text with a window of its length in the longer, cut at the ends.

    The letters that a window shares with the text, kept while it slides, bound its LCS: windows that cannot
    beat the best so far are not compared.  0 when nothing is above `floor`.
    """
    s, t = sorted((a, b), key=len)
    if not s or s in t:
        return 100.0 if s else 0.0
    need, seen, common, best = Counter(s), Counter(), 0, floor
    for end in range(1, len(t) + len(s)):
        if end <= len(t):
            seen[t[end - 1]] += 1
            common += seen[t[end - 1]] <= need[t[end - 1]]
        start = end - len(s)
        if start > 0:
            gone = t[start - 1]
            common -= seen[gone] <= need[gone]
            seen[gone] -= 1
        window = t[max(start, 0):end]
        if 200.0 * common / (len(s) + len(window)) > best:
            best = max(best, indel(s, window))
    return best if best > floor else 0.0


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of the shorter text with its best window in the longer, 0 to 100."""
    return pd.Series([window_best(x or "", y or "") for x, y in zip(a, b)])


def partial_above(a, b, floor: float) -> Column:
    """partial_ratio where it is above `floor`, else 0; windows that cannot pass `floor` cost no comparison."""
    @F.pandas_udf(DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([window_best(p or "", q or "", floor) for p, q in zip(x, y)])
    return score(a, b)


def grams(x, letters_too: bool = False) -> Column:
    """Pairs of neighbouring letters at their places; a text of at most six letters gives its letters too."""
    n = F.length(x)
    letters = F.split(F.col(x), "")
    rest = F.greatest(n - 1, F.lit(0))
    pairs = F.when(n == 1, letters).otherwise(F.zip_with(F.slice(letters, 1, rest), F.slice(letters, 2, rest), lambda p, q: F.concat(p, q)))
    both = F.concat(pairs, letters)
    return both if letters_too else F.when(n > 6, pairs).otherwise(both)


def candidates(titles: DataFrame, lines: DataFrame, least: float, partial: bool = False) -> DataFrame:
    """Distinct (block, a, b) among titles(block, a) and lines(block, b) that may score above `least` (73 at least).

    Exact: no pair above `least` is lost.  A score above it leaves LCS > least / 200 * (n + m); a letter
    dropped breaks two pairs of neighbours and a letter put in breaks one, so of the n - 1 pairs of the text of n letters at least
    k = (3 * least / 200 - 1) * (n + m) - 1 also stand in the other.  So texts meet in an
    equi join on pairs, hits are counted (combined before the shuffle), and only those with k are compared.  For texts of at most six letters single letters take part.
    With `partial` the other text is a window of the longer one, and either side may be the shorter.
    """
    if not 73 <= least < 100:
        raise ValueError("least must lie between 73 and 100")
    share, keep = least / (200.0 - least), 3 * least / 200.0 - 1  # least share of lengths; pairs kept per letter
    a = titles.where("a <> ''").select("block", "a").distinct()
    b = lines.where("b <> ''").select("block", "b").distinct()

    parts = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(x, few, y, many, limit):
        other = many.select("block", y, F.explode(F.array_distinct(grams(y, partial))).alias("g"))
        n = F.length(x)
        k = F.greatest(F.lit(1), F.ceil(F.lit(keep * (1 + share)) * n - 1 - F.lit(1e-9))).cast("int")
        total = F.greatest(n - 1, F.lit(1)) + F.when(n <= 6, n).otherwise(0)
        # repeated pairs of a text meet once, so they come off the need; short texts need one hit
        need = F.when(n > 6, F.greatest(F.lit(1), k - total + F.size("r"))).otherwise(1)
        asked = few.select("block", x, F.array_distinct(grams(x)).alias("r")).select("block", x, F.explode("r").alias("g"), need.alias("need"))
        met = asked.join(other, ["block", "g"]).where(limit).groupBy("block", "a", "b").agg(F.count("*").alias("hits"), F.first("need").alias("need"))
        # few bytes, much work: as many tasks as the session shuffles into, whatever AQE would join
        return met.where("hits >= need").select("block", "a", "b").repartition(parts, "a", "b")

    la, lb = F.length("a"), F.length("b")
    if not partial:
        return meet("a", a, "b", b, (la >= share * lb - 1e-9) & (lb >= share * la - 1e-9))
    return meet("a", a, "b", b, la <= lb).union(meet("b", b, "a", a, lb < la).select("block", "a", "b"))


#: Texts of a tile on either side, classes of letters that are counted, and letters that one step compares.
TILE_A, TILE_B, CLASSES, STEP_LETTERS = 256, 4096, 64, 1 << 22
_PAIRS = pa.schema([("a", pa.string()), ("b", pa.string()), ("score", pa.float64())])


def lcs_rows(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of the letters a and each row of b, rows by falling size.

    The rows of `lcs` side by side, in words of 64 letters of a.
    """
    letters, at = np.unique(b, return_inverse=True)
    words = -(-len(a) // 64)
    masks = np.zeros((len(letters), words), np.uint64)
    place = np.minimum(np.searchsorted(letters, a), len(letters) - 1)
    known = np.flatnonzero(letters[place] == a)
    np.bitwise_or.at(masks, (place[known], known // 64), np.uint64(1) << (known % 64).astype(np.uint64))
    steps = at.reshape(b.shape).T.copy()
    full = np.full(words, ~np.uint64(0))
    if len(a) % 64:
        full[-1] = (np.uint64(1) << np.uint64(len(a) % 64)) - np.uint64(1)
    rows = [np.full(len(b), f) for f in full]
    ends = np.searchsorted(-sizes, -np.arange(b.shape[1]))  # rows longer than each place
    for k, n in enumerate(ends):
        carry = None
        for w, row in enumerate(rows):
            old = row[:n]
            hit = old & masks[steps[k, :n], w]
            new = old + hit
            over = new < old
            if carry is not None:
                new += carry
                over |= new < carry
            row[:n] = new | (old & ~hit)
            carry = over.astype(np.uint64)
    return len(a) - sum(np.bitwise_count(row & f).astype(np.int64) for row, f in zip(rows, full))


def _compare(least: float):
    """(a, b, score) of the pairs of a tile whose indel similarity is above `least`.

    The letters that two texts share, by class, bound their LCS; only pairs that may pass are compared.
    """
    def codes(texts):
        return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]

    def bags(rows):
        return np.stack([np.bincount(x % CLASSES, minlength=CLASSES) for x in rows], 1).astype(np.int32)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[str, str, float]] = []
        if left.num_rows and right.num_rows:
            texts, others = left.column("a").to_pylist(), sorted(right.column("b").to_pylist(), key=len, reverse=True)
            asked, given = codes(texts), codes(others)
            sizes, held = np.array([len(x) for x in given]), bags(given)
            for text, a, bag in zip(texts, asked, bags(asked).T):
                common = sum(np.minimum(held[c], bag[c]) for c in np.flatnonzero(bag))
                may = np.flatnonzero(200.0 * common / (len(a) + sizes) > least)
                while len(may):
                    part, may = np.split(may, [max(1, STEP_LETTERS // int(sizes[may[0]]))])
                    b = np.zeros((len(part), sizes[part[0]]), np.uint32)
                    for i, k in enumerate(part):
                        b[i, :sizes[k]] = given[k]
                    score = 200.0 * lcs_rows(a, b, sizes[part]) / (len(a) + sizes[part])
                    found += [(text, others[part[i]], float(score[i])) for i in np.flatnonzero(score > least)]
        return pa.Table.from_pylist([dict(zip(_PAIRS.names, x)) for x in found], _PAIRS)
    return run


def similar(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b, score): the pairs of a(a) and b(b), different texts that are not empty, whose indel similarity is above `least`.

    A score above it leaves a least share of the lengths, so texts meet within bands of lengths, in tiles of
    some hundred by some thousand texts; no pair is missed and none is a row unless it passes.
    """
    if not 0 < least < 100:
        raise ValueError("least must lie between 0 and 100")
    band = lambda x: F.floor(F.log(F.length(x).cast("double")) / F.log(F.lit((200.0 - least) / least)))
    lot = lambda x, rows, tile: F.pmod(F.xxhash64(x), F.lit(1 + rows // tile))
    a = a.select("a", band("a").alias("band"), lot("a", a.count(), TILE_A).alias("i"))
    near = F.explode(F.array(*[band("b") + k for k in (-1, 0, 1)]))
    b = b.select("b", near.alias("band"), lot("b", b.count(), TILE_B).alias("j"))
    tile = F.concat_ws("/", "band", "i", "j")
    left = a.join(b.select("band", "j").distinct(), "band").select("a", tile.alias("t"))
    right = b.join(a.select("band", "i").distinct(), "band").select("b", tile.alias("u"))
    return left.groupBy("t").cogroup(right.groupBy("u")).applyInArrow(_compare(least), "a string, b string, score double")


def best_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, least: float) -> DataFrame:
    """(left_key, right_key, score): for each left row the right row with the best ratio above `least`.

    Every pair above `least` is found; ties take the smaller right key.  Case does not count; empty and null
    texts match nothing; equal texts are compared once.
    """
    a = left.select(left_key, F.lower(text).alias("a"))
    texts = durable(a.where("a <> ''").select("a").distinct())
    firsts = durable(right.select(right_key, F.lower(text).alias("b")).where("b <> ''").groupBy("b").agg(F.min(right_key).alias(right_key)))
    scored = similar(texts, firsts.select("b"), least)
    best = scored.join(firsts, "b").groupBy("a").agg(F.min_by(F.struct(right_key, "score"), F.struct(-F.col("score"), F.col(right_key))).alias("x"))
    return a.join(best, "a").select(left_key, f"x.{right_key}", "x.score")


def title_lines(titles: DataFrame, lines: DataFrame, least: float = 80.0, partial: float = 85.0, sure: float = 92.0) -> DataFrame:
    """(paper_id, line, score): the line of its block (a year, a volume) that each title stands on.

    titles(paper_id, block, title), lines(block, line, text).  Texts are compared as title keys; lines count
    when they are headers or longer than 15 letters, with a key over 12.  The first line above `sure` wins,
    else the best above `least`, first on ties; titles without one are then sought within lines, above
    `partial`.  Titles found nowhere are left out.
    """
    a = titles.select("paper_id", "block", title_key("title").alias("a")).where("a <> ''")
    text = F.trim("text")
    b = lines.where(text.startswith("#") | (F.length(text) > 15)).select("block", "line", title_key("text").alias("b")).where(F.length("b") > 12)
    b = b.groupBy("block", "b").agg(F.min("line").alias("line"))

    def choose(asked, scorer, above, in_part):
        s = candidates(asked, b, above, in_part).withColumn("score", scorer("a", "b")).where(F.col("score") > above)
        first = F.struct(F.when(F.col("score") > sure, F.lit(-sure)).otherwise(-F.col("score")).alias("rank"), F.col("line"))
        best = s.join(b, ["block", "b"]).withColumn("first", first).groupBy("block", "a").agg(F.min_by(F.struct("line", "score"), "first").alias("x"))
        return asked.join(best, ["block", "a"]).select("paper_id", "x.line", F.round(F.col("x.score") / 100, 2).alias("score"))
    whole = choose(a, ratio, least, False)
    return whole.union(choose(a.join(whole, "paper_id", "left_anti"), lambda x, y: partial_above(x, y, partial), partial, True))


def page_heads(titles: DataFrame, pages: DataFrame, least: float = 85.0, heads: int = 6, first: int = 16, last: int = 3300) -> DataFrame:
    """(paper_id, page, score): the page whose first `heads` lines hold a title best, the first on ties.

    titles(paper_id, block, title), pages(block, page, text); only pages `first` to `last` count.
    """
    a = titles.select("paper_id", "block", F.lower(F.trim("title")).alias("a")).where("a <> ''")
    head = F.lower(F.array_join(F.slice(F.split("text", "\n"), 1, heads), " "))
    b = pages.where(F.col("page").between(first, last)).select("block", "page", head.alias("b")).groupBy("block", "b").agg(F.min("page").alias("page"))
    s = candidates(a, b, least, True).withColumn("score", partial_above("a", "b", least)).where(F.col("score") > least)
    best = s.join(b, ["block", "b"]).groupBy("block", "a").agg(F.min_by(F.struct("page", "score"), F.struct(-F.col("score"), F.col("page"))).alias("x"))
    return a.join(best, ["block", "a"]).select("paper_id", "x.page", "x.score")


def chunks(papers: DataFrame, lines: DataFrame, found: DataFrame, reach: int = 400) -> DataFrame:
    """(paper_id, section, heading, label, text, confidence, low): sections of each paper after the line found.

    papers(paper_id, block, title, abstract), lines(block, line, text), found as title_lines gives it.  A paper
    runs for `reach` lines; lines meet papers by ranges of `reach` in an equi join.  A first section under
    the paper's own title is dropped.  A paper without sections keeps its abstract, or else its title, at
    0.5 when it was not found; `low` marks a confidence under 0.7.
    """
    at = papers.join(found, "paper_id").select("paper_id", "block", F.col("line").alias("_l"), F.explode(F.array(F.floor(F.col("line") / reach), F.floor(F.col("line") / reach) + 1)).alias("_r"))
    own = lines.withColumn("_r", F.floor(F.col("line") / reach)).join(at, ["block", "_r"]).where(f"line >= _l and line < _l + {reach}")
    runs = markdown_sections(own.select(F.col("paper_id").alias("id"), "line", "text"))
    w = Window.partitionBy("paper_id").orderBy("section")
    kept = runs.withColumnRenamed("id", "paper_id").join(papers.select("paper_id", "title"), "paper_id").withColumn("_n", F.row_number().over(w))
    kept = kept.where((F.col("_n") > 1) | (title_key("heading") != title_key("title"))).withColumn("section", F.row_number().over(w))
    body = kept.select("paper_id", "section", "heading", heading_label("heading").alias("label"), "text")
    rest = papers.join(kept.select("paper_id").distinct(), "paper_id", "left_anti")
    bare = rest.select("paper_id", F.lit(1).alias("section"), F.lit("Abstract").alias("heading"), F.lit("introduction").alias("label"),
                       F.coalesce(F.nullif("abstract", F.lit("")), "title").alias("text"))
    score = F.coalesce(F.col("score"), F.lit(0.5))
    return body.union(bare).join(found.select("paper_id", "score"), "paper_id", "left").select(
        "paper_id", "section", "heading", "label", "text", score.alias("confidence"), (score < 0.7).alias("low"))


# ---------------------------------------------------------------- containment and cascades

def stretches(short: DataFrame, long: DataFrame, least: int) -> DataFrame:
    """(a, b): the stretches a of each different text of long(b) that have the first `least` letters and the length of some text of short(a).

    A text that contains another contains its first `least` letters, so no text of short that stands in b is missed; a row is
    a place in b and a length, so their number grows with the letters of long, however many texts begin alike.
    """
    asked = short.where(F.length("a") >= least).select(F.substring("a", 1, least).alias("g"), F.length("a").alias("n")).distinct()
    places = F.sequence(F.lit(1), F.greatest(F.length("b") - least + 1, F.lit(1)))
    cuts = long.where(F.length("b") >= least).select("b").distinct().select("b", F.explode(places).alias("i")).withColumn("g", F.substring(F.col("b"), F.col("i"), F.lit(least)))
    return cuts.join(asked, "g").where("i + n - 1 <= length(b)").select(F.substring(F.col("b"), F.col("i"), F.col("n")).alias("a"), "b")


def cascade(files: DataFrame, papers: DataFrame, stem: int = 5, prefix: int = 30, least: int = 20) -> DataFrame:
    """(file_id, paper_id, tier): the paper of each file by the first rule that finds one, the smallest id on ties.

    files(file_id, stem, title), papers(paper_id, title); ids and stems are texts.  1: the stem stands in the id or the id in
    the stem (each of `stem` letters or more); 2: equal titles, letters and digits alone; 3: of such titles over `least`
    letters, the first `prefix` letters of one stand in the other.
    """
    f = files.select("file_id", F.col("stem"), alnum_key(F.coalesce("title", F.lit(""))).alias("key"))
    p = papers.select("paper_id", alnum_key(F.coalesce("title", F.lit(""))).alias("key"))
    first = F.min("paper_id").alias("paper_id")

    def around(asked, texts, shortest):
        """(a, paper_id): the smallest paper_id of texts(b, paper_id) that contain a; every stretch has its own before they meet."""
        known = texts.groupBy("b").agg(first)
        return stretches(asked, known, shortest).join(known, "b").groupBy("a").agg(first)

    def inside(texts, asked, shortest):
        """(b, paper_id): the smallest paper_id of texts(a, paper_id) that stand in b."""
        known = texts.groupBy("a").agg(first)
        return stretches(known, asked, shortest).join(known, "a").groupBy("b").agg(first)

    def head(df):
        return df.where(F.length("key") > least).withColumn("head", F.substring("key", 1, prefix))
    ids, long = p.select("paper_id", F.col("paper_id").alias("b")), head(f)
    found = [(1, f, "stem", around(f.select(F.col("stem").alias("a")), ids, stem)),
             (1, f, "stem", inside(ids.withColumnRenamed("b", "a"), f.select(F.col("stem").alias("b")), stem)),
             (2, f.where("key <> ''"), "key", p.groupBy("key").agg(first)),
             (3, long, "head", around(long.select(F.col("head").alias("a")), p.select("paper_id", F.col("key").alias("b")), least + 1)),
             (3, long, "key", inside(head(p).select("paper_id", F.col("head").alias("a")), long.select(F.col("key").alias("b")), least + 1))]
    rows = [own.join(best.toDF(on, "paper_id"), on).select("file_id", "paper_id", F.lit(tier).alias("tier")) for tier, own, on, best in found]
    best = F.min_by(F.struct("paper_id", "tier"), F.struct("tier", "paper_id"))
    return reduce(DataFrame.union, rows).groupBy("file_id").agg(best.alias("x")).select("file_id", "x.*")

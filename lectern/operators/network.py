"""Relations between papers, authors and labels, and the aggregations behind their exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_join(value: str, order: list[str], separator: str) -> Column:
    """Aggregate: values joined in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value)))
    return F.array_join(F.transform(rows, lambda r: r[value]), separator)


def author_pairs(paper_authors: DataFrame) -> DataFrame:
    """(paper_id, a1, a2) with a1 < a2: the list of a paper's authors is paired in place, so the
    papers move once and no side is joined with itself."""
    lists = paper_authors.groupBy("paper_id").agg(F.array_sort(F.collect_set("author_id")).alias("a"))
    firsts = lists.select("paper_id", "a", F.posexplode("a").alias("i", "a1"))
    return firsts.select("paper_id", "a1", F.explode(F.expr("slice(a, i + 2, size(a))")).alias("a2"))


def nearest_key(left: DataFrame, right: DataFrame, key: str, near: str, other: str, value: str, reach: int) -> DataFrame:
    """For each left row the right row whose `other` is nearest to `near`, at most `reach` away.

    Integers within reach are listed, so the join is an equi join; ties take the smaller value.
    """
    listed = left.withColumn("_at", F.explode(F.sequence(F.col(near) - reach, F.col(near) + reach)))
    both = listed.join(right, F.col("_at") == F.col(other))
    best = F.min_by(F.struct(other, value), F.struct(F.abs(F.col(near) - F.col(other)), F.col(value)))
    return both.groupBy(key).agg(best.alias("_b")).select(key, f"_b.{other}", f"_b.{value}")


def completeness(df: DataFrame) -> DataFrame:
    """(field, populated, total) for each column, in one pass."""
    row = df.agg(F.count("*").alias("_total"), *[F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("populated"), F.col("_total").alias("total")) for c in df.columns])).alias("x")).select("x.*")


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): element n div 2 of the sorted values, from counts of each value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))
    return ranked.where("_to > _n div 2 and _to - _c <= _n div 2").select(group, value)


def trends(labels: DataFrame, papers: DataFrame, least: int) -> DataFrame:
    """(year, value, n, share): how often each label is given at `least` centrality, by year."""
    n = labels.where(F.col("centrality") >= least).join(papers, "paper_id").groupBy("year", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 4))


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or kept between two result sets."""
    a, b = old.select(key, F.lit(True).alias("_a")), new.select(key, F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full").select(key, change.alias("change"))


def density_matrix(labels: DataFrame) -> DataFrame:
    """Volume and number of co-labels of each label, with quadrants by upper medians.

    A paper's labels are gathered once, so no self join is needed; its other values are the set without the label's
    own.  Labels are unique in a paper then, so volumes are plain counts, and only distinct (label, other
    value) rows, combined before the shuffle, are counted for co-labels.
    """
    lists = labels.groupBy("paper_id").agg(F.collect_set(F.struct("dimension", "value")).alias("all"))
    volume = lists.select(F.explode("all").alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("volume"))
    others = F.expr("transform(filter(all, y -> y <> x), y -> y.value)")
    pairs = lists.select("all", F.explode("all").alias("x")).select("x.*", F.explode(others).alias("other")).distinct()
    co = pairs.groupBy("dimension", "value").agg(F.count("*").alias("co_labels"))
    g = volume.join(co, ["dimension", "value"], "left").fillna(0, ["co_labels"])
    one = g.withColumn("one", F.lit(1))
    mids = [upper_median(one, "one", c).select(F.col(c).alias(f"_m_{c}")) for c in ("volume", "co_labels")]
    both = reduce(lambda a, m: a.crossJoin(F.broadcast(m)), mids, g)  # medians: one row each
    high, wide = F.col("volume") >= F.col("_m_volume"), F.col("co_labels") >= F.col("_m_co_labels")
    quadrant = F.when(high & wide, "motor").when(high, "basic").when(wide, "niche").otherwise("emerging")
    return both.select("dimension", "value", "volume", "co_labels", quadrant.alias("quadrant"))


def citation_links(cited: DataFrame, lines: DataFrame, least: int = 3, words: int = 6, size: int = 4) -> DataFrame:
    """(line_id, target_id, common): the first target by id whose key words share `least` with a line.

    cited(target_id, title[, year]), lines(line_id, text[, year]).  A target's key is its first `words` tokens
    longer than `size`; where both have a year, no target is younger than the line.  A pair that shares `least`
    of a target's k tokens shares one of its k - least + 1 rarest, so only those meet lines, through an equi
    join; the pairs found then meet the line's tokens again and are counted.  Only (line, token) rows are
    shuffled, and only tokens that some key has; the joins are sorted ones, as a column of exploded
    words is larger than its table and must not be taken for small.
    """
    from ..functions.text import tokens

    key = F.slice(F.filter(tokens("title"), lambda t: F.length(t) > size), 1, words)
    dated = "year" in cited.columns and "year" in lines.columns
    index = cited.select("target_id", F.array_distinct(key).alias("k"), *(["year"] if dated else [])).where(F.size("k") >= least)
    keys = index.select("target_id", F.explode("k").alias("token"))
    # key tokens as a regex-free set test: a line's tokens are cut to those that keys have before anything is counted
    said = lines.select("line_id", F.explode(F.array_distinct(F.filter(tokens("text"), lambda t: F.length(t) > size))).alias("token"))
    said = said.join(keys.select("token").distinct(), "token", "left_semi").hint("merge")
    often = said.groupBy("token").agg(F.count("*").alias("n"))
    # a token that no line has is rarer than any other
    ranked = keys.join(often, "token", "left").groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("r"))
    asked = ranked.select("target_id", F.explode(F.expr(f"slice(r, 1, size(r) - {least} + 1).token")).alias("token"))
    pairs = said.join(asked, "token").select("line_id", "target_id").distinct()
    if dated:
        pairs = pairs.join(lines.select("line_id", F.col("year").alias("_said")), "line_id").join(index.select("target_id", "year"), "target_id").where("year <= _said").select("line_id", "target_id")
    met = pairs.join(keys, "target_id").hint("merge").join(said, ["line_id", "token"]).groupBy("line_id", "target_id").agg(F.count("*").alias("common")).where(F.col("common") >= least)
    return met.groupBy("line_id").agg(F.min_by(F.struct("target_id", "common"), "target_id").alias("x")).select("line_id", "x.*")


#: What a reference to the corpus mentions.
VENUES = ["icls", "cscl", "isls", "learning sciences", "proceedings of"]


def reference_lines(lines: DataFrame, venues: list[str] | None = None, least: int = 20, title: int = 10) -> DataFrame:
    """(id, line, citing, text): the lines of reference blocks that mention a venue.

    lines(id, line, text).  A block opens at a line `references` or a header `## references...` and shuts at the next
    header of one or two marks; `citing` is the line of the last header of one mark and more than `title`
    letters, which names the paper, 0 before the first.  Lines under `least` letters do not count.
    """
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    text = F.trim("text")
    low = F.lower(text)
    opens = (low == "references") | low.startswith("## references")
    shuts = text.startswith("# ") | (text.startswith("## ") & ~low.contains("references"))
    paper = text.startswith("# ") & (F.length(text) > title) & ~low.startswith("# references")
    inside = F.last(F.when(opens, F.lit(True)).when(shuts, F.lit(False)), ignorenulls=True).over(w)
    citing = F.coalesce(F.last(F.when(paper, F.col("line")), ignorenulls=True).over(w), F.lit(0))
    walked = lines.withColumns({"_in": inside & ~opens, "citing": citing.cast("long")})
    named = reduce(Column.__or__, [low.contains(v) for v in venues or VENUES])
    return walked.where("_in").where((F.length(text) >= least) & named).select("id", "line", "citing", text.alias("text"))


def block_citations(cited: DataFrame, lines: DataFrame, snippet: int = 150, **options) -> DataFrame:
    """(id, citing, target_id, line, context): each citing paper's targets once, with the first line that cites them.

    cited(target_id, title[, year]), lines(id, line, text[, year]); the options are those of `citation_links`
    (least, words, size) and `venues`.
    """
    venues = options.pop("venues", None)
    own = reference_lines(lines, venues)
    if "year" in lines.columns:
        own = own.join(lines.select("id", "year").distinct(), "id")
    named = own.withColumn("line_id", F.struct("id", "line"))
    links = citation_links(cited, named, **options)
    both = links.join(named, "line_id").groupBy("id", "citing", "target_id").agg(F.min_by(F.struct("line", F.substring("text", 1, snippet).alias("context")), "line").alias("x"))
    return both.select("id", "citing", "target_id", "x.*")

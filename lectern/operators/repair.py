"""Repair of titles and authors that line breaks mixed up, in staged projections without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import people as P


def repaired(papers: DataFrame, title: str, authors: str, section: str) -> DataFrame:
    """papers with fixed_title and fixed_authors (names joined by commas).

    title, authors and section (the first section's text) are text columns, null or not.  A title is dirty when it is over
    150 letters or looks bibliographic; then, or when it is under five letters, the finished title of the
    section's header replaces it.  A dirty one without is cut at its marks.  Names at the title's end go; a first
    author that is a subtitle moves to the title; missing authors come from the header; repeated phrases go.
    Each stage is a projection, so nothing is computed twice and nothing is shuffled.
    """
    low = F.lower
    out = papers.withColumns({"_t": P.strip(F.regexp_replace(P.strip(title), r"(?i)^title:\s*", "")), "_a": P.strip(F.regexp_replace(P.strip(authors), r"(?i)^authors:\s*", "")), "_h": P.header(section)})
    t, a = F.col("_t"), F.col("_a")
    out = out.withColumn("_dirty", (F.length(t) > 150) | (t != "") & P.reference_line(t) | t.rlike(P.PAREN_YEAR) | t.rlike(P.BIBLIOGRAPHIC) | (t == ""))
    found = F.col("_h.title")
    finished = found.isNotNull() & ~found.rlike(P.UNFINISHED) & ~found.endswith("-") & (F.size(F.split(found, r"\s+")) > 2)
    out = out.withColumn("_t", F.when(finished & (F.col("_dirty") | (F.length(t) < 5)), found).otherwise(t))
    still = F.col("_dirty") & (found.isNull() | P.reference_line(t))
    cut = F.regexp_replace(P.strip(F.regexp_replace(P.strip(F.split_part(t, F.lit(";"), F.lit(1))), r"\(?\b(19\d\d|20\d\d)\b.*$", "")), r"(?i)\b(doi:|https?://|vol\.|pp\.).*$", "")
    out = out.withColumn("_t", F.when(still, P.strip(cut)).otherwise(t))
    out = out.withColumn("_t", P.without_trailing_authors(t)).withColumn("_p", P.split_names(a)).withColumn("_f", F.coalesce(F.get("_p", F.lit(0)), F.lit("")))

    f, words = F.col("_f"), F.split("_f", r"\s+")
    ends = (f != "") & F.endswith(low(t), low(f))
    plain = ~f.rlike(r"\d|@") & ~P.holds(low(f), P.FIRST_PLACES)
    subtitle = (f != "") & ~ends & plain & F.exists(words, lambda w: low(w).isin(P.SUBTITLE_WORDS)) & ~F.exists(words, lambda w: w.rlike(r"^\p{Lu}.") & ~low(w).isin(P.SUBTITLE_WORDS))
    shorter = F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(f)), r"[ :,\t-]+$", "")
    longer = F.when(F.contains(low(t), low(f)), t).otherwise(P.strip(F.concat_ws(" ", t, f)))
    out = out.withColumns({"_ends": ends, "_sub": subtitle}).withColumns({
        "_t": F.when(F.col("_ends"), shorter).when(F.col("_sub"), longer).otherwise(t), "_a": F.when(F.col("_sub"), F.array_join(F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), ", ")).otherwise(a)})
    out = out.withColumn("_a", F.when(a == "", F.coalesce("_h.names", F.lit(""))).otherwise(a)).withColumn("_t", P.strip(F.split_part(t, F.lit(";"), F.lit(1))))
    fixed = {"fixed_title": P.clean_title(t), "fixed_authors": F.array_join(P.sanitised(P.split_names(a)), ", ")}
    return out.withColumns(fixed).drop("_t", "_a", "_h", "_dirty", "_p", "_f", "_ends", "_sub")

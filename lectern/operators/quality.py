"""Audits of text: broken citations, connectors, mid-sentence breaks, stray blanks, split words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that a finished paragraph does not end with.
CONNECTORS = ["and", "or", "the", "a", "an", "of", "to", "in", "for", "with",
              "by", "from", "on", "at", "as", "that", "which", "between", "into", "through"]


def open_citation(text) -> Column:
    """More opening than closing brackets."""
    return F.regexp_count(text, F.lit(r"\(")) > F.regexp_count(text, F.lit(r"\)"))


def trailing_connector(text) -> Column:
    return F.rtrim(text).rlike(r"(?i)(^|\s)(" + "|".join(CONNECTORS) + r")$") | F.rtrim(text).rlike(r"[&;,(]$")


def mid_breaks(lines: DataFrame) -> DataFrame:
    """lines whose paragraph has no final mark while the next begins with a lower-case letter."""
    w = Window.partitionBy("id").orderBy("line")
    nxt = F.lead("text").over(w)
    return lines.withColumn("_n", nxt).where((F.trim("text") != "") & ~F.rtrim("text").rlike(r"[.!?:;\"')\]]$") & F.ltrim("_n").rlike(r"^\p{Ll}")).drop("_n")


def stray_blanks(text) -> Column:
    """Blanks before punctuation."""
    return F.regexp_count(text, F.lit(r"\s[,.;:!?]"))


def split_words(words: list[str]) -> str:
    """An alternation of every two-part spelling of the words."""
    cuts = [rf"{w[:i]} {w[i:]}" for w in words for i in range(2, len(w) - 1)]
    return r"(?i)\b(" + "|".join(cuts) + r")\b"


def audit(papers: DataFrame, lines: DataFrame) -> DataFrame:
    """One row of totals: papers, blank bodies, short ones, papers with breaks, lines with glitches."""
    p = papers.agg(F.count("*").alias("papers"), F.count_if(F.trim("body") == "").alias("blank"), F.count_if(F.length(F.trim("text")) < 150).alias("short"))
    l = lines.agg(F.sum(open_citation("text").cast("long")).alias("open_citations"), F.sum(trailing_connector("text").cast("long")).alias("connectors"), F.sum(stray_blanks("text")).cast("long").alias("stray_blanks"))
    return p.crossJoin(F.broadcast(l))  # one row each


# ---------------------------------------------------------------- neighbouring paragraphs

#: Marks and words that a sentence goes on with.
GOES_ON = ["et al.", "p.", "pp.", ",", ";", ")"]


def paragraph_faults(sections: DataFrame, back_matter: str = "references & back matter") -> DataFrame:
    """(id, section, para, fault): what is wrong between each paragraph and the next one.

    sections(id, section, label, text); paragraphs are parted by empty lines.  open_bracket: more brackets open than
    shut; split_citation: ends with & or ; before a year in the next 30 letters; connector: ends with a mark or word that
    leads on (the first of these three that holds); mid_sentence: no final mark and the next begins in small letters or goes
    on, outside back matter.  Paragraphs are paired inside their row, without a shuffle.
    """
    from ..functions.people import filled

    paras = filled(F.split(F.coalesce("text", F.lit("")), "\n\n"))
    rows = sections.select("id", "section", "label", paras.alias("p"))
    pairs = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = rows.select("id", "section", "label", F.posexplode(pairs).alias("para", "x"))
    a, b = F.col("x.a"), F.col("x.b")
    last = F.regexp_replace(F.lower(F.element_at(F.split(a, r"\s+"), -1)), "[^a-z]", "")
    ends = lambda *marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.endswith(a, m))
    first = (F.when(F.regexp_count(a, F.lit(r"\(")) > F.regexp_count(a, F.lit(r"\)")), "open_bracket").when(ends("&", ";") & F.substring(b, 1, 30).rlike(r"\b(?:19|20)\d{2}\b"), "split_citation")
             .when(ends("&", ";", ",", "-", "–", "—") | last.isin(CONNECTORS), "connector"))
    mid = F.when(~ends(".", "!", "?", ":", '"', "”", "’", ")") & (F.coalesce("label", F.lit("")) != back_matter) & (b.rlike(r"^\p{Ll}") | F.exists(F.array(*map(F.lit, GOES_ON)), lambda m: F.startswith(b, m))), "mid_sentence")
    return each.select("id", "section", "para", F.explode(F.array(first, mid)).alias("fault")).where("fault is not null")


def fault_totals(faults: DataFrame, sections: DataFrame, words: str, many: int = 5) -> DataFrame:
    """One row: totals and papers with each kind of fault, stray blanks and split words, and the papers that are flagged.

    A paper is flagged for any broken citation, more than `many` mid-sentence breaks or any split word (pattern `words`).
    """
    kinds = ["open_bracket", "split_citation", "connector", "mid_sentence"]
    per = faults.groupBy("id").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    text = F.coalesce("text", F.lit(""))
    more = sections.groupBy("id").agg(F.sum(F.regexp_count(text, F.lit(r"\s+[,;:.)]"))).cast("long").alias("stray"), F.sum(F.regexp_count(text, F.lit(words))).cast("long").alias("split"))
    both = more.join(per, "id", "left").fillna(0, kinds).withColumn("citations", F.col("open_bracket") + F.col("split_citation"))
    flagged = (F.col("citations") > 0) | (F.col("mid_sentence") > many) | (F.col("split") > 0)
    shown = ["citations", "connector", "mid_sentence", "stray", "split"]
    return both.agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in shown], *[F.count_if(F.col(k) > 0).alias(f"papers_{k}") for k in shown], F.count_if(flagged).alias("flagged"))


def full_audit(papers: DataFrame, authors: DataFrame, sections: DataFrame, files: DataFrame, indexed: DataFrame, labelled: DataFrame, fields: list[str]) -> DataFrame:
    """(metric, value): the all-field audit of a collection, each table read once.

    papers(id, status, abstract, ...), authors(paper_id), sections(paper_id, text), files(paper_id, kind), indexed(paper_id),
    labelled(paper_id).  Populated counts and percentages of `fields`; papers without authors; missing and short
    abstracts; papers by number of sections; sections over 400 letters whose lines break off; complete papers without
    a file of each kind; coverage of index and labels.
    """
    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.trim), lambda x: x != "")
    broken = F.size(F.filter(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: ~x.rlike(r"[.!?:]$")))
    cut = sections.select("paper_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), lines.alias("l"))
    cut = cut.select("paper_id", (F.col("n") > 400).alias("long"), ((F.col("n") > 400) & (F.size("l") > 5) & (broken / F.greatest(F.size("l") - 1, F.lit(1)) > 0.4)).alias("bad"))
    per = cut.groupBy("paper_id").agg(F.count("*").alias("sections"), F.count_if("long").alias("long"), F.count_if("bad").alias("bad"))
    has = lambda df, name: df.select(F.col("paper_id").alias("id")).where("id is not null").distinct().withColumn(name, F.lit(True))
    kinds = files.groupBy(F.col("paper_id").alias("id")).agg(F.bool_or(F.col("kind") == "pdf").alias("_pdf"), F.bool_or(F.col("kind") == "md").alias("_md"))
    rows = papers.join(per.withColumnRenamed("paper_id", "id"), "id", "left").join(has(authors, "_a"), "id", "left").join(has(indexed, "_i"), "id", "left").join(has(labelled, "_l"), "id", "left").join(kinds, "id", "left")
    n, size, done = F.coalesce("sections", F.lit(0)), F.length(F.trim("abstract")), F.col("status") == "complete"
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    counts = {"papers": F.count("*"), **{f"populated {f}": F.count_if(~blank(f)) for f in fields}, "without authors": F.count_if(F.col("_a").isNull()), "missing abstracts": F.count_if(blank("abstract")),
              "short abstracts": F.count_if((size > 0) & (size < 150)), "1 section": F.count_if(n == 1), "2 sections": F.count_if(n == 2), "3 to 4 sections": F.count_if(n.between(3, 4)), "5 or more, or no sections": F.count_if((n >= 5) | (n == 0)),
              "sections checked": F.coalesce(F.sum("long"), F.lit(0)), "fragmented sections": F.coalesce(F.sum("bad"), F.lit(0)), "missing pdf": F.count_if(done & no("_pdf")), "missing md": F.count_if(done & no("_md")),
              "indexed papers": F.count("_i"), "labelled papers": F.count("_l")}
    one = rows.agg(*[c.cast("double").alias(k) for k, c in counts.items()])
    share = lambda a, b: F.round(F.col(f"`{a}`") * 100 / F.greatest(F.col(f"`{b}`"), F.lit(1.0)), 2)
    shares = {**{f"percent {f}": share(f"populated {f}", "papers") for f in fields}, "percent fragmented": share("fragmented sections", "sections checked"), "percent indexed": share("indexed papers", "papers"), "percent labelled": share("labelled papers", "papers")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value")) for k in counts], *[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in shares.items()])).alias("x")).select("x.*")


def ingestion_report(papers: DataFrame, sections: DataFrame, expected: DataFrame) -> DataFrame:
    """One row about a load: papers found and expected, missing titles, authors and abstracts, sections without a role, mean confidence.

    papers(title, authors array, abstract, confidence), sections(roles array), expected: a row for each paper that the contents list.
    """
    none = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    p = papers.agg(F.count("*").alias("detected_papers"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("confidence"), F.count_if(none("title")).alias("missing_title"),
                   F.count_if(F.coalesce(F.size("authors"), F.lit(0)) <= 0).alias("missing_authors"), F.count_if(none("abstract")).alias("missing_abstract"))
    s = sections.agg(F.count_if(F.coalesce(F.size("roles"), F.lit(0)) <= 0).alias("unmapped_headings"))
    return p.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(expected.agg(F.count("*").alias("expected_papers"))))  # one row each

"""Sectioning: order-dependent walks over lines as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Canonical section labels and their keywords, in order of priority.
SECTION_KEYWORDS = {
    "methods": ["method", "methods", "methodology", "methodological", "methodological approach", "methodological framework", "study design", "data collection",
                "analytical framework", "analytical approach", "participants", "intervention", "data sources", "data analysis", "measures", "procedure",
                "methods and context", "context and methods"],
    "results": ["results", "findings", "analysis and results", "outcomes", "observations"],
    "discussion_conclusion": ["discussion", "conclusion", "conclusions", "implications", "concluding remarks", "limitations", "future work", "discussion and conclusion", "summary"],
    "theoretical_background": ["theoretical framework", "conceptual framework", "literature review", "theoretical background", "related work", "perspectives", "prior work"],
    "research_questions": ["research question", "rq", "objectives", "study focus", "goals"],
    "introduction": ["abstract", "introduction", "background", "overview", "problem statement", "motivation"],
    "references": ["references", "reference", "bibliography", "works cited", "literature cited"],
}


def heading_label(heading, rules: dict[str, list[str]] | None = None, default: str = "other") -> Column:
    """Exact match first, then the first rule with a keyword as whole words; numbering is ignored."""
    rules = rules or SECTION_KEYWORDS
    h = F.col(heading) if isinstance(heading, str) else heading
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(h)), r"^\d+(\.\d+)*\s*", ""), r"^([a-z]|\d+)\.\s*", ""))
    exact = [F.when(plain.isin(k), F.lit(label)) for label, k in rules.items()]
    inside = [F.when(plain.rlike(r"\b(" + "|".join(k) + r")\b"), F.lit(label)) for label, k in rules.items()]
    return F.coalesce(*exact, *inside, F.lit(default))


def by_header(lines: DataFrame, header: Column, heading: Column, default: str) -> DataFrame:
    """(id, section, heading, text): runs of lines (id, line, text) that start at header lines.

    One window over each document's lines numbers the runs; each run is then joined in order.
    """
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    flagged = lines.withColumn("_h", header)
    flagged = flagged.withColumn("section", F.sum(F.col("_h").cast("int")).over(w)).withColumn("_t", F.when(F.col("_h"), heading))
    runs = flagged.groupBy("id", "section").agg(F.max("_t").alias("_t"), F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line", "text")))).alias("_l"))
    text = F.regexp_replace(F.array_join(F.transform("_l", lambda r: r["text"]), "\n"), r"^\s+|\s+$", "")
    return runs.select("id", "section", F.coalesce("_t", F.lit(default)).alias("heading"), text.alias("text")).where("text <> ''")


def markdown_sections(lines: DataFrame) -> DataFrame:
    """Sections under '#' to '####' headers; text before the first is 'Abstract / Intro'."""
    text = F.trim("text")
    return by_header(lines, text.rlike(r"^#{1,4}\s+\S"), F.regexp_extract(text, r"^#{1,4}\s+(.+)$", 1), "Abstract / Intro")


def keyword_sections(lines: DataFrame, names: list[str], default: str = "Full Text") -> DataFrame:
    """Sections under lines that are one of the names, with or without a number."""
    pattern = r"(?i)^\s*(\d+(\.\d+)*[.\s]\s*)?(" + "|".join(names) + r")\s*:?\s*$"
    return by_header(lines, F.col("text").rlike(pattern), F.initcap(F.regexp_extract("text", pattern, 3)), default)


def carried(lines: DataFrame, header: Column, value: Column, name: str) -> DataFrame:
    """lines with the value of the last header line at or above each."""
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(F.when(header, value), ignorenulls=True).over(w))


def ends_before_next(starts: DataFrame, group: str, start: str, last: Column) -> DataFrame:
    """starts with `end`: one before the next start, never before the start itself."""
    w = Window.partitionBy(group).orderBy(start)
    return starts.withColumn("end", F.greatest(F.col(start), F.coalesce(F.lead(start).over(w) - 1, last)))


def offsets(sections: DataFrame, group: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """sections with the character `start` each has when joined with `gap` characters between."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("start", F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0)))


def edge_lines(lines: DataFrame, n: int = 3) -> DataFrame:
    """The first and last n lines of each page (id)."""
    up, down = Window.partitionBy("id").orderBy("line"), Window.partitionBy("id").orderBy(F.desc("line"))
    return lines.withColumn("_a", F.row_number().over(up)).withColumn("_b", F.row_number().over(down)).where(f"_a <= {n} or _b <= {n}").drop("_a", "_b")


def without_furniture(lines: DataFrame, pattern: str, n: int = 3) -> DataFrame:
    """lines without edge lines that look like headers, footers or page numbers."""
    up, down = Window.partitionBy("id").orderBy("line"), Window.partitionBy("id").orderBy(F.desc("line"))
    edge = (F.row_number().over(up) <= n) | (F.row_number().over(down) <= n)
    return lines.withColumn("_e", edge).where(~(F.col("_e") & F.trim("text").rlike(rf"^\d{{1,4}}$|{pattern}"))).drop("_e")


def entries(lines: DataFrame, start: str) -> DataFrame:
    """(id, entry, text): reference entries; a new one begins at a blank line or a start pattern."""
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim("text") == ""
    runs = lines.withColumn("entry", F.sum((blank | F.col("text").rlike(start)).cast("int")).over(w)).where(~blank)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: F.trim(r["text"])), " ")
    return runs.groupBy("id", "entry").agg(joined.alias("text"))


def gap_boundaries(pages: DataFrame, gap: int = 1) -> DataFrame:
    """(id, start): pages that open a paper, each more than `gap` pages after the last one taken.

    pages(id, page, opens).  The rule looks at the last page *taken*, so it walks each document's
    flagged pages in order: a fold over a sorted array of those pages only.
    """
    flagged = pages.where("opens").groupBy("id").agg(F.array_sort(F.collect_list("page")).alias("p"))
    taken = F.aggregate("p", F.expr("cast(array() as array<bigint>)"), lambda acc, x: F.when((F.size(acc) == 0) | (x > F.element_at(acc, -1) + gap), F.concat(acc, F.array(x.cast("long")))).otherwise(acc))
    return flagged.select("id", F.explode(taken).alias("start"))


#: Canonical sections and how their headings begin, in order of priority.
CANONICAL = {"References & Back Matter": r"references|bibliography|works cited|acknowledgments|acknowledgements|appendi[cx]",
             "Discussion & Conclusion": r"discussion|conclusion|concluding remarks|summary and conclusion|limitations|implications",
             "Results & Findings": r"results|findings|case study|empirical analysis|data analysis",
             "Methodology & Context": r"method|methods|methodology|participants|context|setting|study design|procedure|data collection|pedagogical design",
             "Abstract & Introduction": r"abstract|introduction|background|theoretical framework|literature review|problem statement|overview"}
#: Canonical sections in the order of a paper.
ORDER = ["Abstract & Introduction", "Methodology & Context", "Results & Findings", "Discussion & Conclusion", "References & Back Matter"]


def canonical_line(line) -> Column:
    """The canonical section whose heading a line is: at most 60 letters, no final dot, numbering ignored; else null."""
    from ..functions.people import strip

    bare = strip(F.regexp_replace(strip(line), r"^(?:[0-9IVX]+(?:\.[0-9]+)*|\([0-9]+\))\s*", ""))
    own = F.coalesce(*[F.when(bare.rlike(rf"(?i)^(?:{p})\b"), F.lit(name)) for name, p in CANONICAL.items()])
    return F.when((F.length(strip(line)) <= 60) & ~strip(line).endswith("."), own)


def canonical_sections(lines: DataFrame, abstracts: DataFrame | None = None) -> DataFrame:
    """(id, order_index, heading, normalized, text): the lines of lines(id, line, text) in five canonical buckets.

    Lines under one canonical heading come together in order wherever they stand; lines before any heading belong to the
    introduction, which an abstract (abstracts: id, abstract) opens.  Empty buckets are left out.
    """
    from ..functions.people import strip

    body = lines.withColumn("text", strip("text")).where("text <> ''").withColumn("_c", canonical_line("text"))
    walked = carried(body, F.col("_c").isNotNull(), F.col("_c"), "heading").where("_c is null")
    rows = walked.select("id", F.coalesce("heading", F.lit(ORDER[0])).alias("heading"), F.col("line").cast("long").alias("line"), "text")
    if abstracts is not None:
        head = abstracts.where("trim(abstract) <> ''").select("id", F.lit(ORDER[0]).alias("heading"), F.lit(-1).cast("long").alias("line"), F.concat(F.lit("### Abstract\n"), "abstract", F.lit("\n\n")).alias("text"))
        rows = rows.unionByName(head)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n\n")
    at = F.array_position(F.array(*map(F.lit, ORDER)), F.col("heading"))
    return rows.groupBy("id", "heading").agg(joined.alias("text")).select("id", at.cast("int").alias("order_index"), "heading", F.lower("heading").alias("normalized"), strip("text").alias("text"))


def section_words(sections: DataFrame, whole: DataFrame, least: int = 200, core: float = 0.15) -> DataFrame:
    """(id, heading, words): words of each of the five canonical sections, 0 for those a paper lacks.

    sections as `canonical_sections` gives them, whole(id, text).  Where a paper has over `least` words but its method, results
    and discussion have less than `core` of them, all words of its text are dealt out by usual shares, with a floor each.
    """
    words = lambda x: F.size(F.filter(F.split(F.coalesce(F.col(x), F.lit("")), r"\s+"), lambda w: w != ""))
    # Shares of the first four sections and least numbers of words of all five.
    shares, floors = [0.32, 0.18, 0.28, 0.14], [50, 30, 50, 30, 20]
    counted = sections.groupBy("id").pivot("heading", ORDER).agg(F.sum(words("text")))
    both = whole.select("id", words("text").alias("_tot")).join(counted, "id", "left").fillna(0, ORDER)
    total, middle = sum((F.col(f"`{h}`") for h in ORDER), F.lit(0)), sum((F.col(f"`{h}`") for h in ORDER[1:4]), F.lit(0))
    dealt = [F.floor(F.col("_tot") * s).cast("long") for s in shares]
    dealt.append(F.col("_tot") - sum(dealt, F.lit(0)))
    poor = (total > least) & (middle < total * core)
    each = [F.struct(F.lit(h).alias("heading"), F.when(poor, F.greatest(F.lit(floors[k]), dealt[k])).otherwise(F.col(f"`{h}`")).cast("long").alias("words")) for k, h in enumerate(ORDER)]
    return both.select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.*")


def hash_sections(docs: DataFrame) -> DataFrame:
    """(id, order_index, heading, text): the parts of docs(id, text) under `## ` headers that have a body, numbered."""
    from ..functions.people import strip

    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n(?=##\s+)"), strip), lambda p: p.startswith("## "))
    pairs = F.transform(parts, lambda p: F.struct(strip(F.substring(F.split_part(p, F.lit("\n"), F.lit(1)), F.lit(4), F.length(p))).alias("heading"), strip(F.when(F.instr(p, "\n") > 0, F.substring(p, F.instr(p, "\n"), F.length(p))).otherwise("")).alias("text")))
    return docs.select("id", F.posexplode(F.filter(pairs, lambda x: x["text"] != "")).alias("i", "x")).select("id", (F.col("i") + 1).alias("order_index"), "x.*")


def clean_text(x) -> Column:
    """A section's paragraphs without contact ones and short abstract stubs: broken words and lines joined, blanks before marks taken out."""
    from ..functions.people import filled, strip
    from ..functions.text import col

    raw = F.replace(F.replace(F.coalesce(col(x), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    contact = lambda p: p.contains("@") & p.rlike(r"\.edu|\.org|\.com|\.ac\.|\.net")
    stub = lambda p: F.lower(p).startswith("abstract:") & (F.size(F.split(p, r"\s+")) < 35)
    kept = F.filter(filled(F.split(raw, r"\n\s*\n")), lambda p: ~contact(p) & ~stub(p))
    joined = F.transform(kept, lambda p: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(\w+)-\n\s*(\w+)", "$1-$2"), r"\n", " "), r"[ \t]+", " "), r"\s+([.,;:!?])", "$1")))
    return F.array_join(F.filter(joined, lambda p: p != ""), "\n\n")


def clean_blocks(sections: DataFrame, text: str = "text") -> DataFrame:
    """sections with their text cleaned; those of which nothing is left go."""
    return sections.withColumn(text, clean_text(text)).where(F.col(text) != "")


def joined_titles(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """(paper_id, title): titles that break off, joined with the line after theirs up to its dot leader.

    titles(paper_id, block, title), lines(block, line, text).  A line is a title's when it is equal to it but for numbers at
    its start, blanks around it and case; the next line must end its text in three dots or more and a page.  The first such
    line counts.  Titles that are whole, or have no such line, are left out.
    """
    from ..functions.people import strip
    from ..functions.text import dangling

    following = F.lead("text").over(Window.partitionBy("block").orderBy("line"))
    rest = strip(F.regexp_extract("_n", r"^(.*?[^.\s])\s*\.{3,}\s*\d+", 1))
    own = lines.withColumn("_n", following).select("block", "line", strip(F.regexp_replace(strip("text"), r"^\d+\s*", "")).alias("_t"), rest.alias("_r")).where("_r <> '' and _t <> ''").where(dangling("_t"))
    asked = titles.where(dangling("title")).select("paper_id", "block", F.lower(strip("title")).alias("_k"))
    met = asked.join(own.withColumn("_k", F.lower("_t")), ["block", "_k"])
    best = met.groupBy("paper_id").agg(F.min_by(F.struct("_t", "_r"), "line").alias("x"))
    return best.select("paper_id", F.regexp_replace(F.concat_ws(" ", "x._t", "x._r"), r"\s+", " ").alias("title"))

"""Property extraction: one observation with evidence for each paper and property definition."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(papers: DataFrame, properties: DataFrame, observations: DataFrame) -> DataFrame:
    """(paper_id, property_id, version): cells with no extracted observation of the current version."""
    cells = papers.select("paper_id").crossJoin(F.broadcast(properties.select("property_id", "version")))
    done = observations.where("status = 'extracted'").select("paper_id", "property_id", "version")
    return cells.join(done, ["paper_id", "property_id", "version"], "left_anti")


def candidates(sections: DataFrame, headings: list[str]) -> DataFrame:
    """The sections with a wanted heading, or all sections of papers that have none."""
    wanted = F.col("heading").isin(headings)
    some = F.max(wanted).over(Window.partitionBy("paper_id"))
    return sections.withColumn("_w", wanted).withColumn("_s", some).where("_w or not _s").drop("_w", "_s")


def first_value(sections: DataFrame, property_id: str, allowed: list[str], terms: list[str]) -> DataFrame:
    """(paper_id, property_id, value, order_index, method, confidence, evidence).

    Sections in order; within one, allowed values as whole words before terms as substrings; the
    first hit wins.  Each section offers its best hit, and one min_by aggregate picks.
    """
    text = F.col("text")
    offers = [F.when(text.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}]){re.escape(v)}($|[^\p{{L}}\p{{N}}])"), F.struct(F.lit(i).alias("r"), F.lit(v).alias("v"), F.lit("allowed_value").alias("m"), F.lit(0.9).alias("c"))) for i, v in enumerate(allowed)]
    offers += [F.when(F.lower(text).contains(v.lower()), F.struct(F.lit(i + len(allowed)).alias("r"), F.lit(v).alias("v"), F.lit("text_term").alias("m"), F.lit(0.8).alias("c"))) for i, v in enumerate(terms)]
    best = sections.withColumn("_o", F.coalesce(*offers)).where("_o is not null")
    pick = F.min_by(F.struct("_o", "order_index", F.substring("text", 1, 200).alias("evidence")), "order_index")
    return best.groupBy("paper_id").agg(pick.alias("x")).select("paper_id", F.lit(property_id).alias("property_id"), F.col("x._o.v").alias("value"), "x.order_index",
                                                                F.col("x._o.m").alias("method"), F.col("x._o.c").alias("confidence"), "x.evidence")


def with_absent(papers: DataFrame, found: DataFrame, property_id: str) -> DataFrame:
    """An observation for every paper: extracted where found, else not_present with confidence 0."""
    return papers.select("paper_id").join(found, "paper_id", "left").select(
        "paper_id", F.lit(property_id).alias("property_id"), "value", F.when(F.col("value").isNull(), "not_present").otherwise("extracted").alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def grid(observations: DataFrame, properties: list[str]) -> DataFrame:
    """One row a paper, one column a property; the value list keeps it one job."""
    return observations.groupBy("paper_id").pivot("property_id", properties).agg(F.first("value"))


def first_location(sections: DataFrame, pattern: str) -> DataFrame:
    """(paper_id, percent, heading, term) of the first match in a paper's sections joined in order."""
    from .sections import offsets

    placed = offsets(sections, "paper_id", "order_index", "text")
    at = F.regexp_instr("text", F.lit(pattern))
    whole = F.sum(F.length("text") + 2).over(Window.partitionBy("paper_id")) - 2
    hits = placed.select("paper_id", "order_index", "heading", F.regexp_substr("text", F.lit(pattern)).alias("term"), (F.col("start") + at - 1).alias("pos"), whole.alias("total"), at.alias("at")).where("at > 0")
    return hits.groupBy("paper_id").agg(F.min_by(F.struct("pos", "total", "heading", "term"), "pos").alias("x")).select(
        "paper_id", F.round(F.col("x.pos") * 100.0 / F.greatest("x.total", F.lit(1)), 1).alias("percent"), "x.heading", "x.term")


def evidence_rows(observations: DataFrame) -> DataFrame:
    """One row per evidence item; an observation without any gives one blank row."""
    return observations.select("paper_id", "property_id", F.explode_outer("evidence").alias("evidence"))


# ---------------------------------------------------------------- tiers with reuse

#: A property definition as a JSON document: term lists are enough, an extractor of its own is not needed.
DEFINITION = ("id string, version string, label string, query struct<candidate_sections:array<string>,heading_terms:array<string>,text_terms:array<string>>, "
              "constraints struct<allowed_values:array<string>>, extraction struct<inference_allowed:boolean>")

_NONE = "cast(array() as array<string>)"


def definitions(raw: DataFrame, column: str = "definition") -> DataFrame:
    """Definitions (JSON texts) as properties: missing lists are empty, a missing version is 1.0.0, inference is off by default."""
    x = raw.select(F.from_json(column, DEFINITION).alias("x")).where("x.id is not null")
    part = lambda path, default: F.coalesce(F.col(f"x.{path}"), F.expr(default))
    return x.select(F.col("x.id").alias("property_id"), part("version", "'1.0.0'").alias("version"), part("label", "x.id").alias("label"), part("query.candidate_sections", _NONE).alias("candidate_sections"),
                    part("query.heading_terms", _NONE).alias("heading_terms"), part("query.text_terms", _NONE).alias("text_terms"), part("constraints.allowed_values", _NONE).alias("allowed_values"),
                    part("extraction.inference_allowed", "false").alias("inference_allowed"))


def fresh(properties: DataFrame, observations: DataFrame) -> DataFrame:
    """The observations that are kept: extracted by the current version of their property."""
    return observations.where("status = 'extracted'").join(properties.select("property_id", "version"), ["property_id", "version"], "left_semi")


def stale_cells(papers: DataFrame, properties: DataFrame, observations: DataFrame) -> DataFrame:
    """(paper_id, property_id): the cells of papers and properties without a fresh observation."""
    kept = fresh(properties, observations).select("paper_id", "property_id").distinct()
    # the grid of papers and definitions is what the operator fills; definitions are few
    return papers.select("paper_id").distinct().crossJoin(properties.select("property_id")).join(kept, ["paper_id", "property_id"], "left_anti")


def quoted(x: Column) -> Column:
    """A text as a pattern that matches it alone."""
    return F.regexp_replace(x, r"([^\p{L}\p{N}\s])", r"\\$1")


def whole_word(x: Column) -> Column:
    """A text as a pattern that matches it as whole words, whatever the case."""
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), quoted(x), F.lit(r"(?![\p{L}\p{N}_])"))


def evaluated(cells: DataFrame, sections: DataFrame, properties: DataFrame) -> DataFrame:
    """(paper_id, property_id, version, value, status, method, confidence, order_index, evidence) of each cell, all tiers in one pass.

    sections(paper_id, order_index, heading, roles array, text).  Candidates are the sections with a wanted role or a
    wanted term in the heading, or all sections where none is.  In their order the first hit wins: an
    allowed value as whole words (0.9), else a term anywhere (0.8); without a hit, and where the definition allows it, an
    inferred value from the first candidate (0.7); else not_present (0).  The sections of a cell are
    reduced by one aggregate; nothing but the cells asked for is looked at.  Of sections with one order_index any may win.
    """
    asked = cells.join(properties, "property_id").join(sections, "paper_id", "left")
    low, text = F.lower("text"), F.coalesce("text", F.lit(""))
    role = F.arrays_overlap(F.transform("candidate_sections", F.lower), F.transform(F.coalesce("roles", F.expr(_NONE)), F.lower))
    named = F.exists(F.transform("heading_terms", F.lower), lambda h: F.contains(F.lower(F.coalesce("heading", F.lit(""))), h))
    wanted = (F.size("candidate_sections") == 0) | role | named
    value = F.get(F.filter("allowed_values", lambda v: F.rlike(text, whole_word(v))), F.lit(0))
    term = F.get(F.filter("text_terms", lambda t: F.contains(F.coalesce(low, F.lit("")), F.lower(t))), F.lit(0))
    offer = F.coalesce(F.when(value.isNotNull(), F.struct(value.alias("v"), F.lit("controlled_vocabulary_match").alias("m"), F.lit(0.9).alias("c"))),
                       F.when(term.isNotNull(), F.struct(F.lower(term).alias("v"), F.lit("keyword_match").alias("m"), F.lit(0.8).alias("c"))))
    rows = asked.withColumns({"_w": F.coalesce(wanted, F.lit(False)) & F.col("order_index").isNotNull(), "_o": offer})
    hit = F.struct("_o", "order_index", F.substring("text", 1, 200).alias("e"))
    lead = F.struct("order_index", F.substring("text", 1, 300).alias("e"))
    first = lambda what, when: F.min_by(F.when(when, what), F.when(when, F.col("order_index")))
    some = F.col("_o").isNotNull()
    got = rows.groupBy("paper_id", "property_id").agg(F.max(F.struct("version", "label", "inference_allowed")).alias("p"), F.bool_or("_w").alias("_any"), first(hit, F.col("_w") & some).alias("_own"), first(hit, some).alias("_all"),
                                                      first(lead, F.col("_w")).alias("_own_lead"), first(lead, F.col("order_index").isNotNull()).alias("_all_lead"))
    best, head = F.when(F.col("_any"), F.col("_own")).otherwise(F.col("_all")), F.when(F.col("_any"), F.col("_own_lead")).otherwise(F.col("_all_lead"))
    got = got.withColumns({"b": best, "h": head}).withColumn("t", F.when(F.col("b").isNotNull(), "extracted").when(F.col("p.inference_allowed") & (F.coalesce("h.e", F.lit("")) != ""), "inferred").otherwise("not_present"))
    tier = lambda e, i, n: F.when(F.col("t") == "extracted", e).when(F.col("t") == "inferred", i).otherwise(n)
    return got.select("paper_id", "property_id", "p.version", tier(F.col("b._o.v"), F.concat(F.lit("Inferred: "), "p.label", F.lit(" from passage context")), F.lit(None)).alias("value"), F.col("t").alias("status"),
                      tier(F.col("b._o.m"), F.lit("prompted_analysis"), F.lit("rule_fallback")).alias("method"), tier(F.col("b._o.c"), F.lit(0.7), F.lit(0.0)).alias("confidence"),
                      tier(F.col("b.order_index"), F.col("h.order_index"), F.lit(None)).alias("order_index"), tier(F.col("b.e"), F.col("h.e"), F.lit(None)).alias("evidence"))


def extract(papers: DataFrame, sections: DataFrame, properties: DataFrame, observations: DataFrame) -> DataFrame:
    """An observation for each paper and property, with `reused`: fresh ones as they are, the others evaluated anew.

    observations has the columns of `evaluated`; of several fresh ones of a cell the largest row is kept.
    """
    columns = ["paper_id", "property_id", "version", "value", "status", "method", "confidence", "order_index", "evidence"]
    kept = fresh(properties, observations).join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    kept = kept.groupBy("paper_id", "property_id").agg(F.max(F.struct(*columns[2:])).alias("x")).select("paper_id", "property_id", "x.*", F.lit(True).alias("reused"))
    new = evaluated(stale_cells(papers, properties, observations), sections, properties).withColumn("reused", F.lit(False))
    return kept.unionByName(new)


def refresh(papers: DataFrame, sections: DataFrame, properties: DataFrame, folder: str, run: int) -> DataFrame:
    """The current observations after storing those of this run; only stale cells are evaluated and written.

    The store is append-only, a folder for each property and version, so a run writes as much as it computed and a
    changed definition leaves other properties' files alone; of a cell's observations the one of the largest
    run counts.  A run that is repeated writes under its own number again and changes nothing.
    """
    spark = papers.sparkSession
    schema = "paper_id long, value string, status string, method string, confidence double, order_index long, evidence string, property_id string, version string, run long"

    def stored() -> DataFrame:
        # the folder is made by the first write; an empty one is written so that it can always be read
        rows = spark.read.schema(schema).parquet(folder)
        last = rows.join(properties.select("property_id", "version"), ["property_id", "version"], "left_semi")
        columns = [c for c in rows.columns if c not in ("paper_id", "property_id")]
        return last.groupBy("paper_id", "property_id").agg(F.max_by(F.struct(*columns), "run").alias("x")).select("paper_id", "property_id", "x.*")
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    before = stored().where(F.col("run") < run).drop("run")
    new = evaluated(stale_cells(papers, properties, before), sections, properties).withColumn("run", F.lit(run).cast("long"))
    typed = new.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])
    # a folder of this run alone within each property and version: overwritten when the run is repeated
    typed.write.partitionBy("property_id", "version", "run").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    return stored()


# ---------------------------------------------------------------- evidence texts

# How a text of references begins, where acknowledgements follow, and how an entry begins.
REFERENCES = r"^\s*(?:#+\s*)?(?:References|REFERENCES|Bibliography|Citations)\s*"
THANKS_LINE = r"\n\s*(?:#+\s*)?(?:Acknowledgements?|ACKNOWLEDGEMENTS?)\s*\n"
THANKS = r"\b(?:Acknowledgements?|ACKNOWLEDGEMENTS?)\b"
ENTRY = r"^(?:\[\d+\]|\d+\.|\b[A-Z][a-zA-Z\-'\s]+,\s+[A-Z]\.|\b[A-Z][a-zA-Z\-'\s]+,\s+[A-Z][a-z]+)"


def split_references(text, late: float = 0.7, least: int = 15) -> Column:
    """The entries of a text of references, blanks squeezed, each over `least` letters.

    Acknowledgements on a line of their own end it, and the word anywhere once it stands behind `late` of the
    text.  An entry begins after a blank line or with an entry's start; the lines of a row are walked in
    place, so nothing is shuffled.  Null gives none.
    """
    from ..functions.people import let, strip

    raw = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), REFERENCES, "")

    def before(t: Column, pattern: str, behind: float = 0.0) -> Column:
        at = F.regexp_instr(t, F.lit(pattern))
        return F.when((at > 0) & (at - 1 > F.length(t) * behind), F.substring(t, F.lit(1), at - 1)).otherwise(t)

    def grouped(p: Column) -> Column:
        lines, starts = p["lines"], p["starts"]
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
        return F.zip_with(starts, ends, lambda a, b: F.array_join(F.filter(F.slice(lines, a + 1, b - a), lambda c: c != ""), " "))

    def marked(lines: Column) -> Column:
        flags = F.transform(lines, lambda c, i: F.when((i == 0) | (c == "") | c.rlike(ENTRY), i))
        return F.struct(lines.alias("lines"), F.filter(flags, lambda i: i.isNotNull()).alias("starts"))
    cut = let(let(raw, lambda t: before(t, THANKS_LINE, -1.0)), lambda t: before(t, THANKS, late))
    entries = let(let(F.transform(F.split(cut, "\n"), strip), marked), grouped)
    squeezed = F.transform(entries, lambda e: strip(F.regexp_replace(e, r"\s+", " ")))
    return F.filter(squeezed, lambda e: F.length(e) > least)


def theory_usage(papers: DataFrame, sections: DataFrame, strong: str, acronym: str, context: list[str], weak: str, cues: list[tuple[list[str], str]], other: str, principles: str, mention: str, shown: int = 180) -> DataFrame:
    """(paper_id, strength, usage, evidence): how each paper uses a theory, from its first telling sentence.

    papers(paper_id, title, abstract), sections(paper_id, order_index, heading, text).  A sentence is strong if it names the
    theory, or its acronym near a context word; weak if it has a weak mark.  The first strong sentence in order of
    sections decides, else the first weak one.  A strong one takes the wording of the first cue it has a word of, else `other`;
    a weak one `principles`; papers without either `mention`.  `{section}` stands for the heading.
    """
    from ..functions.text import sentences

    said = F.transform(sentences(F.coalesce("text", F.lit(""))), lambda s: F.trim(F.replace(s, F.lit("\n"), F.lit(" "))))
    near = lambda s: F.exists(F.array(*map(F.lit, context)), lambda w: F.contains(F.lower(s), w))
    is_strong = lambda s: s.rlike(strong) | (s.rlike(acronym) & near(s))
    own = sections.select("paper_id", "order_index", F.coalesce(F.nullif("heading", F.lit("")), F.lit("Main Text")).alias("heading"), said.alias("s"))
    own = own.withColumn("a", F.get(F.filter("s", is_strong), F.lit(0))).withColumn("b", F.when(F.col("a").isNull(), F.get(F.filter("s", lambda s: s.rlike(weak)), F.lit(0))))
    hit = F.struct(F.coalesce("a", "b").alias("s"), "heading", F.col("a").isNotNull().alias("strong"))
    best = own.where("a is not null or b is not null").groupBy("paper_id").agg(F.min_by(hit, F.struct(F.col("a").isNull(), "order_index")).alias("x"))
    low = F.lower("x.s")
    wording = F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(text)) for words, text in cues], F.lit(other))
    text = F.replace(F.when(F.col("x.strong"), wording).otherwise(F.lit(principles)), F.lit("{section}"), F.col("x.heading"))
    shown_part = F.concat(F.substring("x.s", 1, shown), F.when(F.length("x.s") > shown, F.lit("...")).otherwise(""))
    usage = F.when(F.col("x").isNull(), F.lit(mention)).otherwise(F.concat(text, F.lit(' Evidence: "'), shown_part, F.lit('"')))
    evidence = F.coalesce("x.s", F.nullif(F.substring("abstract", 1, 200), F.lit("")), F.col("title"))
    return papers.join(best, "paper_id", "left").select("paper_id", F.when(F.col("x").isNull(), "none").when(F.col("x.strong"), "strong").otherwise("weak").alias("strength"), usage.alias("usage"), evidence.alias("evidence"))


def match_explanation(title, abstract, keywords: list[str], shown: int = 2, long: int = 160, before: int = 40, after: int = 80) -> Column:
    """Which keywords title and abstract have as whole words, with the first sentences of the abstract that show it.

    A sentence over `long` letters is cut around its first match.  Null counts as empty.
    """
    from ..functions.people import let
    from ..functions.text import col, sentences

    words = F.array(*map(F.lit, keywords))
    t, a = F.coalesce(col(title), F.lit("")), F.coalesce(col(abstract), F.lit(""))

    def had(x: Column) -> Column:
        return F.filter(words, lambda k: F.rlike(x, whole_word(k)))
    listed = lambda ks: F.array_join(F.transform(ks, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")

    def cut(s: Column, k: Column) -> Column:
        at, size = F.regexp_instr(s, whole_word(k)), F.length(k)
        start, stop = F.greatest(at - before, F.lit(1)), F.least(at + size - 1 + after, F.length(s))
        body = F.substring(s, start, stop - start + 1)
        return F.when(F.length(s) <= long, s).otherwise(F.concat(F.when(start > 1, F.lit("...")).otherwise(""), body, F.when(stop < F.length(s), F.lit("...")).otherwise("")))

    def told(p: Column) -> Column:
        def shows(k: Column) -> Column:
            return let(F.get(F.filter(p["s"], lambda s: F.rlike(s, whole_word(k))), F.lit(0)), lambda s: F.when(s.isNotNull(), F.concat(F.lit('"'), cut(F.trim(s), k), F.lit('"'))))
        evidence = F.slice(F.array_distinct(F.filter(F.transform(p["a"], shows), lambda s: s.isNotNull())), 1, shown)
        parts = F.filter(F.array(F.when(F.size(p["t"]) > 0, F.concat(F.lit("Title explicitly mentions "), listed(p["t"]))), F.when(F.size(p["a"]) > 0, F.concat(F.lit("Abstract discusses "), listed(p["a"])))), lambda x: x.isNotNull())
        whole = F.concat(F.array_join(parts, "; "), F.lit("."), F.when(F.size(evidence) > 0, F.concat(F.lit(" Evidence: "), F.array_join(evidence, " "))).otherwise(""))
        return F.when(F.size(parts) == 0, F.lit("Matches target keywords in paper text.")).otherwise(whole)
    return let(F.struct(had(t).alias("t"), had(a).alias("a"), sentences(a).alias("s")), told)


#: Words of headings of reference sections, and the line that opens references in a whole text.
REFERENCE_HEADINGS = ["reference", "citation", "bibliography", "works cited"]
REFERENCE_LINE = r"(?:\n|^)\s*(?:#+\s*)?(?:References|REFERENCES|Bibliography|Citations)\s*(?:\n|$)"


def reference_text(sections: DataFrame) -> DataFrame:
    """(paper_id, refs): the text of each paper's references.

    sections(paper_id, order_index, heading, text).  The sections under a heading of references, joined in order; else the
    whole text from its line of references on; else the last section.
    """
    h = F.lower(F.coalesce("heading", F.lit("")))
    named = F.exists(F.array(*map(F.lit, REFERENCE_HEADINGS)), lambda t: F.contains(h, t))
    rows = sections.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_n", named)
    joined = lambda x: F.array_join(F.transform(x, lambda r: r["text"]), "\n")
    got = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "text", "_n"))).alias("s"))
    own, whole = F.filter("s", lambda r: r["_n"]), joined(F.col("s"))
    staged = got.select("paper_id", F.size(own).alias("n"), joined(own).alias("own"), whole.alias("whole"), F.element_at("s", -1)["text"].alias("last")).withColumn("at", F.regexp_instr("whole", F.lit(REFERENCE_LINE)))
    return staged.select("paper_id", F.when(F.col("n") > 0, F.col("own")).when(F.col("at") > 0, F.substring("whole", F.col("at"), F.length("whole"))).otherwise(F.col("last")).alias("refs"))


#: What a reference to a review looks like.
REVIEW_MARKS = [r"\breviews?\b", r"\bmeta-analys", r"\bsystematic review\b", r"\bscoping review\b", r"\bliterature review\b", r"\bsynthesis\b", r"\bsurvey\b", r"\bstate of the art\b", r"\breview of educational research\b",
                r"\bharvard educational review\b", r"\beducational research review\b", r"\bannual review\b", r"\beducational psychology review\b", r"\bacademy of management review\b", r"\breview of research in education\b"]


def review_references(references: Column, marks: list[str] | None = None, without: list[str] | None = None, least: int = 15) -> Column:
    """The references of a list (of `least` letters or more) with a mark of a review and none of the texts `without`, numbers stripped, each once."""
    mark = "(?i)" + "|".join(marks or REVIEW_MARKS)
    kept = F.filter(references, lambda r: (F.length(r) >= least) & r.rlike(mark) & ~F.exists(F.array(*map(F.lit, without or [chr(0)])), lambda w: F.contains(r, w)))
    return F.array_distinct(F.transform(kept, lambda r: F.trim(F.regexp_replace(r, r"^(?:\[\d+\]|\d+\.)\s*", ""))))

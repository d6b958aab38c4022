"""Titles and authors that got into each other: tests and repairs as column functions.

Blanks are ASCII whitespace without the vertical tab.  A null counts as an empty text everywhere here, so nothing is null that goes out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PREFIXES, col, re2

EDGES = r"^\s+|\s+$"

# Marks of reference lines, page furniture and bibliographies.
MARKER = r"^(<!--|-->|page:|http|https|doi:)"
LINK = r"\b(doi:\s*10\.\d{4,}|https?://\S+)"
CITED_NAME = r"^[A-Z][a-zA-Z\-]+,\s+[A-Z]\."
YEAR = r"\b(19\d\d|20\d\d)\b"
PAREN_YEAR = r"\([12]\d{3}\)"
PUBLISHED = r"\b(vol\.|pp\.|no\.|journal|proceedings|press|routledge|springer|ieee|elsevier|wiley)\b"
BACK_MATTER = r"^(references|acknowledgments|figure\s+\d|table\s+\d)"
BIBLIOGRAPHIC = r"(?i)\b(doi:|https?://|vol\.|pp\.|journal|routledge)\b"

# Shapes of names at the end of a title.
NAME = r"[A-Z][a-z]+(?:\s+[A-Z]\.|\s+[A-Z][a-z]+)+"
CHAIR = rf"(?i)\s+({NAME})\s*\((?:co-)?chair\)$"
TRAILING = rf"^(.*?)\s+(({NAME})(?:[,\s]+(?:and|&)?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)*)$"
PAGE_AND_NAME = r"\s+\d{2,4}\s+[A-Z][a-z]+.*$"
LEADS_ON = r"(?i)\b(and|or|in|of|for|with|to|by|at|on|from|a|an)\s*$"
UNFINISHED = r"(?i)\b(for|in|during|the|with|of|to|by|at|on|and|or|a|an|from|about|as|into|supported)\s*$"

# Words of titles that names do not have.
TITLE_WORDS = ["critical", "cognitive", "affective", "moments", "during", "problem", "solving", "learning", "education", "development", "scaffolding", "reasoning",
               "collaborative", "design", "analysis", "review", "study", "system", "technology", "artificial", "intelligence", "model", "assessment", "engaging",
               "engagement", "roles", "tools", "supporting", "climate", "changing", "unstructured", "reading", "club", "peer", "feedback", "generative", "practices",
               "exploration", "investigating", "understanding", "promoting", "fostering", "evaluating", "characterizing", "shaping", "building"]
HEADER_TITLE_WORDS = ["review", "analysis", "learning", "education", "framework", "study", "approach", "using", "toward", "towards"]
SUBTITLE_WORDS = ["with", "towards", "for", "using", "analytical", "interdisciplinary", "geometrical", "initial", "development"]

# Words of affiliations and places, by use.
AFFILIATIONS = ["university", "college", "school", "institute", "department", "laboratory", "lab", "united states", "los angeles", "new york", "california", "boston",
                "chicago", "germany", "canada", "china", "uk", "netherlands", "spain", "france", "australia", "japan", "korea", "gmbh", "inc", "corp", "foundation",
                "center", "centre", "faculty", "educational testing service", "learnology labs", "mindset copilot", "district", "drexel", "ucla"]
MORE_AFFILIATIONS = ["llc", "council", "mit", "stanford", "harvard", "carnegie mellon", "georgia institute of technology", "raspberry pi foundation", "google research",
                     "google deepmind", "impact accelerator", "phantom llc", "massachusetts institute of technology", "new york jobs ceo council", "digital promise",
                     "hadassah academic college jerusalem"]
HEADER_PLACES = ["university", "college", "school", "institute", "department", "laboratory", "lab", "germany", "united states", "canada", "china", "uk", "netherlands",
                 "spain", "france", "australia", "japan", "korea", "gmbh", "inc."]
NAME_PLACES = ["university", "college", "school", "institute", "department", "lab", "gmbh", "inc", "united states", "germany", "canada", "china", "uk", "netherlands",
               "spain", "france", "australia", "japan", "korea"]
FIRST_PLACES = ["university", "college", "school", "institute", "department", "lab", "aeres"]
ROLES = r"(?i)\b(co-chair|discussant|chair|organizer|first authorship)\b"
CONNECTOR_START = r"(?i)^(and|in|the|of|for|with|through|to|from|by|on|at|during|across|within|towards|toward|into)\b"


def strip(x) -> Column:
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), re2(EDGES), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def holds(x: Column, words: list[str]) -> Column:
    """Whether x contains any of the words, anywhere."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


def filled(parts: Column) -> Column:
    """The stripped parts that are not empty."""
    return F.filter(F.transform(parts, strip), lambda p: p != "")


# ---------------------------------------------------------------- titles

def reference_line(x) -> Column:
    """Whether a line belongs to references, page furniture or back matter; a blank line does."""
    def test(s: Column) -> Column:
        low = F.lower(s)
        dated = low.rlike(YEAR) & (s.rlike(PAREN_YEAR) | low.rlike(PUBLISHED) | s.contains(","))
        return (s == "") | low.rlike(MARKER) | low.rlike(LINK) | s.rlike(CITED_NAME) | dated | low.rlike(BACK_MATTER)
    return let(strip(x), test)


def without_trailing_authors(x) -> Column:
    """A title of 20 letters or more without a chair's signature, a list of names or a page and a name at its end.

    Names that hold a word of TITLE_WORDS stay; a list needs a comma, `and` or `&`, and what remains at least
    ten letters that do not lead on.  A text over 4,000 letters is no title and stays as it is.
    """
    def names(s: Column) -> Column:
        head, tail = strip(F.regexp_extract(s, TRAILING, 1)), F.regexp_extract(s, TRAILING, 2)
        worded = F.exists(F.split(F.lower(tail), r"\s+"), lambda w: w.isin(TITLE_WORDS))
        listed = tail.contains(",") | tail.contains(" and ") | tail.contains("&")
        return (F.when((tail != "") & worded, s).when((tail != "") & (F.length(head) >= 10) & ~head.rlike(LEADS_ON) & listed, head)
                .otherwise(strip(F.regexp_replace(s, PAGE_AND_NAME, ""))))
    text = F.coalesce(col(x), F.lit(""))
    return F.when(~F.length(text).between(20, 4000), text).otherwise(let(strip(F.regexp_replace(text, CHAIR, "")), names))


def without_repeat(x) -> Column:
    """A title without the longest run of final words (two at least, half at most) that stands before them, prefixes aside."""
    def cut(words: Column) -> Column:
        def stands(n: Column) -> Column:
            tail, head = (F.lower(F.array_join(p, " ")) for p in (F.slice(words, F.size(words) - n + 1, n), F.slice(words, 1, F.size(words) - n)))
            return F.contains(head, tail) | F.contains(F.regexp_replace(head, f"({PREFIXES})", ""), F.regexp_replace(tail, f"^({PREFIXES})", ""))
        sizes = F.when(F.size(words) >= 4, F.sequence(F.floor(F.size(words) / 2).cast("int"), F.lit(2), F.lit(-1)))
        longest = F.get(F.filter(sizes, stands), F.lit(0))
        return F.coalesce(F.array_join(F.slice(words, 1, F.size(words) - longest), " "), strip(x))
    return let(F.split(strip(x), r"\s+"), cut)


def clean_title(x) -> Column:
    """A title without repeated phrase, trailing names and final marks."""
    return F.regexp_replace(without_trailing_authors(without_repeat(x)), r"[\s:;,.]+$", "")


# ---------------------------------------------------------------- authors

def split_names(x, marks: str = ",") -> Column:
    """The names of a text as a list."""
    return filled(F.split(F.coalesce(col(x), F.lit("")), f"[{marks}]"))


def struct_names(x, *fields: str) -> Column:
    """The first field that is not empty of each struct of a list."""
    return filled(F.transform(col(x), lambda s: F.coalesce(*[F.nullif(s[f], F.lit("")) for f in fields], F.lit(""))))


def sanitised(names: Column, affiliations: list[str] | None = None, fragments: list[str] | None = None) -> Column:
    """A list of names without affiliations (whole words), addresses, numbers, fragments and repeats."""
    words = r"\b(" + "|".join(affiliations or AFFILIATIONS) + r")\b"

    def person(n: Column) -> Column:
        low = F.lower(n)
        return (F.length(low) >= 2) & ~low.rlike(words) & ~low.rlike(r"@|http|\d") & ~low.isin(list(fragments or [""]))
    return F.array_distinct(F.filter(filled(names), person))


def spilled(author, title) -> Column:
    """Whether an author is a piece of the title.

    It ends the title, or its last two words do, or it begins with a connecting word or has three words and stands in the title.
    """
    plain = lambda x: strip(F.regexp_replace(F.lower(strip(x)), "[^a-z0-9 ]", ""))

    def test(p: Column) -> Column:
        a, t, raw = p["a"], p["t"], p["raw"]
        aw, tw = F.split(a, r"\s+"), F.split(t, r"\s+")
        both = (F.size(aw) >= 2) & (F.size(tw) >= 2)
        last = F.when(both, F.slice(aw, -2, 2) == F.slice(tw, -2, 2)).otherwise(False)
        inside = F.contains(t, a) & (raw.rlike(CONNECTOR_START) | (F.size(aw) >= 3))
        return p["long"] & (a != "") & (t != "") & (F.endswith(t, a) | last | inside)
    return let(F.struct(plain(author).alias("a"), plain(title).alias("t"), strip(author).alias("raw"), ((F.length(strip(author)) >= 3) & (F.length(strip(title)) >= 5)).alias("long")), test)


def no_person(author) -> Column:
    """Whether an author is an affiliation, an address, has a digit or fewer than two letters."""
    low = F.lower(strip(author))
    return (F.length(low) < 2) | low.rlike(r"@|http|\d") | holds(low, AFFILIATIONS + MORE_AFFILIATIONS)


def trimmed_name(author) -> Column:
    """Without a leading `and` and final marks."""
    return strip(F.regexp_replace(F.regexp_replace(strip(author), r"(?i)^(?:and|&)\s+", ""), r"[;,.]+$", ""))


def clean_authors(title, names, registered=None) -> Column:
    """The registered names that are persons and no pieces of the title, if there are any, else those among `names`.

    Names are split at commas and semicolons and trimmed; repeats go.
    """
    def kept(n: Column) -> Column:
        return F.filter(n, lambda a: (a != "") & ~spilled(a, title) & ~no_person(a))
    parts = F.flatten(F.transform(F.coalesce(col(names), F.array().cast("array<string>")), lambda n: F.split(F.coalesce(n, F.lit("")), "[,;]")))
    own = kept(F.array_distinct(F.transform(parts, trimmed_name)))
    if registered is None:
        return own
    known = kept(F.transform(F.coalesce(col(registered), F.array().cast("array<string>")), trimmed_name))
    return F.when(F.size(known) > 0, known).otherwise(own)


# ---------------------------------------------------------------- lines of a first page

def text_lines(x) -> Column:
    """The stripped lines of a text that are not empty."""
    return filled(F.split(F.coalesce(col(x), F.lit("")), "\n"))


def _upto(lines: Column, stop: Callable[[Column], Column]) -> Column:
    """The lines before the first that stops."""
    first = F.array_position(F.transform(lines, stop), True)
    return F.when(first > 0, F.slice(lines, 1, F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(lines)


def header(section, venues: str = "cscl|icls|isls", first: int = 20) -> Column:
    """struct(title, names): what the first lines of a paper say, before its abstract; each null where nothing is found.

    Dot leaders, numbers at the start, venue lines, furniture and reference lines go.  From the first line with an
    address, a place or a role on, lines are authors'; so is a last title line with a comma and a capital but no
    word of a title.  Names have two to four words.
    """
    def bare(line: Column) -> Column:
        return strip(F.regexp_replace(strip(F.regexp_replace(line, r"\.{3,}\s*\d+$", "")), r"^\d+\s*", ""))

    def wanted(c: Column) -> Column:
        low = F.lower(c)
        return (c != "") & ~low.rlike(rf"^({venues})\s*\d+") & ~low.startswith("proceedings") & ~low.startswith("©") & ~reference_line(c)

    def signed(line: Column) -> Column:
        return line.contains("@") | holds(F.lower(line), HEADER_PLACES) | line.rlike(ROLES)

    def split(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, signed), True)
        n = F.when(at > 0, at - 1).otherwise(F.size(lines)).cast("int")
        last = F.get(lines, n - 1)
        moves = (n > 1) & last.rlike(r"\p{Lu}") & last.contains(",") & ~holds(F.lower(last), HEADER_TITLE_WORDS)
        return let(F.when(F.coalesce(moves, F.lit(False)), n - 1).otherwise(n), lambda k: F.struct(F.slice(lines, 1, k).alias("t"), F.slice(lines, k + 1, F.size(lines)).alias("a")))

    def joined(p: Column) -> Column:
        title = strip(F.regexp_replace(F.regexp_replace(F.array_join(p["t"], " "), r"(\w+)-\s+(\w+)", "$1-$2"), r"\s+", " "))
        chunks = F.filter(split_names(F.array_join(p["a"], ", "), ",;"), lambda c: ~c.contains("@") & ~holds(F.lower(c), NAME_PLACES))
        names = F.transform(chunks, lambda c: strip(F.regexp_replace(strip(F.regexp_replace(c, r"\s*\([^)]*\)", "")), r"\*+$", "")))
        people = F.array_distinct(F.filter(names, lambda c: (c != "") & F.size(F.split(c, r"\s+")).between(2, 4)))
        return F.struct(let(title, lambda t: F.when((t != "") & ~reference_line(t) & (F.length(t) <= 200), t)).alias("title"), F.when(F.size(people) > 0, F.array_join(people, ", ")).alias("names"))
    lines = F.filter(F.transform(F.slice(text_lines(section), 1, first), bare), wanted)
    return let(let(_upto(lines, lambda c: F.lower(c).startswith("abstract")), split), joined)


def author_lines(lines: Column) -> Column:
    """The names in the lines between a paper's title and its abstract: no digit, address or university, two words at least."""
    before = F.array_position(F.transform(lines, lambda c: F.lower(c).rlike("^abstract:?")), True)
    own = F.when(before > 1, F.slice(lines, 2, F.greatest(before - 2, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<string>"))
    parts = filled(F.flatten(F.transform(own, lambda c: F.split(c, "[,;]"))))
    return F.filter(parts, lambda p: ~p.rlike(r"\d|@") & ~F.lower(p).contains("university") & (F.size(F.split(p, r"\s+")) >= 2))


#: Words that end an abstract.
AFTER_ABSTRACT = r"(?i)^(keywords|introduction|background|methods?|1\.)"


def abstract_lines(lines: Column) -> Column:
    """The abstract from its heading line to the next heading word, joined; null without a heading."""
    at = F.array_position(F.transform(lines, lambda c: c.rlike("(?i)^abstract:?")), True)

    def body(rest: Column) -> Column:
        first = strip(F.regexp_replace(F.get(rest, F.lit(0)), "(?i)^abstract:?", ""))
        after = _upto(F.slice(rest, 2, F.size(rest)), lambda c: c.rlike(AFTER_ABSTRACT))
        return strip(F.array_join(F.concat(F.filter(F.array(first), lambda x: x != ""), after), " "))
    return F.when(at > 0, let(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.size(lines)), body))


#: How an abstract begins and what follows it, and paragraphs that are none.
ABSTRACT = r"(?is)\babstract\s*[:.\-]?\s+(.+?)(?:\n\s*(?:keywords|introduction|\d+\.|\b(?:theoretical|background)\b)|\n\n[a-z]|$)"
NO_ABSTRACT = r"(?i)^(?:cscl|icls|isls|figure|table|keywords|introduction)"


def found_abstract(text, least: int = 60, most: int = 1500) -> Column:
    """The abstract of a first section: its marked block of more than `least` letters, else the first long paragraph; null without either."""
    raw = F.coalesce(col(text), F.lit(""))
    block = strip(F.regexp_extract(raw, re2(ABSTRACT), 1))
    paragraph = F.get(F.filter(F.transform(F.split(raw, "\n\n"), strip), lambda p: (F.length(p) > 100) & ~p.rlike(re2(NO_ABSTRACT))), F.lit(0))
    unwrapped = lambda x: strip(F.regexp_replace(F.regexp_replace(F.array_join(text_lines(x), " "), re2(r"(\b\w+)\s+-\s*(\w+\b)"), "$1-$2"), re2(r"\s+"), " "))
    return let(F.when(F.length(block) > least, F.substring(block, 1, most)).otherwise(F.substring(paragraph, 1, most)), lambda x: F.when(x.isNotNull(), unwrapped(x)))


#: Marks of an author line.
AUTHOR_MARKS = "@|University|Institute|College|,"


def found_authors(text, nobody: str, first: int = 10, most: int = 100) -> Column:
    """The first of the first lines with a mark of authors, without addresses and brackets, under `most` letters; else `nobody`."""
    lines = F.filter(F.slice(text_lines(text), 1, first), lambda c: c.rlike(AUTHOR_MARKS))
    bare = F.transform(lines, lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\w.-]+@[\w.-]+", ""), r"\([^)]*\)", ""), r"^[\s,;]+|[\s,;]+$", ""))
    return F.coalesce(F.get(F.filter(bare, lambda c: (c != "") & (F.length(c) < most)), F.lit(0)), F.lit(nobody))

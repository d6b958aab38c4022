"""Rules that name things: paper types, conferences, headings and roles; column functions with their lists as parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .people import filled, let, strip
from .text import col

# Marks of chaired sessions and of symposia.
CHAIRED = r"(?i)(?:\(co-chairs?\)|\(chairs?\)|\(organizers?\)|\(discussants?\)|\(session chair\)|\bco-chair\b|\bsession chair\b)"
SYMPOSIUM = r"(?i)\b(?:in this symposium|this symposium brings together|structured poster symposium|this symposium proposes|this symposium addresses|in this structured poster session)\b"


def text(x) -> Column:
    return F.coalesce(col(x), F.lit(""))


def chaired(title, section, paper_type, authors, first_section, abstract, opening: int = 800, abstract_opening: int = 400) -> Column:
    """Whether a paper is a symposium or a chaired session, by any of its type, section, title, authors, first section and abstract."""
    start = F.substring(text(first_section), 1, opening)
    people = F.exists(F.coalesce(col(authors), F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")).rlike(CHAIRED))
    return (F.lower(strip(paper_type)).isin("symposium") | F.lower(strip(section)).isin("symposia", "symposium") | text(title).rlike(r"(?i)\b(?:symposium|symposia)\b") | people
            | start.rlike(CHAIRED) | start.rlike(SYMPOSIUM) | F.substring(text(abstract), 1, abstract_opening).rlike(SYMPOSIUM))


def type_of_pages(pages, whole, title, abstract, authors, known_type, opening: int = 800, longer: int = 1200) -> Column:
    """Type by markers of a symposium near the start of the whole text, else by the number of pages."""
    marked = (F.substring(text(whole), 1, opening).rlike(CHAIRED) | text(authors).rlike(CHAIRED) | F.substring(text(whole), 1, longer).rlike(SYMPOSIUM) | text(abstract).rlike(SYMPOSIUM)
              | F.lower(text(title)).contains("symposium") | (F.lower(text(known_type)) == "symposium"))
    n = F.coalesce(col(pages), F.lit(0))
    return F.when(marked, "Symposium").when(n >= 6, "Full Paper").when(n >= 3, "Short Paper").otherwise("Poster")


def conference_of(citation, doi, default, venues: dict[str, tuple[str, str]]) -> Column:
    """The venue of a paper: by DOI, by the clause `in ... proceedings of ...`, by name in the citation, by the default's text.

    venues: acronym -> (part of its DOIs, its full name), in order of preference; the last one is the answer where nothing tells.
    """
    cited, names = text(citation), "|".join(v.lower() for v in venues)
    clause = F.upper(F.regexp_extract(cited, rf"(?i)\bin\s+.*?proceedings\s+of.*?\b({names})\b", 1))
    tests = [(F.lower(text(doi)).contains(part), v) for v, (part, _) in venues.items()]
    tests += [(clause == v.upper(), v) for v in venues]
    tests += [(cited.rlike(rf"(?i)\b{v}\s*\d{{4}}\b") | cited.rlike(rf"(?i)\b{name}\b"), v) for v, (_, name) in venues.items()]
    tests += [(F.lower(text(default)).contains(v.lower()), v) for v in venues]
    return F.coalesce(*[F.when(t, F.lit(v)) for t, v in tests], F.lit(list(venues)[-1]))


# ---------------------------------------------------------------- headings

def roles_of(heading, aliases: dict[str, list[str]]) -> Column:
    """All roles with an alias that is the heading or one of its words, in the order of the roles; numbering is ignored."""
    def found(h: Column) -> Column:
        words = F.split(h, r"\s+")
        return F.filter(F.array(*[F.when(F.exists(F.array(*[F.lit(a.lower()) for a in names]), lambda a: (a == h) | F.array_contains(words, a)), F.lit(role)) for role, names in aliases.items()]), lambda r: r.isNotNull())
    return let(strip(F.regexp_replace(F.lower(strip(heading)), r"^[\d.\s\-:]+", "")), found)


#: Groups of a table of contents, and the headings that stand for them.
TOC_GROUPS = {"Keynotes": ["keynote", "keynotes", "keynote addresses"], "Special Session": ["special session", "special sessions", "invited session", "invited sessions"],
              "Interactive Tools and Demos": ["interactive tools and demos", "interactive tools", "demos", "demos and tools"], "Pre-Conference Workshops": ["pre-conference workshops", "pre-conference workshop", "workshops", "workshop"],
              "Community Workshops": ["community workshops", "community workshop"], "Early Career Workshops": ["early career workshops", "early career workshop", "early career"],
              "Doctoral Consortium": ["doctoral consortium", "doctoral consortium papers"], "Long Papers": ["long paper", "long papers", "full paper", "full papers", "long paper sessions"],
              "Short Papers": ["short paper", "short papers", "short paper sessions"],
              "Practise-Oriented Papers": ["practise-oriented paper", "practise-oriented papers", "practice-oriented paper", "practice-oriented papers", "practise oriented papers", "practice oriented papers"],
              "Posters": ["poster", "posters", "poster sessions", "poster presentations", "posters and late breaking results"], "Symposia": ["symposium", "symposia", "symposium sessions"],
              "Panels": ["panel", "panels", "roundtables", "roundtable"]}


def title_case(x) -> Column:
    """Every run of letters with a capital first letter and small ones after it."""
    parts = F.split(F.lower(col(x)), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def toc_group(heading, groups: dict[str, list[str]] | None = None) -> Column:
    """The group of a contents heading, else the heading in title case."""
    low = F.lower(strip(heading))
    return F.coalesce(*[F.when(low.isin(names), F.lit(g)) for g, names in (groups or TOC_GROUPS).items()], title_case(strip(heading)))


def display_name(heading, normalised, is_abstract, is_introduction, names: dict[str, str], long: int = 35, short: int = 30) -> Column:
    """A section's name to show: numbers and bullets go; a long or sentence-like heading gives way to what stands before its colon, else to the normalised name."""
    n = F.lower(text(normalised))
    known = F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in names.items()], F.lit(None).cast("string")) if names else F.lit(None).cast("string")

    def shown(h: Column) -> Column:
        head = strip(F.split_part(h, F.lit(":"), F.lit(1)))
        wordy = (F.length(h) > long) | h.endswith(":") | h.endswith("(") | h.contains(".") | h.contains("?")
        fits = h.contains(":") & (F.length(F.split_part(h, F.lit(":"), F.lit(1))) <= short) & (F.length(head) >= 3) & ~F.lower(head).startswith("poster")
        fall = F.coalesce(known, F.when(n != "", title_case(text(normalised))), F.lit("Main Body"))
        return F.when(wordy & fits, head).when(wordy, fall).when(h != "", h).otherwise(F.coalesce(known, F.lit("Main Body")))
    raw = strip(heading)
    bare = strip(F.regexp_replace(strip(F.regexp_replace(raw, r"^[0-9]+[.\s\-]+", "")), r"^[●*\-]\s*", ""))
    intro = col(is_introduction) | F.lower(raw).isin("abstract & introduction", "abstract and introduction")
    return F.when(col(is_abstract), "Abstract").when(intro, "Introduction").otherwise(let(bare, shown))


# ---------------------------------------------------------------- finding texts

def whole_sentences(x, pattern: str) -> Column:
    """The stretches between final marks that hold the pattern and end in a mark, blanks squeezed, each once, in order."""
    # cut first, then tested: a search for stretches would take the square of the length of a text without marks
    found = F.filter(F.split(text(x), r"(?<=[.!?])"), lambda s: s.rlike(r"[.!?]$") & s.rlike(rf"\b(?:{pattern})\b"))
    return F.array_distinct(filled(F.transform(found, lambda s: F.regexp_replace(s, r"\s+", " "))))


def split_sentences(x, least: int = 0) -> Column:
    return F.filter(filled(F.split(text(x), r"(?<=[.!?])\s+")), lambda s: F.length(s) > least)


def callouts(whole, abstract, patterns: list[str], label: str, context: str, nothing: str, shown: int = 3) -> Column:
    """The first sentences with the patterns, pattern by pattern; else the first two of the abstract; else a fixed text."""
    found = F.slice(F.array_distinct(F.concat(*[whole_sentences(whole, f"(?i:{p})") for p in patterns])), 1, shown)
    two = F.array_join(F.slice(split_sentences(abstract, 25), 1, 2), " ")
    cut = let(two, lambda t: F.when(F.length(t) > 200, F.concat(F.substring(t, 1, 195), F.lit("..."))).otherwise(t))
    quoted = let(found, lambda h: F.array_join(F.transform(h, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), " | "))
    return let(quoted, lambda q: F.when(q != "", F.concat(F.lit(label), q)).when(two != "", F.concat(F.lit(context), F.lit('"'), cut, F.lit('"'))).otherwise(F.lit(nothing)))


def named_terms(whole, pattern: str, default: str) -> Column:
    """The distinct terms of a text in title case, in order of appearance."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text(whole), F.lit(rf"(?i)\b({pattern})\b"), F.lit(1)), title_case))
    return F.coalesce(F.nullif(F.array_join(found, ", "), F.lit("")), F.lit(default))


def framework_text(whole, abstract, tools: str, methods: str, findings: list[str], defaults: tuple[str, str, str], most: int = 220, cut: int = 215) -> Column:
    """Framework, method and findings of a paper in one text; a second finding counts when it is not the first one's sentence."""
    first, second = (F.get(whole_sentences(whole, f"(?i:{p})"), F.lit(0)) for p in findings)
    last = F.element_at(F.concat(F.array(F.lit(None).cast("string")), split_sentences(abstract, 20)), -1)

    def joined(p: Column) -> Column:
        more = F.when(p["b"].isNotNull() & (p["a"].isNull() | ~F.contains(p["a"], p["b"])), p["b"])
        both = F.concat_ws(" ", p["a"], more)
        found = F.when(both != "", both).otherwise(F.coalesce(p["c"], F.lit(defaults[2])))
        return let(found, lambda f: F.when(F.length(f) > most, F.concat(F.substring(f, 1, cut), F.lit("..."))).otherwise(f))
    finding = let(F.struct(first.alias("a"), second.alias("b"), last.alias("c")), joined)
    return F.concat(F.lit("**Framework/Tool**: "), named_terms(whole, tools, defaults[0]), F.lit(". **Method**: "), named_terms(whole, methods, defaults[1]), F.lit(". **Key Findings**: "), finding)


def facets(whole, rules: list[tuple[str, str, str, str, str]]) -> Column:
    """A text with one clause a facet: (name, cue pattern, terms pattern, text with a cue, text without one); terms found replace the text."""
    def clause(name: str, cue: str, terms: str, some: str, none: str) -> Column:
        found = F.array_distinct(F.transform(F.regexp_extract_all(text(whole), F.lit(rf"(?i)\b({terms})\b"), F.lit(1)), F.lower))
        said = F.when(~text(whole).rlike(rf"(?i)\b({cue})\b"), F.lit(none)).when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(F.lit(some))
        return F.concat(F.lit(f"**{name}**: "), F.upper(F.substring(said, 1, 1)), F.lower(F.substring(said, F.lit(2), F.length(said))), F.lit("."))
    return F.concat_ws(" ", *[clause(*r) for r in rules])


def paradigm(title, abstract, chain: list[tuple[str, str, str]], other: tuple[str, str], topic: str, most: int = 190) -> tuple[Column, Column, Column]:
    """(paradigm, quote, text): the first pattern of the chain that title and abstract have, and the longest sentence of the abstract on the topic (the first of equals), else the first of the title or the title itself."""
    whole = F.concat(text(title), F.lit(". "), text(abstract))
    about = lambda ss: F.filter(ss, lambda s: s.rlike(rf"(?i)\b({topic})\b"))
    ranked = F.array_sort(F.transform(about(split_sentences(abstract)), lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    best = F.coalesce(F.get(ranked, F.lit(0))["s"], F.get(about(split_sentences(whole)), F.lit(0)), text(title))
    quote = let(strip(F.replace(best, F.lit("\n"), F.lit(" "))), lambda q: F.when(F.length(q) > most, F.concat(F.substring(q, 1, most - 3), F.lit("..."))).otherwise(q))
    pick = lambda k: F.coalesce(*[F.when(whole.rlike(f"(?i){c[0]}"), F.lit(c[k])) for c in chain], F.lit(other[k - 1]))
    return pick(1), quote, F.concat(F.lit("**"), pick(1), F.lit("**: "), pick(2), F.lit(' Evidence: "'), quote, F.lit('"'))


def matched_keywords(whole, families: list[tuple[str, str]], listed: dict[str, Column], default: str) -> Column:
    """The names of the families that a paper belongs to by list or by pattern, joined; the default where there is none."""
    hits = F.array(*[F.when(F.coalesce(listed[n], F.lit(False)) | text(whole).rlike(rf"(?i)\b({p})\b") if n in listed else text(whole).rlike(rf"(?i)\b({p})\b"), F.lit(n)) for n, p in families])
    return F.coalesce(F.nullif(F.array_join(hits, ", "), F.lit("")), F.lit(default))


def five_keywords(title, abstract, given: Column, patterns: list[str], stop: str, most: int = 5) -> Column:
    """Given keywords in title case without the stop value and repeats (whatever the case), then the patterns that title or abstract contain, `most` in all."""
    low = F.lower(F.concat(text(title), F.lit(" "), text(abstract)))
    own = F.filter(F.transform(filled(F.coalesce(given, F.array().cast("array<string>"))), title_case), lambda k: F.lower(k) != stop.lower())
    known = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(low, F.lower(p)))
    all_ = F.concat(own, known)
    return let(F.transform(all_, F.lower), lambda keys: F.slice(F.filter(F.transform(all_, lambda k, i: F.when(F.array_position(keys, F.lower(k)) == i + 1, k)), lambda k: k.isNotNull()), 1, most))


def short_summary(title, abstract, finding: list[str], relevance: list[str]) -> Column:
    """Objective, finding and relevance sentences of an abstract in one text of about fifty words."""
    cue = lambda s, words: reduce(Column.__or__, [F.contains(F.lower(s), F.lit(w)) for w in words])
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")

    def built(ss: Column) -> Column:
        objective = F.coalesce(F.get(ss, F.lit(0)), text(title))
        rest = F.slice(ss, 2, F.greatest(F.size(ss) - 1, F.lit(0)))
        found = F.coalesce(F.get(F.filter(rest, lambda s: cue(s, finding)), F.lit(0)), F.get(rest, F.lit(0)))
        useful = F.get(F.filter(ss, lambda s: cue(s, relevance)  & (s != objective) & (found.isNull() | (s != found))), F.lit(0))
        whole = F.concat_ws(" ", F.concat(F.lit("**RQ/Objective**: "), objective), F.concat(F.lit("**Finding**: "), found), F.concat(F.lit("**Relevance**: "), useful))
        return let(strip(whole), lambda c: F.when(F.size(words(c)) > 60, F.concat(F.array_join(F.slice(words(c), 1, 52), " "), F.lit("...")))
                   .when((F.size(words(c)) < 35) & (F.size(words(text(abstract))) > 35), F.concat(F.array_join(F.slice(words(text(abstract)), 1, 50), " "), F.lit("..."))).otherwise(c))
    return let(split_sentences(abstract), built)


# ---------------------------------------------------------------- cited reviews

def cited_title(reference, journals: list[str]) -> Column:
    """The title in a reference: in quotes (unless it is a journal's), after a year in brackets, after a bare year, else the whole."""
    bare = strip(F.regexp_replace(text(reference), r"^(?:\[\d+\]|\d+\.)\s*", ""))

    def pick(r: Column) -> Column:
        q = strip(F.regexp_extract(r, "[\"“']([^\"”']{8,250})[\"”']", 1))
        a = F.regexp_replace(F.regexp_extract(r, r"\(\d{4}[a-z]?\)[.,]?\s*([^.?!]{8,250}[.?!])", 1), r"^[ .?!]+|[ .?!]+$", "")
        y = F.regexp_replace(F.regexp_extract(r, r"\b(?:19\d\d|20\d\d)[a-z]?[.,]?\s+([^.?!]{8,250}[.?!])", 1), r"^[ .?!]+|[ .?!]+$", "")
        no_journal = ~F.exists(F.array(*map(F.lit, journals)), lambda j: F.contains(F.lower(q), j))
        return F.when((F.length(q) > 10) & no_journal, q).when((a != "") & ~a.rlike(r"^[A-Z][a-z]+,\s+[A-Z]\."), a).when(y != "", y).otherwise(r)
    return let(bare, pick)


def names_review(title, journals: list[str]) -> Column:
    """Whether a title has the word review(s) outside the names of journals that have it."""
    word = r"(?i)\breviews?\b"
    rest = [F.when(F.contains(F.lower(text(title)), F.lit(j)), F.replace(F.lower(text(title)), F.lit(j), F.lit("")).rlike(word)).otherwise(True) for j in journals]
    return text(title).rlike(word) & reduce(Column.__and__, rest, F.lit(True))


def first_seen(blobs: Column, names: list[str], default: str) -> Column:
    """The names that a list of texts has as whole words, by first text, then in the order of the names; the default alone where there is none."""
    found = F.transform(blobs, lambda b: F.filter(F.array(*map(F.lit, names)), lambda n: F.rlike(text(b), F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), F.regexp_replace(n, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}_])")))))
    return let(F.array_distinct(F.flatten(found)), lambda d: F.when(F.size(d) > 0, d).otherwise(F.array(F.lit(default))))

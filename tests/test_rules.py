"""Types, conferences, headings, canonical sections, audits, page records and finding texts on small cases."""

import pytest
from lectern.functions import people as P
from lectern.functions import rules as X
from lectern.operators import extraction, quality, sections
from lectern.sources import pages, sinks, tables
from pyspark.sql import functions as F


def value(spark, column, **cells):
    kinds = {str: "string", bool: "boolean", int: "int", list: "array<string>", type(None): "string"}
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} {kinds[type(v)]}" for n, v in cells.items())).select(column).first()[0]


@pytest.mark.parametrize("change, want", [({}, False), ({"kind": "SYMPOSIUM"}, True), ({"sec": " symposia"}, True), ({"title": "Two symposia"}, True), ({"people": ["A", "B (discussants)"]}, True), ({"first": "x" * 790 + " session chair"}, False),
                                          ({"first": "in this symposium"}, True), ({"abstract": "y" * 395 + " in this symposium"}, False), ({"abstract": "Structured poster symposium"}, True), ({"title": None}, False)])
def test_chaired(spark, change, want):
    row = {"title": "T", "sec": "Papers", "kind": "Poster", "people": ["A B"], "first": "text", "abstract": "text", **change}
    assert value(spark, X.chaired("title", "sec", "kind", "people", "first", "abstract"), **row) is want


@pytest.mark.parametrize("citation, doi, default, want", [("x", "10.22318/CSCL2019", "ICLS", "CSCL"), ("In A, Proceedings of the icls in CSCL", None, "", "ICLS"), ("cscl 2019", None, "", "CSCL"), (None, None, "my CSCL", "CSCL"), (None, None, "", "ICLS"), ("Computer-supported collaborative learning", None, "icls", "CSCL")])
def test_conference(spark, citation, doi, default, want):
    venues = {"CSCL": ("10.22318/cscl", "computer-supported collaborative learning"), "ICLS": ("10.22318/icls", "international conference of the learning sciences")}
    assert value(spark, X.conference_of("c", "d", "e", venues), c=citation, d=doi, e=default) == want


def test_headings(spark):
    assert value(spark, X.roles_of("h", {"a": ["Methods", "x y"], "b": ["results"], "c": ["z"]}), h="3.1 - Methods results") == ["a", "b"] and value(spark, X.roles_of("h", {"a": ["x y"]}), h="X Y") == ["a"] and value(spark, X.roles_of("h", {"a": ["x"]}), h=None) == []
    assert [value(spark, X.toc_group("h"), h=h) for h in (" POSTER ", "late-breaking o'clock", "")] == ["Posters", "Late-Breaking O'Clock", ""]
    name = lambda h, n="of rooms": value(spark, X.display_name("h", "n", F.lit(False), F.lit(False), {"m": "Method"}), h=h, n=n)
    assert [name("1. Start"), name("* A"), name("Methods: " + "x" * 40), name("Poster: " + "x" * 40), name("Why?", "m"), name("", ""), name(None, "m"), name("Abstract and introduction")] == ["Start", "A", "Methods", "Of Rooms", "Method", "Main Body", "Method", "Introduction"]


def test_canonical_sections_merge_and_reapportion(spark):
    lines = ["opening", "1.2 Methods", "we did", "Results", "we saw", "IV Method notes", "again", "Discussion ended here.", "x" * 61, "References", "A. B."]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 1, "only " * 300), (3, 1, "  ")], "id int, line int, text string")
    got = sections.canonical_sections(df, spark.createDataFrame([(1, "short"), (3, " ")], "id int, abstract string"))
    mine = {r.heading: r.text for r in got.where("id = 1").collect()}
    assert mine["Methodology & Context"].split("\n\n") == ["we did", "again", "Discussion ended here.", "x" * 61] and mine["Results & Findings"] == "we saw"
    assert mine["Abstract & Introduction"].startswith("### Abstract\nshort") and mine["Abstract & Introduction"].endswith("opening") and got.where("id = 3").count() == 0
    whole = df.groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    words = {(r.id, r.heading): r.words for r in sections.section_words(got, whole).collect()}
    assert [words[(2, h)] for h in sections.ORDER] == [96, 54, 84, 42, 24] and words[(3, "Results & Findings")] == 0 and words[(1, "Results & Findings")] == 2
    texts = spark.createDataFrame([(1, "lead\n## A\nbody\n\n## Empty\n##  B \nx\n### deep\ny"), (2, None)], "id int, text string")
    assert [(r.order_index, r.heading, r.text) for r in sections.hash_sections(texts).collect()] == [(1, "A", "body"), (2, "B", "x\n### deep\ny")]


def test_paragraph_faults(spark):
    paras = ["Open (here", "see Roe &", "2019 shows", "ends with the", "Big", "goes on", "et al. more;", "end."]
    df = spark.createDataFrame([(1, 1, "results", "\n\n".join(paras)), (2, 1, "references & back matter", "x\n\nb"), (3, 1, None, None)], "id int, section int, label string, text string")
    faults = quality.paragraph_faults(df)
    assert sorted((r.id, r.para, r.fault) for r in faults.collect()) == [(1, 0, "mid_sentence"), (1, 0, "open_bracket"), (1, 1, "split_citation"), (1, 2, "mid_sentence"), (1, 3, "connector"), (1, 4, "mid_sentence"), (1, 5, "connector"), (1, 5, "mid_sentence"), (1, 6, "connector"), (1, 6, "mid_sentence")]
    t = quality.fault_totals(faults, df, r"\bth e\b").first()
    assert (t.citations, t.connector, t.mid_sentence, t.papers_citations, t.flagged) == (2, 3, 5, 1, 1)


def test_page_records(spark):
    html = '<title> x </title><meta name="DC.title" content="A &amp;amp; B &Eacute;&#x1F600;&#233; &bogus; &#0;"><meta name="DC.creator" content="Lind, Bo"><meta  name="DCTERMS.issued" content="2019-05"><meta name="DCTERMS.bibliographicCitation" content="pp. 3-9"><a href="https://doi.org/10.1/x">'
    df = spark.createDataFrame([(1, html), (2, "<title>Only &lt;title&gt;</title>"), (3, "<title> </title>"), (4, None)], "page_id int, html string")
    got = {r.page_id: r for r in pages.page_records(df, "b", 2000).collect()}
    assert set(got) == {1, 2} and got[1].title == "A &amp; B É😀é &bogus; &#0;" and (got[1].year, got[1].doi, got[1].start_page, got[1].end_page, got[1].paper_type, got[1].authors) == (2019, "10.1/x", 3, 9, "Full Paper", ["Lind, Bo"])
    assert got[2].title == "Only <title>" and got[2].authors == [] and got[2].citation is None and got[2].year == 2000


def test_finding_texts(spark):
    assert value(spark, X.whole_sentences("t", "(?i:floor)"), t="A low\nfloor here. None! A low floor here. The floor") == ["A low floor here."]
    assert value(spark, X.five_keywords("t", "a", F.col("k"), ["Play", "room", "Z"], "stop"), t="rooms", a="at play", k=["pLAY", " STOP", "new-kind", "play"]) == ["Play", "New-Kind", "room"]
    long = "We " + "aim " * 20 + "here. Other. We found that. It suggests use."
    assert value(spark, X.short_summary("t", "a", ["find", "found"], ["suggest"]), t="T", a="We aim. We found that. It suggests use.") == "**RQ/Objective**: We aim. **Finding**: We found that. **Relevance**: It suggests use."
    assert value(spark, X.short_summary("t", "a", ["zzz"], ["zzz"]), t="T", a=None) == "**RQ/Objective**: T" and value(spark, X.short_summary("t", "a", ["found"], ["suggest"]), t="T", a=long).startswith("**RQ/Objective**: We aim")
    assert value(spark, X.cited_title("r", ["annual review"]), r='[2] X. "Annual review of it" (2001). Rooms in schools. P') == "Rooms in schools" and value(spark, X.cited_title("r", []), r="X 1999b. Rooms in schools. P") == "Rooms in schools" and value(spark, X.cited_title("r", []), r="7. whole") == "whole"
    assert [value(spark, X.names_review("t", ["annual review"]), t=t) for t in ("A review", "Annual Review of x", "Review in annual review", "preview", None)] == [True, False, True, False, False]
    assert value(spark, X.first_seen(F.col("b"), ["ERIC", "ACM (x)", "Web"], "none"), b=["web eric", None, "acm (X)"]) == ["ERIC", "Web", "ACM (x)"] and value(spark, X.first_seen(F.col("b"), ["ERIC"], "none"), b=["generic"]) == ["none"]
    kind, quote, text = X.paradigm("t", "a", [(r"\bagent\b", "Agents", "They act.")], ("Other", "It is."), "model|models")
    assert value(spark, quote, t="T", a="A model. Two models. Big models!") == "Two models." and value(spark, kind, t="an Agent", a=None) == "Agents" and value(spark, text, t="T", a=None) == '**Other**: It is. Evidence: "T"'


def test_long_texts_without_marks_stay_linear(spark):
    text = "THE LONG Text " * 40_000
    row = spark.createDataFrame([(text,)], "t string").select(X.whole_sentences("t", "(?i:text)"), P.without_trailing_authors("t"), X.callouts("t", "t", ["text"], "a", "b", "c")).first()
    assert row[0] == [] and row[1] == text and row[2].startswith("b")


def test_reference_text_has_three_tiers(spark):
    rows = [(1, 1, "Intro", "a\nReferences\nno"), (1, 2, "Works Cited", "r1"), (1, 3, "REFERENCES", "r2"), (2, 1, "Intro", "a"), (2, 2, None, "b\n## Bibliography\nr3"), (2, 3, "End", "c"), (3, 1, "Intro", "a"), (3, 2, "End", "References are here"), (4, 1, None, None)]
    df = spark.createDataFrame(rows, "paper_id int, order_index int, heading string, text string")
    got = {r.paper_id: r.refs for r in extraction.reference_text(df).collect()}
    assert got == {1: "r1\nr2", 2: "\n## Bibliography\nr3\nc", 3: "References are here", 4: ""}


def test_review_references(spark):
    refs = ["[1] A systematic review of it", "A systematic review of it", "2. Survey of all rooms", "A preview of rooms", "review", "Abstract of a review paper"]
    assert value(spark, extraction.review_references(F.col("r"), without=["Abstract"]), r=refs) == ["A systematic review of it", "Survey of all rooms"]


def test_clean_blocks(spark):
    text = "One co-\n design\r\nline , here .\n \nmail x@y.edu now\n\nAbstract: stub\n\n  \n\nlast\tone !"
    df = spark.createDataFrame([(1, text), (2, "a@b.com"), (3, None)], "id int, text string")
    assert [(r.id, r.text) for r in sections.clean_blocks(df).collect()] == [(1, "One co-design line, here.\n\nlast one!")]


def test_titles_are_joined_with_the_next_line(spark):
    lines = [(1, "3 Learning to see in"), (2, "the Open Rooms of X ...... 12"), (3, "Learning to see in"), (4, "other ..... 9"), (5, "Whole title"), (6, "not it .... 4"), (7, "Play as a"), (8, "no leader here")]
    df = spark.createDataFrame([("b", n, t) for n, t in lines], "block string, line int, text string")
    titles = spark.createDataFrame([(1, "b", "learning to see IN"), (2, "b", "Whole title"), (3, "b", "Play as a"), (4, "c", "Learning to see in"), (5, "b", None)], "paper_id int, block string, title string")
    assert [tuple(r) for r in sections.joined_titles(titles, df).collect()] == [(1, "Learning to see in the Open Rooms of X")]


def test_csv_round_trip(spark, tmp_path):
    rows = [("  lead ", 'say "x", y'), ("a\nb", ""), (None, "\\"), ("é", " ")]
    sinks.write_csv(spark.createDataFrame(rows, "a string, b string"), str(tmp_path / "c"))
    assert sorted(map(tuple, tables.csv_rows(spark, str(tmp_path / "c")).collect()), key=str) == sorted(rows, key=str)


def test_repeated_suffix_by_halving(spark):
    """Against every run, longest first; and a title of 20,000 words, which takes no longer than its letters."""
    import random
    import re
    import time

    from lectern.functions import text as T

    def plain(t):
        words = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" "))
        for n in range(len(words) // 2, 1, -1):
            head, tail = " ".join(words[:-n]).lower(), " ".join(words[-n:]).lower()
            if tail in head or re.sub(f"^({T.PREFIXES})", "", tail) in re.sub(f"({T.PREFIXES})", "", head):
                words = words[:-n]
                break
        return re.sub(r"[\s:;,.]+\Z", "", " ".join(words))
    r = random.Random(4)
    texts = ["  ".join(r.choice(["a", "A", "self-a", "co-b", "b", "pre-", "ba", "Ünder,", "x:"]) for _ in range(r.randint(1, 14))) for _ in range(400)]
    texts += ["", " one two  ", "one two one two", None]
    long = " ".join(f"w{i * 7919 % 20000}" for i in range(19990))
    texts += [long, f"{long} and so it ends, and SO it ends,"]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.strip_repeated_suffix("t").alias("t")).collect()
    assert time.time() - began < 60
    assert {r.id: r.t for r in rows} == {i: None if t is None else plain(t) for i, t in enumerate(texts[:-2])} | {len(texts) - 2: long, len(texts) - 1: f"{long} and so it ends"}

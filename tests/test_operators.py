"""Small cases with literal inputs for operators that SQL does not check."""

from lectern.functions import text as T
from lectern.operators import quality, search, sections, similarity, taxonomy, upserts
from lectern.sources import sinks, tables
from lectern.sources.versions import VersionedTable
from lectern.streaming import incremental
from pyspark.sql import functions as F


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'array<string>'}" for n, v in zip(names, values))).select(column).first()[0]


def test_headings(spark):
    want = {"3. Methodological Approach": "methods", "Study Design and Data Collection": "methods", "4. Results and Findings": "results", "5. Concluding Remarks": "discussion_conclusion",
            "Theoretical Framework": "theoretical_background", "References": "references", "Custom Acknowledgments Header": "other"}
    df = spark.createDataFrame([(h,) for h in want], "h string").select("h", sections.heading_label("h").alias("l"))
    assert {r.h: r.l for r in df.collect()} == want


def test_markdown_sections(spark):
    names = ["Introduction", "Theoretical Framework", "Methods", "Results", "Discussion", "References"]
    lines = [(1, i * 2 + j, x) for i, n in enumerate(names) for j, x in enumerate([f"{'#' * (1 + i % 2)} {n}", f"Text of {n}."])]
    got = sections.markdown_sections(spark.createDataFrame(lines, "id int, line int, text string")).orderBy("section").collect()
    assert [(r.heading, r.text) for r in got] == [(n, f"Text of {n}.") for n in names]


def test_citations(spark):
    assert tuple(one(spark, T.page_range("c0", "c1"), "In X (Ed.), pp. 2515-2516. ISLS", "")) == (2515, 2516)
    assert tuple(one(spark, T.page_range("c0", "c1"), None, "paper_12-19.pdf")) == (12, 19)
    assert tuple(one(spark, T.page_range("c0", "c1"), "p. 7", "x_1-2.pdf")) == (7, 7)
    assert one(spark, T.paper_type("c0", "c1", "c2", "c3"), "A", "b", 2515, 2516) == "Poster"
    assert one(spark, T.paper_type("c0", "c1", "c2", "c3"), "A", "b", 100, 108) == "Full Paper"
    assert one(spark, T.paper_type("c0", "c1", F.lit(None), F.lit(None), "c2"), "A", "b", ["Long Paper"]) == "Full Paper"


def test_names_and_text(spark):
    assert one(spark, T.flip_name("c0"), "Roe, Jane A.") == "Jane A. Roe"
    assert one(spark, T.apa_name("c0"), "Ada B. Lovelace") == "Lovelace, A. B."
    assert (one(spark, T.given_name("c0"), "Ada B. Lovelace"), one(spark, T.family_name("c0"), "Ada B. Lovelace")) == ("Ada B.", "Lovelace")
    assert one(spark, T.title_key("c0"), "Resolving  Expert: A Case Study!") == "resolving expert a case study"
    assert one(spark, T.strip_repeated_suffix("c0"), "On Talk Jane Roe Jane Roe") == "On Talk Jane Roe"
    assert one(spark, T.strip_repeated_suffix("c0"), "Learning by design in science class: learning by design") == "Learning by design in science class"
    assert one(spark, T.strip_repeated_suffix("c0"), "Three plain words.") == "Three plain words"
    assert one(spark, T.paper_type("c0", "c1", F.lit(None), F.lit(None)), "A", "b") == "Short Paper"
    assert one(spark, T.dangling("c0"), "Learning towards") and one(spark, T.dangling("c0"), "co-") and not one(spark, T.dangling("c0"), "Learning data")
    assert one(spark, T.clean_paragraphs("c0"), "A bro-\nken line ,\nand more .\n\nContact: a@b.org\n\nAbstract:") == "A broken line, and more."
    assert one(spark, T.context("c0", "(?i)needle", 4), "hay hay Needle hay hay") == "...hay Needle hay..."
    assert one(spark, T.unescape("c0"), "a &amp;lt; b &quot;c&quot;") == 'a &lt; b "c"'
    assert one(spark, T.conference_in("c0", ["CSCL", "ICLS", "ISLS"], "?"), "icls-2025-proceedings.pdf") == "ICLS"
    assert one(spark, T.year_in("c0"), "icls-2025-proceedings.pdf") == 2025
    assert one(spark, T.provenance("c0", {"a": "*", "b": "+"}), ["b", "a", "b"]) == "+*"


def test_search(spark):
    rows = [("h1", "Resolving Expert Disagreement", 2024, "ISLS Annual Meeting 2024", "methods", "Students used interactive agent-based simulations daily"),
            ("h1", "Resolving Expert Disagreement", 2024, "ISLS Annual Meeting 2024", "results", "Learning improved"), ("h2", "Knowledge Building", 2023, "ISLS 2023", "methods", "Knowledge Forum was used for learning")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sid int, paper string, title string, year int, conference string, normalized_section string, body string")

    def papers(q, **k):
        return [r.paper for r in search.search(df, "sid", ["title", "body"], q, group="paper", **k).collect()]
    assert papers("agent-based simulations") == ["h1"]
    assert papers("Knowledge Forum", section="methods") == ["h2"]
    assert papers("learning", min_year=2024) == ["h1"]
    assert papers("!! a") == [] and search.query_terms("É a of!") == ["of"]
    s = df.where("sid = 0").select(search.snippet(F.col("body"), ["agent"]), search.snippet(F.col("body"), ["used"])).first()
    assert s[0] is None and "<b>used</b>" in s[1]


def test_fuzzy(spark):
    assert similarity.lcs("abcde", "xbyd") == 2 and similarity.indel("abc", "abc") == 100 and similarity.indel("", "") == 100
    df = spark.createDataFrame([("a cat sat", "the cat sat down", "cat")], "a string, b string, c string")
    r = df.select(similarity.ratio("a", "b"), similarity.partial_ratio("c", "b")).first()
    assert abs(r[0] - 200 * 8 / 25) < 1e-9 and r[1] == 100
    left = spark.createDataFrame([(1, "Resolving expert disagreement by evaluating"), (2, "Unrelated")], "k int, text string")
    right = spark.createDataFrame([(7, "Resolving expert disagreement by evaluation"), (8, "expert disagreement")], "j int, text string")
    assert [(x.k, x.j) for x in similarity.best_match(left, right, "k", "j", "text", 80).collect()] == [(1, 7)]


def test_taxonomy_seam_and_default(spark):
    p = spark.createDataFrame([(1, "About games", "play play play"), (2, "x", "nothing"), (3, "deep", "learning here")], "id int, title string, body string")
    got = {(r.id, r.label): (r.centrality, r.confidence) for r in taxonomy.classify(p, {"d": {"game": ["games?"], "play": ["play"], "deep": ["deep learning"]}}, {"d": "none"}).collect()}
    assert got == {(1, "game"): (5, .9), (1, "play"): (4, .9), (2, "none"): (1, .5), (3, "deep"): (1, .9)}


def test_gaps_and_audit(spark):
    pages = spark.createDataFrame([(1, p, p in (2, 3, 4, 7)) for p in range(1, 9)] + [(2, 1, False)], "id int, page long, opens boolean")
    assert sorted(r.start for r in sections.gap_boundaries(pages).collect()) == [2, 4, 7]
    df = spark.createDataFrame([("see (Smith, 2020",), ("the end of",), ("fine ,  here .",), ("co llab work",)], "t string")
    r = df.select(quality.open_citation("t"), quality.trailing_connector("t"), quality.stray_blanks("t"), F.regexp_count("t", F.lit(quality.split_words(["collab"])))).collect()
    assert [x[0] for x in r] == [True, False, False, False] and r[1][1] and r[2][2] == 2 and r[3][3] == 1


def test_ids_continue_without_gaps(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b")], "id long, display_name string")
    names = spark.createDataFrame([(f"n{i}",) for i in range(50)] + [("a",), (" ",)], "display_name string")
    made = upserts.add_names(known, names).collect()
    assert sorted(r.id for r in made) == list(range(1, 53)) and {r.id: r.display_name for r in made}[1] == "a"


def test_sources_sinks_and_stream(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"n": 2, "papers": [{"id": "a", "year": 1},\n {"id": "b", "year": 2}]}')
    assert [r.id for r in tables.registry(spark, str(tmp_path / "r.json"), "papers").orderBy("id").collect()] == ["a", "b"]
    records = spark.createDataFrame([("p1", "T", ["A B", ""], [("Intro", "x | y")])], "id string, title string, authors array<string>, sections array<struct<heading string, text string>>")
    out = sinks.normalised(records)
    assert out["paper_authors"].count() == 1 and out["sections"].first().id == "p1_sec_1"
    sinks.write_tables(out, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/sections.parquet")).count() == 1
    text = sinks.markdown_papers(records).first().value
    (tmp_path / "md").mkdir()
    (tmp_path / "md/p1.md").write_text(text)
    back = tables.markdown_papers(spark, str(tmp_path / "md/*.md")).first()
    assert (back.id, back.title, back.authors) == ("p1", "T", ["A B"])
    assert sinks.markdown_rows(out["sections"], ["heading", "text"]).first().value == "| Intro | x \\| y |"
    rows = spark.createDataFrame([(1, 1, "old"), (2, 1, "keep")], "k int, seq int, v string")
    rows.write.parquet(str(tmp_path / "in/a"))
    for _ in range(2):
        incremental.start(spark, str(tmp_path / "in/*"), rows.schema, str(tmp_path / "t"), ["k"], "seq", str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(1, 2, "new"), (3, 1, "add")], rows.schema).write.mode("overwrite").parquet(str(tmp_path / "in/b"))
    last = VersionedTable(spark, str(tmp_path / "t"), ["k"], "seq", rows.schema).read()
    assert sorted((r.k, r.v) for r in last.collect()) == [(1, "new"), (2, "keep"), (3, "add")]

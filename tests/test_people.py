"""Repair of titles and authors: damaged rows with the repaired values, written by hand."""

import pytest
from lectern.functions import people as P
from lectern.operators import repair
from pyspark.sql import functions as F

HEADER = "12 Peers and Play in Open Rooms .... 7\nCSCL 2021\nProceedings of X\nAnna Meyer, Bo Lind\nCy Roe* (University of X), x@y.edu\nAbstract: we did"
DIRTY = [
    ("Peers and Play in Open Rooms", "Anna Meyer, Bo Lind", None, "Peers and Play in Open Rooms", "Anna Meyer, Bo Lind"),
    ("Title:  Peers and Play in Open Rooms:.", "Authors: Anna Meyer, University of X, Bo Lind, a@b.edu, Anna Meyer", "", "Peers and Play in Open Rooms", "Anna Meyer, Bo Lind"),
    ("Peers and play in open rooms Anna Meyer, Bo Lind", "Anna Meyer", None, "Peers and play in open rooms", "Anna Meyer"),
    ("Peers and play in open rooms 602 Anna Meyer", "Anna Meyer", None, "Peers and play in open rooms", "Anna Meyer"),
    ("Play - Anna Meyer (co-chair)", "", None, "Play -", ""),
    ("Peers and play in open rooms Anna Meyer (co-chair)", "", None, "Peers", ""),  # whatever the case, so all words before the mark are a name's
    ("Weber, X. (2019). On play. doi:10.1234/abc", "", HEADER, "Peers and Play in Open Rooms", "Anna Meyer, Bo Lind"),
    ("ab", None, HEADER, "Peers and Play in Open Rooms", "Anna Meyer, Bo Lind"),
    ("Peers and play in open rooms", "using tools with care, Bo Lind", None, "Peers and play in open rooms using tools with care", "Bo Lind"),
    ("Peers and play in open rooms", "using Tools with care, Bo Lind", None, "Peers and play in open rooms", "using Tools with care, Bo Lind"),
    ("Peers and play in open rooms - Bo Lind", "Bo Lind, Anna Meyer", None, "Peers and play in open rooms", "Bo Lind, Anna Meyer"),
    ("Peers and play in open rooms; vol. 7", "Bo Lind", None, "Peers and play in open rooms", "Bo Lind"),
    ("Peers and play in open rooms open rooms", "Bo Lind", None, "Peers and play in open rooms", "Bo Lind"),
    ("Self-regulated learning of peers regulated learning", "Bo Lind", None, "Self-regulated learning of peers", "Bo Lind"),
    ("Peers and play (2011) press, x", "", "Peers and play for\nGermany\nBo Lind", "Peers and play", "Bo Lind"),
    ("Notes on critical work by Critical Design, Bo Lind", "", None, "Notes on critical work by Critical Design, Bo Lind", ""),
    ("Peers in rooms of Anna Meyer, Bo Lind", "", None, "Peers in rooms of Anna Meyer, Bo Lind", ""),
    ("Peers", "Bo Lind, R2 D2, Chicago, http x", None, "Peers", "Bo Lind"),
    (None, "", HEADER, "Peers and Play in Open Rooms", "Anna Meyer, Bo Lind"),
    ("", "", None, "", ""),
    ("x" * 160, "Bo Lind", "Peers at play in one room\nlearning together, Always\nDiscussant: Q", "Peers at play in one room learning together, Always", "Bo Lind"),
    ("Figure 3 of peers and play", "", "Self- made tools and peers\nSome of Us\nBo Lind, Cy Roe\nJapan", "Self-made tools and peers Some of Us", "Bo Lind, Cy Roe"),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_dirty_rows(spark, parts):
    df = spark.createDataFrame([(i, *r[:3], "kept") for i, r in enumerate(DIRTY)], "id int, title string, authors string, first string, other string").repartition(parts)
    out = repair.repaired(df, "title", "authors", "first")
    assert out.columns == [*df.columns, "fixed_title", "fixed_authors"]
    got = {r.id: (r.fixed_title, r.fixed_authors) for r in out.collect()}
    assert got == {i: r[3:] for i, r in enumerate(DIRTY)}


def test_repair_stays_in_the_jvm_and_shuffles_nothing(spark):
    df = spark.createDataFrame([("a", "b", "c")], "t string, a string, s string")
    plan = repair.repaired(df, "t", "a", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("author, title, want", [
    ("in Open Rooms", "Peers and Play in Open Rooms", True), ("open rooms", "Play in Open Rooms!", True), ("wide open rooms", "Play in Open Rooms", True), ("rooms", "Play in Open Rooms", True),
    ("and play", "Peers and play in rooms", True), ("play", "Peers and play in rooms", False), ("peers and play", "Peers and play in rooms", True), ("Anna Meyer", "Peers and play", False),
    ("ms", "Play in Rooms", False), ("Rooms", "Room", False), ("", "Peers and play", False), (None, "Peers and play", False), ("§§§", "Peers and play", False), ("of", "All of it", False)])
def test_spill(spark, author, title, want):
    assert spark.createDataFrame([(author, title)], "a string, t string").select(P.spilled("a", "t")).first()[0] is want


def test_clean_authors(spark):
    df = spark.createDataFrame([(1, "Peers and play in rooms", ["and Anna Meyer.", "Bo Lind; in rooms, Drexel", "Anna Meyer", None, "R2"], ["in rooms", "UCLA"]), (2, "T", ["Bo Lind"], ["& Cy Roe,"]), (3, None, None, None)], "id int, t string, n array<string>, r array<string>")
    got = {r.id: r.x for r in df.select("id", P.clean_authors("t", "n", "r").alias("x")).collect()}
    assert got == {1: ["Anna Meyer", "Bo Lind"], 2: ["Cy Roe"], 3: []}


def test_three_shapes_of_author_lists(spark):
    df = spark.createDataFrame([("Bo Lind, UK, ", ["Bo Lind", "x@y", None], [("", "Cy Roe"), ("Bo Lind", "B"), (None, None)])], "a string, b array<string>, c array<struct<display_name:string,name:string>>")
    row = df.select(P.sanitised(P.split_names("a")).alias("a"), P.sanitised(F.col("b")).alias("b"), P.sanitised(P.struct_names("c", "display_name", "name")).alias("c"), P.sanitised(P.split_names("a"), fragments=["bo lind"]).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (["Bo Lind"], ["Bo Lind"], ["Cy Roe", "Bo Lind"], [])


@pytest.mark.parametrize("line, want", [("doi:10.1/x", True), ("see https://a.b", True), ("Bers, M. U.", True), ("In 2019, we", True), ("Press 2019", True), ("in 2019 we", False), ("Table 3 shows", True), ("references", True), ("A title", False), ("", True), (None, True)])
def test_artifacts(spark, line, want):
    assert spark.createDataFrame([(line,)], "a string").select(P.reference_line("a")).first()[0] is want


def test_first_page(spark):
    text = "T\nAnna Meyer; Bo Lind, University of X\nx@y.z, Cy Roe\nAbstract: we\ndid it\n1. Start\nrest"
    row = spark.createDataFrame([(text,)], "s string").select(P.author_lines(P.text_lines("s")).alias("a"), P.abstract_lines(P.text_lines("s")).alias("b"), P.found_authors("s", "nobody").alias("c"), P.abstract_lines(P.text_lines(F.lit("no\nheading"))).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (["Anna Meyer", "Bo Lind", "Cy Roe"], "we did it", "Anna Meyer; Bo Lind, University of X", None)
    long = "Abstract - " + "word " * 30 + "self - made\nend\nKeywords: q"
    row = spark.createDataFrame([(long, "Figure 1 " + "x" * 200 + "\n\n" + "y " * 60, "short")], "a string, b string, c string").select(*[P.found_abstract(c) for c in "abc"], P.found_authors("c", "nobody")).first()
    assert row[0] == "word " * 30 + "self-made end" and row[1] == ("y " * 60).strip() and row[2] is None and row[3] == "nobody"

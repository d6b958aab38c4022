import json

import pytest
from lectern.functions import text as T
from lectern.operators import network, review
from lectern.sources import tables
from pyspark.sql import functions as F


@pytest.mark.parametrize("name,keywords,protocol,fields,want", [
    ("", ["collaboration", "AI"], None, ["title"], ("Dipstick Review - collaboration, AI", "Dipstick Review")),
    ("", ["feedback"], "Expanded Scope", ["title"], ("Expanded Scope - feedback", "Expanded Scope")),
    ("machine learning", ["ml"], "Expanded Scope", ["title"], ("Expanded Scope - machine learning", "Expanded Scope")),
    ("Agentic Review - qualitative coding", ["coding"], None, ["title"], ("Agentic Review - qualitative coding", "Agentic Review")),
    (None, ["scaffolding"], None, ["sections"], ("Expanded Scope - scaffolding", "Expanded Scope"))])
def test_review_names(spark, name, keywords, protocol, fields, want):
    df = spark.createDataFrame([(name, keywords, protocol, fields)], "n string, k array<string>, p string, f array<string>")
    assert tuple(df.select(*review.review_name(F.col("n"), F.col("k"), F.col("p"), F.col("f"))).first()) == want


def test_protected_columns_stay_and_rows_go(spark):
    df = spark.createDataFrame([("paper-001", "t", "x"), ("paper-002", "u", "y")], "id string, title string, custom_property_1 string")
    for column in ("title", "id"):
        with pytest.raises(ValueError):
            review.without_columns(df, [column])
    assert review.without_columns(df, ["custom_property_1"]).columns == ["id", "title"]
    assert [r.id for r in review.without_rows(df, df.where("title = 't'")).collect()] == ["paper-002"]
    assert review.place(df, "custom_property_1", before="title").columns == ["id", "custom_property_1", "title"]


def test_observations_replace_their_own_property(spark, tmp_path):
    path = str(tmp_path / "observations")
    a = spark.createDataFrame([("p1", "a", "1"), ("p1", "b", "2")], "paper_id string, property_id string, value string")
    review.write_observations(a, path)
    review.write_observations(a.where("property_id = 'a'").withColumn("value", F.lit("3")), path)
    got = {(r.paper_id, r.property_id): r.value for r in spark.read.json(path).collect()}
    assert got == {("p1", "a"): "3", ("p1", "b"): "2"}


def test_readers(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "icls-2024.md").write_text("# A\ntext")
    (tmp_path / "v" / "icls-2023.md").write_text("# old")
    assert [(r.file, r.line, r.text) for r in tables.year_volumes(spark, str(tmp_path / "v"), 2024, ["icls", "cscl"]).collect()] == [("icls-2024.md", 1, "# A"), ("icls-2024.md", 2, "text")]
    (tmp_path / "b.jsonl").write_text('{"block_id": "x", "pdf_page": 3}\n{"block_id": "y"}\n')
    assert [tuple(r) for r in tables.json_lines(spark, str(tmp_path / "b.jsonl"), "block_id string, pdf_page int").collect()] == [("x", 3), ("y", None)]
    (tmp_path / "c.csv").write_text('id,title\n1,"two\nlines"\n')
    assert [tuple(r) for r in tables.csv_rows(spark, str(tmp_path / "c.csv")).collect()] == [("1", "two\nlines")]
    for k, (layer, value) in enumerate((("work", "new"), ("data", "old"))):
        (tmp_path / layer).mkdir()
        (tmp_path / layer / "o.json").write_text(json.dumps({"paper_id": "p", "property_id": "q", "value": value}))
    got = tables.layered_observations(spark, [str(tmp_path / "work"), str(tmp_path / "data")], "paper_id string, property_id string, value string").collect()
    assert [(r.paper_id, r.property_id, r.value) for r in got] == [("p", "q", "new")]


def test_citing_lines_are_not_older_and_rare_words_suffice(spark):
    cited = spark.createDataFrame([(1, "Common learning analytics dashboards", 2020), (2, "Common learning analytics dashboards", 2010)], "target_id long, title string, year int")
    lines = spark.createDataFrame([(7, "see learning analytics and common dashboards", 2015), (8, "learning learning common", 2024)], "line_id long, text string, year int")
    assert [tuple(r) for r in network.citation_links(cited, lines).collect()] == [(7, 2, 4)]


def test_marked_letters_fold(spark):
    assert spark.range(1).select(T.tokens(F.lit("Žižek Erdős Muş Ålesund")).alias("x")).first().x == ["zizek", "erdos", "mus", "alesund"]

"""Tiered extraction with reuse, references, theory use and explanations on small cases."""

from lectern.operators import extraction as X
from pyspark.sql import functions as F

DEFS = ['{"id": "role", "version": "1", "label": "Role", "query": {"candidate_sections": ["method"], "text_terms": ["teacher"]}, "constraints": {"allowed_values": ["Co-Designer (x)"]}, "extraction": {"inference_allowed": true}}',
        '{"id": "site", "query": {"heading_terms": ["setting"], "candidate_sections": ["none"], "text_terms": ["school"]}}', '{"version": "3"}', "not json"]
SECTIONS = [(1, 1, "Introduction", ["intro"], "A teacher came."), (1, 2, "Methods", ["method"], "Our co-designer (X) taught in a School."), (2, 1, "Introduction", ["intro"], "A teacher in school."), (2, 2, "The Setting", None, "Nothing here."),
            (3, 1, "Methods", ["method"], ""), (3, 2, None, None, None), (5, 1, "Methods", ["METHOD"], "Only passage.")]


def frames(spark):
    return (spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "paper_id long"), spark.createDataFrame(SECTIONS, "paper_id long, order_index long, heading string, roles array<string>, text string"),
            X.definitions(spark.createDataFrame([(x,) for x in DEFS], "definition string")))


def cells(df):
    return {(r.paper_id, r.property_id): (r.value, r.status, r.confidence, r.order_index) for r in df.collect()}


def test_definitions_by_terms(spark):
    got = {r.property_id: r for r in frames(spark)[2].collect()}
    assert set(got) == {"role", "site"} and got["site"].version == "1.0.0" and got["site"].label == "site" and got["site"].allowed_values == [] and not got["site"].inference_allowed


def test_tiers(spark):
    papers, sections, props = frames(spark)
    got = cells(X.evaluated(X.stale_cells(papers, props, X.evaluated(papers.limit(0).withColumn("property_id", F.lit("")), sections, props)), sections, props))
    assert got == {
        (1, "role"): ("Co-Designer (x)", "extracted", 0.9, 2), (1, "site"): ("school", "extracted", 0.8, 2), (2, "role"): ("teacher", "extracted", 0.8, 1), (2, "site"): (None, "not_present", 0.0, None),
        (3, "role"): (None, "not_present", 0.0, None), (3, "site"): (None, "not_present", 0.0, None), (4, "role"): (None, "not_present", 0.0, None), (4, "site"): (None, "not_present", 0.0, None),
        (5, "role"): ("Inferred: Role from passage context", "inferred", 0.7, 1), (5, "site"): (None, "not_present", 0.0, None)}


def test_refresh_evaluates_and_writes_stale_cells_only(spark, tmp_path, monkeypatch):
    papers, sections, props = frames(spark)
    papers = papers.where("paper_id in (1, 2)")
    asked, folder = [], str(tmp_path / "store")
    real = X.evaluated
    monkeypatch.setattr(X, "evaluated", lambda c, *a: (asked.append(sorted(map(tuple, c.collect()))), real(c, *a))[1])
    first = cells(X.refresh(papers, sections, props, folder, 1))
    assert asked[-1] == [(1, "role"), (1, "site"), (2, "role"), (2, "site")]
    # the section of a fresh cell is not looked at again, even when its text has changed
    other = sections.withColumn("text", F.lit("teacher, school"))
    second = cells(X.refresh(papers, other, props, folder, 2))
    assert asked[-1] == [(2, "site")] and second == {**first, (2, "site"): ("school", "extracted", 0.8, 2)}
    newer = props.withColumn("version", F.when(F.col("property_id") == "site", "2.0.0").otherwise(F.col("version")))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    third = cells(X.refresh(papers, other, newer, folder, 3))
    assert asked[-1] == [(1, "site"), (2, "site")] and third[(1, "role")] == first[(1, "role")] and third[(1, "site")][0] == "school"
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())
    files = len(list((tmp_path / "store").rglob("version=*/**/*.parquet")))
    assert cells(X.refresh(papers, other, newer, folder, 3)) == third  # a repeated run
    assert len(list((tmp_path / "store").rglob("version=*/**/*.parquet"))) == files and {c for a in asked[-1:] for c in a} == {(1, "site"), (2, "site")}


def test_extract_marks_what_is_reused(spark):
    papers, sections, props = frames(spark)
    old = X.evaluated(papers.select("paper_id", F.lit("role").alias("property_id")), sections, props).withColumn("value", F.lit("old"))
    got = {(r.paper_id, r.property_id): (r.value, r.reused) for r in X.extract(papers, sections, props, old.unionByName(old)).collect()}
    assert len(got) == 10 and got[(1, "role")] == ("old", True) and got[(5, "role")] == ("Inferred: Role from passage context", False) and sum(r for _, r in got.values()) == 2


def test_references(spark):
    text = "## References\n  [1] Weber, X. (2001). On\n  play  in rooms.\n2. Short\n\nMeyer, Anna and more text\n(2002). Title of it.\n## Acknowledgements\nWe thank everyone very much"
    late = "Bibliography\n" + "Weber, X. wrote a long text. " * 10 + "\nAcknowledgement to all of you here"
    early = "Acknowledgement in the middle of it\n" + "Weber, X. wrote a long text. " * 10
    df = spark.createDataFrame([(text, late, early, None, "")], "a string, b string, c string, d string, e string")
    a, b, c, d, e = df.select(*[X.split_references(x) for x in "abcde"]).first()
    assert a == ["[1] Weber, X. (2001). On play in rooms.", "Meyer, Anna and more text (2002). Title of it."]
    assert b == [("Weber, X. wrote a long text. " * 10).strip()] and len(c) == 2 and d == e == []


def test_theory_usage(spark):
    rows = [(1, 1, "Intro", "We see activity systems. Nothing."), (1, 2, "", "Under CHAT theory, an analysis\nfollows. More."), (2, 1, "Intro", "We CHAT a lot. An activity system!"), (3, 1, "X", "Nothing."), (4, 1, "A", "Cultural historical activity theory informs it."), (5, 1, "A", "Cultural-Historical Activity Theory " + "x" * 300 + ".")]
    papers = spark.createDataFrame([(1, "t", "a"), (2, "t", None), (3, "t3", ""), (4, "t", "a"), (5, "t", "a"), (6, "t6", "abs")], "paper_id int, title string, abstract string")
    sections = spark.createDataFrame(rows, "paper_id int, order_index int, heading string, text string")
    got = {r.paper_id: r for r in X.theory_usage(papers, sections, r"(?i)cultural[-\s]historical activity theory", r"\bCHAT\b", ["theory"], r"(?i)activity system", [(["analy"], "Analyses in {section}."), (["inform"], "Grounded in {section}.")], "Applied in {section}.", "Draws on it in {section}.", "Mentions it.").collect()}
    assert got[1].usage == 'Analyses in Main Text. Evidence: "Under CHAT theory, an analysis follows."' and got[1].strength == "strong"
    assert got[2].usage == 'Draws on it in Intro. Evidence: "An activity system!"' and got[2].strength == "weak"
    assert (got[3].usage, got[3].evidence, got[3].strength) == ("Mentions it.", "t3", "none") and got[6].evidence == "abs"
    assert got[4].usage.startswith("Grounded in A.") and got[5].usage.startswith("Applied in A.") and got[5].usage.endswith('..."')


def test_match_explanation(spark):
    long = "x " * 60 + "then co-design comes " + "y " * 60 + "end."
    df = spark.createDataFrame([(1, "Peer co-design", "We use AI. AI helps."), (2, None, long), (3, "none", None), (4, "AI and peers", "paid aids")], "id int, t string, a string")
    got = {r.id: r.x for r in df.select("id", X.match_explanation("t", "a", ["ai", "co-design", "peer"]).alias("x")).collect()}
    assert got[1] == "Title explicitly mentions 'co-design', 'peer'; Abstract discusses 'ai'. Evidence: \"We use AI.\""
    assert got[3] == "Matches target keywords in paper text." and got[4] == "Title explicitly mentions 'ai'."
    assert got[2].startswith("Abstract discusses 'co-design'. Evidence: \"...") and "then co-design comes" in got[2] and got[2].endswith('..."')

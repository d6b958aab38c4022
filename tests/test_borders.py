"""Word borders, blanks and ends of texts that Java and the SQL's patterns read differently, by the queries' own SQL."""

import duckdb
import pytest
from lectern.plans import catalog

# What may stand at a border besides ASCII letters, and ends that only Java takes for one.
MARKS = ["", "é", "ée", "_", "7", " ", "-", "ß", "漢", "\x0b", "\u00a0", "’"]
ENDS = ["", " ", "\t\r", "\x0b", "\u00a0", "\u0085", "\u2028", "."]


def against_sql(spark, folder, name, texts):
    """The query's rows over documents with these texts, held against its SQL."""
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, str(folder)).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(duck.sql(catalog.oracle_sql()[name]).fetchall())
    assert [(r, texts[r[0]]) for r in got] == [(r, texts[r[0]]) for r in want]
    return got


def test_dangling(spark, tmp_path):
    texts = [f"Of trees {m}{w}{e}" for m in MARKS for w in ("a", "THE", "towards", "a\u017f", "tree", "-") for e in ENDS]
    got = against_sql(spark, tmp_path, "str45_dangling", [*texts, None, ""])
    assert {r[1] for r in got} == {True, False, None}


def test_found_abstract(spark, tmp_path):
    """Four headers by the document's number; words of a broken line join at ASCII letters, wherever those end."""
    long = "Words that are long enough to be an abstract of more than sixty letters and of a hundred, in one paragraph or block, "
    texts = [f"{long}vequ{m}e{e}- {m}Ouan {m} -Os{e}\n{e}Intro {m}{e}\n\n{long}x{e}-{e}y{e}" for m in MARKS for e in ENDS for _ in range(4)]
    got = against_sql(spark, tmp_path, "str31_found_abstract", [*texts, *[e for e in ENDS for _ in range(4)], None, None, None, None])
    assert any(r[1] is None for r in got) and any(r[1] and "-Ouan" in r[1] for r in got)

"""Writers: normalised tables, flat exports, Markdown, nested JSON, bundles and reports.

Each returns the DataFrame that is written, so exports can be checked without a file system; the
write itself is one Spark job to the given path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell


def normalised(records: DataFrame) -> dict[str, DataFrame]:
    """records(id, title, authors array, sections array of struct) as papers, paper_authors, sections."""
    authors = records.select("id", F.posexplode(F.filter("authors", lambda a: F.trim(a) != "")).alias("i", "display_name"))
    sections = records.select("id", F.posexplode("sections").alias("i", "s"))
    return {
        "papers": records.drop("authors", "sections"),
        "paper_authors": authors.select(F.col("id").alias("paper_id"), "display_name", (F.col("i") + 1).alias("author_order")),
        "sections": sections.select(F.concat_ws("_sec_", "id", F.col("i") + 1).alias("id"), F.col("id").alias("paper_id"), (F.col("i") + 1).alias("order_index"), "s.*"),
    }


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV export with header, blanks around values kept; order is the caller's."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def flat_labels(papers: DataFrame, labels: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row a paper: each dimension's labels joined, and its largest centrality (1 without any)."""
    both = labels.groupBy("id").pivot("dimension", dimensions).agg(F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("labels"), F.max("centrality").alias("score"))
    out = papers.join(both, "id", "left")
    for d in dimensions:
        out = out.withColumn(f"{d}_labels", F.coalesce(f"{d}_labels", F.lit(""))).withColumn(f"{d}_score", F.coalesce(f"{d}_score", F.lit(1)))
    return out


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): a Markdown table row for each row, pipes escaped."""
    cells = [F.coalesce(cell(F.col(c).cast("string")), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_papers(records: DataFrame) -> DataFrame:
    """(id, value): title, authors and sections of a paper as one Markdown text."""
    parts = F.transform("sections", lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["text"]))
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n**Authors:** "), F.array_join("authors", ", "))
    return records.select("id", F.concat_ws("\n\n", head, F.array_join(parts, "\n\n")).alias("value"))


def collections(sections: DataFrame, key: str) -> DataFrame:
    """(key, data_json): children nested in order, as one JSON document each."""
    rows = F.array_sort(F.collect_list(F.struct("order_index", "heading", "text")))
    return sections.groupBy(key).agg(F.to_json(F.struct(rows.alias("sections"))).alias("data_json"))


def evidence_csv(observations: DataFrame) -> DataFrame:
    """One row per evidence item; an observation without any gives one row with blanks."""
    rows = observations.select("paper_id", "property_id", "value", F.explode_outer("evidence").alias("e"))
    return rows.select("paper_id", "property_id", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("e.supporting_text", F.lit("")).alias("supporting_text"))


def dictionary(columns: DataFrame, properties: DataFrame, standard: list[str]) -> DataFrame:
    """(column, kind, label): canonical, extracted or unknown."""
    both = columns.join(properties.select(F.col("property_id").alias("column"), "label"), "column", "left")
    kind = F.when(F.col("column").isin(standard), "canonical").when(F.col("label").isNotNull(), "extracted").otherwise("unknown")
    return both.select("column", kind.alias("kind"), F.coalesce("label", F.col("column")).alias("label"))


def reviews(members: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers of each review, manifest): enriched rows and counts, largest first."""
    rows = members.join(papers, members.paper_id == papers.id).drop("id")
    return rows, rows.groupBy("review_id").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "review_id")

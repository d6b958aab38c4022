"""Readers: tables, nested registries, Markdown corpora, layered definitions, web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def registry(spark: SparkSession, path: str, array: str, schema=None) -> DataFrame:
    """One row per record of a JSON document {array: [record, ...]} (multi-line files)."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True).select(F.inline(array))


def markdown_papers(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, authors, conference, body) of Markdown files, one paper a file."""
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)\.md$", 1).alias("id"))
    names = F.split(F.regexp_extract("value", r"(?m)^\*\*Authors:\*\*\s*(.+)$", 1), r"\s*[,;]\s*")
    return raw.select("id", F.regexp_extract("value", r"(?m)^# (.+)$", 1).alias("title"), F.filter(names, lambda x: x != "").alias("authors"),
                      F.regexp_extract("value", r"(?m)^\*\*Conference:\*\*\s*(.+)$", 1).alias("conference"), F.col("value").alias("body"))


def top_layer(rows: DataFrame, key: str, layer: str) -> DataFrame:
    """For each key the row of the highest layer (a user's definition overrides a core one)."""
    w = Window.partitionBy(key).orderBy(F.desc(layer))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, h1, n_links) scraped from raw HTML; the title is unescaped."""
    from ..functions.text import unescape

    return pages.select(
        "page_id", unescape(F.trim(F.regexp_extract("html", r"<title[^>]*>([^<]*)</title>", 1))).alias("title"),
        F.regexp_extract("html", r'<html[^>]* lang="([^"]*)"', 1).alias("lang"), F.trim(F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1)).alias("h1"),
        F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href): distinct link targets in order of first appearance, without the page itself."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", "url", F.posexplode(found).alias("position", "href")).where("href <> url").select("page_id", "href")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blocks of a folder of JSON-lines files, one row a line, with a given schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and quoted line breaks, every column as text; such a file can't be split, so it is one task.

    A quoted empty cell is an empty text, one without anything is null.
    """
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue=chr(0))


def year_volumes(spark: SparkSession, folder: str, year: int, names: list[str]) -> DataFrame:
    """(file, line, text): lines of the volumes `<name>-<year>.md` of one year that exist."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"{{{','.join(names)}}}-{year}.md").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")


def layered_observations(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """One observation for each (paper_id, property_id); folders named first win."""
    from functools import reduce

    layers = [spark.read.schema(schema).json(p, multiLine=True).withColumn("layer", F.lit(i)) for i, p in enumerate(folders)]
    rows = reduce(DataFrame.unionByName, layers)
    return rows.groupBy("paper_id", "property_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("paper_id", "property_id", "layer")]), "layer").alias("x")).select("paper_id", "property_id", "x.*")

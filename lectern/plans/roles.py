"""The roles that the given tables play: papers, authors, labels, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line, rest_lines
from ..sources.tables import table


def papers(spark: SparkSession, d: str) -> DataFrame:
    """documents as papers: id, title (first line), body (the rest), conference (source), type (lang), text."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), first_line("text").alias("title"), rest_lines("text").alias("body"), F.col("source").alias("conference"), F.col("lang").alias("paper_type"), "n_chars", "text")


PAPERS = "(SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body, source AS conference, lang AS paper_type, n_chars, text FROM documents)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """documents as lines: id, line (from 1), text."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("id", (F.col("p") + 1).cast("long").alias("line"), "text")


LINES = "(SELECT doc_id AS id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


def paper_authors(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, author_id, author_order): suppliers of an order, by first line number."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).agg(F.min("l_linenumber").alias("author_order"))


PAPER_AUTHORS = "(SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS author_order FROM lineitem GROUP BY ALL)"


def dated(spark: SparkSession, d: str) -> DataFrame:
    """orders as papers with a year: paper_id, year, conference (priority), status."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("conference"), F.col("o_orderstatus").alias("status"))


DATED = "(SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS conference, o_orderstatus AS status FROM orders)"


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Tall labels of orders: paper_id, dimension (brand or size band), value, centrality 1 to 5."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit("S"), F.floor((F.col("p_size") - 1) / 10).cast("string")).alias("band"))
    both = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    score = F.least(F.lit(5), F.floor(F.col("l_quantity") / 10).cast("int") + 1)
    tall = both.select(F.col("l_orderkey").alias("paper_id"), F.explode(F.array(
        F.struct(F.lit("brand").alias("dimension"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("dimension"), F.col("band").alias("value")))).alias("x"), score.alias("s"))
    return tall.groupBy("paper_id", "x.dimension", "x.value").agg(F.max("s").alias("centrality"))


LABELS = """(SELECT paper_id, dimension, value, max(s) AS centrality FROM (
  SELECT l_orderkey AS paper_id, u.dimension, u.value, CAST(least(5, floor(l_quantity / 10) + 1) AS INTEGER) AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey,
  LATERAL (VALUES ('brand', p_brand), ('size', 'S' || CAST(CAST(floor((p_size - 1) / 10.0) AS INTEGER) AS VARCHAR))) u(dimension, value)) GROUP BY ALL)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations as sections: paper_id, order_index, heading (role), text."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("order_index"), F.col("role").alias("heading"), "text")


TURNS = "(SELECT conv_id AS paper_id, turn AS order_index, role AS heading, text FROM conversations)"

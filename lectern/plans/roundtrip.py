"""Readers and writers as queries: the given tables written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network, review
from ..sources import sinks, tables
from ..sources.tables import table
from ..sources.versions import workspace
from . import relational
from . import roles as R
from .registering import registry

FOUND, SQL, query = registry()


@query("SELECT doc_id, source, text FROM documents")
def src1_registry(spark, d):
    """JSON documents of up to 500 records each, one a file."""
    rows = table(spark, d, "documents").select("doc_id", "source", "text").withColumn("part", F.floor(F.col("doc_id") / 500))
    path = workspace(spark, "registry")
    documents = rows.groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct("doc_id", "source", "text")).alias("papers"))).alias("value"))
    documents.repartition("part").write.partitionBy("part").text(path)
    return tables.registry(spark, f"{path}/*", "papers", "papers array<struct<doc_id:long,source:string,text:string>>")


@query("SELECT doc_id, source, lang, text FROM documents")
def src8_json_lines(spark, d):
    path = workspace(spark, "blocks")
    table(spark, d, "documents").select("doc_id", "source", "lang", "text").write.json(path)
    return tables.json_lines(spark, path, "doc_id long, source string, lang string, text string")


@query("SELECT doc_id::VARCHAR AS doc_id, source, text FROM documents")
def src11_csv_rows(spark, d):
    path = workspace(spark, "csv")
    sinks.write_csv(table(spark, d, "documents").select("doc_id", "source", "text"), path)
    return tables.csv_rows(spark, path)


@query(f"SELECT paper_id || '_sec_' || row_number() OVER (PARTITION BY paper_id ORDER BY order_index) AS id, paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY order_index)::INTEGER AS order_index, heading, text FROM {R.TURNS}")
def snk1_normalised_sections(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("order_index", "heading", "text"))), lambda s: F.struct(s["heading"].alias("heading"), s["text"].alias("text")))
    records = R.turns(spark, d).groupBy(F.col("paper_id").alias("id")).agg(F.array(F.lit("A")).alias("authors"), parts.alias("sections"))
    path = workspace(spark, "normalised")
    sinks.write_tables(sinks.normalised(records), path)
    return spark.read.parquet(f"{path}/sections.parquet")


@query(f"SELECT dimension, value, volume::VARCHAR AS volume, co_labels::VARCHAR AS co_labels, quadrant FROM ({relational.SQL['ana3_density_matrix']})")
def snk6_density_csv(spark, d):
    path = workspace(spark, "density")
    sinks.write_csv(network.density_matrix(R.labels(spark, d)), path)
    return tables.csv_rows(spark, path)


@query("SELECT doc_id, u.p AS property_id, u.v::VARCHAR AS value FROM labels, LATERAL (VALUES ('quality', quality), ('toxic', toxic)) u(p, v) WHERE NOT (u.p = 'toxic' AND doc_id % 2 = 1) UNION ALL SELECT doc_id, 'toxic', 'again' FROM labels WHERE doc_id % 2 = 1")
def snk15_observations(spark, d):
    """Observations of two properties; one of them is written again and replaces its own folder alone."""
    tall = table(spark, d, "labels").select("doc_id", F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"))).alias("property_id", "value"))
    path = workspace(spark, "observations")
    review.write_observations(tall, path)
    review.write_observations(tall.where("property_id = 'toxic'").withColumn("value", F.when(F.col("doc_id") % 2 == 1, "again").otherwise(F.col("value"))), path)
    return spark.read.schema("doc_id long, value string, property_id string").json(path)


@query("SELECT 'design.v' || r_regionkey || '.' || lower(r_name) AS id, 'design_v' || r_regionkey || '_' || replace(lower(r_name), '.', '_') || '.json' AS file FROM region")
def snk19_dotted_definitions(spark, d):
    ids = table(spark, d, "region").select(F.concat(F.lit("design.v"), "r_regionkey", F.lit("."), F.lower("r_name")).alias("id"))
    return ids.select("id", review.definition_file(F.col("id")).alias("file"))

"""Source files and their registry: what is new, what has changed, what is as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col


def source_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content, size, modified) of the files in a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def document_id(file_name) -> Column:
    """A file's id: its name without the extension, lowered, runs of blanks and hyphens as one hyphen, none at the ends."""
    stem = F.regexp_replace(col(file_name), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(stem), F.lit(" "), F.lit("-")), "-+", "-"), "^-|-$", "")


def register(files: DataFrame, registry: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(registry after, changes): files(path, content) upserted by document id.

    registry(id, file_name, path, sha256, size, registered_at).  A file is new, changed (another digest) or unchanged (its entry
    stays as it is, with its time); entries without a file stay and count as `absent`.  Of files that share an id the
    one with the largest path is registered.  Contents are digested where they are read and never
    shuffled.
    """
    at = F.current_timestamp() if at is None else at
    name = F.element_at(F.split("path", "/"), -1)
    seen = files.select(document_id(name).alias("id"), F.struct("path", name.alias("file_name"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size")).alias("x"))
    seen = seen.groupBy("id").agg(F.max("x").alias("x")).select("id", "x.*")
    old = registry.select("id", F.struct("file_name", "path", "sha256", "size", "registered_at").alias("old"))
    both = seen.join(old, "id", "full")
    change = F.when(F.col("sha256").isNull(), "absent").when(F.col("old").isNull(), "new").when(F.col("old.sha256") == F.col("sha256"), "unchanged").otherwise("changed")
    both = both.withColumn("change", change)
    keep = F.col("change").isin("absent", "unchanged")
    entry = F.when(keep, F.col("old")).otherwise(F.struct("file_name", "path", "sha256", "size", at.alias("registered_at")))
    return both.select("id", entry.alias("e")).select("id", "e.*"), both.select("id", "change")

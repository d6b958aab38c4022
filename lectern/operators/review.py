"""Review tables: naming, column placement and protection, exports, bundles, reports and definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Review protocols and columns that every review keeps.
PROTOCOLS = ("Dipstick Review", "Expanded Scope", "Agentic Review")
STANDARD = ("id", "title", "authors", "year", "conference", "abstract")


def review_name(name, keywords, protocol=None, search_fields=None) -> tuple[Column, Column]:
    """(name, protocol) of a review: an explicit prefix wins, then the given protocol, then the scope."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    prefix = F.coalesce(*[F.when(raw.startswith(p), F.lit(p)) for p in PROTOCOLS])
    wide = F.array_contains(search_fields, "sections") if search_fields is not None else F.lit(False)
    own = F.coalesce(prefix, protocol if protocol is not None else F.lit(None), F.when(wide, F.lit(PROTOCOLS[1])), F.lit(PROTOCOLS[0]))
    rest = F.when(raw == "", F.array_join(keywords, ", ")).otherwise(raw)
    return F.when(prefix.isNotNull(), raw).otherwise(F.concat_ws(" - ", own, rest)), own


def place(df: DataFrame, column: str, before: str | None = None, after: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with `column` moved right before or after another one, and without `drop`."""
    names = [c for c in df.columns if c != column and c not in drop]
    at = names.index(before) if before in names else names.index(after) + 1 if after in names else len(names)
    return df.select(*names[:at], column, *names[at:])


def without_columns(df: DataFrame, columns: list[str], protected: tuple[str, ...] = STANDARD) -> DataFrame:
    """df without the columns; a protected one is an error."""
    kept = sorted(set(columns) & set(protected))
    if kept:
        raise ValueError(f"protected columns: {', '.join(kept)}")
    return df.drop(*columns)


def without_rows(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def flat_values(df: DataFrame) -> DataFrame:
    """Struct columns that have a field `value` as that value; other columns as they are."""
    def flat(f):
        return F.col(f.name)["value"].alias(f.name) if isinstance(f.dataType, StructType) and "value" in f.dataType.names else F.col(f.name)
    return df.select(*map(flat, df.schema))


def review_csv(papers: DataFrame, observations: DataFrame, properties: list[str]) -> DataFrame:
    """papers(id, ...) with a text column for each property, absent values as ''.

    observations(paper_id, property_id, value); one shuffle for the pivot, the properties are given.
    """
    wide = observations.groupBy(F.col("paper_id").alias("id")).pivot("property_id", properties).agg(F.max(F.col("value").cast("string")))
    both = papers.join(wide, "id", "left")
    return both.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in both.columns])


def bundles(members: DataFrame, papers: DataFrame, observations: DataFrame) -> DataFrame:
    """(review_id, papers, observed, bundle): a JSON document for each review with its papers and their observations."""
    mine = members.select("review_id", F.col("paper_id"))
    seen = observations.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("property_id", "value"))).alias("observations"))
    rows = mine.join(papers.withColumnRenamed("id", "paper_id"), "paper_id").join(seen, "paper_id", "left")
    entry = F.struct("paper_id", "title", F.coalesce("observations", F.array().cast(seen.schema["observations"].dataType)).alias("observations"))
    got = rows.groupBy("review_id").agg(F.count("*").alias("papers"), F.sum(F.coalesce(F.size("observations"), F.lit(0))).alias("observed"), F.sort_array(F.collect_list(entry)).alias("entries"))
    return got.select("review_id", "papers", "observed", F.to_json(F.struct("review_id", "papers", "observed", "entries")).alias("bundle"))


def write_observations(observations: DataFrame, path: str) -> None:
    """Observations as JSON, a folder for each property; a property written again replaces its own folder alone."""
    observations.write.partitionBy("property_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def report(metrics: DataFrame, path: str) -> None:
    """A one-row table of metrics as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def definition_file(name) -> Column:
    """A definition's file name: dots of its id as underscores."""
    return F.concat(F.replace(name, F.lit("."), F.lit("_")), F.lit(".json"))

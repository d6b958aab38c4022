"""Mutations as new table versions: upserts, child replacement, re-keying, cascades, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last writer wins: for each key the new row with the largest `order`, else the old row; ties go by all columns."""
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order), *[F.desc_nulls_last(c) for c in new.columns if c not in key])
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def add_names(known: DataFrame, names: DataFrame, key: str = "display_name", number: str = "id") -> DataFrame:
    """First wins: known(id, name) plus ids for the names not there yet, without gaps after the largest id.

    New names are numbered in blocks by the first letters of a hash, so no task orders them all.
    """
    fresh = names.select(key).where(F.trim(key) != "").distinct().join(known, key, "left_anti").withColumn("_b", F.substring(F.md5(key), 1, 2))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = fresh.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))  # 256 rows at most
    top = known.agg(F.coalesce(F.max(number), F.lit(0)).alias("_t"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    made = fresh.withColumn("_r", rank).join(F.broadcast(starts), "_b").crossJoin(F.broadcast(top)).select((F.col("_t") + F.col("_s") + F.col("_r")).cast("long").alias(number), key)
    return known.select(F.col(number).cast("long").alias(number), key).unionByName(made)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents that `new` mentions are replaced as a whole."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def update_where_changed(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """old with `column` from new where the key has a different value there, and a changed flag."""
    other = new.select(key, F.col(column).alias("_v"))
    changed = F.col("_v").isNotNull() & ~F.col("_v").eqNullSafe(F.col(column))
    both = old.join(other, key, "left")
    return both.withColumn("changed", changed).withColumn(column, F.when(F.col("changed"), F.col("_v")).otherwise(F.col(column))).drop("_v")


def rekey(children: DataFrame, merges: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """children with merged parents' keys replaced (merges: old_key, new_key); of those with one identity the smallest row stays."""
    moved = children.join(merges, F.col(key) == F.col("old_key"), "left").withColumn(key, F.coalesce("new_key", key)).drop("old_key", "new_key")
    rest = [c for c in moved.columns if c not in identity]
    return moved.groupBy(*identity).agg(F.min(F.struct(*rest)).alias("_x")).select(*identity, "_x.*").select(*moved.columns) if rest else moved.distinct()


def surviving(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Cascade delete: the children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def pending(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key the manifest does not have as complete."""
    return rows.join(manifest.where("status = 'complete'").select(key), key, "left_anti")


def members(current: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(review_id, paper_id) after adding and removing papers."""
    keys = ["review_id", "paper_id"]
    return current.select(keys).union(added.select(keys)).distinct().join(removed, keys, "left_anti")


def update_or_append(manifest: DataFrame, changes: DataFrame, key: str, append: bool = True) -> DataFrame:
    """The manifest with the fields of changes set in the entries of their key, and new entries appended.

    A null field of a change leaves the entry's as it is; columns that changes lack stay, and are null in new entries.  Keys
    are unique on both sides.  With append=False changes without an entry are dropped.
    """
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = manifest.join(new, key, "full" if append else "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in manifest.columns])


def synchronised(old: DataFrame, master: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(old with the columns of master where the key is there, one row of counts: <column>_changes).

    A value changes where the master's differs, null or not; rows without a master row stay.  Keys of master are unique.
    """
    own = master.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_m_{c}") for c in columns])
    both = old.join(own, key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    differs = {c: F.col("_hit") & ~F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in columns}
    out = both.select(*[F.when(F.col("_hit"), F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
    return out, both.agg(*[F.count_if(x).alias(f"{c}_changes") for c, x in differs.items()])


def conference_header(text, conference) -> Column:
    """A paper's text with its first `**Conference:** ISLS <year>` naming another conference; a text without one stays."""
    from ..functions.text import col

    mark = r"\*\*Conference:\*\*\s*ISLS\s+\d{4}"
    at, found = F.regexp_instr(col(text), F.lit(mark)), F.regexp_extract(col(text), mark, 0)
    year = F.substring(found, -4, 4)
    put = F.concat(F.substring(col(text), F.lit(1), at - 1), F.lit("**Conference:** "), col(conference), F.lit(" "), year, F.substring(col(text), at + F.length(found), F.length(col(text))))
    return F.when(at > 0, put).otherwise(col(text))


def listed_members(members: DataFrame, reviews: DataFrame) -> DataFrame:
    """reviews(review_id, ...) with the number of papers of each, 0 for those without."""
    return reviews.join(members.groupBy("review_id").agg(F.count_distinct("paper_id").alias("papers")), "review_id", "left").withColumn("papers", F.coalesce("papers", F.lit(0)))

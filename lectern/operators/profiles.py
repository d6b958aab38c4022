"""Layered profiles: JSON documents merged at any depth, and the profile that a name gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = "map<string,variant>"


def _fields(x) -> Column:
    """A JSON object's fields as a map to JSON texts."""
    return F.transform_values(F.from_json(x, _FIELDS), lambda k, v: F.to_json(v))


def _name(k: Column) -> Column:
    """A key as JSON text."""
    listed = F.to_json(F.array(k))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def deep_merge(rows: DataFrame, key: str, base: str, override: str, name: str = "merged") -> DataFrame:
    """rows with `name`: the JSON object of column `base` under that of `override`, merged at any depth; key is unique.

    Where both have an object under a key, the objects are merged; elsewhere the override's value counts, lists and
    nulls included, and what only one has stays.  Keys come out sorted.  A null document counts as an object without keys.
    One round a level: objects on both sides are split into their keys, then put together again from the
    deepest up, so neither depth nor size of a document meets one expression.
    """
    start = rows.select(F.col(key).alias("_row"), F.expr("cast(array() as array<string>)").alias("_path"), F.coalesce(base, F.lit("{}")).alias("b"), F.coalesce(override, F.lit("{}")).alias("o"))
    levels, now = [], start
    while True:
        both = F.ltrim("b").startswith("{") & F.ltrim("o").startswith("{")
        marked = now.withColumn("_both", F.coalesce(both, F.lit(False)))
        levels.append(marked)
        if marked.where("_both").isEmpty():
            break
        split = marked.where("_both").select("_row", "_path", _fields("b").alias("b"), _fields("o").alias("o"))
        keys = F.array_distinct(F.concat(F.map_keys("b"), F.map_keys("o")))
        now = split.select("_row", "_path", "b", "o", F.explode(keys).alias("k")).select("_row", F.concat("_path", F.array("k")).alias("_path"), F.try_element_at("b", F.col("k")).alias("b"), F.try_element_at("o", F.col("k")).alias("o"))
    done = levels[-1].select("_row", "_path", F.coalesce("o", "b").alias("v"))
    for level in reversed(levels[:-1]):
        up = done.select("_row", F.slice("_path", 1, F.size("_path") - 1).alias("_path"), F.struct(F.element_at("_path", -1).alias("k"), "v").alias("kv"))
        made = up.groupBy("_row", "_path").agg(F.array_sort(F.collect_list("kv")).alias("kv"))
        text = F.concat(F.lit("{"), F.array_join(F.transform("kv", lambda x: F.concat(_name(x["k"]), F.lit(":"), x["v"])), ","), F.lit("}"))
        built = level.where("_both").select("_row", "_path").join(made.select("_row", "_path", text.alias("v")), ["_row", "_path"], "left").select("_row", "_path", F.coalesce("v", F.lit("{}")).alias("v"))
        done = level.where("not _both").select("_row", "_path", F.coalesce("o", "b").alias("v")).unionByName(built)
    return rows.join(done.select(F.col("_row").alias(key), F.col("v").alias(name)), key)


def profile_of(file_name, profiles: list[tuple[str, str]], default: str) -> Column:
    """The first profile (id, pattern) whose pattern the name matches, else the default."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.coalesce(*[F.when(name.rlike(f"(?i){pattern}"), F.lit(i)) for i, pattern in profiles], F.lit(default))


def resolve(names: DataFrame, file_name: str, profiles: DataFrame, patterns: list[tuple[str, str]], common: str) -> DataFrame:
    """names with profile_id and profile: the merged profile over the common one that each name gets.

    profiles(profile_id, document) holds the common profile under `common` too; a name without a match gets that one.
    """
    base = profiles.where(F.col("profile_id") == common).select(F.col("document").alias("_base"))
    layered = profiles.crossJoin(F.broadcast(base))  # one row
    merged = deep_merge(layered, "profile_id", "_base", "document", "profile").select("profile_id", "profile")
    return names.withColumn("profile_id", profile_of(file_name, patterns, common)).join(merged, "profile_id", "left")

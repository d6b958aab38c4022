"""Regex taxonomies: multi-label assignment, defaults, centrality, concept mining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import context

Rules = dict[str, dict[str, list[str]]]


def any_of(patterns: list[str]) -> str:
    """One case-insensitive alternation of a label's patterns."""
    return "(?iu)(" + "|".join(patterns) + ")"


def centrality(title, abstract, patterns: list[str]) -> Column:
    """5 for a title hit, 4 for three or more abstract hits over all patterns, 3 for one, else 1."""
    hits = reduce(lambda a, b: a + b, [F.coalesce(F.regexp_count(abstract, F.lit(f"(?iu){p}")), F.lit(0)) for p in patterns])
    return F.when(F.col(title).rlike(any_of(patterns)), 5).when(hits >= 3, 4).when(hits >= 1, 3).otherwise(1)


def classify(papers: DataFrame, rules: Rules, defaults: dict[str, str], title: str = "title", abstract: str = "body") -> DataFrame:
    """(id, dimension, label, centrality, confidence): every matching label, or the default.

    One literal pattern per label, so each is compiled once a task and the papers are read once.
    """
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    df, arrays = papers.select("id", title, abstract, text.alias("_text")), []
    for dimension, labels in rules.items():
        found = F.array_compact(F.array(*[F.when(F.col("_text").rlike(any_of(p)), F.struct(
            F.lit(dimension).alias("dimension"), F.lit(label).alias("label"), centrality(title, abstract, p).alias("centrality"), F.lit(0.9).alias("confidence")))
            for label, p in labels.items()]))
        if dimension in defaults:
            none = F.array(F.struct(F.lit(dimension).alias("dimension"), F.lit(defaults[dimension]).alias("label"), F.lit(1).alias("centrality"), F.lit(0.5).alias("confidence")))
            found = F.when(F.size(found) == 0, none).otherwise(found)
        arrays.append(found)
    return df.select("id", F.explode(F.flatten(F.array(*arrays))).alias("x")).select("id", "x.*")


def mirrored(labels: DataFrame, source: str, copy: str) -> DataFrame:
    """labels with the rows of one dimension repeated under another name."""
    extra = F.when(F.col("dimension") == source, F.array(F.lit(source), F.lit(copy))).otherwise(F.array("dimension"))
    return labels.withColumn("dimension", F.explode(extra))


def concepts(papers: DataFrame, rules: Rules, text: str, around: int = 40) -> DataFrame:
    """(id, family, label, snippet): labels found in non-null texts, with the context of the first match of the first pattern that matches."""
    found = [F.when(F.col(text).rlike(any_of(ps)), F.struct(F.lit(family).alias("family"), F.lit(label).alias("label"), F.coalesce(*[context(text, any_of([p]), around) for p in ps]).alias("snippet")))
             for family, labels in rules.items() for label, ps in labels.items()]
    return papers.where(F.col(text).isNotNull()).select("id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("id", "x.*")


def lens(text, chain: dict[str, list[str]], fallback: list[str], number) -> Column:
    """The first lens with a substring hit, else one of the fallbacks in turn by row number."""
    low = F.lower(text)
    rules = []
    for name, words in chain.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        rules.append(F.when(hit, F.lit(name)))
    return F.coalesce(*rules, F.element_at(F.array(*map(F.lit, fallback)), (F.pmod(number, F.lit(len(fallback))) + 1).cast("int")))

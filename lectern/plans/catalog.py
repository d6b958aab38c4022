"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import corpus, entries, evidence, grid, people, relational, repair, roundtrip, rulebook, shapes, upkeep


def queries() -> dict:
    return {**relational.FOUND, **corpus.FOUND, **grid.FOUND, **repair.FOUND, **shapes.FOUND, **people.FOUND, **evidence.FOUND, **upkeep.FOUND, **rulebook.FOUND, **roundtrip.FOUND, **entries.FOUND}


def oracle_sql() -> dict:
    return {**relational.SQL, **corpus.SQL, **grid.SQL, **repair.SQL, **shapes.SQL, **people.SQL, **evidence.SQL, **upkeep.SQL, **rulebook.SQL, **roundtrip.SQL, **entries.SQL}

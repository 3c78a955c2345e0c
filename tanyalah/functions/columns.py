"""Which column is a question about? SQL expressions over the question.

``columns`` is one list of names for all questions, or the SQL text of an array
column where each question brings its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intent import WORDS_IN_CODE, contains_any
from .sqltext import array, string, strings_type
from .vocab import (
    AGE_COLUMNS,
    DEFAULT_VOCABULARY,
    FALLBACK_COLUMNS,
    NAME_COLUMNS,
    PLACEHOLDER_COLUMN,
    Vocabulary,
)

ColumnList = Sequence[str] | Column


def usable_columns(columns: ColumnList | None) -> Column:
    """The given column list, or the fallback names when there is none."""
    if not isinstance(columns, Column):
        return F.expr(array(columns or FALLBACK_COLUMNS))
    given = F.coalesce(columns, F.expr(strings_type("array()")))
    return F.when(F.size(given) == 0, F.expr(array(FALLBACK_COLUMNS))).otherwise(given)


def detect_column(
    lowered: str,
    columns: Sequence[str] | str,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> str:
    """Column named in the question, else by synonym, else the first one."""
    if isinstance(columns, str):
        return _detect_per_row(lowered, columns, vocabulary)
    names = list(columns)
    if not names:
        return string(PLACEHOLDER_COLUMN)
    said = [(n.lower(), n) for n in names]
    for term, parts in vocabulary.synonyms.items():
        meant = [n for n in names if any(p in n.lower() for p in parts)]
        said += [(term, n) for n in meant[:1]]
    if len(said) <= WORDS_IN_CODE:
        branches = [
            f"WHEN contains({lowered}, {string(word)}) THEN {string(name)}"
            for word, name in said
        ]
        return f"CASE {' '.join(branches)} ELSE {string(names[0])} END"
    pairs = ", ".join(
        f"named_struct('word', {string(word)}, 'name', {string(name)})" for word, name in said
    )
    first = f"get(filter(array({pairs}), c -> contains({lowered}, c.word)), 0).name"
    return f"coalesce({first}, {string(names[0])})"


def _detect_per_row(lowered: str, columns: str, vocabulary: Vocabulary) -> str:
    choices = [f"get(filter({columns}, c -> contains({lowered}, lower(c))), 0)"]
    for term, parts in vocabulary.synonyms.items():
        meant = f"get(filter({columns}, c -> {contains_any('lower(c)', parts)}), 0)"
        choices.append(f"CASE WHEN contains({lowered}, {string(term)}) THEN {meant} END")
    return f"coalesce({', '.join(choices)}, get({columns}, 0), {string(PLACEHOLDER_COLUMN)})"


def person_columns(columns: Sequence[str]) -> tuple[str, str] | None:
    """Name and age column of a list, as they stand where both are first known."""
    lowered = [c.lower() for c in columns]
    firsts = [
        next((i for i, c in enumerate(lowered) if c in wanted), None)
        for wanted in (NAME_COLUMNS, AGE_COLUMNS)
    ]
    if None in firsts:
        return None
    seen = list(zip(columns, lowered))[: max(firsts) + 1]
    return tuple(
        [c for c, low in seen if low in wanted][-1]
        for wanted in (NAME_COLUMNS, AGE_COLUMNS)
    )


def person_column_exprs(columns: Sequence[str] | str) -> tuple[str, str] | None:
    """As ``person_columns``, in SQL; for array columns null where one is missing."""
    if not isinstance(columns, str):
        pair = person_columns(columns)
        return (string(pair[0]), string(pair[1])) if pair else None

    def first(wanted: tuple[str, ...]) -> str:
        kinds = f"transform({columns}, c -> array_contains({array(wanted)}, lower(c)))"
        return f"array_position({kinds}, true)"

    first_name, first_age = first(NAME_COLUMNS), first(AGE_COLUMNS)
    end = f"CAST(greatest({first_name}, {first_age}) AS int)"

    def last(wanted: tuple[str, ...]) -> str:
        seen = f"slice({columns}, 1, {end})"
        fits = f"filter({seen}, c -> array_contains({array(wanted)}, lower(c)))"
        return f"CASE WHEN {first_name} > 0 AND {first_age} > 0 THEN element_at({fits}, -1) END"

    return last(NAME_COLUMNS), last(AGE_COLUMNS)

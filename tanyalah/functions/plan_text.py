"""Spark SQL text for a classified question.

The text runs with ``spark.sql``. ``:value`` is a named parameter of
``spark.sql(text, args=...)``; ``:func`` and ``:columns`` mark places where the
user puts an expression or the columns before running it.
"""

from __future__ import annotations

from collections.abc import Sequence

from .columns import person_column_exprs
from .sqltext import array, string
from .vocab import PLACEHOLDER_COLUMN

AGGREGATES = {"MAX": "max", "MIN": "min", "SUM": "sum", "MEAN": "avg", "COUNT": "count"}
ROW_ORDER = {"MAX": "DESC", "MIN": "ASC"}
UNKNOWN_PLAN = "-- unknown operation"


def quoted(name: str) -> str:
    return f"concat('`', replace({name}, '`', '``'), '`')"


def plan_text(columns: Sequence[str] | str, view: str = "t") -> str:
    """SQL expression over the columns that ``classify_column`` adds.

    ``columns`` as in ``detect_column``.
    """
    source = string(f" FROM {view}")
    name = quoted(
        f"CASE WHEN detected_column = '' THEN {string(PLACEHOLDER_COLUMN)} "
        "ELSE detected_column END"
    )
    listed = columns if isinstance(columns, str) else array(columns)
    named = f"filter({listed}, c -> c <> '')"
    person = person_column_exprs(columns)
    fields = "'*'"
    if person:
        pair = f"concat({quoted(person[0])}, ', ', {quoted(person[1])})"
        fields = f"coalesce({pair}, '*')"

    def over_all(function: str) -> str:
        call = f"concat('{function}(', {quoted('c')}, ') AS ', {quoted('c')})"
        return (
            f"CASE WHEN size({named}) = 0 THEN '{function}(:columns)' "
            f"ELSE array_join(transform({named}, c -> {call}), ', ') END"
        )

    branches = [
        f"WHEN operation = '{operation}' AND wants_row AND detected_column <> '' THEN "
        f"concat('SELECT ', {fields}, {source}, ' WHERE ', {name}, "
        f"' IS NOT NULL ORDER BY ', {name}, ' {order} LIMIT 1')"
        for operation, order in ROW_ORDER.items()
    ]
    branches.append(
        "WHEN operation = 'COUNT' AND wants_row_count THEN "
        f"concat('SELECT count(*)', {source})"
    )
    branches += [
        f"WHEN operation = '{operation}' THEN concat('SELECT ', CASE WHEN "
        f"detected_column = '' THEN {over_all(function)} "
        f"ELSE concat('{function}(', {name}, ')') END, {source})"
        for operation, function in AGGREGATES.items()
    ]
    branches += [
        "WHEN operation = 'FILTER' THEN "
        f"concat('SELECT *', {source}, ' WHERE ', {name}, ' > :value')",
        "WHEN operation = 'SORT' THEN "
        f"concat('SELECT *', {source}, ' ORDER BY ', {name}, ' ASC NULLS LAST')",
        "WHEN operation = 'GROUP' THEN "
        f"concat('SELECT ', {name}, ', :func', {source}, ' WHERE ', {name}, "
        f"' IS NOT NULL GROUP BY ', {name})",
    ]
    return f"CASE {' '.join(branches)} ELSE {string(UNKNOWN_PLAN)} END"

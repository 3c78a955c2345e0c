"""Pieces of Spark SQL text.

The expressions of this package are written as SQL text: one text is one call
into the JVM, where a tree of Column objects costs a call, and a search for the
calling line, per node. Spark makes the same plan of both.
"""

from __future__ import annotations

from collections.abc import Iterable


def string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def array(values: Iterable[str | float]) -> str:
    return f"array({', '.join(map(literal, values))})"


def strings_type(expression: str) -> str:
    return f"CAST({expression} AS array<string>)"


def once(**expressions: str) -> str:
    """The expressions as columns that are evaluated exactly once per row.

    Spark may move a condition on a column below the projection that defines
    it, and put the whole definition in its place: the work is then done twice,
    and parts of it once per use. It does not move conditions on the output of
    a generator.
    """
    fields = ", ".join(f"{string(name)}, {e}" for name, e in expressions.items())
    return f"inline(array(named_struct({fields})))"


def values(rows: Iterable[tuple], ddl: str) -> str:
    """A query for a small table. It needs no Python worker to be read."""
    names = [part.split(" ", 1) for part in ddl.split(", ")]
    listed = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    fields = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in names)
    return f"SELECT {fields} FROM VALUES {listed} AS t({', '.join(n for n, _ in names)})"


def literal(value: str | int | float | bool | None) -> str:
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return string(value)
    return f"{value!r}D" if isinstance(value, float) else str(value)

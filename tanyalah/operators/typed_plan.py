"""Spark SQL text that means what ``ask`` does, and running such texts.

The text of a question depends on the types of the table: floating columns
leave NaN out, sums of nothing are 0, sums and means take numeric columns
only, and rows of one value come in the same order as from ``ask``. A table
has few different texts, so they are written once, and questions look theirs
up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import person_columns
from ..functions.sqltext import ident, string
from .answer import SCALAR_OPERATIONS, UnsupportedColumn, is_float, supports

PLAN = "plan_sql"
REFUSED = "-- "
_CALLS = {"MAX": "max", "MIN": "min", "MEAN": "avg", "COUNT": "count"}
_DIRECTIONS = {"MAX": "DESC", "MIN": "ASC"}


def _known(df: DataFrame, name: str) -> str:
    column = ident(name)
    return f"CASE WHEN NOT isnan({column}) THEN {column} END" if is_float(df, name) else column


def _present(df: DataFrame, name: str) -> str:
    column = ident(name)
    return f"{column} IS NOT NULL" + (f" AND NOT isnan({column})" if is_float(df, name) else "")


def _aggregate(df: DataFrame, operation: str, name: str) -> str:
    value = _known(df, name)
    if operation != "SUM":
        return f"{_CALLS[operation]}({value}) AS {ident(name)}"
    if isinstance(df.schema[name].dataType, T.IntegralType):
        value = f"CAST({value} AS decimal(38,0))"
    return f"coalesce(sum({value}), 0) AS {ident(name)}"


def plan_for(
    df: DataFrame,
    operation: str,
    column: str,
    by_row: bool = False,
    columns: Sequence[str] | None = None,
    view: str = "t",
) -> str:
    """The text for one operation on one column; a blank column is the whole table.

    ``by_row`` asks for the row of a MAX or MIN, and for the rows of a COUNT.
    ``:value`` and ``:func`` mark what the user adds. An operation that is not
    defined on the column gives a comment that says so.
    """
    source = f" FROM {view}"
    if operation == "COUNT" and by_row:
        return f"SELECT count(1) AS row_count{source}"
    if operation in SCALAR_OPERATIONS and not column:
        able = [c for c in df.columns if supports(df, operation, c)]
        if not able:
            return f"{REFUSED}no column supports {operation}"
        return "SELECT " + ", ".join(_aggregate(df, operation, c) for c in able) + source
    if column not in df.columns:
        return f"{REFUSED}{operation} needs a column"
    if operation in SCALAR_OPERATIONS and not supports(df, operation, column):
        kind = df.schema[column].dataType.simpleString()
        return f"{REFUSED}{operation} is not defined on {column} ({kind})"
    others = [c for c in df.columns if c != column and supports(df, "MAX", c)]
    if operation in _DIRECTIONS and by_row:
        person = person_columns(list(columns or df.columns))
        ties = [c for c in person if c != column and supports(df, "MAX", c)] if person else others
        order = [f"{ident(column)} {_DIRECTIONS[operation]}"]
        order += [f"{_known(df, c)} ASC NULLS LAST" for c in ties]
        shown = ", ".join(map(ident, person)) if person else "*"
        present = _present(df, column)
        return f"SELECT {shown}{source} WHERE {present} ORDER BY {', '.join(order)} LIMIT 1"
    if operation in SCALAR_OPERATIONS:
        return f"SELECT {_aggregate(df, operation, column)}{source}"
    if operation == "SORT":
        order = f"{_known(df, column)} ASC NULLS LAST"
        if others:
            order += f", xxhash64({', '.join(_known(df, c) for c in others)}) ASC NULLS LAST"
        return f"SELECT *{source} ORDER BY {order}"
    if operation == "GROUP":
        name = ident(column)
        return f"SELECT {name}, :func{source} WHERE {_present(df, column)} GROUP BY {name}"
    number = f" AND NOT isnan({ident(column)})" if is_float(df, column) else ""
    return f"SELECT *{source} WHERE {ident(column)} > :value{number}"


def _key(operation: str, by_row: bool, column: str) -> str:
    return f"{operation}|{str(by_row).lower()}|{column}"


def with_typed_plan(
    classified: DataFrame, df: DataFrame, columns: Sequence[str] | None = None, view: str = "t"
) -> DataFrame:
    """Add ``plan_sql`` to questions that ``classify_column`` has read with the columns of `df`.

    The texts, at most ten per column, stand in the plan as one map.
    """
    names = list(dict.fromkeys(columns or df.columns))
    entries = []
    for column in names:
        for operation in (*SCALAR_OPERATIONS, "SORT", "GROUP", "FILTER"):
            for by_row in (False, True) if operation in ("MAX", "MIN", "COUNT") else (False,):
                text = plan_for(df, operation, column, by_row, names, view)
                entries += [string(_key(operation, by_row, column)), string(text)]
    by_row = (
        "CASE WHEN operation IN ('MAX', 'MIN') THEN wants_row AND detected_column <> '' "
        "WHEN operation = 'COUNT' THEN wants_row_count ELSE false END"
    )
    key = f"concat(operation, '|', {by_row}, '|', detected_column)"
    return classified.selectExpr("*", f"try_element_at(map({', '.join(entries)}), {key}) AS {PLAN}")


def run_plan(
    df: DataFrame, text: str, value=None, func: str | None = None, view: str = "t"
) -> DataFrame:
    """Run one text on `df`; ``value`` and ``func`` (SQL aggregates) fill its marks."""
    if text.startswith(REFUSED):
        raise UnsupportedColumn(text.removeprefix(REFUSED))
    if ":func" in text and func is None:
        raise ValueError("a GROUP text needs func")
    if ":value" in text and value is None:
        raise ValueError("a FILTER text needs value")
    df.createOrReplaceTempView(view)
    args = {"value": value} if ":value" in text else None
    return df.sparkSession.sql(text.replace(":func", func or ""), args)


def run_plans(planned: DataFrame, df: DataFrame, view: str = "t") -> DataFrame:
    """Add ``plan_answer`` to questions with ``plan_sql``: the value of texts that give one, as text.

    The different texts among any number of questions are few, at most ten per
    column. Their aggregates become one statement with one scan of the table,
    and their answers go back by a broadcast join. Texts that give rows,
    several columns, or need a mark filled have a null.
    """
    texts = [r[0] for r in planned.select(PLAN).distinct().collect()]
    df.createOrReplaceTempView(view)
    spark = df.sparkSession
    single = [t for t in texts if t and _gives_one_value(t)]
    if not single:
        return planned.withColumn("plan_answer", F.lit(None).cast("string"))
    values = [t.removeprefix("SELECT ").removesuffix(f" FROM {view}").rpartition(" AS ")[0] for t in single]
    totals = spark.sql("SELECT " + ", ".join(f"{v} AS a{k}" for k, v in enumerate(values)) + f" FROM {view}")
    rows = ", ".join(
        f"named_struct('{PLAN}', {string(t)}, 'plan_answer', CAST(a{k} AS string))" for k, t in enumerate(single)
    )
    answers = totals.selectExpr(f"inline(array({rows}))")
    return planned.join(F.broadcast(answers), PLAN, "left").select(*planned.columns, "plan_answer")


def _gives_one_value(text: str) -> bool:
    """An aggregate of one column or of all rows."""
    marked = any(mark in text for mark in (":value", ":func", " ORDER BY ", "SELECT *"))
    return not marked and not text.startswith(REFUSED) and text.count(" AS `") + text.count(" AS row_count") == 1


def answer_number(column: str = "plan_answer") -> Column:
    """The answer as a double, null where it is none."""
    return F.expr(f"try_cast({ident(column)} AS double)")

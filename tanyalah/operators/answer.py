"""The eight operations on any table, and the dispatch from a question.

Missing values follow the data-frame convention: NULL and NaN are skipped by
aggregates, never pass a comparison, sort last, and form no group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import person_columns
from ..functions.vocab import DEFAULT_VOCABULARY, Vocabulary
from .classify import classify_one
from .learned import Model

SCALAR_OPERATIONS = ("MAX", "MIN", "SUM", "MEAN", "COUNT")
_UNORDERED = (T.MapType, T.VariantType)


class UnsupportedColumn(TypeError):
    """The operation is not defined on the type of the column."""


def col_of(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    column = col_of(name)
    return F.when(~F.isnan(column), column) if is_float(df, name) else column


def _present(df: DataFrame, name: str) -> Column:
    """Filter for rows with a value; its IS NOT NULL reaches the scan."""
    column = col_of(name)
    filled = column.isNotNull()
    return filled & ~F.isnan(column) if is_float(df, name) else filled


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared, inside arrays and structs too."""
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, _UNORDERED)


def supports(df: DataFrame, operation: str, name: str) -> bool:
    kind = df.schema[name].dataType
    if operation in ("SUM", "MEAN"):
        return isinstance(kind, T.NumericType)
    if operation in ("MAX", "MIN"):
        return _ordered(kind)
    return True


def exact_sum(value: Column) -> Column:
    """Sum of whole numbers as a decimal, free of overflow.

    A sum of longs overflows on large tables, and a sum of decimals takes two to
    three times as long per group. So the number is summed in three parts of 21
    bits (the first with the sign), each a sum of longs that can take 4e12 rows.
    """
    number, low = value.cast("bigint"), F.lit((1 << 21) - 1)
    parts = (
        (F.shiftright(number, 42), 1 << 42),
        (F.shiftright(number, 21).bitwiseAND(low), 1 << 21),
        (number.bitwiseAND(low), 1),
    )
    first, second, third = (
        F.sum(part).cast("decimal(20,0)") * F.lit(weight) for part, weight in parts
    )
    return (first + second + third).cast("decimal(38,0)")


def aggregate_expr(df: DataFrame, operation: str, name: str) -> Column:
    if not supports(df, operation, name):
        kind = df.schema[name].dataType.simpleString()
        raise UnsupportedColumn(f"{operation} is not defined on {name} ({kind})")
    value = known(df, name)
    if operation == "MAX":
        return F.max(value)
    if operation == "MIN":
        return F.min(value)
    if operation == "SUM":
        whole = isinstance(df.schema[name].dataType, T.IntegralType)
        return F.coalesce(exact_sum(value) if whole else F.sum(value), F.lit(0))
    if operation == "MEAN":
        return F.avg(value)
    if operation == "COUNT":
        return F.count(value)
    raise ValueError(f"{operation} gives no single value")


def aggregate(df: DataFrame, operation: str, column: str | None = None) -> DataFrame:
    """One row: the aggregate of one column, or of every column that has one."""
    names = [column] if column else [c for c in df.columns if supports(df, operation, c)]
    if not names:
        raise UnsupportedColumn(f"no column supports {operation}")
    return df.agg(*[aggregate_expr(df, operation, n).alias(n) for n in names])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def _tie_names(
    df: DataFrame,
    column: str,
    tie: Sequence[str] | str | None,
    project: Sequence[str] | None,
) -> list[str]:
    """The given names, else the other columns of the result that have an order.

    Rows that agree in all columns of the result are the same row of it, so a
    projection needs no further column.
    """
    if tie is not None:
        return [tie] if isinstance(tie, str) else list(tie)
    return [c for c in project or df.columns if c != column and supports(df, "MAX", c)]


def extreme_row(
    df: DataFrame,
    operation: str,
    column: str,
    tie: Sequence[str] | str | None = None,
    project: Sequence[str] | None = None,
) -> DataFrame:
    """The whole row with the largest (MAX) or smallest (MIN) value.

    Two passes: the first reads one column, the second reads the other columns
    of the matching rows only, with row groups skipped by their statistics. Of
    several matching rows the tie columns pick one by a per-task top-1. Write
    an expensive derived table first, since it is read twice.
    """
    best = df.agg(aggregate_expr(df, operation, column).alias("best")).scalar()
    found = df.filter(_present(df, column) & (col_of(column) == best))
    ties = _tie_names(df, column, tie, project)
    top = found.orderBy(*[known(df, n).asc_nulls_last() for n in ties]).limit(1)
    return top.select(*map(col_of, project)) if project else top


def filter_above(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with a value strictly above the given one; pushed to the scan."""
    above = col_of(column) > F.lit(value)
    # Spark orders NaN above every number.
    return df.filter(above & ~F.isnan(col_of(column)) if is_float(df, column) else above)


def sort_by(
    df: DataFrame,
    column: str,
    tie: Sequence[str] | str | None = None,
    project: Sequence[str] | None = None,
) -> DataFrame:
    """All rows in ascending order, missing values last (a range-partitioned sort).

    Rows of one value are in the order of the tie columns, else of the other
    projected ones, else of one hash of all others. So the order is the same
    on every run, the range partitioning can split a value that many rows
    share, and its sample, which the driver gets, holds no whole rows.
    """
    ties = _tie_names(df, column, tie, project)
    keys = [known(df, n) for n in ties]
    if tie is None and project is None and keys:
        keys = [F.xxhash64(*keys)]
    ordered = df.orderBy(*[k.asc_nulls_last() for k in (known(df, column), *keys)])
    return ordered.select(*map(col_of, project)) if project else ordered


_FUNCTIONS = {"max": "MAX", "min": "MIN", "sum": "SUM", "mean": "MEAN", "count": "COUNT"}


def group_agg(
    df: DataFrame, column: str, func: str | Column | Sequence[str | Column]
) -> DataFrame:
    """Aggregate per value of a column; rows without a value form no group.

    ``func`` is a name (max, min, sum, mean, count), applied to every other
    column that supports it, an aggregate Column, or a list of both. All are
    built-in aggregates with partial results before the shuffle, so a value
    held by a large part of the rows is no heavier than another.
    """
    funcs = [func] if isinstance(func, (str, Column)) else list(func)
    if not funcs:
        raise ValueError("func must not be empty")
    plain = isinstance(func, str)
    aggregates = []
    for f in funcs:
        if isinstance(f, Column):
            aggregates.append(f)
            continue
        if f not in _FUNCTIONS:
            raise ValueError(f"unknown func {f!r}, use one of {', '.join(_FUNCTIONS)}")
        for name in df.columns:
            if name != column and supports(df, _FUNCTIONS[f], name):
                expr = aggregate_expr(df, _FUNCTIONS[f], name)
                aggregates.append(expr.alias(name if plain else f"{name}_{f}"))
    return df.filter(_present(df, column)).groupBy(col_of(column)).agg(*aggregates)


def group_size(df: DataFrame, column: str) -> DataFrame:
    return group_agg(df, column, F.count(F.lit(1)).alias("size"))


@dataclass(frozen=True)
class Intent:
    """What one question asks for."""

    operation: str
    confidence: float
    by_rule: bool
    column: str
    wants_row: bool
    wants_row_count: bool


def understand(
    df: DataFrame,
    question: str,
    columns: Sequence[str] | None = None,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    model: Model | None = None,
) -> Intent:
    """Classify a single question with the same expressions as a whole table."""
    names = list(columns or df.columns)
    row = classify_one(df.sparkSession, question, names, vocabulary, model)
    return Intent(
        row["operation"], row["confidence"], row["by_rule"], row["detected_column"],
        row["wants_row"], row["wants_row_count"],
    )


def ask(
    df: DataFrame,
    question: str,
    value=None,
    func: str | Column | Sequence[str | Column] | None = None,
    tie: Sequence[str] | str | None = None,
    columns: Sequence[str] | None = None,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    model: Model | None = None,
) -> DataFrame:
    """Answer one question on a table, lazily.

    ``value`` is needed for FILTER, ``func`` for GROUP. ``columns`` replaces
    the column names offered to the question; a blank name among them stands
    for the whole table. A ``model`` decides where no rule applies.
    """
    names = list(columns) if columns else df.columns
    intent = understand(df, question, names, vocabulary, model)
    operation, column = intent.operation, intent.column
    if operation == "COUNT" and intent.wants_row_count:
        return row_count(df)
    if operation in SCALAR_OPERATIONS and not column:
        return aggregate(df, operation)
    if not column:
        raise ValueError(f"{operation} needs a column")
    if operation in ("MAX", "MIN") and intent.wants_row:
        return extreme_row(df, operation, column, tie, person_columns(names))
    if operation in SCALAR_OPERATIONS:
        return aggregate(df, operation, column)
    if operation == "SORT":
        return sort_by(df, column, tie)
    if operation == "GROUP":
        if func is None:
            raise ValueError("a GROUP question needs func")
        return group_agg(df, column, func)
    if value is None:
        raise ValueError("a FILTER question needs value")
    return filter_above(df, column, value)

"""Answer a table of questions about one table in a single scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocab import DEFAULT_VOCABULARY, Vocabulary
from .answer import SCALAR_OPERATIONS, aggregate_expr, supports
from .classify import classify_column
from .learned import Model

ROWS = "*"
_ANSWER = (
    "operation string, answer_key string, answer_double double, "
    "answer_exact string, answer_string string, supported boolean"
)


def answer_many(
    questions: DataFrame,
    df: DataFrame,
    text: str = "query",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    model: Model | None = None,
) -> DataFrame:
    """Add operation, detected_column, answer_double, answer_exact, answer_string and status.

    Many questions ask for few different (operation, column) pairs: at most
    five operations times the columns of the table. One job over the questions
    finds the pairs in use, one aggregation over the table computes all of
    them while reading only the columns they need, and a broadcast join of
    those few answers leaves the questions unshuffled.

    status: ok; row_wanted (the question asks for a row: the value is given,
    ``ask`` returns the row); unsupported_type; needs_value (FILTER);
    needs_func (GROUP); whole_table (SORT). Numbers are in answer_double;
    whole numbers and decimals, which a double may round, in answer_exact too,
    as text; everything else is in answer_string.
    """
    asked = classify_column(questions, df.columns, text, vocabulary, model).withColumn(
        "answer_key",
        F.when((F.col("operation") == "COUNT") & F.col("wants_row_count"), ROWS).otherwise(
            F.col("detected_column")
        ),
    )
    # At most 8 * (number of columns + 1) rows. Not filtered in Spark, as the
    # filter would classify every question a second time.
    pairs = asked.select("operation", "answer_key").distinct().collect()
    scalar = [tuple(p) for p in pairs if p["operation"] in SCALAR_OPERATIONS]
    answers = _answers(df, sorted(scalar))
    joined = asked.join(F.broadcast(answers), ["operation", "answer_key"], "left")
    status = (
        F.when(F.col("operation") == "FILTER", "needs_value")
        .when(F.col("operation") == "GROUP", "needs_func")
        .when(F.col("operation") == "SORT", "whole_table")
        .when(~F.col("supported"), "unsupported_type")
        .when(F.col("wants_row") & F.col("operation").isin("MAX", "MIN"), "row_wanted")
        .otherwise("ok")
    )
    return joined.select(
        *questions.columns,
        "operation",
        "detected_column",
        "answer_double",
        "answer_exact",
        "answer_string",
        status.alias("status"),
    )


def _answers(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row per pair, from one aggregation over the table."""
    if not pairs:
        return df.sparkSession.createDataFrame([], _ANSWER)
    able = {p: p[1] == ROWS or supports(df, *p) for p in pairs}
    values = {p: f"a{i}" for i, p in enumerate(pairs) if able[p]}
    exprs = [_value(df, *p).alias(name) for p, name in values.items()]
    totals = df.agg(*(exprs or [F.count(F.lit(1))]))

    def as_row(pair: tuple[str, str]) -> Column:
        operation, key = pair
        number = F.lit(None).cast("double")
        exact = string = F.lit(None).cast("string")
        if able[pair]:
            kind = totals.schema[values[pair]].dataType
            if isinstance(kind, T.NumericType):
                number = F.col(values[pair]).cast("double")
                if not isinstance(kind, (T.FloatType, T.DoubleType)):
                    exact = F.col(values[pair]).cast("string")
            else:
                string = F.col(values[pair]).cast("string")
        return F.struct(
            F.lit(operation).alias("operation"),
            F.lit(key).alias("answer_key"),
            number.alias("answer_double"),
            exact.alias("answer_exact"),
            string.alias("answer_string"),
            F.lit(able[pair]).alias("supported"),
        )

    return totals.select(F.inline(F.array(*map(as_row, pairs))))


def _value(df: DataFrame, operation: str, key: str) -> Column:
    return F.count(F.lit(1)) if key == ROWS else aggregate_expr(df, operation, key)

"""Classify a table or stream of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import intent
from ..functions.columns import ColumnList, detect_column, usable_columns
from ..functions.plan_text import plan_text
from ..functions.sqltext import ident, once, values
from ..functions.vocab import (
    DEFAULT_VOCABULARY,
    DESCRIPTIONS,
    EXAMPLES,
    FALLBACK_COLUMNS,
    OPERATIONS,
    Vocabulary,
)
from .learned import VERSION, Model, decide

LOWERED = "__lowered"
RULE = "__rule"
COLUMNS = "columns_used"
# A table that is classified again gets these anew.
RESULTS = (
    "operation", "confidence", "by_rule", "detected_column",
    "wants_row", "wants_row_count", "generated_code", VERSION,
)


def classify_operation(
    questions: DataFrame,
    text: str = "query",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    model: Model | None = None,
) -> DataFrame:
    """Add ``operation``, ``confidence`` and ``by_rule``.

    Rules come first; a ``model`` decides where none applies, and adds
    ``model_version``.

    One pass that lower-cases and matches every text once, whatever is done
    with the result. No shuffle, no Python.
    """
    questions = questions.drop(*RESULTS)
    lowered = questions.selectExpr("*", f"lower({ident(text)}) AS {LOWERED}")
    rule = intent.rule_number(LOWERED, vocabulary)
    matched = lowered.selectExpr("*", once(**{RULE: rule}))
    ruled = _named(matched, vocabulary).drop(LOWERED, RULE)
    return decide(ruled, model, text) if model else ruled


def classify_column(
    questions: DataFrame,
    columns: ColumnList | None = None,
    text: str = "query",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    model: Model | None = None,
) -> DataFrame:
    """As ``classify_operation``, with the column and kind of answer wanted.

    Adds detected_column, wants_row, wants_row_count and columns_used.
    ``columns`` is one list of names for all questions or an array column.
    """
    matched = (
        questions.drop(*RESULTS)
        .withColumn(COLUMNS, usable_columns(columns))
        .selectExpr("*", f"lower({ident(text)}) AS {LOWERED}")
        .selectExpr("*", once(**{RULE: intent.rule_number(LOWERED, vocabulary)}))
        .selectExpr("*", once(**_wanted(columns, vocabulary)))
    )
    ruled = _named(matched, vocabulary).drop(LOWERED, RULE)
    return decide(ruled, model, text) if model else ruled


def classify_one(
    spark: SparkSession,
    question: str,
    columns: Sequence[str],
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    model: Model | None = None,
) -> Row:
    """``classify_column`` for a single question, which Spark's optimizer
    evaluates by itself, without a job. A model takes one where no rule applies."""
    asked = spark.sql(
        f"SELECT *, lower(query) AS {LOWERED} FROM VALUES (:question) AS asked(query)",
        args={"question": question},
    )
    parts = {RULE: intent.rule_number(LOWERED, vocabulary), **_wanted(columns, vocabulary)}
    matched = asked.selectExpr("*", *[f"{e} AS {name}" for name, e in parts.items()])
    ruled = _named(matched, vocabulary)
    row = ruled.first()
    return row if row["by_rule"] or not model else decide(ruled, model, "query").first()


def _wanted(columns: ColumnList | None, vocabulary: Vocabulary) -> dict[str, str]:
    return {
        "detected_column": detect_column(LOWERED, _sql_columns(columns), vocabulary),
        "wants_row": intent.wants_row(LOWERED),
        "wants_row_count": intent.wants_row_count(LOWERED),
    }


def _named(matched: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    return matched.selectExpr(
        "*",
        f"{intent.operation_of(RULE, vocabulary)} AS operation",
        f"{intent.confidence_of(RULE, vocabulary)} AS confidence",
        f"{RULE} > 0 AS by_rule",
    )


def classify(
    questions: DataFrame,
    columns: ColumnList | None = None,
    text: str = "query",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    view: str = "t",
    model: Model | None = None,
) -> DataFrame:
    """The whole result record: ``classify_column`` and the generated_code."""
    code = plan_text(_sql_columns(columns), view)
    return classify_column(questions, columns, text, vocabulary, model).selectExpr(
        "*", f"{code} AS generated_code"
    )


def _sql_columns(columns: ColumnList | None) -> Sequence[str] | str:
    return COLUMNS if isinstance(columns, Column) else list(columns or FALLBACK_COLUMNS)


def intent_catalog(
    spark: SparkSession, vocabulary: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """The supported operations, one row per example question."""
    rows = [
        (
            number,
            name,
            vocabulary.priority.index(name) + 1,
            DESCRIPTIONS[name],
            ", ".join(vocabulary.trigger_words[name]),
            example,
        )
        for number, name in enumerate(OPERATIONS)
        for example in EXAMPLES[name]
    ]
    ddl = (
        "operation_id int, operation string, priority int, description string, "
        "keywords string, example string"
    )
    return spark.sql(values(rows, ddl))


def operation_usage(questions: DataFrame, text: str = "query") -> DataFrame:
    """The catalogue with the number of given questions per operation."""
    used = classify_operation(questions, text).groupBy("operation").agg(
        F.count(F.lit(1)).alias("questions")
    )
    # One row per operation on either side, whatever the size of the input.
    return (
        intent_catalog(questions.sparkSession)
        .join(F.broadcast(used), "operation", "left")
        .withColumn("questions", F.coalesce("questions", F.lit(0)))
    )

"""Compare predicted with expected operations, and replay labelled questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import DEFAULT_VOCABULARY, Vocabulary
from ..sources.query_log import log_rows
from .classify import classify, classify_operation

SESSION_SIZE = 3


def verdict(predicted: Column, expected: Column) -> Column:
    return F.when(predicted == expected, "correct").otherwise("incorrect")


def judge(
    labelled: DataFrame,
    text: str = "query",
    expected: str = "expected",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Classify labelled questions and add ``feedback``: correct or incorrect."""
    return classify_operation(labelled, text, vocabulary).withColumn(
        "feedback", verdict(F.col("operation"), F.col(expected))
    )


def accuracy(judged: DataFrame, by: str = "expected") -> DataFrame:
    """Questions, hits, accuracy and mean confidence per expected operation."""
    hits = F.count_if(F.col("feedback") == "correct")
    count = F.count(F.lit(1))
    return judged.groupBy(by).agg(
        count.alias("questions"),
        hits.alias("correct"),
        F.round(hits / count, 4).alias("accuracy"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def session_name(position: Column, size: int = SESSION_SIZE) -> Column:
    """Name of the session of the question at a 1-based position."""
    number = F.floor(position / size).cast("string")
    return F.concat(F.lit("session_"), number)


def replay(
    labelled: DataFrame,
    columns: Sequence[str],
    text: str = "query",
    expected: str = "expected",
) -> tuple[DataFrame, DataFrame]:
    """Log rows and feedback events as if users had asked labelled questions.

    ``labelled`` has id (1, 2, ...), ts, the question and the expected
    operation. The results feed ``log_stats``, ``training_set`` and the gates.
    """
    judged = classify(labelled, columns, text).withColumns(
        {
            "feedback": verdict(F.col("operation"), F.col(expected)),
            "session_id": session_name(F.col("id")),
        }
    )
    events = judged.select(
        F.col("id").alias("query_id"),
        F.col("id").alias("seq"),
        "ts",
        "feedback",
        F.col(expected).alias("correct_operation"),
        F.lit(None).cast("string").alias("comments"),
    )
    return log_rows(judged, text=text), events



def replay_report(
    labelled: DataFrame,
    columns: Sequence[str],
    text: str = "query",
    expected: str = "expected",
) -> DataFrame:
    """Replay labelled questions and count in one pass: confusions, classes, sessions and all.

    Rows (level, expected, predicted_operation, session_id, questions, correct,
    accuracy, mean_confidence); ``level`` says what a row is about: confusion,
    class, session or all. Every grouping set is reduced per task before the
    one shuffle, so the hot class or session is no heavier than another.
    """
    asked = classify(labelled, columns, text).select(
        F.col(expected).alias("expected"),
        F.col("operation").alias("predicted_operation"),
        session_name(F.col("id")).alias("session_id"),
        "confidence",
        (F.col("operation") == F.col(expected)).alias("__hit"),
    )
    by = ["expected", "predicted_operation", "session_id"]
    sets = [by[:2], by[:1], by[2:], []]
    counted = asked.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(
        F.grouping_id().alias("__set"),
        F.count(F.lit(1)).alias("questions"),
        F.count_if("__hit").alias("correct"),
        F.avg("confidence").alias("__mean"),
    )
    # Bits of the columns that a set leaves out, the first column highest.
    level = {1: "confusion", 3: "class", 6: "session", 7: "all"}
    named = F.element_at(F.create_map(*[F.lit(x) for pair in level.items() for x in pair]), F.col("__set").cast("int"))
    return counted.select(
        named.alias("level"),
        *by,
        "questions",
        "correct",
        F.round(F.col("correct") / F.col("questions"), 4).alias("accuracy"),
        F.round("__mean", 4).alias("mean_confidence"),
    )

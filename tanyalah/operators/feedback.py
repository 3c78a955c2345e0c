"""Feedback on logged questions: current state and accepted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import POSITIVE_FEEDBACK


def is_accepted() -> Column:
    """A named operation together with positive feedback, in any case.

    Null where either is missing, which both filters and counts leave out; the
    scan then skips such rows itself.
    """
    named = F.length("correct_operation") > 0
    return named & F.lower("feedback").isin(*POSITIVE_FEEDBACK)


def feedback_state(events: DataFrame) -> DataFrame:
    """One row per question: its last feedback and its number of accepted events.

    The last event wins as a whole, its nulls included, whatever the order in
    which the events arrived. Partial aggregation keeps a question with very
    many events from weighing on one task.
    """
    last = F.max_by(
        F.struct("feedback", "correct_operation"), F.struct("ts", "seq")
    )
    return (
        events.groupBy("query_id")
        .agg(
            last.alias("last"),
            F.count_if(is_accepted()).alias("accepted_events"),
        )
        .select(
            "query_id",
            F.col("last.feedback").alias("user_feedback"),
            F.col("last.correct_operation").alias("correct_operation"),
            "accepted_events",
        )
    )


def feedback_latest(events: DataFrame) -> DataFrame:
    return feedback_state(events).drop("accepted_events")


def feedback_accepted(events: DataFrame) -> DataFrame:
    return events.filter(is_accepted())


def log_with_feedback(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log with the current feedback; events on unknown questions fall away."""
    latest = feedback_latest(events)
    return log.join(latest, log["id"] == latest["query_id"], "left").drop("query_id")

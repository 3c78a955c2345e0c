"""Statistics over the question log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import RETRAIN_ONLINE
from .feedback import feedback_state


def by_operation(log: DataFrame) -> DataFrame:
    return log.groupBy("predicted_operation").agg(F.count(F.lit(1)).alias("questions"))


def log_stats(
    log: DataFrame, events: DataFrame, needed: int = RETRAIN_ONLINE
) -> DataFrame:
    """All figures of the log in one row, from one scan of each table.

    The feedback events become one row per question before the join, so the
    join moves narrow rows and no question is heavier than another. Totals
    come from the few rows per operation. ``questions_by_operation`` is a map
    for display; ``by_operation`` gives it as rows.
    """
    state = feedback_state(events).select("query_id", "user_feedback", "accepted_events")
    asked = log.select("id", "predicted_operation", "confidence")
    per_operation = (
        asked.join(state, asked["id"] == state["query_id"], "left")
        .groupBy("predicted_operation")
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.count("user_feedback").alias("with_feedback"),
            F.sum("confidence").alias("confidence"),
            F.sum("accepted_events").alias("accepted"),
        )
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    questions = total("questions")
    mean = F.when(questions == 0, 0.0).otherwise(F.sum("confidence") / questions)
    return per_operation.agg(
        questions.alias("total_questions"),
        total("with_feedback").alias("questions_with_feedback"),
        F.round(mean, 3).alias("average_confidence"),
        total("accepted").alias("verified_samples"),
        (total("accepted") >= needed).alias("model_needs_retraining"),
        F.map_from_entries(
            F.collect_list(F.struct("predicted_operation", "questions"))
        ).alias("questions_by_operation"),
    )


def percent(share: Column) -> Column:
    """A share as percent with one decimal."""
    return F.round(share * 100, 1)


def display_stats(stats: DataFrame) -> DataFrame:
    """The figures as a dashboard shows them."""
    return stats.select(
        "total_questions",
        "questions_with_feedback",
        percent(F.col("average_confidence")).alias("confidence_percent"),
        "verified_samples",
    )

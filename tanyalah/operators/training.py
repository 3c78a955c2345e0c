"""Training data from accepted feedback, and the retraining around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intent import operation_id, operation_name
from ..functions.sqltext import values
from ..functions.vocab import (
    RETRAIN_DEFAULT,
    RETRAIN_MANUAL,
    RETRAIN_ONLINE,
    TRAINING_SOURCE,
)
from ..sources import schemas
from ..sources.training_table import append_training, read_training_table
from .feedback import feedback_accepted, feedback_state
from .model import DEFAULT_EPOCHS, FEATURES, fit_model

# Any text survives: quotes are doubled, blanks and line breaks are kept.
CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
RETRAIN_REPORT = (
    "status string, min_samples int, training_samples bigint, samples_exported bigint, "
    "suggestion string, export_path string, model_path string"
)
SUGGESTION = "enough new data to retrain the model"


def training_set(log: DataFrame, events: DataFrame) -> DataFrame:
    """One verified row per accepted event on a known question.

    Repeated events stay repeated rows. The join is on the question id, which
    is unique in the log; should one question hold many events, adaptive
    execution splits its partition, as nothing after the join needs the
    partitioning.
    """
    accepted = feedback_accepted(events).select(
        "query_id", "seq", "ts", "correct_operation"
    )
    questions = log.select(F.col("id").alias("query_id"), "query")
    return accepted.join(questions, "query_id").select(
        F.col("seq").alias("id"),
        "query",
        operation_id(F.col("correct_operation")).alias("operation_id"),
        F.col("correct_operation").alias("operation_name"),
        F.lit(TRAINING_SOURCE).alias("source"),
        F.lit(True).alias("verified"),
        F.col("ts").alias("created_at"),
    )


def read_training(training: DataFrame, verified_only: bool = True) -> DataFrame:
    """Questions and labels, newest first."""
    rows = training.filter("verified") if verified_only else training
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).select(
        "query", "operation_id"
    )


def with_names(labelled: DataFrame) -> DataFrame:
    """Add operation_name from operation_id, null where the id is unknown."""
    return labelled.withColumn("operation_name", operation_name(F.col("operation_id")))


def export_training(training: DataFrame, path: str, single_file: bool = False) -> str:
    """Write the verified rows as CSV with header, newest first.

    Many part files in order; ``single_file`` is for small tables only.
    """
    rows = with_names(read_training(training))
    rows = rows.coalesce(1) if single_file else rows
    rows.write.mode("overwrite").options(**CSV).csv(path)
    return path


def export_summary(training: DataFrame, path: str) -> DataFrame:
    """Export, whatever the number of rows; one row: status, samples_exported, export_path."""
    spark = training.sparkSession
    exported = read_export(spark, export_training(training, path)).count()
    ddl = "status string, samples_exported bigint, export_path string"
    return spark.sql(values([("exported", exported, path)], ddl))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    rows = (
        spark.read.schema(schemas.TRAINING_EXPORT).options(**CSV, multiLine=True).csv(path)
    )
    # CSV does not tell an empty question from none.
    return rows.withColumn("query", F.coalesce("query", F.lit("")))


def verified_count(log: DataFrame, events: DataFrame) -> DataFrame:
    """Number of verified rows without building them.

    Accepted events are counted per question before the join, so the join
    moves one small row per question.
    """
    counts = feedback_state(events).filter("accepted_events > 0")
    known = counts.join(
        log.select(F.col("id").alias("query_id")), "query_id", "left_semi"
    )
    return known.agg(
        F.coalesce(F.sum("accepted_events"), F.lit(0)).alias("verified_samples")
    )


def retrain_gate(verified: DataFrame, *needed: int) -> DataFrame:
    """Is retraining due, and how many rows are missing? One row per threshold."""
    samples, minimum = F.col("verified_samples"), F.col("min_samples")
    thresholds = F.explode(F.lit(list(needed or (RETRAIN_DEFAULT,))))
    return verified.select("verified_samples", thresholds.alias("min_samples")).select(
        "verified_samples",
        "min_samples",
        (samples >= minimum).alias("should_retrain"),
        F.greatest(minimum - samples, F.lit(0).cast("bigint")).alias("samples_needed"),
    )


def feedback_reply(
    events: DataFrame, verified: DataFrame, needed: int = RETRAIN_ONLINE
) -> DataFrame:
    """Reply to each feedback event, with a hint once enough rows are verified."""
    due = verified.select((F.col("verified_samples") >= needed).alias("due")).scalar()
    return events.select(
        "query_id", "feedback", F.when(due, F.lit(SUGGESTION)).alias("suggestion")
    )


def retrain(
    spark: SparkSession,
    log: DataFrame,
    events: DataFrame,
    folder: str,
    epochs: int = DEFAULT_EPOCHS,
    needed: int = RETRAIN_MANUAL,
    features: int = FEATURES,
) -> DataFrame:
    """Export the training data and fit and save a model, if there is enough.

    What the stored training table below ``folder`` lacks is appended to it; the
    export, the count and the fit start from there.

    Returns one row as in ``RETRAIN_REPORT``; its status is insufficient or
    completed.
    """
    samples = verified_count(log, events).first()["verified_samples"]
    export_path = model_path = None
    exported = 0
    if samples >= needed:
        stored = f"{folder}/training"
        append_training(training_set(log, events), stored)
        training = read_training_table(spark, stored)
        export_path = export_training(training, f"{folder}/training_csv")
        data = training.filter("verified")
        exported = data.count()
        model_path = f"{folder}/model"
        fit_model(data, epochs, features).write().overwrite().save(model_path)
    row = (
        "completed" if model_path else "insufficient",
        needed, samples, exported,
        SUGGESTION if samples >= RETRAIN_ONLINE else None,
        export_path, model_path,
    )
    return spark.sql(values([row], RETRAIN_REPORT))

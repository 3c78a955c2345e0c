"""The stored training table: verified rows, appended as feedback arrives.

Every append writes a folder of its own and then names it in the manifest.
Rows count once the manifest has them: an append that fails half-way leaves a
folder that nobody reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import values
from . import schemas
from .query_log import read_table
from .scratch import unique

MANIFEST = "batch bigint, folder string, rows bigint, first_day date, last_day date"
DAY = "created_day"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, f"{path}/manifest", MANIFEST)


def stored_training(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, with the day of ``created_at``, by which folders are pruned."""
    folders = [r["folder"] for r in _manifest(spark, path).select("folder").collect()]
    layout = f"{schemas.TRAINING_DATA}, {DAY} date"
    if not folders:
        return spark.createDataFrame([], layout)
    # One path per append, all below the same base, so that the day is found in them.
    return spark.read.schema(layout).option("basePath", f"{path}/rows").parquet(
        *[f"{path}/rows/{folder}" for folder in folders]
    ).select(*schemas.field_names(layout))


def read_training_table(spark: SparkSession, path: str) -> DataFrame:
    return stored_training(spark, path).drop(DAY)


def append_training(rows: DataFrame, path: str) -> int:
    """Append the training rows that are not stored yet; gives their number.

    ``rows`` as from ``training_set``. A row is known by its id, the number of
    its feedback event, which always has the same time. So only the stored ids
    of the days at hand are compared, whatever the table holds. Rows without a
    time have a day of their own.
    """
    spark = rows.sparkSession
    number = _manifest(spark, path).agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0] + 1
    folder = f"append={number}-{unique()}"
    new = rows.withColumn(DAY, F.to_date("created_at"))
    span = new.agg(F.min(DAY).alias("low"), F.max(DAY).alias("high")).first()
    stored = stored_training(spark, path)
    if span["low"] is not None:
        near = stored.where(F.col(DAY).between(F.lit(span["low"]), F.lit(span["high"])) | F.col(DAY).isNull())
    else:
        near = stored.where(F.col(DAY).isNull())
    left = new.join(near.select("id"), "id", "left_anti").select(*rows.columns, DAY)
    target = f"{path}/rows/{folder}"
    left.hint("rebalance", DAY).write.partitionBy(DAY).parquet(target)
    layout = f"{schemas.TRAINING_DATA}, {DAY} date"
    count = spark.read.schema(layout).parquet(target).count()
    entry = spark.sql(values([(number, folder, count, str(span["low"]) if span["low"] else None, str(span["high"]) if span["high"] else None)], MANIFEST))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return count

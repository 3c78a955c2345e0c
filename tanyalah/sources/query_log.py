"""The question log and the feedback events: append-only parquet tables."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import values
from . import schemas
from .scratch import unique


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Read a table by its declared layout; a missing path is an empty table."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


# A stream keeps a list of its files beside them, and Spark then sees no others:
# what batches and what streams write to one table lies in two folders.
BATCH, STREAM = "batch", "stream"


def _read_parts(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    batch, stream = (read_table(spark, f"{path}/{part}", ddl) for part in (BATCH, STREAM))
    return batch.unionByName(stream)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log: those of batches, of streams, and of streams after compaction."""
    names = schemas.field_names(schemas.QUERY_LOG)
    parts = [read_table(spark, f"{path}/{BATCH}", schemas.QUERY_LOG), _open_rows(spark, path)]
    folders = [r["folder"] for r in _runs(spark, path).select("folder").distinct().collect()]
    parts += [read_table(spark, f"{path}/{COMPACT}/{folder}", schemas.QUERY_LOG) for folder in folders]
    return reduce(DataFrame.unionByName, [part.select(*names) for part in parts])


# A micro-batch is one folder, named by its stream and number: a batch that is
# run again after a failure overwrites itself.
WRITER, NUMBER = "writer", "micro_batch"
_STREAMED = f"{schemas.QUERY_LOG}, {WRITER} string, {NUMBER} bigint"
# What a compaction holds: of each stream, the batches up to a number, before a day.
COMPACT = "compact"
RUNS = f"folder string, {WRITER} string, last_batch bigint, before date"


def append_micro_batch(rows: DataFrame, path: str, writer: str, number: int) -> None:
    """Write one micro-batch of a stream, a file of the advised size per day."""
    (
        rows.hint("rebalance", "log_date")
        .write.mode("overwrite")
        .partitionBy("log_date")
        .parquet(f"{path}/{STREAM}/{WRITER}={writer}/{NUMBER}={number}")
    )


def _runs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, f"{path}/{COMPACT}d", RUNS)


def _open_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of streams that no compaction holds; the folders of all others are not opened."""
    rows = read_table(spark, f"{path}/{STREAM}", _STREAMED)
    for run in _runs(spark, path).collect():
        held = (
            (F.col(WRITER) == run[WRITER])
            & (F.col(NUMBER) <= run["last_batch"])
            & (F.col("log_date") < F.lit(run["before"]))
        )
        # A row without a day is in no closed one.
        rows = rows.filter(~F.coalesce(held, F.lit(False)))
    return rows


def compact_log(spark: SparkSession, path: str, before: date) -> int:
    """Put the streamed rows of the days before `before` into few files; gives the rows moved.

    The new folder counts once the table of runs names it, together with what
    it holds of each stream. So a run that fails half-way changes nothing, and
    rows of a closed day that arrive later stay where the stream put them, until the next
    run. The old folders are left for readers that have begun.
    """
    closed = _open_rows(spark, path).filter(F.col("log_date") < F.lit(before))
    holds = closed.groupBy(WRITER).agg(F.max(NUMBER).alias("last_batch"), F.count("*").alias("rows")).collect()
    if not holds:
        return 0
    folder = unique()
    below = reduce(or_, [(F.col(WRITER) == h[WRITER]) & (F.col(NUMBER) <= h["last_batch"]) for h in holds])
    rows = closed.filter(below).select(*schemas.field_names(schemas.QUERY_LOG))
    rows.hint("rebalance", "log_date").write.partitionBy("log_date").parquet(f"{path}/{COMPACT}/{folder}")
    entry = spark.sql(values([(folder, h[WRITER], h["last_batch"], str(before)) for h in holds], RUNS))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/{COMPACT}d")
    return sum(h["rows"] for h in holds)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """All feedback events, whether batches or streams wrote them."""
    return _read_parts(spark, path, schemas.FEEDBACK_EVENTS)


def log_rows(
    classified: DataFrame,
    id_column: str | None = "id",
    ts_column: str = "ts",
    text: str = "query",
) -> DataFrame:
    """Bring classified questions into the layout of the log.

    Without an id column the log numbers the rows as they are appended.
    """
    have = set(classified.columns)

    def optional(name: str, kind: str):
        column = F.col(name) if name in have else F.lit(None)
        return column.cast(kind).alias(name)

    columns_used = optional("columns_used", "array<string>")
    return classified.select(
        *([F.col(id_column).cast("bigint").alias("id")] if id_column else []),
        F.col(ts_column).cast("timestamp_ntz").alias("timestamp"),
        F.col(text).alias("query"),
        F.col("operation").alias("predicted_operation"),
        "confidence",
        "generated_code",
        F.coalesce(columns_used, F.array().cast("array<string>")).alias("columns_used"),
        optional("session_id", "string"),
        optional("user_id", "string"),
        optional("model_version", "string"),
        F.to_date(ts_column).alias("log_date"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows, one folder per day.

    The rebalance hint gives each day files of the advised size: adaptive
    execution splits a day with many rows over several tasks and joins small
    ones, so neither one task writes a hot day nor each task a file per day.
    Rows without an id get the numbers after the log's last.
    """
    if "id" not in rows.columns:
        rows = _with_reserved_ids(rows, path).select(*schemas.field_names(schemas.QUERY_LOG))
    (
        rows.hint("rebalance", "log_date")
        .write.mode("append")
        .partitionBy("log_date")
        .parquet(f"{path}/{BATCH}")
    )


def append_feedback(events: DataFrame, path: str) -> None:
    events.select(*schemas.field_names(schemas.FEEDBACK_EVENTS)).write.mode(
        "append"
    ).parquet(f"{path}/{BATCH}")


def with_row_ids(df: DataFrame, start: int = 1, name: str = "id") -> DataFrame:
    """Number the rows start, start + 1, ... where the source brings no id.

    One pass counts the rows per partition and a second adds the offsets, so
    no row moves. The input is read twice and has to give the same partitions
    both times: read it from files, or write a computed table first.
    """
    return _numbered(df, start, name)[0]


def _numbered(df: DataFrame, start: int, name: str) -> tuple[DataFrame, int]:
    """The numbered rows, and how many they are."""
    mark = F.monotonically_increasing_id()
    numbered = df.withColumn("__mark", mark).withColumns(
        {
            "__part": F.shiftright("__mark", 33).cast("int"),
            "__place": F.col("__mark").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("rows"))
    counted = sizes.orderBy("__part").toArrow()  # one row per input partition
    ends = pc.cumulative_sum(counted.column("rows"))
    firsts = pc.add(pc.subtract(ends, counted.column("rows")), start)
    offsets = df.sparkSession.createDataFrame(
        pa.table({"__part": counted.column("__part"), "__first": firsts})
    )
    # No broadcast hint: Spark knows the size of the offsets and decides by it.
    rows = (
        numbered.join(offsets, "__part")
        .withColumn(name, F.col("__first") + F.col("__place"))
        .select(name, *df.columns)
    )
    return rows, pc.sum(counted.column("rows")).as_py() or 0


# Ids that appends have taken: one row each, written before the rows themselves.
IDS = "first bigint, last bigint"


def last_id(spark: SparkSession, path: str) -> int:
    """The highest id that the log has given or reserved, 0 if none.

    Rows that brought their own ids count too.
    """
    reserved = read_table(spark, f"{path}/ids", IDS).agg(F.max("last")).first()[0]
    if reserved is not None:
        return reserved
    return read_log(spark, path).agg(F.max("id")).first()[0] or 0


def _with_reserved_ids(rows: DataFrame, path: str) -> DataFrame:
    """The rows with the ids after the last one.

    They are written once, so that numbering sees the same partitions in both
    passes. Their range is put down before they reach the log: an append that
    fails half-way leaves a gap and never gives an id twice.
    """
    spark = rows.sparkSession
    staged = f"{path}/staged/{unique()}"
    rows.write.parquet(staged)
    start = last_id(spark, path) + 1
    numbered, count = _numbered(spark.read.schema(rows.schema).parquet(staged), start, "id")
    reserved = spark.sql(values([(start, start + count - 1)], IDS))
    reserved.coalesce(1).write.mode("append").parquet(f"{path}/ids")
    return numbered


def as_text_log(log: DataFrame) -> DataFrame:
    """The log with ISO timestamps and JSON column lists as text."""
    return log.withColumns(
        {
            "timestamp": F.replace(
                F.col("timestamp").cast("string"), F.lit(" "), F.lit("T")
            ),
            "columns_used": F.to_json(
                F.coalesce("columns_used", F.array().cast("array<string>"))
            ),
        }
    )

"""Questions and feedback as streams.

Classification keeps no state: a stream of questions is the same projection as
a table of them, appended to the log. Feedback is appended as it arrives; late
or repeated events need no state, since the current feedback is a batch view
over all events. Only the running statistics hold state: one row per operation.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.columns import ColumnList
from ..functions.vocab import DEFAULT_VOCABULARY, Vocabulary
from ..operators.classify import classify, classify_operation
from ..operators.feedback import feedback_latest
from ..operators.learned import Model
from ..sources import schemas
from ..sources.query_log import NUMBER, STREAM, append_micro_batch, log_rows, read_table


def read_stream(
    spark: SparkSession,
    folder: str,
    ddl: str,
    pattern: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files as they arrive in a folder, whatever their names; the layout must be declared.

    Spark leaves out files whose names start with a dot or an underscore.
    """
    reader = spark.readStream.schema(ddl)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def stream_table(
    spark: SparkSession, path: str, ddl: str, max_files: int | None = None
) -> DataFrame:
    """A parquet table as a stream, be it one file or a folder of part files.

    A path with neither raises, instead of a stream without rows.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(place):
        raise FileNotFoundError(path)
    if store.getFileStatus(place).isFile():
        folder, _, name = path.rpartition("/")
        return read_stream(spark, folder, ddl, name, max_files)
    if spark.read.schema(ddl).parquet(path).inputFiles() == []:
        raise FileNotFoundError(f"no parquet file in {path}")
    return read_stream(spark, path, ddl, max_files=max_files)


def stream_to_log(
    questions: DataFrame,
    columns: ColumnList | None,
    path: str,
    checkpoint: str,
    text: str = "query",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    all_available: bool = True,
    model: Model | None = None,
) -> StreamingQuery:
    """Classify questions as they arrive and append them to the log.

    ``questions`` has id, ts and the question, as for ``log_rows``. Every
    micro-batch is one folder named by the checkpoint and its number, with a file
    of the advised size per day; after a failure it is written anew, so every question is
    there exactly once. ``compact_log`` joins the folders of closed days. A
    ``model`` decides where no rule applies.
    """
    rows = log_rows(classify(questions, columns, text, vocabulary, model=model), text=text)
    name = md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def put(batch: DataFrame, number: int) -> None:
        append_micro_batch(batch, path, name, number)

    writer = rows.writeStream.foreachBatch(put).outputMode("append")
    return _start(writer, None, checkpoint, all_available)


def stream_feedback(
    events: DataFrame, path: str, checkpoint: str, all_available: bool = True
) -> StreamingQuery:
    """Append feedback events as they arrive."""
    rows = events.select(*schemas.field_names(schemas.FEEDBACK_EVENTS))
    writer = rows.writeStream.format("parquet").outputMode("append")
    return _start(writer, f"{path}/{STREAM}", checkpoint, all_available)


def latest_feedback_stream(
    events: DataFrame, open_for: str | None = None, late: str = "7 days"
) -> DataFrame:
    """The last event of each question, over a stream: a row whenever it changes.

    Rows (query_id, ts, seq, feedback, correct_operation), ties by (ts, seq),
    for update mode. The state has one row per question; each micro-batch is
    reduced per task before the shuffle, so a question with very many events weighs no more.

    How long a question stays open: without ``open_for``, for good, and events
    in any order count. With it, time is cut into periods of that length, and
    a question's state of a period is dropped once the latest event seen is
    ``late`` past its end. Events that come later still, or without a time, are
    left to the batch view of all events.
    """
    keys: list = ["query_id"]
    if open_for:
        moment = F.col("ts").cast("timestamp")
        events = events.withColumn("__moment", moment).withWatermark("__moment", late)
        keys.append(F.window("__moment", open_for).alias("__period"))
    order = F.struct("ts", "seq")
    return (
        events.groupBy(*keys)
        .agg(
            F.max(order).alias("at"),
            F.max_by(F.struct("feedback", "correct_operation"), order).alias("said"),
        )
        .select("query_id", "at.*", "said.*")
    )


def stream_latest_feedback(
    events: DataFrame,
    path: str,
    checkpoint: str,
    open_for: str | None = None,
    late: str = "7 days",
    all_available: bool = True,
) -> StreamingQuery:
    """Keep ``latest_feedback_stream`` in a table: one folder of changes per micro-batch.

    A batch that is run again overwrites its folder. ``read_latest_feedback`` reads it.
    """
    changes = latest_feedback_stream(events, open_for, late)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{NUMBER}={number}")

    writer = changes.writeStream.foreachBatch(put).outputMode("update")
    return _start(writer, None, checkpoint, all_available)


def read_latest_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The current feedback, as ``feedback_latest`` gives it: the last of the changes of each question."""
    ddl = "query_id bigint, ts timestamp_ntz, seq bigint, feedback string, correct_operation string"
    return feedback_latest(read_table(spark, path, ddl))


def running_stats(
    questions: DataFrame,
    text: str = "query",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Questions and mean confidence per operation, over a stream or a table.

    Grouped by operation, so the state has at most eight rows and needs no
    watermark; each micro-batch is reduced per task before the shuffle.
    """
    return (
        classify_operation(questions, text, vocabulary)
        .groupBy("operation")
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        )
    )


def stream_stats(
    questions: DataFrame,
    name: str,
    checkpoint: str,
    text: str = "query",
    all_available: bool = True,
) -> StreamingQuery:
    """Keep ``running_stats`` in the in-memory table ``name`` (eight rows)."""
    writer = (
        running_stats(questions, text)
        .writeStream.format("memory")
        .queryName(name)
        .outputMode("complete")
    )
    return _start(writer, None, checkpoint, all_available)


def _start(
    writer: DataStreamWriter, path: str | None, checkpoint: str, all_available: bool
) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if all_available:
        writer = writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()

import pytest
from pyspark.sql import functions as F

from tanyalah.operators import feedback
from tanyalah.operators.classify import classify
from tanyalah.plans import derived
from tanyalah.sources import query_log, schemas
from tanyalah.sources.scratch import fresh_folder
from tanyalah.streaming import questions as streaming

DDL = "id bigint, ts timestamp_ntz, query string, user_id string, expected string"
COLUMNS = ["harga", "tanggal"]


@pytest.fixture
def inbox(spark, sf_dir):
    """A folder into which questions arrive in two steps."""
    path = fresh_folder(spark, "inbox")
    asked = derived.questions(spark, sf_dir)

    def deliver(condition):
        rows = asked.filter(condition).select(*[f.split()[0] for f in DDL.split(", ")])
        rows.repartition(3).write.mode("append").parquet(path)

    return path, deliver


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_batch_and_resumes(spark, sf_dir, inbox):
    path, deliver = inbox
    folder = fresh_folder(spark, "stream")
    for condition in ("id < 400", "id >= 400"):
        deliver(condition)
        source = streaming.read_stream(spark, path, DDL, max_files=2)
        streaming.stream_to_log(
            source, COLUMNS, f"{folder}/log", f"{folder}/checkpoint"
        ).awaitTermination()
    stored = query_log.read_log(spark, f"{folder}/log")
    batch = query_log.log_rows(classify(derived.questions(spark, sf_dir), COLUMNS))
    assert rows_of(stored) == rows_of(batch)


def test_running_stats_over_two_deliveries(spark, sf_dir, inbox):
    path, deliver = inbox
    folder = fresh_folder(spark, "stats")
    for step, condition in enumerate(("id < 300", "id >= 300")):
        deliver(condition)
        source = streaming.read_stream(spark, path, DDL)
        name = f"running_{step}"
        streaming.stream_stats(source, name, f"{folder}/checkpoint").awaitTermination()
    batch = streaming.running_stats(derived.questions(spark, sf_dir))
    assert rows_of(spark.table(name)) == rows_of(batch)


def test_feedback_stream(spark, sf_dir):
    inbox, folder = fresh_folder(spark, "feedback_inbox"), fresh_folder(spark, "feedback")
    events = derived.feedback(spark, sf_dir)
    events.repartition(4).write.parquet(inbox)
    # A late copy of old events changes nothing in the current feedback.
    events.filter(F.col("seq") < 50).write.mode("append").parquet(inbox)
    source = streaming.read_stream(spark, inbox, schemas.FEEDBACK_EVENTS, max_files=1)
    streaming.stream_feedback(source, f"{folder}/events", f"{folder}/cp").awaitTermination()
    stored = query_log.read_feedback(spark, f"{folder}/events")
    assert stored.count() == events.count() + 50
    assert rows_of(feedback.feedback_latest(stored)) == rows_of(feedback.feedback_latest(events))


def _classified(spark, sf_dir):
    from tanyalah.plans import derived

    return derived.questions(spark, sf_dir)


def test_batch_and_stream_rows_of_one_log_are_both_read(spark, sf_dir, tmp_path):
    from tanyalah import streaming
    from tanyalah.operators.classify import classify
    from tanyalah.plans import derived
    from tanyalah.sources import query_log

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{tmp_path}/parts"
    table.repartition(3).write.parquet(folder)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    rows = query_log.log_rows(classify(_classified(spark, sf_dir), ["harga"]))
    for order in (("batch", "stream"), ("stream", "batch")):
        log = f"{tmp_path}/log-{order[0]}"
        for kind in order:
            if kind == "batch":
                query_log.append_log(rows, log)
            else:
                events = derived.as_questions(streaming.questions.stream_table(spark, folder, ddl))
                streaming.questions.stream_to_log(events, ["harga"], log, f"{log}-state").awaitTermination()
        assert query_log.read_log(spark, log).count() == 2 * table.count()


def test_a_stream_of_nothing_is_refused(spark, tmp_path):
    import pytest

    from tanyalah.streaming.questions import stream_table

    with pytest.raises(FileNotFoundError):
        stream_table(spark, f"{tmp_path}/none", "a int")


def test_a_classified_table_can_be_classified_again(spark):
    from tanyalah.operators.classify import classify

    once = classify(spark.createDataFrame([("harga tertinggi",)], "query string"), ["harga"])
    assert classify(once, ["harga"]).collect() == once.collect()


def test_maps_inside_arrays_have_no_extremes(spark):
    from tanyalah.operators.answer import supports

    frame = spark.createDataFrame([], "a array<map<string,int>>, s struct<x:map<string,int>>, f array<int>")
    assert [supports(frame, "MAX", c) for c in "asf"] == [False, False, True]


def files_of(spark, path):
    return [r[0] for r in query_log.read_log(spark, path).select(F.input_file_name()).distinct().collect()]


def test_log_sink_writes_nothing_twice_and_few_files(spark, sf_dir, inbox):
    path, deliver = inbox
    folder = fresh_folder(spark, "stream")
    days = derived.questions(spark, sf_dir).select(F.to_date("ts")).distinct().count()
    for step, condition in enumerate(("id < 400", "id >= 400"), start=1):
        deliver(condition)
        source = streaming.read_stream(spark, path, DDL)
        streaming.stream_to_log(source, COLUMNS, f"{folder}/log", f"{folder}/cp").awaitTermination()
        assert len(files_of(spark, f"{folder}/log")) <= step * days
    before = rows_of(query_log.read_log(spark, f"{folder}/log"))
    # A batch that is run again, as after a failure before its commit, overwrites itself.
    writer = next(f for f in files_of(spark, f"{folder}/log") if "micro_batch=1" in f).split("writer=")[1].split("/")[0]
    again = query_log.log_rows(classify(derived.questions(spark, sf_dir).where("id >= 400"), COLUMNS))
    query_log.append_micro_batch(again, f"{folder}/log", writer, 1)
    assert rows_of(query_log.read_log(spark, f"{folder}/log")) == before
    streaming.stream_to_log(streaming.read_stream(spark, path, DDL), COLUMNS, f"{folder}/log", f"{folder}/cp").awaitTermination()
    assert rows_of(query_log.read_log(spark, f"{folder}/log")) == before


def test_compaction_bounds_the_files_of_a_day(spark, sf_dir, inbox):
    path, deliver = inbox
    folder = fresh_folder(spark, "stream")
    log = f"{folder}/log"

    def run():
        source = streaming.read_stream(spark, path, DDL, max_files=1)
        streaming.stream_to_log(source, COLUMNS, log, f"{folder}/cp").awaitTermination()

    deliver("id < 600")
    run()
    before = rows_of(query_log.read_log(spark, log))
    days = sorted(r[0] for r in query_log.read_log(spark, log).select("log_date").distinct().collect())
    many = files_of(spark, log)
    closed = query_log.read_log(spark, log).where(F.col("log_date") < F.lit(days[-1])).count()
    assert query_log.compact_log(spark, log, days[-1]) == closed
    assert rows_of(query_log.read_log(spark, log)) == before
    few = [f for f in files_of(spark, log) if f"log_date={days[0]}" in f]
    assert len(few) == 1 < len([f for f in many if f"log_date={days[0]}" in f])
    assert query_log.compact_log(spark, log, days[-1]) == 0
    # Rows of a closed day that come later stay in the stream's folders until the next run.
    deliver("id >= 600")
    run()
    batch = rows_of(query_log.log_rows(classify(derived.questions(spark, sf_dir), COLUMNS)))
    assert rows_of(query_log.read_log(spark, log)) == batch
    query_log.compact_log(spark, log, days[-1])
    assert rows_of(query_log.read_log(spark, log)) == batch


@pytest.mark.parametrize("open_for", [None, "400 days"])
def test_latest_feedback_over_three_batches_out_of_order(spark, sf_dir, open_for):
    inbox, folder = fresh_folder(spark, "feedback_inbox"), fresh_folder(spark, "latest")
    events = derived.feedback(spark, sf_dir)
    # Newest first, the middle last; the third delivery comes after a restart.
    for parts in (["seq >= 700"], ["seq < 300", "seq between 300 and 699"]):
        for part in parts:
            events.where(part).coalesce(1).write.mode("append").parquet(inbox)
        source = streaming.read_stream(spark, inbox, schemas.FEEDBACK_EVENTS, max_files=1)
        streaming.stream_latest_feedback(source, f"{folder}/changes", f"{folder}/cp", open_for).awaitTermination()
    changes = spark.read.parquet(f"{folder}/changes")
    assert changes.select("micro_batch").distinct().count() >= 3
    got = streaming.read_latest_feedback(spark, f"{folder}/changes")
    assert rows_of(got) == rows_of(feedback.feedback_latest(events))


def test_part_files_of_any_name_are_streamed(spark, tmp_path):
    folder = tmp_path / "parts"
    spark.range(50).write.parquet(str(folder))
    for k, file in enumerate(folder.glob("part-*.parquet")):
        file.rename(folder / f"part-{k}")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    stream = streaming.stream_table(spark, str(folder), "id bigint")
    stream.writeStream.format("memory").queryName("any_name").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("any_name").count() == 50

"""The model inside every entry point, typed plan texts, versions, the stored training table, ids of appends."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tanyalah import ask, understand
from tanyalah.functions.intent import operation_id
from tanyalah.operators import typed_plan, versions
from tanyalah.operators.answer import UnsupportedColumn, group_agg
from tanyalah.operators.answer_many import answer_many
from tanyalah.operators.classify import classify, classify_column
from tanyalah.operators.learned import Served
from tanyalah.operators.model import fit_model
from tanyalah.plans import derived
from tanyalah.sources import query_log, schemas
from tanyalah.sources.scratch import fresh_folder
from tanyalah.sources.training_table import append_training, read_training_table, stored_training
from tanyalah.streaming import questions as streaming

TAUGHT = [("perkecil nilai sampai nol", "MIN"), ("gabung semua nilai", "SUM"), ("rapikan daftar nilai", "SORT")]


@pytest.fixture(scope="module")
def learned(spark):
    rows = spark.createDataFrame(TAUGHT * 15, "query string, operation_name string")
    rows = rows.withColumn("operation_id", operation_id(F.col("operation_name")))
    return Served(fit_model(rows, epochs=30), "v7")


@pytest.fixture(scope="module")
def readings(spark, sf_dir):
    path = fresh_folder(spark, "readings")
    derived.readings(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_model_decides_in_every_entry_point(spark, readings, learned):
    asked = spark.createDataFrame(
        [(k, dt.datetime(2024, 1, 1), q) for k, (q, _) in enumerate(TAUGHT)] + [(9, dt.datetime(2024, 1, 1), "nilai tertinggi")],
        "id bigint, ts timestamp_ntz, query string",
    )
    record = {r["id"]: r for r in classify(asked, ["nilai"], model=learned).collect()}
    for k, (_, operation) in enumerate(TAUGHT):
        row = record[k]
        assert (row["operation"], row["by_rule"], row["model_version"]) == (operation, False, "v7")
        assert row["confidence"] > 0.5
    # The plan text is that of the model's operation.
    assert record[0]["generated_code"] == "SELECT min(`nilai`) FROM t"
    assert (record[9]["operation"], record[9]["model_version"]) == ("MAX", None)
    least = readings.agg(F.min(F.when(~F.isnan("nilai"), F.col("nilai")))).first()[0]
    assert ask(readings, TAUGHT[0][0], columns=["nilai"], model=learned).first()[0] == least
    assert understand(readings, "nilai tertinggi", model=learned).operation == "MAX"
    answers = {r["id"]: r for r in answer_many(asked, readings, model=learned).collect()}
    assert answers[0]["answer_double"] == least and answers[2]["status"] == "whole_table"
    again = classify(classify(asked, ["nilai"], model=learned), ["nilai"])
    assert "model_version" not in again.columns and not again.where("id = 0").first()["by_rule"]


def test_model_in_a_stream_equals_the_batch(spark, sf_dir, learned):
    inbox, folder = fresh_folder(spark, "inbox"), fresh_folder(spark, "log")
    asked = derived.questions(spark, sf_dir).limit(300)
    asked = asked.withColumn("query", F.when(F.col("id") % 4 == 0, TAUGHT[1][0]).otherwise(F.col("query")))
    asked.repartition(3).write.parquet(inbox)
    ddl = "id bigint, ts timestamp_ntz, user_id string, query string, expected string"
    source = streaming.read_stream(spark, inbox, ddl, max_files=1)
    streaming.stream_to_log(source, ["nilai"], folder, f"{folder}-state", model=learned).awaitTermination()
    stored = query_log.read_log(spark, folder)
    batch = query_log.log_rows(classify(spark.read.schema(ddl).parquet(inbox), ["nilai"], model=learned))
    assert sorted(map(str, stored.collect())) == sorted(map(str, batch.collect()))
    assert stored.where("model_version = 'v7'").count() >= 75


QUESTIONS = [
    "nilai tertinggi", "nilai terendah", "total nilai", "rata-rata nilai", "hitung nilai", "hitung baris nilai",
    "total event_id", "urutkan nilai", "siapa dengan nilai terbesar", "siapa dengan jenis terkecil", "total user_id",
    "urutkan jenis", "jenis tertinggi",
]


@pytest.mark.parametrize("question", QUESTIONS)
def test_typed_text_gives_what_ask_gives(spark, readings, question):
    asked = spark.createDataFrame([(question,)], "query string")
    text = typed_plan.with_typed_plan(classify_column(asked, readings.columns), readings).first()[typed_plan.PLAN]
    got, want = typed_plan.run_plan(readings, text), ask(readings, question)
    assert got.dtypes == want.dtypes
    ordered = "urutkan" in question
    rows = [list(map(str, x.collect())) for x in (got, want)]
    assert rows[0] == rows[1] if ordered else sorted(rows[0]) == sorted(rows[1])


def test_typed_text_with_marks_and_whole_tables(spark, readings):
    text = typed_plan.plan_for(readings, "FILTER", "nilai")
    got = typed_plan.run_plan(readings, text, value=50.0)
    assert sorted(map(str, got.collect())) == sorted(map(str, ask(readings, "cari nilai", value=50.0).collect()))
    text = typed_plan.plan_for(readings, "GROUP", "jenis")
    got = typed_plan.run_plan(readings, text, func="count(1) AS n, min(event_id) AS least")
    want = group_agg(readings, "jenis", [F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least")])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for operation, word in (("MAX", "maksimum"), ("MIN", "minimum"), ("SUM", "total"), ("MEAN", "mean"), ("COUNT", "hitung")):
        got = typed_plan.run_plan(readings, typed_plan.plan_for(readings, operation, "")).collect()
        assert list(map(str, got)) == list(map(str, ask(readings, word, columns=[""]).collect()))
    with pytest.raises(UnsupportedColumn, match="SUM is not defined on jenis"):
        typed_plan.run_plan(readings, typed_plan.plan_for(readings, "SUM", "jenis"))
    with pytest.raises(ValueError, match="needs func"):
        typed_plan.run_plan(readings, typed_plan.plan_for(readings, "GROUP", "jenis"))
    with pytest.raises(ValueError, match="needs value"):
        typed_plan.run_plan(readings, typed_plan.plan_for(readings, "FILTER", "nilai"))


def test_many_texts_share_one_scan(spark, readings, plan_of):
    asked = spark.createDataFrame([(q,) for q in QUESTIONS + ["kelompokkan jenis", "total jenis"]], "query string")
    planned = typed_plan.with_typed_plan(classify_column(asked, readings.columns), readings)
    answered = typed_plan.run_plans(planned, readings)
    answers = {r["query"]: r["plan_answer"] for r in answered.collect()}
    assert float(answers["nilai tertinggi"]) == ask(readings, "nilai tertinggi").first()[0]
    for none in ("urutkan nilai", "siapa dengan nilai terbesar", "kelompokkan jenis", "total jenis"):
        assert answers[none] is None
    optimized = plan_of(answered).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("Relation [") == 1


def labelled(spark, rows):
    frame = spark.createDataFrame(rows, "query string, operation_name string")
    return frame.withColumn("operation_id", operation_id(F.col("operation_name")))


def test_a_worse_model_does_not_serve(spark):
    folder = fresh_folder(spark, "versions")
    good = labelled(spark, [(f"{q} {k}", o) for q, o in TAUGHT for k in range(40)])
    assert versions.serving_model(spark, folder) is None
    poor = versions.retrain_version(good.limit(3), folder, needed=100).first()
    assert (poor["status"], poor["serving"], poor["model_path"]) == ("insufficient", None, None)
    first = versions.retrain_version(good, folder, epochs=20).first()
    assert (first["version"], first["status"], first["serving"]) == (2, "first", 2) and first["hits"] == first["held_out"] > 5
    worse = versions.retrain_version(good.withColumn("operation_id", F.lit(3)).withColumn("operation_name", F.lit("MEAN")), folder, held=good, epochs=20).first()
    assert (worse["status"], worse["champion"], worse["serving"]) == ("refused", 2, 2) and worse["hits"] < worse["champion_hits"]
    same = versions.retrain_version(good, folder, epochs=20).first()
    assert (same["status"], same["serving"]) == ("accepted", 4)
    assert versions.serving_model(spark, folder).version == "4"
    asked = spark.createDataFrame([(TAUGHT[0][0],)], "query string")
    row = classify(asked, ["nilai"], model=versions.serving_model(spark, folder)).first()
    assert (row["operation"], row["model_version"]) == ("MIN", "4")


def test_the_held_out_fold_is_never_fitted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(versions, "fit_model", lambda rows, *_: seen.extend(r["query"] for r in rows.collect()) or fit_model(rows, 2))
    rows = labelled(spark, [(f"{q} {k}", o) for q, o in TAUGHT for k in range(40)])
    versions.retrain_version(rows, fresh_folder(spark, "versions"))
    held = {r["query"] for r in rows.where(versions.held_out()).collect()}
    assert held and not held & set(seen) and held | set(seen) == {r["query"] for r in rows.collect()}


def training_rows(spark, ids):
    return spark.createDataFrame(
        [(i, f"q{i}", 0, "MAX", "s", True, None if i % 10 == 0 else dt.datetime(2024, 1, 1 + i % 5)) for i in ids],
        schemas.TRAINING_DATA,
    )


def test_training_rows_are_stored_once(spark):
    path = fresh_folder(spark, "table")
    assert read_training_table(spark, path).count() == 0
    assert append_training(training_rows(spark, range(0, 60)), path) == 60
    assert append_training(training_rows(spark, range(30, 90)), path) == 30
    assert append_training(training_rows(spark, range(0, 90)), path) == 0
    assert append_training(training_rows(spark, []), path) == 0
    # A folder that no manifest names, as an append leaves that failed half-way, is not read.
    stray = training_rows(spark, range(500, 510)).withColumn("created_day", F.to_date("created_at"))
    stray.write.partitionBy("created_day").parquet(f"{path}/rows/append=9-stray")
    got = read_training_table(spark, path)
    assert got.columns == schemas.field_names(schemas.TRAINING_DATA)
    assert sorted(map(str, got.collect())) == sorted(map(str, training_rows(spark, range(90)).collect()))


def test_only_the_days_at_hand_are_compared(spark, plan_of):
    path = fresh_folder(spark, "table")
    append_training(training_rows(spark, range(1, 60)), path)
    day = stored_training(spark, path).where(F.col("created_day") == F.lit(dt.date(2024, 1, 2)))
    assert "PartitionFilters: [isnotnull(created_day" in plan_of(day)


def test_ids_go_on_after_the_last(spark):
    path = fresh_folder(spark, "log")
    moment = dt.datetime(2024, 3, 1)

    def rows(n):
        asked = spark.range(0, n, 1, 5).select(F.concat(F.lit("nilai "), F.col("id")).alias("query"), F.lit(moment).cast("timestamp_ntz").alias("ts"))
        return query_log.log_rows(classify(asked, ["nilai"]), id_column=None)

    for n in (100, 0, 37):
        query_log.append_log(rows(n), path)
    ids = sorted(r["id"] for r in query_log.read_log(spark, path).collect())
    assert ids == list(range(1, 138))
    # An append that reserved its ids and failed leaves a gap, and no id comes twice.
    query_log._with_reserved_ids(rows(10), path)
    query_log.append_log(rows(5), path)
    ids = sorted(r["id"] for r in query_log.read_log(spark, path).collect())
    assert ids == [*range(1, 138), *range(148, 153)]


def test_ids_start_after_those_that_rows_brought(spark):
    path = fresh_folder(spark, "log")
    asked = spark.createDataFrame([(41, dt.datetime(2024, 3, 1), "nilai")], "id bigint, ts timestamp_ntz, query string")
    query_log.append_log(query_log.log_rows(classify(asked, ["nilai"])), path)
    query_log.append_log(query_log.log_rows(classify(asked, ["nilai"]), id_column=None), path)
    assert sorted(r["id"] for r in query_log.read_log(spark, path).collect()) == [41, 42]

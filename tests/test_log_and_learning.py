import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tanyalah.functions.intent import operation_id, operation_name
from tanyalah.functions.vocab import OPERATIONS, RETRAIN_REPLAY
from tanyalah.operators import evaluate, feedback, model, stats, training
from tanyalah.operators.classify import classify
from tanyalah.sources import corpus, query_log, schemas
from tanyalah.sources.scratch import fresh_folder

NOW = dt.datetime(2024, 5, 1, 12, 30, 15, 250)

# Golden questions, their labels and columns, whose figures are known.
SCENARIOS = [
    ("berapa harga tertinggi dari produk?", "MAX"),
    ("nilai minimum gaji karyawan", "MIN"),
    ("jumlah total penjualan bulan ini", "SUM"),
    ("rata-rata umur pegawai", "MEAN"),
    ("hitung berapa banyak data", "COUNT"),
    ("cari produk dengan harga di atas 100", "FILTER"),
    ("urutkan berdasarkan tanggal lahir", "SORT"),
    ("kelompokkan data per departemen", "GROUP"),
    ("nilai maksimum dari kolom pendapatan", "MAX"),
    ("berapa jumlah seluruh transaksi", "SUM"),
]
SCENARIO_COLUMNS = ["nama", "harga", "gaji", "tanggal", "departemen", "pendapatan"]


def make_log(spark, questions):
    rows = [(i, NOW, q) for i, q in enumerate(questions, start=1)]
    frame = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, query string")
    return query_log.log_rows(classify(frame, ["harga"]))


def make_events(spark, events):
    """Events as (query_id, feedback, correct_operation), in order of arrival."""
    rows = [
        (q, i, NOW + dt.timedelta(seconds=i // 2), f, o, "remark")
        for i, (q, f, o) in enumerate(events)
    ]
    return spark.createDataFrame(rows, schemas.FEEDBACK_EVENTS)


EVENTS = [
    (1, "correct", "MAX"),       # accepted
    (1, "Good", "MIN"),          # accepted once more; the last one wins
    (2, "ACCURATE", "MEDIAN"),   # accepted, unknown operation
    (3, "correct", None),        # nothing to learn
    (4, "incorrect", "SUM"),     # not positive
    (5, "correct", "SUM"),
    (5, None, None),             # nulls win too
    (6, "good", ""),             # an empty operation is none
    (99, "correct", "MAX"),      # unknown question
]


@pytest.fixture(scope="module")
def log(spark):
    return make_log(spark, [f"harga tertinggi {i}" for i in range(1, 8)])


@pytest.fixture(scope="module")
def events(spark):
    return make_events(spark, EVENTS)


def test_missing_tables_read_as_empty(spark):
    path = fresh_folder(spark, "absent")
    for read, ddl in (
        (query_log.read_log, schemas.QUERY_LOG),
        (query_log.read_feedback, schemas.FEEDBACK_EVENTS),
    ):
        empty = read(spark, path)
        assert empty.count() == 0
        assert empty.columns == schemas.field_names(ddl)


def test_append_and_read_back(spark, log):
    path = fresh_folder(spark, "log")
    query_log.append_log(log, path)
    query_log.append_log(make_log(spark, ["total harga"]).withColumn("id", F.lit(8)), path)
    stored = query_log.read_log(spark, path)
    assert stored.count() == 8
    row = stored.filter("id = 8").first()
    assert row["timestamp"] == NOW and row["log_date"] == NOW.date()
    assert row["columns_used"] == ["harga"] and row["user_id"] is None
    as_text = query_log.as_text_log(stored).filter("id = 8").first()
    assert dt.datetime.fromisoformat(as_text["timestamp"]) == NOW
    assert as_text["columns_used"] == '["harga"]'


def test_no_column_list_is_logged_as_an_empty_one(spark):
    frame = spark.createDataFrame([(1, NOW, "x")], "id int, ts timestamp_ntz, query string")
    rows = query_log.log_rows(classify(frame).drop("columns_used"))
    assert query_log.as_text_log(rows).first()["columns_used"] == "[]"


def test_row_ids_are_dense(spark):
    path = fresh_folder(spark, "ids")
    spark.range(0, 1000, 1, 7).repartition(5).write.parquet(path)
    rows = query_log.with_row_ids(spark.read.parquet(path).toDF("n"), start=11, name="log_id")
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().toString()
    got = [tuple(r) for r in rows.collect()]
    assert sorted(i for i, _ in got) == list(range(11, 1011))
    assert sorted(n for _, n in got) == list(range(1000))


def test_latest_feedback(events):
    latest = {r["query_id"]: tuple(r)[1:] for r in feedback.feedback_latest(events).collect()}
    assert latest == {
        1: ("Good", "MIN"), 2: ("ACCURATE", "MEDIAN"), 3: ("correct", None),
        4: ("incorrect", "SUM"), 5: (None, None), 6: ("good", ""), 99: ("correct", "MAX"),
    }


def test_order_of_arrival_does_not_matter(spark, events):
    shuffled = events.repartition(5).orderBy(F.rand(3))
    key = feedback.feedback_latest(events).orderBy("query_id").collect()
    assert feedback.feedback_latest(shuffled).orderBy("query_id").collect() == key


def test_log_with_feedback(log, events):
    rows = feedback.log_with_feedback(log, events).orderBy("id").collect()
    assert [(r["id"], r["user_feedback"]) for r in rows] == [
        (1, "Good"), (2, "ACCURATE"), (3, "correct"), (4, "incorrect"), (5, None),
        (6, "good"), (7, None),
    ]


def test_training_set(log, events):
    rows = training.training_set(log, events).orderBy("id").collect()
    assert [(r["query"], r["operation_id"], r["operation_name"]) for r in rows] == [
        ("harga tertinggi 1", 0, "MAX"), ("harga tertinggi 1", 1, "MIN"),
        ("harga tertinggi 2", -1, "MEDIAN"), ("harga tertinggi 5", 2, "SUM"),
    ]
    assert all(r["verified"] and r["source"] == "user_feedback" for r in rows)
    assert rows[-1]["created_at"] == NOW + dt.timedelta(seconds=2)


def test_training_is_read_newest_first(spark, log, events):
    rows = training.training_set(log, events)
    got = [tuple(r) for r in training.read_training(rows).collect()]
    assert got == [
        ("harga tertinggi 5", 2), ("harga tertinggi 2", -1),
        ("harga tertinggi 1", 1), ("harga tertinggi 1", 0),
    ]
    unverified = rows.withColumn("verified", F.col("id") > 1)
    assert training.read_training(unverified).count() == 2
    assert training.read_training(unverified, verified_only=False).count() == 4


def test_export_keeps_odd_texts(spark):
    texts = ['koma, dan "kutip"', "dua\nbaris", " spasi ", "garis \\ miring", "'", '"', "",
             "a\r\nb", "# bukan komentar", '\\"']
    rows = [
        (i, t, i % 8, None, "s", True, NOW + dt.timedelta(seconds=i))
        for i, t in enumerate(texts)
    ]
    path = fresh_folder(spark, "export")
    training.export_training(spark.createDataFrame(rows, schemas.TRAINING_DATA), path, True)
    got = training.read_export(spark, path).collect()
    assert [r["query"] for r in got] == texts[::-1]
    assert [r["operation_name"] for r in got][-1] == "MAX"


def test_ids_and_names(spark):
    frame = spark.createDataFrame([(n,) for n in [*OPERATIONS, "MEDIAN", None]], "n string")
    ids = [r[0] for r in frame.select(operation_id(F.col("n"))).collect()]
    assert ids == [0, 1, 2, 3, 4, 5, 6, 7, -1, None]
    numbers = spark.createDataFrame([(i,) for i in [0, 7, 8, -1, None]], "i int")
    names = [r[0] for r in numbers.select(operation_name(F.col("i"))).collect()]
    assert names == ["MAX", "GROUP", None, None, None]


def test_gates(log, events):
    verified = training.verified_count(log, events)
    assert verified.first()[0] == training.training_set(log, events).count() == 4
    rows = training.retrain_gate(verified, 4, 5, 10).collect()
    assert [(r["should_retrain"], r["samples_needed"]) for r in rows] == [
        (True, 0), (False, 1), (False, 6),
    ]
    assert training.retrain_gate(verified).first()["min_samples"] == 50
    replies = training.feedback_reply(events, verified).collect()
    assert len(replies) == len(EVENTS) and all(r["suggestion"] is None for r in replies)
    eager = training.feedback_reply(events, verified, needed=4).collect()
    assert all(r["suggestion"] == training.SUGGESTION for r in eager)


def test_retraining_is_refused_without_data(spark, log, events):
    row = training.retrain(spark, log, events, fresh_folder(spark, "no_model")).first()
    assert (row["status"], row["training_samples"], row["model_path"]) == ("insufficient", 4, None)


def test_stats(log, events):
    row = stats.log_stats(log, events).first().asDict()
    assert row == {
        "total_questions": 7, "questions_with_feedback": 5, "average_confidence": 0.95,
        "verified_samples": 4, "model_needs_retraining": False,
        "questions_by_operation": {"MAX": 7},
    }
    shown = stats.display_stats(stats.log_stats(log, events)).first()
    assert shown["confidence_percent"] == 95.0
    assert stats.log_stats(log, events, needed=4).first()["model_needs_retraining"]


def test_stats_of_an_empty_log(spark):
    empty = spark.createDataFrame([], schemas.QUERY_LOG)
    none = spark.createDataFrame([], schemas.FEEDBACK_EVENTS)
    row = stats.log_stats(empty, none).first().asDict()
    assert row == {
        "total_questions": 0, "questions_with_feedback": 0, "average_confidence": 0.0,
        "verified_samples": 0, "model_needs_retraining": False, "questions_by_operation": {},
    }


def test_smoke_log(spark):
    """One logged question with one accepted feedback event."""
    rows = [(1, NOW, "berapa harga tertinggi?", "MAX", 0.85, "x", ["harga"], "s", None, None, NOW.date())]
    one = spark.createDataFrame(rows, schemas.QUERY_LOG)
    row = stats.log_stats(one, make_events(spark, [(1, "correct", "MAX")])).first()
    assert tuple(row) == (1, 1, 0.85, 1, False, {"MAX": 1})


def test_replay_of_scenarios(spark):
    labelled = spark.createDataFrame(
        [(i, NOW + dt.timedelta(seconds=i), q, e) for i, (q, e) in enumerate(SCENARIOS, 1)],
        "id bigint, ts timestamp_ntz, query string, expected string",
    )
    log, events = evaluate.replay(labelled, SCENARIO_COLUMNS)
    row = stats.log_stats(log, events).first()
    assert (row["total_questions"], row["questions_with_feedback"]) == (10, 10)
    assert (row["average_confidence"], row["verified_samples"]) == (0.885, 9)
    by_operation = Counter(row["questions_by_operation"])
    assert by_operation == {**dict.fromkeys(OPERATIONS, 1), "MAX": 2, "FILTER": 2}
    gate = training.retrain_gate(training.verified_count(log, events), RETRAIN_REPLAY).first()
    assert gate["should_retrain"] and gate["samples_needed"] == 0
    sessions = {r[0]: r[1] for r in log.groupBy("session_id").count().collect()}
    assert sessions == {"session_0": 2, "session_1": 3, "session_2": 3, "session_3": 2}
    wrong = evaluate.accuracy(evaluate.judge(labelled)).filter("accuracy < 1").collect()
    assert [(r["expected"], r["questions"], r["correct"]) for r in wrong] == [("SUM", 2, 1)]


def test_corpus_file(spark, tmp_path):
    file = tmp_path / "corpus.csv"
    file.write_text("# judul\n\nskor tertinggi,0,MAX\n# bagian\ntotal skor,2,SUM\n")
    rows = [tuple(r) for r in corpus.read_corpus(spark, str(file)).collect()]
    assert rows == [("skor tertinggi", 0, "MAX"), ("total skor", 2, "SUM")]


def test_seed_has_every_label(spark):
    counts = {r[0]: r[1] for r in corpus.seed_corpus(spark).groupBy("operation_id").count().collect()}
    assert counts == dict.fromkeys(range(8), 4)


def test_model_decides_only_where_no_rule_does(spark):
    learned = [("saring semua tagihan mahal", 5), ("perkecil sampai nol", 1)] * 20
    labelled = spark.createDataFrame(
        [*learned, ("tanpa label", -1)], "query string, operation_id int"
    )
    fitted = model.fit_model(labelled, epochs=30)
    path = fresh_folder(spark, "model")
    fitted.write().overwrite().save(path)
    questions = spark.createDataFrame(
        [(1, "perkecil sampai nol"), (2, "harga tertinggi"), (3, ""), (4, None)],
        "id int, query string",
    )
    for used in (fitted, model.load_model(path)):
        rows = model.classify_with_model(questions, used).orderBy("id").collect()
        assert rows[0]["operation"] == "MIN" and not rows[0]["by_rule"]
        assert 0.5 < rows[0]["confidence"] <= 1
        assert (rows[1]["operation"], rows[1]["confidence"]) == ("MAX", 0.95)
        assert all(r["operation"] in OPERATIONS for r in rows)
    assert rows[0].asDict().keys() == {"id", "query", "operation", "confidence", "by_rule"}


def test_retrain_saves_a_model(spark):
    log = make_log(spark, [f"pertanyaan nomor {i}" for i in range(1, 31)])
    events = make_events(spark, [(i, "correct", OPERATIONS[i % 8]) for i in range(1, 31)])
    row = training.retrain(spark, log, events, fresh_folder(spark, "retrain"), epochs=3).first()
    assert (row["status"], row["training_samples"], row["samples_exported"]) == ("completed", 30, 30)
    assert row["suggestion"] == training.SUGGESTION
    assert model.load_model(row["model_path"]) is not None
    assert training.read_export(spark, row["export_path"]).count() == 30


def test_one_question_with_most_of_the_events(spark):
    """A hot question id keeps every event and the right last one."""
    log = make_log(spark, [f"harga {i}" for i in range(1, 101)])
    hot = spark.range(0, 30000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100 + 1).alias("query_id"),
        F.col("id").alias("seq"),
        F.lit(NOW).cast("timestamp_ntz").alias("ts"),
        F.lit("good").alias("feedback"),
        F.concat(F.lit("OP"), F.col("id")).alias("correct_operation"),
        F.lit(None).cast("string").alias("comments"),
    )
    assert training.training_set(log, hot).count() == 30000
    assert training.verified_count(log, hot).first()[0] == 30000
    latest = feedback.feedback_latest(hot).filter("query_id = 7").first()
    assert latest["correct_operation"] == "OP29997"

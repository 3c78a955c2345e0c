"""The queries by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intent import operation_id
from ..operators import answer, classify, evaluate, feedback, model, stats, training, typed_plan, vector_index, versions
from ..operators.answer_many import answer_many as answer_questions
from ..operators.fold import Fold, fold_groups
from ..operators.learned import Served
from ..operators.similarity import top_k_similar
from ..sources import query_log
from ..sources.scratch import fresh_folder
from ..sources.training_table import append_training, read_training_table
from ..streaming import questions as streaming
from . import derived
from .derived import LINEITEM_COLUMNS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOP_K = 5


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# Classification ------------------------------------------------------------


@query
def intent_catalog(spark, sf_dir):
    return classify.operation_usage(derived.questions(spark, sf_dir))


@query
def classify_intent(spark, sf_dir):
    asked = classify.classify_operation(derived.questions(spark, sf_dir))
    return asked.select("id", "query", "operation", "confidence", "by_rule")


@query
def classify_default_share(spark, sf_dir):
    """How much free text falls to the default, by operation, over two tables."""
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("source"), F.col("text").alias("query")
    )
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("text").alias("query")
    )
    texts = classify.classify_operation(turns.unionByName(documents))
    return texts.groupBy("source", "operation").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(~F.col("by_rule")).alias("by_default"),
    )


@query
def detect_column(spark, sf_dir):
    asked = derived.questions_with_columns(spark, sf_dir)
    return classify.classify(asked, F.col("columns")).select(
        "id", "query", "detected_column"
    )


@query
def plan_text(spark, sf_dir):
    asked = derived.questions_with_columns(spark, sf_dir)
    return classify.classify(asked, F.col("columns")).select("id", "generated_code")


@query
def classify_full(spark, sf_dir):
    asked = derived.questions(spark, sf_dir)
    return classify.classify(asked, LINEITEM_COLUMNS, view="lineitem").select(
        "id", "query", "operation", "confidence", "detected_column", "wants_row",
        "wants_row_count", "generated_code",
    )


@query
def classify_with_model(spark, sf_dir):
    """The whole record, with a model that learned what each phrase is meant to be."""
    asked = derived.questions(spark, sf_dir)
    learned = Served(model.fit_model(_labelled(asked)), "first")
    record = classify.classify(asked, LINEITEM_COLUMNS, view="lineitem", model=learned)
    return record.select(
        "id", "by_rule", "operation", "generated_code", "model_version",
        (F.col("confidence") > 0.5).alias("confident"),
    )


def _labelled(asked):
    return asked.select(
        "query", operation_id(F.col("expected")).alias("operation_id"),
        F.col("expected").alias("operation_name"),
    )


@query
def run_plan_text(spark, sf_dir):
    """The typed text of every question about lineitem, run."""
    items = table(spark, sf_dir, "lineitem")
    asked = classify.classify_column(derived.questions(spark, sf_dir), LINEITEM_COLUMNS)
    planned = typed_plan.with_typed_plan(asked, items, LINEITEM_COLUMNS, "planned_items")
    number = typed_plan.answer_number()
    return typed_plan.run_plans(planned, items, "planned_items").select(
        "id", "operation", "detected_column",
        F.round(number, 4).alias("answer_double"),
        F.when(number.isNull(), F.col("plan_answer")).alias("answer_string"),
    )


# Answers -------------------------------------------------------------------


@query
def ask_max(spark, sf_dir):
    return answer.ask(table(spark, sf_dir, "part"), "berapa harga tertinggi")


@query
def ask_max_all(spark, sf_dir):
    return answer.ask(table(spark, sf_dir, "orders"), "maksimum", columns=[""])


@query
def ask_min(spark, sf_dir):
    return answer.ask(table(spark, sf_dir, "orders"), "tanggal pesanan terendah")


@query
def ask_min_all(spark, sf_dir):
    return answer.ask(derived.readings(spark, sf_dir), "minimum", columns=[""])


@query
def ask_sum(spark, sf_dir):
    total = answer.ask(table(spark, sf_dir, "lineitem"), "total harga semua barang")
    return total.select(F.round("l_extendedprice", 2).alias("l_extendedprice"))


@query
def ask_sum_all(spark, sf_dir):
    return _rounded(answer.ask(table(spark, sf_dir, "lineitem"), "total", columns=[""]))


@query
def ask_mean(spark, sf_dir):
    return _rounded(answer.ask(derived.readings(spark, sf_dir), "rata-rata nilai"))


@query
def ask_mean_all(spark, sf_dir):
    return _rounded(answer.ask(table(spark, sf_dir, "lineitem"), "mean", columns=[""]))


@query
def ask_count(spark, sf_dir):
    return answer.ask(derived.readings(spark, sf_dir), "hitung nilai")


@query
def ask_count_all(spark, sf_dir):
    return answer.ask(derived.readings(spark, sf_dir), "hitung", columns=[""])


@query
def ask_row_count(spark, sf_dir):
    return answer.ask(table(spark, sf_dir, "lineitem"), "hitung jumlah baris")


@query
def ask_argmax(spark, sf_dir):
    question = "siapa pelanggan dengan c_acctbal terbesar"
    return answer.ask(table(spark, sf_dir, "customer"), question, tie="c_custkey")


@query
def ask_argmin(spark, sf_dir):
    question = "barang yang mana dengan l_quantity terkecil"
    return answer.ask(table(spark, sf_dir, "lineitem"), question)


def _people(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("nomor"),
        F.col("c_name").alias("nama"),
        F.col("c_nationkey").alias("umur"),
        F.col("c_acctbal").alias("saldo"),
    )


@query
def ask_argmax_named(spark, sf_dir):
    return answer.ask(_people(spark, sf_dir), "siapa yang umurnya tertua", tie="nomor")


@query
def ask_argmin_named(spark, sf_dir):
    return answer.ask(_people(spark, sf_dir), "siapa dengan saldo terendah", tie="nomor")


@query
def ask_filter_gt(spark, sf_dir):
    return answer.ask(
        table(spark, sf_dir, "orders"), "cari pesanan dengan harga di atas nilai",
        value=200000.0,
    )


@query
def ask_sort(spark, sf_dir):
    return answer.ask(
        table(spark, sf_dir, "orders"), "urutkan menurut tanggal", tie="o_orderkey"
    )


@query
def ask_group_agg(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    groups = answer.ask(
        items, "kelompokkan per l_returnflag", func=["max", "min", "sum", "mean", "count"]
    )
    return _rounded(groups, keep=["l_returnflag"])


def _geometric_mean():
    """Not built in: a sum of logarithms and a count are its partial state."""

    def update(state, rows):
        values = rows.column("l_quantity").to_numpy().astype("float64")
        return state[0] + float(np.log(values).sum()), state[1] + len(values)

    return Fold(
        lambda: (0.0, 0), update, lambda a, b: (a[0] + b[0], a[1] + b[1]),
        lambda state: float(np.exp(state[0] / state[1])),
    )


@query
def group_fold(spark, sf_dir):
    """An aggregate of the user's own per flag."""
    items = table(spark, sf_dir, "lineitem")
    means = fold_groups(items, "l_returnflag", _geometric_mean(), ["l_quantity"], "double")
    return means.select("l_returnflag", F.round("value", 6).alias("geometric_mean"))


@query
def ask_group_size(spark, sf_dir):
    return answer.group_size(derived.readings(spark, sf_dir), "jenis")


@query
def ask_sort_project(spark, sf_dir):
    return answer.sort_by(
        table(spark, sf_dir, "part"), "p_retailprice", project=["p_name", "p_retailprice"]
    )


DISPATCHED = (
    "harga tertinggi", "l_discount minimum", "total harga",
    "rata-rata l_quantity", "hitung jumlah baris",
)


@query
def ask_dispatch(spark, sf_dir):
    """One question at a time over the same table."""
    items = table(spark, sf_dir, "lineitem")
    answers = None
    for question in DISPATCHED:
        value = answer.ask(items, question)
        row = value.select(
            F.lit(question).alias("question"),
            F.round(value[value.columns[0]].cast("double"), 4).alias("answer"),
        )
        answers = row if answers is None else answers.unionByName(row)
    return answers


@query
def answer_many(spark, sf_dir):
    answers = answer_questions(derived.questions(spark, sf_dir), table(spark, sf_dir, "lineitem"))
    return answers.select(
        "id", "query", "operation", "detected_column",
        F.round("answer_double", 4).alias("answer_double"), "answer_exact", "answer_string",
        "status",
    )


# Log, feedback, training ---------------------------------------------------


def _log(spark, sf_dir):
    asked = derived.questions(spark, sf_dir).withColumn(
        "session_id", evaluate.session_name(F.col("id") + 1)
    )
    return query_log.log_rows(classify.classify(asked, LINEITEM_COLUMNS))


def _narrow_log(spark, sf_dir):
    """The columns of the log that feedback, training and statistics read."""
    asked = classify.classify_operation(derived.questions(spark, sf_dir))
    return asked.withColumnRenamed("operation", "predicted_operation").select(
        "id", "query", "predicted_operation", "confidence"
    )


def _training(spark, sf_dir):
    # Training rows need the questions only, not their classes.
    asked = derived.questions(spark, sf_dir).select("id", "query")
    return training.training_set(asked, derived.feedback(spark, sf_dir))


_LOG_COLUMNS = (
    "id", "query", "predicted_operation", "confidence", "generated_code",
    "columns_used", "session_id", "user_id",
)


@query
def log_append(spark, sf_dir):
    """Write the log to a fresh folder and read it back."""
    path = fresh_folder(spark, "query_log")
    query_log.append_log(_log(spark, sf_dir), path)
    stored = query_log.as_text_log(query_log.read_log(spark, path))
    return stored.select(*_LOG_COLUMNS, F.col("log_date").cast("string").alias("log_date"))


@query
def feedback_latest(spark, sf_dir):
    return feedback.feedback_latest(derived.feedback(spark, sf_dir))


@query
def log_with_feedback(spark, sf_dir):
    joined = feedback.log_with_feedback(
        _narrow_log(spark, sf_dir), derived.feedback(spark, sf_dir)
    )
    return joined.select(
        "id", "query", "predicted_operation", "user_feedback", "correct_operation"
    )


@query
def feedback_accepted(spark, sf_dir):
    accepted = feedback.feedback_accepted(derived.feedback(spark, sf_dir))
    return accepted.select("query_id", "seq", "feedback", "correct_operation")


@query
def training_set(spark, sf_dir):
    return _training(spark, sf_dir)


@query
def training_read(spark, sf_dir):
    return training.read_training(_training(spark, sf_dir))


@query
def training_export(spark, sf_dir):
    path = fresh_folder(spark, "training_export")
    training.export_training(_training(spark, sf_dir), path)
    return training.read_export(spark, path)


@query
def export_summary(spark, sf_dir):
    path = fresh_folder(spark, "training_export")
    return training.export_summary(_training(spark, sf_dir), path).drop("export_path")


@query
def retrain_gate(spark, sf_dir):
    verified = training.verified_count(
        derived.questions(spark, sf_dir), derived.feedback(spark, sf_dir)
    )
    return training.retrain_gate(verified, 5, 10, 20, 50, 1_000_000_000)


@query
def retrain_status(spark, sf_dir):
    """Export, fit and save a model, then report."""
    done = training.retrain(
        spark, derived.questions(spark, sf_dir), derived.feedback(spark, sf_dir),
        fresh_folder(spark, "retrain"),
    )
    return done.drop("export_path", "model_path")


@query
def retrain_insufficient(spark, sf_dir):
    """Too few verified rows: nothing is exported or fitted."""
    done = training.retrain(
        spark, derived.questions(spark, sf_dir), derived.feedback(spark, sf_dir),
        fresh_folder(spark, "retrain"), needed=1_000_000_000,
    )
    return done.drop("export_path", "model_path")


@query
def retrain_versions(spark, sf_dir):
    """Three retrainings: a good one, one that knows a single class, and the good one again."""
    folder = fresh_folder(spark, "versions")
    rows = _labelled(derived.questions(spark, sf_dir))
    for taught in (rows, rows.where("operation_name = 'MAX'"), rows):
        versions.retrain_version(taught, folder, held=rows)
    return versions.decisions(spark, folder).select(
        "version", "status", "training_rows", "held_out",
        (F.col("hits") == F.col("held_out")).alias("all_right"), "serving",
    )


@query
def training_append(spark, sf_dir):
    """Two appends with events in common, read back."""
    path = fresh_folder(spark, "training_table")
    asked = derived.questions(spark, sf_dir).select("id", "query")
    for part in ("seq % 3 <> 2", "seq % 3 <> 0"):
        events = derived.feedback(spark, sf_dir).where(part)
        append_training(training.training_set(asked, events), path)
    return read_training_table(spark, path)


@query
def log_row_ids(spark, sf_dir):
    """Turns of conversations, without ids of their own, in two appends to a log."""
    path = fresh_folder(spark, "numbered_log")
    turns = table(spark, sf_dir, "conversations").select(
        F.col("text").alias("query"), "turn", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts")
    )
    for part in (0, 1):
        asked = classify.classify(turns.where(F.col("turn") % 2 == part))
        query_log.append_log(query_log.log_rows(asked, id_column=None), path)
    return query_log.read_log(spark, path).agg(
        F.count("id").alias("questions"), F.countDistinct("id").alias("ids"),
        F.min("id").alias("least"), F.max("id").alias("greatest"),
    )


@query
def feedback_reply(spark, sf_dir):
    events = derived.feedback(spark, sf_dir)
    verified = training.verified_count(derived.questions(spark, sf_dir), events)
    return training.feedback_reply(events, verified)


# Statistics ----------------------------------------------------------------


@query
def log_stats(spark, sf_dir):
    figures = stats.log_stats(_narrow_log(spark, sf_dir), derived.feedback(spark, sf_dir))
    return figures.drop("questions_by_operation")


@query
def log_stats_display(spark, sf_dir):
    return stats.display_stats(
        stats.log_stats(_narrow_log(spark, sf_dir), derived.feedback(spark, sf_dir))
    )


@query
def log_by_operation(spark, sf_dir):
    return stats.by_operation(_narrow_log(spark, sf_dir))


def _judged(spark, sf_dir):
    return evaluate.judge(derived.questions(spark, sf_dir))


@query
def eval_feedback(spark, sf_dir):
    return _judged(spark, sf_dir).select("id", "expected", "operation", "feedback")


@query
def eval_accuracy(spark, sf_dir):
    return evaluate.accuracy(_judged(spark, sf_dir))


@query
def eval_by_session(spark, sf_dir):
    judged = _judged(spark, sf_dir).withColumn(
        "session_id", evaluate.session_name(F.col("id") + 1)
    )
    return evaluate.accuracy(judged, "session_id")


@query
def eval_replay(spark, sf_dir):
    asked = derived.questions(spark, sf_dir).withColumn("id", F.col("id") + 1)
    return evaluate.replay_report(asked, LINEITEM_COLUMNS)


# Streams: run to the end of the available input, then read back ------------


def _event_stream(spark, sf_dir):
    ddl = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf_dir, "events").schema
    )
    return streaming.stream_table(spark, f"{sf_dir}/events.parquet", ddl)


@query
def stream_classify(spark, sf_dir):
    folder = fresh_folder(spark, "stream_classify")
    asked = derived.as_questions(_event_stream(spark, sf_dir)).withColumn(
        "session_id", evaluate.session_name(F.col("id") + 1)
    )
    streaming.stream_to_log(
        asked, LINEITEM_COLUMNS, f"{folder}/log", f"{folder}/checkpoint"
    ).awaitTermination()
    stored = query_log.as_text_log(query_log.read_log(spark, f"{folder}/log"))
    return stored.select(*_LOG_COLUMNS, F.col("log_date").cast("string").alias("log_date"))


@query
def log_compact(spark, sf_dir):
    """Streams of two halves of the questions into one log, whose closed days are then compacted."""
    folder = fresh_folder(spark, "log_compact")
    for half in (0, 1):
        events = _event_stream(spark, sf_dir).where(F.col("event_id") % 2 == half)
        asked = derived.as_questions(events).withColumn(
            "session_id", evaluate.session_name(F.col("id") + 1)
        )
        streaming.stream_to_log(
            asked, LINEITEM_COLUMNS, f"{folder}/log", f"{folder}/checkpoint-{half}"
        ).awaitTermination()
    days = table(spark, sf_dir, "events").agg(F.max(F.to_date("ts"))).first()[0]
    query_log.compact_log(spark, f"{folder}/log", days)
    stored = query_log.as_text_log(query_log.read_log(spark, f"{folder}/log"))
    return stored.select(*_LOG_COLUMNS, F.col("log_date").cast("string").alias("log_date"))


@query
def stream_latest_feedback(spark, sf_dir):
    """The current feedback as stream state."""
    folder = fresh_folder(spark, "latest_feedback")
    streaming.stream_latest_feedback(
        derived.as_feedback(_event_stream(spark, sf_dir)),
        f"{folder}/changes", f"{folder}/checkpoint",
    ).awaitTermination()
    return streaming.read_latest_feedback(spark, f"{folder}/changes")


@query
def stream_feedback(spark, sf_dir):
    """Feedback arrives as a stream; its current state is a batch view."""
    folder = fresh_folder(spark, "stream_feedback")
    streaming.stream_feedback(
        derived.as_feedback(_event_stream(spark, sf_dir)),
        f"{folder}/events", f"{folder}/checkpoint",
    ).awaitTermination()
    return feedback.feedback_latest(query_log.read_feedback(spark, f"{folder}/events"))


@query
def stream_stats(spark, sf_dir):
    folder = fresh_folder(spark, "stream_stats")
    name = "running_stats_" + folder.rsplit("-", 1)[1]
    streaming.stream_stats(
        derived.as_questions(_event_stream(spark, sf_dir)), name, f"{folder}/checkpoint"
    ).awaitTermination()
    return spark.table(name)


# Similarity ----------------------------------------------------------------


@query
def vector_topk(spark, sf_dir):
    """The vectors nearest to the mean vector of every label."""
    vectors = table(spark, sf_dir, "embeddings")
    centers = vectors.groupBy("label").agg(
        vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("center")
    )
    return top_k_similar(centers, vectors, TOP_K, "label", "center", plan="broadcast")


@query
def vector_topk_blocks(spark, sf_dir):
    """The vectors nearest to those whose id is divisible by 50, over the whole table."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    return top_k_similar(asked, vectors, TOP_K)


@query
def vector_topk_index(spark, sf_dir):
    """The same questions through inverted lists, held against the exact answers."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    index = vector_index.build_index(vectors, k=TOP_K)
    found = vector_index.top_k_indexed(asked, index, TOP_K)
    exact = top_k_similar(asked, vectors, TOP_K).select("query_id", "vec_id", F.lit(1).alias("in_exact"))
    held = found.join(exact, ["query_id", "vec_id"], "left").agg(
        F.countDistinct("query_id").alias("queries"), F.count("*").alias("pairs"),
        F.coalesce(F.sum("in_exact"), F.lit(0)).alias("hits"),
    )
    return held.select("queries", "pairs", (F.col("hits") >= 0.9 * F.col("pairs")).alias("recall_reached"))


def _rounded(df: DataFrame, digits: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Numbers as doubles of few digits: sums of doubles depend on the order."""
    kept = keep or []
    return df.select(
        *kept,
        *[
            F.round(F.col(c).cast("double"), digits).alias(c)
            for c in df.columns
            if c not in kept
        ],
    )

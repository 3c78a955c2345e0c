"""The physical plans have the shape that large tables need."""

import re

import pytest
from pyspark.sql import functions as F

from tanyalah.functions import vocab
from tanyalah.operators import answer, feedback, stats, training
from tanyalah.operators.answer_many import answer_many
from tanyalah.operators.classify import classify, classify_column, classify_operation
from tanyalah.plans import derived, registry
from tanyalah.sources import query_log
from tanyalah.sources.scratch import fresh_folder


def physical(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan ==") :]


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    """Log and feedback as tables on disk."""
    folder = fresh_folder(spark, "stored")
    query_log.append_log(
        query_log.log_rows(classify(derived.questions(spark, sf_dir), ["harga"])),
        f"{folder}/log",
    )
    query_log.append_feedback(derived.feedback(spark, sf_dir), f"{folder}/events")
    return (
        query_log.read_log(spark, f"{folder}/log"),
        query_log.read_feedback(spark, f"{folder}/events"),
    )


MAPS = ("classify_intent", "classify_full", "detect_column", "plan_text", "eval_feedback")


@pytest.mark.parametrize("name", MAPS)
def test_classification_is_one_pass_without_shuffle_or_python(spark, sf_dir, name):
    plan = physical(registry.QUERIES[name](spark, sf_dir))
    assert "Exchange" not in plan and "Python" not in plan and "UDF" not in plan
    assert plan.count("FileScan") == 1


def test_each_text_is_lowered_and_matched_once(spark, sf_dir):
    """Also under a filter on the result, and in one stage of generated code."""
    asked = derived.questions(spark, sf_dir)
    for classified in (classify_operation(asked), classify_column(asked, ["harga"])):
        for frame in (classified, classified.filter("operation = 'MAX'")):
            plan = physical(frame)
            assert plan.count(" AS __lowered") == 1
            assert plan.count("paling tinggi") == 1
            assert all(line.strip().startswith(("*(1)", "+- *(1)", "+- FileScan", "=="))
                       for line in plan.strip().splitlines())


def test_answers_read_one_column(items):
    plan = physical(answer.ask(items, "harga tertinggi"))
    assert "ReadSchema: struct<l_extendedprice:double>" in plan


def test_many_answers_share_one_scan(spark, sf_dir, items):
    plan = physical(answer_many(derived.questions(spark, sf_dir), items))
    assert plan.count("lineitem.parquet") == 1 and plan.count("FileScan") == 2
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    read = re.search(r"FileScan parquet \[(l_[^]]*)\]", plan).group(1)
    assert "l_extendedprice" in read and "l_partkey" not in read and "l_suppkey" not in read


def test_filter_reaches_the_scan(items):
    plan = physical(answer.ask(items, "cari l_quantity", value=10.0))
    assert "GreaterThan(l_quantity,10.0)" in plan


def test_extreme_row_takes_one_row_per_task(items):
    plan = physical(answer.ask(items, "siapa l_quantity terbesar"))
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(l_quantity,ScalarSubquery" in plan
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_groups_are_reduced_before_the_shuffle(items):
    plan = physical(answer.ask(items, "grup l_returnflag", func="sum"))
    first, second = [m.start() for m in re.finditer("HashAggregate", plan)][:2]
    assert first < plan.index("Exchange") < second
    assert "partial_sum" in plan


def test_sort_has_two_range_keys(items):
    """The value, and one hash that splits equal values."""
    plan = physical(answer.ask(items, "urut l_returnflag"))
    exchange = re.search(r"rangepartitioning\((.*)", plan).group(1)
    assert exchange.count("ASC NULLS LAST") == 2 and "xxhash64(" in exchange


def test_projected_sort_reads_its_columns_only(spark, sf_dir):
    plan = physical(registry.QUERIES["ask_sort_project"](spark, sf_dir))
    assert "ReadSchema: struct<p_name:string,p_retailprice:double>" in plan


def test_named_extreme_row_reads_value_name_and_age(spark, sf_dir):
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnsRenamed(
        {"c_name": "nama", "c_nationkey": "umur"}
    )
    plan = physical(answer.ask(people, "siapa dengan c_acctbal terbesar"))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and all("c_custkey" not in r and "c_phone" not in r for r in read)
    assert max(r.count(":") for r in read) == 3


def test_stats_scan_each_table_once(stored):
    log, events = stored
    plan = physical(stats.log_stats(log, events))
    assert plan.count("FileScan") == 2
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert "id:bigint,predicted_operation:string,confidence:double" in read


def test_training_set_joins_once(stored):
    plan = physical(training.training_set(*stored))
    assert plan.count("Join") == 1 and plan.count("FileScan") == 2
    assert "IsNotNull(correct_operation)" in plan or "isnotnull(correct_operation" in plan


def test_a_hot_question_is_split_over_tasks(spark, stored):
    """Adaptive execution splits the events of one question in the join."""
    log, events = stored
    third = F.when(F.col("seq") % 3 == 0, F.lit(7)).otherwise(F.col("query_id"))
    copies = events.withColumn("query_id", third).withColumn(
        "id", F.explode(F.sequence(F.lit(0), F.lit(59)))
    )
    path = fresh_folder(spark, "hot")
    copies.withColumns(
        {"seq": F.col("seq") * 60 + F.col("id"), "feedback": F.lit("good"),
         "correct_operation": F.sha2(F.concat_ws("-", "seq", "id"), 256)}
    ).drop("id").repartition(8).write.parquet(f"{path}/{query_log.BATCH}")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = training.training_set(log, query_log.read_feedback(spark, path))
        run = joined._jdf.queryExecution()
        assert run.toRdd().count() > 0
        assert "skew=true" in run.executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_feedback_state_is_a_partial_aggregate(stored):
    plan = physical(feedback.feedback_state(stored[1]))
    assert "partial_max_by" in plan and plan.count("Exchange") == 1


def test_log_days_are_balanced(stored, spark):
    log, _ = stored
    plan = physical(log.hint("rebalance", "log_date"))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    files = log.select(F.input_file_name().alias("f"), "log_date").distinct()
    assert files.count() == log.select("log_date").distinct().count()


def test_a_day_prunes_the_log(stored):
    plan = physical(stored[0].filter(F.col("log_date") == F.lit("2024-01-05").cast("date")))
    assert re.search(r"PartitionFilters: \[.*log_date.*2024-01-05", plan)


def test_similarity_keeps_k_per_task(spark, sf_dir):
    plan = physical(registry.QUERIES["vector_topk"](spark, sf_dir))
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "NestedLoop" not in plan


def test_no_query_has_a_cross_join(spark, sf_dir):
    for name in ("intent_catalog", "answer_many", "training_set", "log_stats", "feedback_reply"):
        plan = physical(registry.QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_vocabulary_is_whole():
    assert tuple(vocab.TRIGGER_WORDS) == (
        "MAX", "MIN", "MEAN", "SUM", "COUNT", "SORT", "GROUP", "FILTER",
    )
    assert sum(map(len, vocab.TRIGGER_WORDS.values())) == 49

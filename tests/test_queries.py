"""Every registered query against its SQL on the same tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tanyalah.plans.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return None if isinstance(value, float) and math.isnan(value) else value


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    result = contract.queries()[name](spark, sf_dir)
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    want = by_name(columns, cursor.fetchall())
    assert want, "an empty result checks nothing"
    assert by_name(result.columns, map(tuple, result.collect())) == want


def test_queries_without_sql():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql())


def test_model_query_keeps_every_question(spark, sf_dir):
    got = contract.queries()["classify_with_model"](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rules = contract.queries()["classify_intent"](spark, sf_dir)
    ruled = got.filter("by_rule").select("id", "operation")
    assert ruled.exceptAll(rules.filter("by_rule").select(*ruled.columns)).count() == 0
    assert got.filter("NOT by_rule").count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "id", "query", "operation", "detected_column", "answer_double", "answer_exact",
        "answer_string", "status",
    ]


def test_stream_and_batch_log_share_one_oracle():
    sql = contract.oracle_sql()
    assert sql["stream_classify"] == sql["log_append"]


def test_no_data_is_kept_in_the_repository():
    root = Path(contract.__file__).parent
    assert not [p for p in root.rglob("*.parquet") if ".git" not in p.parts]

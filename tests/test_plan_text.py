import pytest
from pyspark.sql import functions as F

from tanyalah.operators.answer import ask
from tanyalah.operators.classify import classify


def code(spark, question, columns, view="t"):
    frame = spark.createDataFrame([(question,)], "query string")
    return classify(frame, columns, view=view).first()["generated_code"]


@pytest.mark.parametrize(
    "question, columns, text",
    [
        ("harga tertinggi", ["harga"], "SELECT max(`harga`) FROM t"),
        ("harga terendah", ["harga"], "SELECT min(`harga`) FROM t"),
        ("total harga", ["harga"], "SELECT sum(`harga`) FROM t"),
        ("rata harga", ["harga"], "SELECT avg(`harga`) FROM t"),
        ("hitung harga", ["harga"], "SELECT count(`harga`) FROM t"),
        ("hitung baris", ["harga"], "SELECT count(*) FROM t"),
        ("total baris", ["harga"], "SELECT sum(`harga`) FROM t"),
        (
            "siapa dengan harga tertinggi", ["harga"],
            "SELECT * FROM t WHERE `harga` IS NOT NULL ORDER BY `harga` DESC LIMIT 1",
        ),
        (
            "yang mana harga terendah", ["harga", "nama", "umur"],
            "SELECT `nama`, `umur` FROM t WHERE `harga` IS NOT NULL ORDER BY `harga` ASC LIMIT 1",
        ),
        ("siapa total harga", ["harga", "nama", "umur"], "SELECT sum(`harga`) FROM t"),
        ("cari harga", ["harga"], "SELECT * FROM t WHERE `harga` > :value"),
        ("urut harga", ["harga"], "SELECT * FROM t ORDER BY `harga` ASC NULLS LAST"),
        (
            "grup harga", ["harga"],
            "SELECT `harga`, :func FROM t WHERE `harga` IS NOT NULL GROUP BY `harga`",
        ),
        ("max", ["", "a", "b`c"], "SELECT max(`a`) AS `a`, max(`b``c`) AS `b``c` FROM t"),
        ("siapa max", ["", "nama", "umur"],
         "SELECT max(`nama`) AS `nama`, max(`umur`) AS `umur` FROM t"),
        ("max", [""], "SELECT max(:columns) FROM t"),
        ("hitung baris", [""], "SELECT count(*) FROM t"),
        ("cari", [""], "SELECT * FROM t WHERE `column` > :value"),
        ("urut", [""], "SELECT * FROM t ORDER BY `column` ASC NULLS LAST"),
        ("grup", [""],
         "SELECT `column`, :func FROM t WHERE `column` IS NOT NULL GROUP BY `column`"),
    ],
)
def test_texts(spark, question, columns, text):
    assert code(spark, question, columns) == text
    frame = spark.createDataFrame([(question, columns)], "query string, columns array<string>")
    assert classify(frame, F.col("columns")).first()["generated_code"] == text


@pytest.mark.parametrize(
    "question",
    [
        "gaji tertinggi", "umur minimum", "total gaji", "rata umur", "hitung nama",
        "hitung baris", "siapa gaji terbesar", "urutkan umur",
    ],
)
def test_text_runs_and_equals_ask(spark, staff, question):
    staff.createOrReplaceTempView("staff_view")
    text = code(spark, question, staff.columns, "staff_view")
    ours = [tuple(r) for r in ask(staff, question).collect()]
    assert [tuple(r) for r in spark.sql(text).collect()] == ours


def test_filter_text_takes_a_parameter(spark, staff):
    staff.createOrReplaceTempView("staff_view")
    text = code(spark, "cari umur", staff.columns, "staff_view")
    assert spark.sql(text, args={"value": 30}).count() == 2


def test_group_text_takes_an_expression(spark, staff):
    staff.createOrReplaceTempView("staff_view")
    text = code(spark, "grup departemen", staff.columns, "staff_view")
    rows = spark.sql(text.replace(":func", "count(*)")).collect()
    assert sorted(map(tuple, rows)) == [("Finance", 1), ("HR", 1), ("IT", 3)]

"""Question, feedback and other tables that Spark derives from the given ones.

All are whole-table projections: every event is one question, and every event
is one feedback event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import array, string, strings_type

# (question, expected operation). Some phrases are meant to go wrong: a trigger
# word hides in a longer word or a column name, or no word fits.
PHRASES = (
    ("tunjukkan harga tertinggi bulan ini", "MAX"),
    ("puncak l_quantity sepanjang tahun", "MAX"),
    ("siapa pembeli dengan harga terbesar", "MAX"),
    ("nama kapal paling tua", "MAX"),
    ("harga terendah dari semua pesanan", "MIN"),
    ("siapa pemasok dengan l_quantity terkecil", "MIN"),
    ("nilai l_discount paling kecil", "MIN"),
    ("tanggal kirim terendah", "MIN"),
    ("total harga seluruh pesanan", "SUM"),
    ("akumulasi l_quantity sampai hari ini", "SUM"),
    ("jumlahkan pajak l_tax", "SUM"),
    ("TOTAL PAJAK L_TAX", "SUM"),
    ("total l_returnflag", "SUM"),
    ("rata-rata harga tiap transaksi", "MEAN"),
    ("mean l_quantity untuk gudang", "MEAN"),
    ("harga rata minggu lalu", "MEAN"),
    ("hitung baris pesanan", "COUNT"),
    ("berapa banyak tanggal kirim", "COUNT"),
    ("banyaknya catatan gudang", "COUNT"),
    ("urutkan menurut tanggal", "SORT"),
    ("susun daftar harga", "SORT"),
    ("sorting l_tax naik", "SORT"),
    ("kelompokkan per l_returnflag", "GROUP"),
    ("grup pesanan per l_linestatus", "GROUP"),
    ("bagi data menurut l_returnflag", "GROUP"),
    ("cari pesanan di atas harga 100", "FILTER"),
    ("tampilkan barang yang nilainya besar", "FILTER"),
    ("ambil pesanan mahal saja", "FILTER"),
)

# Column lists that questions may bring along, blank and missing ones included.
COLUMN_LISTS = (
    ("nama", "harga", "l_quantity", "tanggal"),
    ("o_orderdate", "o_totalprice", "l_tax"),
    ("page_id", "Nama", "Umur", "name"),
    (),
    ("kota", ""),
    ("",),
    ("umur", "salary`x", "L_Returnflag"),
)

FEEDBACK_WORDS = ("correct", "Good", "incorrect", "ACCURATE")
CORRECT_OPERATIONS = (
    None, "MAX", "MIN", "SUM", "MEAN", "COUNT", "FILTER", "SORT", "GROUP", "MEDIAN", "",
)

LINEITEM_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, number: Column) -> Column:
    options = ", ".join("NULL" if v is None else string(v) for v in values)
    return F.get(F.expr(f"array({options})"), (number % len(values)).cast("int"))


def as_questions(events: DataFrame) -> DataFrame:
    """id, ts, user_id, query, expected: one question per event."""
    number = F.col("event_id")
    phrase = pick(tuple(p for p, _ in PHRASES), number)
    return events.select(
        number.alias("id"),
        "ts",
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws(" ", phrase, F.lit("pengguna"), F.col("user_id")).alias("query"),
        pick(tuple(o for _, o in PHRASES), number).alias("expected"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_questions(table(spark, sf_dir, "events"))


def questions_with_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ", ".join(strings_type(array(c)) for c in COLUMN_LISTS)
    place = f"CAST(id % {len(COLUMN_LISTS)} AS int)"
    return questions(spark, sf_dir).selectExpr("*", f"get(array({lists}), {place}) AS columns")


def as_feedback(events: DataFrame) -> DataFrame:
    """Two events per question; events of type error name an unknown question."""
    number = F.col("event_id")
    return events.select(
        F.when(F.col("event_type") == "error", -1 - number)
        .otherwise(F.floor(number / 2))
        .cast("bigint")
        .alias("query_id"),
        number.alias("seq"),
        "ts",
        pick(FEEDBACK_WORDS, number).alias("feedback"),
        pick(CORRECT_OPERATIONS, number).alias("correct_operation"),
        F.col("props").alias("comments"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_feedback(table(spark, sf_dir, "events"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing values: NULL in every 7th, NaN in every 11th."""
    number = F.col("event_id")
    value = (
        F.when(number % 7 == 0, F.lit(None))
        .when(number % 11 == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
    )
    kind = F.when(number % 5 > 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", kind.alias("jenis"), value.alias("nilai")
    )

"""Labelled questions: from commented CSV files, and a built-in seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sqltext import values
from ..functions.vocab import OPERATIONS
from . import schemas

SEED = {
    "MAX": (
        "suhu maksimum bulan juni", "skor tertinggi di kelas",
        "tagihan terbesar tahun lalu", "puncak pemakaian listrik",
    ),
    "MIN": (
        "suhu minimum bulan juni", "skor terendah di kelas",
        "tagihan terkecil tahun lalu", "batas bawah pemakaian listrik",
    ),
    "SUM": (
        "total tagihan pelanggan", "akumulasi hujan setahun",
        "jumlahkan seluruh biaya", "sum pemakaian listrik",
    ),
    "MEAN": (
        "rata-rata skor kelas", "rerata suhu harian",
        "nilai tengah tagihan", "average pemakaian listrik",
    ),
    "COUNT": (
        "hitung pelanggan aktif", "berapa banyak kelas",
        "jumlah pelanggan di kota", "count tagihan terbuka",
    ),
    "FILTER": (
        "cari pelanggan dari Medan", "tagihan dimana biaya di atas 50",
        "ambil kelas dengan skor bagus", "saring pelanggan lama",
    ),
    "SORT": (
        "urutkan kelas menurut skor", "susun tagihan dari awal",
        "order by biaya", "sort pelanggan menaik",
    ),
    "GROUP": (
        "kelompokkan pelanggan per kota", "grup tagihan per bulan",
        "group by kelas", "bagi pelanggan per kategori",
    ),
}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """CSV without header: query, operation_id, operation_name; # comments."""
    return (
        spark.read.schema(schemas.LABELLED_CORPUS)
        .option("comment", "#")
        .csv(path)
    )


def seed_corpus(spark: SparkSession) -> DataFrame:
    """Four labelled questions per operation, so that a model knows all labels."""
    rows = [
        (question, OPERATIONS.index(operation), operation)
        for operation, questions in SEED.items()
        for question in questions
    ]
    return spark.sql(values(rows, schemas.LABELLED_CORPUS))

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tanyalah.functions.columns import person_columns
from tanyalah.functions.vocab import (
    CONFIDENCE,
    OPERATIONS,
    TRIGGER_WORDS,
    Vocabulary,
    shortest_words,
)
from tanyalah.operators.classify import (
    classify,
    classify_column,
    classify_operation,
    intent_catalog,
)


def ask_all(spark, questions, columns=None, **options):
    frame = spark.createDataFrame([(q,) for q in questions], "query string")
    return classify(frame, columns, **options).collect()


STAFF_QUESTIONS = [
    ("berapa gaji tertinggi?", "MAX", 0.95, "gaji"),
    ("siapa yang umurnya paling muda?", "MIN", 0.95, "umur"),
    ("jumlah total gaji semua karyawan", "SUM", 0.9, "gaji"),
    ("rata-rata umur karyawan", "MEAN", 0.95, "umur"),
    ("hitung berapa banyak karyawan", "COUNT", 0.9, "nama"),
    ("cari karyawan dari departemen IT", "FILTER", 0.9, "departemen"),
    ("urutkan berdasarkan umur", "SORT", 0.95, "umur"),
    ("kelompokkan berdasarkan departemen", "GROUP", 0.9, "departemen"),
]


def test_staff_questions(spark, staff):
    rows = ask_all(spark, [q for q, *_ in STAFF_QUESTIONS], staff.columns)
    got = [(r["query"], r["operation"], r["confidence"], r["detected_column"]) for r in rows]
    assert got == STAFF_QUESTIONS


def test_smoke_questions(spark):
    columns = ["nama", "harga", "gaji", "tanggal", "kategori"]
    rows = ask_all(
        spark,
        [
            "berapa harga tertinggi di data ini?",
            "cari rata-rata gaji karyawan",
            "urutkan data berdasarkan tanggal",
            "jumlah total penjualan bulan ini",
        ],
        columns,
    )
    assert [(r["operation"], r["detected_column"]) for r in rows] == [
        ("MAX", "harga"), ("MEAN", "gaji"), ("SORT", "tanggal"), ("SUM", "nama"),
    ]


@pytest.mark.parametrize(
    "question, operation, confidence",
    [
        ("yang paling besar nilainya", "FILTER", 0.9),
        ("yang paling kecil nilainya", "FILTER", 0.9),
        ("sum dari semua nilai", "FILTER", 0.5),
        ("tambahkan semua nilai", "FILTER", 0.5),
        ("nilai tengah dari data", "FILTER", 0.5),
        ("count total record", "SUM", 0.9),
        ("jumlah karyawan", "FILTER", 0.5),
        ("total jumlah baris data", "SUM", 0.9),
        ("sorting data dari terkecil", "MIN", 0.95),
        ("sort ascending atau descending", "FILTER", 0.5),
        ("grup data menurut jenis", "SORT", 0.95),
        ("klasifikasi data per kategori", "FILTER", 0.5),
        # Matches inside longer words and inside column names.
        ("harga rata minggu lalu", "MIN", 0.95),
        ("nilai l_discount", "COUNT", 0.9),
        ("nilai o_totalprice", "SUM", 0.9),
        # "yang " needs its blank.
        ("barang yang", "FILTER", 0.5),
        ("barang yang mahal", "FILTER", 0.9),
        ("", "FILTER", 0.5),
        ("HARGA TERTINGGI", "MAX", 0.95),
    ],
)
def test_known_traps(spark, question, operation, confidence):
    (row,) = ask_all(spark, [question])
    assert (row["operation"], row["confidence"]) == (operation, confidence)
    assert row["by_rule"] == (confidence != 0.5)


def test_random_questions_take_the_first_matching_class(spark):
    chance = random.Random(7)
    words = [w for ws in TRIGGER_WORDS.values() for w in ws]
    filler = ["data", "Nilai ", "x", "ini'", "\\", "%", "É", "yang", "JUMLAH"]
    questions = [
        "".join(chance.choices([*words, *filler, " ", " "], k=chance.randint(0, 5)))
        for _ in range(2000)
    ]
    for row in ask_all(spark, questions):
        lowered = row["query"].lower()
        hits = [o for o, ws in TRIGGER_WORDS.items() if any(w in lowered for w in ws)]
        expected = (hits[0], CONFIDENCE[hits[0]]) if hits else ("FILTER", 0.5)
        assert (row["operation"], row["confidence"]) == expected, row["query"]


def test_dropped_words_change_nothing():
    for words in TRIGGER_WORDS.values():
        kept = shortest_words(words)
        assert all(any(k in w for k in kept) for w in words)


def test_a_question_for_a_person_always_meets_a_rule():
    """Every phrase that could decide "who is ..." is itself a trigger word."""
    decisive = {
        "MAX": ("paling tua", "paling tinggi", "tertinggi", "terbesar"),
        "MIN": ("paling muda", "terendah", "terkecil"),
    }
    for operation, phrases in decisive.items():
        assert set(phrases) <= set(TRIGGER_WORDS[operation])


def test_row_and_row_count_flags(spark):
    rows = ask_all(spark, ["SIAPA tertua", "yang mana", "hitung Baris", "harga"])
    assert [(r["wants_row"], r["wants_row_count"]) for r in rows] == [
        (True, False), (True, False), (False, True), (False, False),
    ]


def test_null_question_gets_the_default(spark):
    frame = spark.createDataFrame([(None,)], "query string")
    row = classify(frame, ["a"]).first()
    assert (row["operation"], row["confidence"], row["detected_column"]) == ("FILTER", 0.5, "a")


COLUMN_CASES = [
    ("total Harga", ["nama", "HARGA"], "HARGA"),
    ("total harga", ["nama", "unit_price"], "unit_price"),
    ("nama dan harga", ["zz", "cost", "name"], "cost"),  # order of the terms
    ("umur", ["kota", "page_id"], "page_id"),  # "age" inside "page_id"
    ("gaji", ["kota", "x"], "kota"),
    ("gaji dan tanggal", ["kota", "due_date"], "due_date"),  # falls to the next term
    ("apa saja", ["kota", ""], ""),  # a blank name is in every question
    ("kota apa", ["kota", ""], "kota"),
    ("apa saja", ["", "kota"], ""),
    ("apa saja", [], "column1"),
    ("apa saja", None, "column1"),
    ("isi it's", ["x", "it's"], "it's"),
    ("isi a`b", ["x", "a`b"], "a`b"),
    ("isi a\\b", ["x", "a\\b"], "a\\b"),
]


def test_columns_per_question(spark):
    frame = spark.createDataFrame(
        [(i, q, c) for i, (q, c, _) in enumerate(COLUMN_CASES)],
        "id int, query string, columns array<string>",
    )
    rows = classify_column(frame, F.col("columns")).orderBy("id").collect()
    assert [r["detected_column"] for r in rows] == [want for *_, want in COLUMN_CASES]


@pytest.mark.parametrize("question, columns, want", COLUMN_CASES)
def test_one_column_list_gives_the_same(spark, question, columns, want):
    frame = spark.createDataFrame([(question,)], "query string")
    assert classify_column(frame, columns).first()["detected_column"] == want


def test_person_columns():
    assert person_columns(["nama", "umur"]) == ("nama", "umur")
    assert person_columns(["umur", "x", "Name", "nama"]) == ("Name", "umur")
    assert person_columns(["nama", "name", "AGE", "umur"]) == ("name", "AGE")
    assert person_columns(["nama", "x"]) is None
    assert person_columns([]) is None


def test_person_columns_per_question(spark):
    lists = [
        ["x", "nama", "umur"], ["umur", "x", "Name", "nama"],
        ["nama", "name", "AGE", "umur"], ["nama", "x"], ["x"],
    ]
    frame = spark.createDataFrame(
        [(i, "siapa tertua x", c) for i, c in enumerate(lists)],
        "id int, query string, columns array<string>",
    )
    rows = classify(frame, F.col("columns")).orderBy("id").collect()
    for row, columns in zip(rows, lists):
        pair = person_columns(columns)
        fields = ", ".join(f"`{c}`" for c in pair) if pair else "*"
        assert row["generated_code"].startswith(f"SELECT {fields} FROM t"), row
        (same,) = ask_all(spark, ["siapa tertua x"], columns)
        assert same["generated_code"] == row["generated_code"]


def test_own_words(spark):
    own = Vocabulary().with_words("MAX", "Paling besar").with_synonym("biaya", "fee")
    (row,) = ask_all(spark, ["biaya paling besar"], ["kota", "fee_idr"], vocabulary=own)
    assert (row["operation"], row["detected_column"]) == ("MAX", "fee_idr")
    with pytest.raises(ValueError):
        Vocabulary().with_words("MEDIAN", "tengah")
    with pytest.raises(ValueError):
        Vocabulary().with_words("MAX", "")


@pytest.mark.parametrize("n_words", [60, 79, 80, 81, 5000])
def test_vocabularies_of_any_size(spark, n_words):
    """Random questions against a plain search, with that many trigger words and a hundred columns."""
    rng = random.Random(n_words)
    taken = sum(map(len, TRIGGER_WORDS.values()))
    vocabulary = Vocabulary()
    words = [f"kata{i}z'" for i in range(n_words - taken)]
    for place, operation in enumerate(vocabulary.priority):
        vocabulary = vocabulary.with_words(operation, *words[place::8])
    assert sum(map(len, vocabulary.trigger_words.values())) == n_words
    columns = [f"kolom{i}z" for i in range(100)] + ["harga", "Nama"]
    said = [*words, *columns, *vocabulary.synonyms, *(w for ws in TRIGGER_WORDS.values() for w in ws), "kata", "apa", "Z"]
    questions = [" ".join(rng.choices(said, k=rng.randrange(4))) for _ in range(300)] + ["", None]

    def operation(text):
        lowered = (text or "").lower()
        return next((o for o, ws in vocabulary.trigger_words.items() if any(w in lowered for w in ws)), "FILTER")

    def column(text):
        lowered = (text or "").lower()
        named = [c for c in columns if text is not None and c.lower() in lowered]
        for term, parts in vocabulary.synonyms.items():
            if text is not None and term in lowered:
                named += [c for c in columns if any(p in c.lower() for p in parts)][:1]
        return (named or columns)[0]

    rows = ask_all(spark, questions, columns, vocabulary=vocabulary)
    assert Counter((r["query"], r["operation"], r["detected_column"]) for r in rows) == Counter((q, operation(q), column(q)) for q in questions)


def test_catalog(spark):
    rows = intent_catalog(spark).collect()
    assert [r["operation"] for r in rows[::3]] == list(OPERATIONS)
    by_name = {r["operation"]: r for r in rows}
    assert by_name["MEAN"]["operation_id"] == 3 and by_name["MEAN"]["priority"] == 3
    assert by_name["SUM"]["operation_id"] == 2 and by_name["SUM"]["priority"] == 4
    # The examples are examples of their operation.
    frame = spark.createDataFrame(rows).select(
        F.col("example").alias("query"), F.col("operation").alias("expected")
    )
    assert classify_operation(frame).filter("operation <> expected").count() == 0


def test_whole_texts_are_searched(spark):
    text = "kata " * 20000 + "tertinggi"
    (row,) = ask_all(spark, [text])
    assert row["operation"] == "MAX"

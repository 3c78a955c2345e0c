"""Words the engine knows: operations, trigger words, column synonyms."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Results depend on every entry, so change them only on purpose.
# ---------------------------------------------------------------------------

# The position of a name is its operation id.
OPERATIONS = ("MAX", "MIN", "SUM", "MEAN", "COUNT", "FILTER", "SORT", "GROUP")

# Trigger words by operation, in the order in which the operations are tried.
# They match anywhere inside the question, also inside longer words; "yang "
# ends in a blank.
TRIGGER_WORDS = {
    "MAX": (
        "max", "maks", "maksimum", "terbesar", "tertinggi", "paling tinggi",
        "nilai tertinggi", "puncak", "teratas", "paling tua", "tertua",
    ),
    "MIN": (
        "min", "minimum", "terkecil", "terendah", "paling rendah",
        "nilai terendah", "bawah", "paling muda", "termuda",
    ),
    "MEAN": ("rata", "rerata", "average", "mean"),
    "SUM": ("total", "penjumlahan", "akumulasi", "totalkan", "menjumlah"),
    "COUNT": ("hitung", "berapa banyak", "jumlah baris", "banyaknya", "count"),
    "SORT": ("urut", "sorting", "susun", "order by", "diurutkan"),
    "GROUP": ("kelompok", "group", "grup", "per grup", "kelompokan"),
    "FILTER": ("cari", "yang ", "dimana", "where", "filter"),
}

CONFIDENCE = {
    "MAX": 0.95, "MIN": 0.95, "MEAN": 0.95, "SUM": 0.9,
    "COUNT": 0.9, "SORT": 0.95, "GROUP": 0.9, "FILTER": 0.9,
}

DEFAULT_OPERATION = "FILTER"
DEFAULT_CONFIDENCE = 0.5

# A term in the question stands for the first column whose name contains one
# of the listed parts. Terms are tried in this order.
COLUMN_SYNONYMS = {
    "harga": ("price", "harga", "cost"),
    "nama": ("name", "nama", "title"),
    "umur": ("age", "umur", "usia"),
    "gaji": ("salary", "gaji", "income"),
    "tanggal": ("date", "tanggal", "waktu"),
}

ROW_WORDS = ("siapa", "yang mana")
ROW_COUNT_WORD = "baris"
NAME_COLUMNS = ("nama", "name")
AGE_COLUMNS = ("umur", "age")
FALLBACK_COLUMNS = ("column1", "column2", "column3")
PLACEHOLDER_COLUMN = "column"
POSITIVE_FEEDBACK = ("correct", "good", "accurate")
TRAINING_SOURCE = "user_feedback"

# Verified rows needed before retraining: by default, when feedback arrives,
# on request, and in a scenario replay.
RETRAIN_DEFAULT = 50
RETRAIN_ONLINE = 20
RETRAIN_MANUAL = 10
RETRAIN_REPLAY = 5

# ---------------------------------------------------------------------------

DESCRIPTIONS = {
    "MAX": "Largest value of a column",
    "MIN": "Smallest value of a column",
    "SUM": "Sum over a column",
    "MEAN": "Average over a column",
    "COUNT": "Number of values or rows",
    "FILTER": "Rows above a given value",
    "SORT": "Rows in ascending order of a column",
    "GROUP": "Aggregates per value of a column",
}

EXAMPLES = {
    "MAX": ("biaya kirim tertinggi", "suhu maksimum hari ini", "skor terbesar siswa"),
    "MIN": ("biaya kirim terendah", "suhu minimum malam ini", "skor terkecil siswa"),
    "SUM": ("total biaya kirim", "akumulasi curah hujan", "penjumlahan semua tagihan"),
    "MEAN": ("rata-rata biaya kirim", "rerata suhu harian", "average skor siswa"),
    "COUNT": ("hitung semua tagihan", "berapa banyak siswa", "jumlah baris tabel ini"),
    "FILTER": ("cari siswa dari Bandung", "tagihan dimana biaya besar", "filter suhu panas"),
    "SORT": ("urutkan siswa menurut skor", "susun tagihan", "order by biaya"),
    "GROUP": ("kelompokkan siswa per kota", "grup tagihan per bulan", "group by kota"),
}


def shortest_words(words: tuple[str, ...]) -> tuple[str, ...]:
    """Leave out every word that contains another one: it can add no match."""
    return tuple(
        w for w in words if not any(other != w and other in w for other in words)
    )


@dataclass(frozen=True)
class Vocabulary:
    """Trigger words and synonyms; ``with_words`` adds a user's own."""

    trigger_words: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(TRIGGER_WORDS)
    )
    synonyms: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(COLUMN_SYNONYMS)
    )

    @property
    def priority(self) -> tuple[str, ...]:
        return tuple(self.trigger_words)

    def with_words(self, operation: str, *words: str) -> Vocabulary:
        if operation not in OPERATIONS:
            raise ValueError(f"unknown operation {operation!r}")
        if not all(words):
            raise ValueError("a trigger word must not be empty")
        extended = dict(self.trigger_words)
        extended[operation] += tuple(w.lower() for w in words)
        return replace(self, trigger_words=extended)

    def with_synonym(self, term: str, *parts: str) -> Vocabulary:
        extended = dict(self.synonyms)
        extended[term.lower()] = extended.get(term.lower(), ()) + tuple(
            p.lower() for p in parts
        )
        return replace(self, synonyms=extended)


DEFAULT_VOCABULARY = Vocabulary()

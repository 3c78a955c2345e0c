"""From raw documents to encoded training text in five stages, each over all that the one before it kept.

STAGES are functions of (spark, docs, sf_dir); what a stage returns is written
as Parquet and read again as the next one's `docs`. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanyalah.llm import bagminhash, line_dedup, mixing, quality_rules, sentencepiece_trie
from tanyalah.llm.components import written
from tanyalah.llm.queries import VOCABULARY_FILE, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learned from the labels, keep."""
    rules = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules, carry=docs.columns).where("kept").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    return line_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return bagminhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them; those taken twice are there twice."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with whether they decode to it (a mark in a text becomes a space)."""
    vocabulary = sentencepiece_trie.read_vocabulary(VOCABULARY_FILE)
    rows = sentencepiece_trie.encode_and_decode(docs, vocabulary, ["doc_id", "lang", "source"])
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_trie.MARK, " ")
    return rows.select("row.*", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

# The learned rules and the model's segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

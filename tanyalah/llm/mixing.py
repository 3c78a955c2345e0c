"""Mixing sources to target weights by systematic sampling.

All rows of a source have the same expected number of copies, its target over
its size, so the prefix sum of a row is that ratio times its rank. Ranks are
found without gathering a source in one task: rows are cut into blocks of
(source, size class, salt), the salt a hash of id and text whose length follows
from the number of rows; a block's rows are ranked in a window, and the counts
of the blocks before it are added. So null ids and an id held by many rows
spread; only rows equal in id and text share a block. Ordering by size spreads long and
short texts evenly over the copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tanyalah.sources.scratch import fresh_folder

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
BLOCK_ROWS = 1 << 18


def word_count(text):
    """Number of words of a text column, 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANKS))).cast("long")


def _hex(column, n: int):
    return F.conv(F.substring(F.md5(column), 1, n), 16, 10).cast("long")


def salt_digits(rows: int) -> int:
    """Hexadecimal digits of the salt: two, and more where a source of all rows would have blocks above BLOCK_ROWS."""
    digits = 2
    while BLOCK_ROWS * 16**digits < rows:
        digits += 1
    return digits


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of sources from a table (source, source_size): one row per source.

    Weights repeat over the sources by code point, null last. A target stops at
    `most` times the size; what is over goes to the others by weight, until
    none is above: the common level per weight is found by prefix sums over
    the sources in the order in which they fill up. The windows see one row
    per source, in one task, so the sources are meant to be kinds of origin:
    up to about a million of them, not one per site or per row.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("_weight", weight.cast("long"))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_fill", F.col("_cap") / F.col("_weight"))
        .withColumn("_place", F.row_number().over(by_fill))
        .withColumn("_left", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.sum("_weight").over(after))
    )
    full = F.col("_level") > F.col("_fill")
    level = F.min_by("_level", F.when(~full, F.col("_place"))).over(Window.partitionBy())
    target = F.least(F.coalesce(level, F.col("_fill")) * F.col("_weight"), F.col("_cap").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    carry: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """Copies that a mix takes of every row of `docs` (doc_id, text, source).

    Columns: doc_id, size, source_size, target, copies, taken, and those of
    `carry` under their own names in a struct `row`. A null text or one
    without words has size 0; it takes part and gives no words. A null source
    is a source of its own and comes last. Repeated rows are separate rows.
    Equal (size, doc_id, text) ranks in any order, as such rows give the same.
    Runs agree. An empty table gives an empty result. Other columns are ignored.
    """
    spark, nothing = docs.sparkSession, F.lit("")
    narrow = docs.select(
        "doc_id",
        "source",
        word_count(docs["text"]).alias("size"),
        F.xxhash64("text").alias("_text"),
        _hex(F.concat(F.coalesce(docs["doc_id"].cast("string"), nothing), F.lit("/"), F.coalesce(docs["text"], nothing)), salt_digits(docs.count())).alias("_salt"),
        F.coalesce(docs["source"], F.lit("")).alias("_name"),
        docs["source"].isNull().alias("_none"),
        *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []),
    ).withColumn("_class", F.length(F.bin("size")))
    block = ["_name", "_none", "_class", "_salt"]
    folder = fresh_folder(spark, "mix")
    narrow.groupBy(*block).agg(F.first("source").alias("source"), F.count("*").alias("_n"), F.sum("size").alias("_words")).write.parquet(folder)
    counts = spark.read.parquet(folder)
    sizes = counts.groupBy("_name", "_none").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none"), "source_size", "target")
    earlier = Window.partitionBy("_name", "_none").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(targets, ["_name", "_none"])
        .select(*block, "_before", "source_size", "target")
    )
    within = Window.partitionBy(*block).orderBy("size", "doc_id", "_text")
    ranked = narrow.withColumn("_rank", F.row_number().over(within)).join(offsets, block)
    rank = F.col("_before") + F.col("_rank")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _hex(F.concat(F.col("_name"), F.lit(seed)), 8) / F.lit(4294967296.0)
    copies = F.floor(rank * F.col("_ratio") + F.col("_start")) - F.floor((rank - 1) * F.col("_ratio") + F.col("_start"))
    done = ranked.withColumn("_ratio", ratio).withColumn("_start", start).withColumn("copies", copies)
    return done.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as the mix takes them, each as often as it is taken; same columns."""
    taken = mix_sources(docs, carry=docs.columns, **options).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")

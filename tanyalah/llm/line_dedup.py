"""Line dedup across documents: first occurrences by range-partitioned, sorted hashes; bitmaps out.

Keys of lines are dealt by ranges of (hash, chunk of documents) and sorted by
document and position; each stream of a key passes its first document on and
drops the rest. What a chunk kept, at most one document each, meets the other
chunks of its key in a second pass of the same form. Lines already decided ride
along under keys of their own, so a line held by a third of all documents
never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanyalah.llm.mixing import BLANK_CHARS

LEAST_CHARS = 10
CHUNKS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without outer blanks, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK_CHARS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("_doc"), F.xxhash64("text").alias("_text")]


def drop_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, chunks: int = CHUNKS) -> DataFrame:
    """Bitmaps of the lines that go: _doc, _text, bits, 64 lines to a whole number.

    A document that loses no line has no row, which is the bitmap of all lines.
    """
    every = docs.select(*_identity(docs), lines_of(docs["text"]).alias("_lines"))
    keyed = (
        every.select("_doc", "_text", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.char_length("_key") >= least_chars)
        .select("_doc", "_text", "_n", "_pos", F.xxhash64("_key").alias("_hash"), F.hash("_key").alias("_more"))
        .withColumn("_chunk", F.pmod(F.xxhash64("_doc"), F.lit(chunks)).cast("int"))
    )

    def first_document(frame: DataFrame, part: str) -> Column:
        stream = Window.partitionBy("_hash", "_more", part).orderBy("_doc", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.first("_doc").over(stream)

    ranged = keyed.repartitionByRange("_hash", "_more", "_chunk")
    once = ranged.withColumn("_gone", F.col("_doc") != first_document(ranged, "_chunk"))
    once = once.withColumn("_part", F.when(F.col("_gone"), F.col("_chunk") + 1).otherwise(F.lit(0)))
    twice = once.withColumn("_gone", F.col("_gone") | (F.col("_doc") != first_document(once, "_part"))).where("_gone")
    sparse = (
        twice.groupBy("_doc", "_text", (F.col("_pos") / 64).cast("int").alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_bits"), F.max("_n").alias("_n"))
        .groupBy("_doc", "_text")
        .agg(F.collect_list(F.struct("_word", "_bits")).alias("_some"), F.max("_n").alias("_n"))
    )
    blank = F.expr("transform(sequence(0, cast((_n - 1) / 64 as int)), w -> struct(w as _word, 0L as _bits))")
    dense = (
        sparse.select("_doc", "_text", F.inline(F.concat("_some", blank)))
        .groupBy("_doc", "_text", "_word")
        .agg(F.bit_or("_bits").alias("_bits"))
        .groupBy("_doc", "_text")
        .agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_all"))
    )
    return dense.select("_doc", "_text", F.col("_all._bits").alias("bits"))


def kept_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Per row of `docs`: row (a struct of its columns), bits (null: every line stays), kept (text without the lines that go), n_lines, n_dropped.

    A line goes if its key of at least `least_chars` code points is found in
    two or more documents and this is not the smallest doc_id that holds it.
    Rows of one doc_id are one document; a null doc_id comes last. A null or
    empty text is one empty line. Equal rows lose the same lines. Other columns
    are carried, whatever their names. An empty table stays empty.
    """
    bitmaps = drop_bitmaps(docs, least_chars)
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_identity(docs))
    joined = left.join(bitmaps, ["_doc", "_text"], "left").select("row", "bits", lines_of(F.col("row.text")).alias("split"))
    stay = F.expr("array_join(filter(split, (line, i) -> (shiftright(bits[cast(i / 64 as int)], i % 64) & 1L) = 0L), '\n')")
    dropped = F.coalesce(F.expr("aggregate(bits, 0L, (a, b) -> a + bit_count(b))"), F.lit(0).cast("long"))
    return joined.select(
        "row",
        "bits",
        F.when(F.col("bits").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(stay).alias("kept"),
        F.size("split").cast("long").alias("n_lines"),
        dropped.alias("n_dropped"),
    )


def with_kept_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """`docs` with _bits, _kept, _n_lines and _n_dropped, as `kept_lines` gives them; for columns of other names."""
    names = {"bits": "_bits", "kept": "_kept", "n_lines": "_n_lines", "n_dropped": "_n_dropped"}
    return kept_lines(docs, least_chars).select("row.*", *[F.col(c).alias(name) for c, name in names.items()])


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """`docs` with the same columns and without the lines that go; a null text stays null, n_chars follows.

    Columns of any name are carried; all else is as in `kept_lines`.
    """
    text = F.when(F.col("row.text").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept"))
    changed = {"text": text, "n_chars": F.char_length(text)}
    columns = [changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns]
    return kept_lines(docs, least_chars).select(*columns)

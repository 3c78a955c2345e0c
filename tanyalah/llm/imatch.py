"""I-Match fingerprints: rare terms of a document, hashed over randomised lexicon subsets.

The document frequency of every term, counted over distinct texts by its 64-bit
hash, decides which terms lie in the chosen band of inverse document frequency.
Terms above the band are few whatever the corpus holds (a text's terms over the
share of texts), so they can be part of the plan, as sets that are built once a
task. Terms below it are in one text only and are sent to that text. What an
edit cuts into terms of neither text is looked up. A text of fewer than `FILL`
terms in the band is filled up to that many with the rarest of its terms above
the band, so that a large family of near copies keeps the terms it shares.

A document's terms are sorted and cut into subsets of the lexicon: 8 each of
eight densities (1/8, 1/32, ... 1/131072 of the lexicon), so short and long
documents both have subsets of few terms, also those of 100,000 terms in the
band. The hash of a subset's sorted terms is one cell of the fingerprint; two
documents are alike by the share of their non-empty cells that agree.
"""

from __future__ import annotations

import json
import math
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanyalah.llm.components import written

MOST_SHARE = 0.02
LEAST_MOST = 2
FILL = 64
CELLS, SCALES = 8, 8
BUCKET_BYTES = 64 << 20
QUANTILES = 1000
MOST_LISTED = 100_000
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_ID = (1 << 63) - 1


class Lexicon(NamedTuple):
    """Terms (_term, _lo, _hi: least and greatest hash of their texts), those above the band by doublings of frequency, and the bytes of all texts."""

    terms: DataFrame
    above: list[list[int]]
    bytes: int

    def below(self, name: str) -> Column:
        """The terms of a list that are not above the band."""
        common = [t for tier in self.above for t in tier]
        return F.expr(f"filter({name}, h -> h not in ({_numbers(common)}))") if common else F.col(name)

    def rarest(self, name: str) -> Column:
        """The `FILL` rarest of the terms of a list that are above the band: by doublings of frequency, then by hash."""
        tiers = [F.sort_array(F.expr(f"filter({name}, h -> h in ({_numbers(tier)}))")) for tier in self.above]
        return F.slice(F.concat(*tiers), 1, FILL) if tiers else F.array().cast("array<bigint>")


def _numbers(values: list[int]) -> str:
    return ", ".join(f"{v}L" for v in values)


def term_hashes(text: Column) -> Column:
    """Distinct hashes of a text's terms: lower-case runs without ASCII space or punctuation."""
    terms = F.filter(F.split(F.lower(text), BREAKS), lambda w: w != "")
    return F.array_distinct(F.transform(terms, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, most_share: float = MOST_SHARE) -> Lexicon:
    """Terms of all texts of `docs`; above the band are those in more than `most_share` of the distinct texts.

    Copies of a text count once. Only terms of that many rows can be above, so
    only theirs are counted again over distinct texts: as a list in the plan,
    which keeps the shuffle to one row a text, or, if copies make more than
    `MOST_LISTED` of them, by a join. What reaches the driver otherwise are the
    terms above the band: at most a text's mean number of terms over
    `most_share`.
    """
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.xxhash64(text).alias("_text"), term_hashes(text).alias("_terms"))
    pairs = each.select("_text", F.explode("_terms").alias("_term"))
    terms = written(pairs.groupBy("_term").agg(F.count("*").alias("_rows"), F.min("_text").alias("_lo"), F.max("_text").alias("_hi")), "terms")
    copies = docs.select(F.xxhash64(text).alias("_text"), F.octet_length(text).alias("_size")).groupBy("_text").agg(F.count("*").alias("_n"), F.sum("_size").alias("_size"))
    rows, texts, size = copies.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    most = max(LEAST_MOST, int(most_share * texts))
    often = terms.where(F.col("_rows") > most).select("_term", F.col("_rows").alias("_n"))
    if rows > texts:
        maybe = often.select("_term").limit(MOST_LISTED + 1).collect()
        if len(maybe) > MOST_LISTED:
            once = pairs.join(often.select("_term"), "_term").distinct()
        else:
            hits = F.expr(f"filter(_terms, h -> h in ({_numbers([row['_term'] for row in maybe] or [0])}))")
            once = each.select("_text", hits.alias("_hits")).groupBy("_text").agg(F.any_value("_hits").alias("_hits")).select(F.explode("_hits").alias("_term"))
        often = once.groupBy("_term").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    doublings = lambda row: int(row["_n"] / most).bit_length()
    found = sorted(often.collect(), key=lambda row: (doublings(row), row["_term"]))
    return Lexicon(terms, [[row["_term"] for row in tier] for _, tier in groupby(found, doublings)], size)


def _bind(value: Column, use) -> Column:
    """`use` of a value that is made once: a one-element array gives it a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cells(terms: Column) -> Column:
    """Fingerprint cells of a list of distinct terms, 0 where empty."""

    def own(kept: Column, scale: int) -> Column:
        def cell(k: Column) -> Column:
            mine = F.filter(kept, lambda h: F.shiftrightunsigned(h, 3 * scale).bitwiseAND(F.lit(CELLS - 1)) == k)
            return _bind(mine, lambda m: F.when(F.size(m) > 0, F.xxhash64(m)).otherwise(F.lit(0)))

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long")), cell)

    def scales(kept: Column, scale: int) -> Column:
        if scale == SCALES - 1:
            return own(kept, scale)
        thinner = F.filter(kept, lambda h: F.shiftrightunsigned(h, 48 + 2 * scale).bitwiseAND(F.lit(3)) == 0)
        return F.concat(own(kept, scale), _bind(thinner, lambda x: scales(x, scale + 1)))

    return _bind(F.sort_array(terms), lambda x: scales(x, 0))


def filled(own: Column, rarest: Column) -> Column:
    """Terms in the band, filled up to `FILL` with the rarest above it."""
    return F.when(F.size(own) < FILL, F.concat(own, F.slice(rarest, F.lit(1), FILL - F.size(own)))).otherwise(own)


def sharing(terms: Column, others: Column) -> Column:
    """The terms that are in one cell with any of the others."""

    def meet(h: Column, other: Column, scale: int) -> Column:
        same = F.shiftrightunsigned(h.bitwiseXOR(other), 3 * scale).bitwiseAND(F.lit(CELLS - 1)) == 0
        if scale == SCALES - 1:
            return same
        both_thinner = F.shiftrightunsigned(h.bitwiseOR(other), 48 + 2 * scale).bitwiseAND(F.lit(3)) == 0
        return same | (both_thinner & meet(h, other, scale + 1))

    return F.filter(terms, lambda h: F.exists(others, lambda other: meet(h, other, 0)))


def whole(terms: Column) -> Column:
    return F.xxhash64(F.sort_array(terms))


def closed(banded: Column, all_terms: Column) -> Column:
    """Cells with a last one that holds the hash of all terms where all others are empty."""
    return F.concat(banded, F.array(F.when(F.forall(banded, lambda x: x == 0), all_terms).otherwise(F.lit(0))))


def fingerprint(closed_cells: Column) -> Column:
    return F.array_join(F.transform(closed_cells, lambda x: F.when(x == 0, F.lit("")).otherwise(F.lower(F.hex(x)))), ":")


def likeness(a: Column, b: Column) -> Column:
    """Share of the cells filled in either that agree, 0 to 1."""
    some = F.filter(F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise((x == y).cast("int"))), lambda v: v.isNotNull())
    return F.aggregate(some, F.lit(0.0), lambda t, v: t + v) / F.greatest(F.size(some), F.lit(1))


def _marked(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (text, _once: its terms that are in no other text) with their terms and cells."""
    rows = rows.withColumn("_terms", term_hashes(F.col("text")))
    rows = rows.withColumn("_own", F.array_except(lexicon.below("_terms"), F.coalesce("_once", F.array().cast("array<bigint>"))))
    kept = filled(F.col("_own"), lexicon.rarest("_terms"))
    return rows.withColumn("_cells", closed(cells(kept), whole(F.col("_terms")))).drop("_own")


def _bucket(ids: DataFrame, size: int, quantiles: int) -> Column:
    """Bucket of a row (_id, _tie) for the whole of `ids`, growing with (_id, _tie); about `BUCKET_BYTES` of text each.

    Quantiles of the ids bound steps; a step is cut further by the place of an
    id in it, and an id that fills several steps (null ids, say) by its tie,
    which is a hash. Rows equal in both share a bucket.
    """
    at = [k / quantiles for k in range(1, quantiles)] or [0.5]
    low, high, bounds = ids.agg(F.min("_id"), F.max("_id"), F.percentile_approx("_id", at, 10_000)).first()
    if low is None:
        return F.lit(0).cast("long")
    cuts, start, after, steps = max(1, math.ceil(size / (quantiles * BUCKET_BYTES))), 0, low, []
    for bound, same in groupby([*sorted(bounds), high]):
        ties = len(list(same)) * cuts
        steps.append({"bound": bound, "after": after, "start": start, "ties": ties})
        start, after = start + cuts + ties, bound
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<bound: bigint, after: bigint, start: bigint, ties: bigint>>")
    number = lambda c: c.cast("double")

    def place(step: Column) -> Column:
        inside = F.floor((number(F.col("_id")) - number(step["after"])) / (number(step["bound"]) - number(step["after"])) * cuts)
        tied = F.floor((number(F.col("_tie")) / 2.0**64 + 0.5) * step["ties"])
        at_bound = step["start"] + cuts - 1 + F.least(tied, step["ties"] - 1)
        return F.when(F.col("_id") == step["bound"], at_bound).otherwise(step["start"] + F.least(inside, F.lit(cuts - 1)))

    return _bind(F.get(F.filter(table, lambda step: step["bound"] >= F.col("_id")), F.lit(0)), place)


def with_next(docs: DataFrame, lexicon: Lexicon, quantiles: int | None = None) -> DataFrame:
    """doc_id, text, _once, _terms and _cells, with `next`: a struct of all but doc_id of the next row by doc_id, after the last that of the first.

    Rows are dealt to buckets of (doc_id, hash of the text), sized by the bytes
    of all texts. The window never sees more than a bucket; the first row of
    the following bucket is joined to the last of each. Equal ids follow each
    other by hash of the text, null ids come last. The terms that only one text
    has meet its rows in the same buckets.
    """
    spark = docs.sparkSession
    quantiles = quantiles or min(QUANTILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = _bucket(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id")), lexicon.bytes, quantiles)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_tie")).withColumn("_bucket", bucket)
    once = lexicon.terms.where("_lo = _hi").groupBy(F.col("_lo").alias("_tie")).agg(F.collect_list("_term").alias("_once"))
    places = keyed.select("_bucket", "_id", "_tie").distinct().join(once, "_tie")
    order = Window.partitionBy("_bucket").orderBy("_id", "_tie", "_row")
    mixed = keyed.withColumn("_row", F.lit(1)).unionByName(places.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    before = F.last(F.when(F.col("_row") == 0, F.struct("_id", "_tie", "_once")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    mine = mixed.withColumn("_before", before).where("_row = 1").drop("_once")
    mine = mine.withColumn("_once", F.when((F.col("_before._id") == F.col("_id")) & (F.col("_before._tie") == F.col("_tie")), F.col("_before._once"))).drop("_before")
    row = F.struct("text", "_once", "_terms", "_cells")
    inner = _marked(mine, lexicon)
    order = Window.partitionBy("_bucket").orderBy("_id", "_tie")
    inner = inner.withColumn("_next", F.lead(row).over(order)).withColumn("_last", F.lead("_id").over(order).isNull())

    # First row of each bucket: narrow rows, one for about 64 MB of text.
    firsts = keyed.groupBy("_bucket").agg(F.min(F.struct("_id", "_tie")).alias("_first")).select("_bucket", "_first.*")
    around = Window.orderBy("_bucket")
    firsts = firsts.withColumn("_from", F.coalesce(F.lag("_bucket").over(around), F.max("_bucket").over(Window.partitionBy())))
    rows = keyed.join(F.broadcast(firsts.select("_bucket", "_id", "_tie", "_from")), ["_bucket", "_id", "_tie"])
    rows = rows.select(F.col("_from").alias("_bucket"), "text", "_tie").dropDuplicates(["_bucket"]).join(once, "_tie", "left")
    joined = inner.join(_marked(rows, lexicon).select("_bucket", row.alias("_jump")), "_bucket", "left")
    return joined.select("doc_id", "text", "_once", "_terms", "_cells", F.when(F.col("_last"), F.col("_jump")).otherwise(F.col("_next")).alias("next"))


def fingerprint_and_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts of `docs` (doc_id, text) and of their edited texts.

    The edit replaces the last floor(n/2) code points by the first as many (or
    all) of the next document by doc_id, after the last the first. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null is an empty text; equal texts have equal
    fingerprints and a likeness of 1, also without any term in the band. Null
    ids come last, equal ids in order of a hash. A single row is its own next.
    An empty table gives an empty result; other columns are ignored.
    """
    known = lexicon(docs)
    rows = with_next(docs, known)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.withColumn("_n", n.cast("long")).withColumn("_edited", edited).withColumn("_e", term_hashes(F.col("_edited")))
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_below", known.below("_e"))
    rows = rows.withColumn("_new", F.array_except("_below", F.concat("_terms", F.col("next._terms"))))
    rows = rows.withColumn("_own", F.array_except("_below", F.concat(F.coalesce("_once", none), F.coalesce("next._once", none), "_new")))
    # Of the new terms it is not yet known which are in the band. Until then the cells are those without any, beside
    # the terms of the cells that may change: all of a text that is filled up.
    short = F.size("_own") < FILL
    rows = rows.withColumn("_rarest", F.when(short, F.slice(known.rarest("_e"), F.lit(1), FILL - F.size("_own"))).otherwise(none))
    rows = rows.select(
        "doc_id",
        F.col("_n").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        "_cells",
        likeness(F.col("_cells"), F.col("next._cells")).alias("near_next"),
        "_new",
        cells(F.concat("_own", "_rarest")).alias("_sure"),
        F.when(short, F.col("_own")).otherwise(sharing(F.col("_own"), F.col("_new"))).alias("_own"),
        "_rarest",
        whole(F.col("_e")).alias("_whole"),
    )
    rows = written(rows, "edits")
    asked = rows.select("edited_sha256", F.explode("_new").alias("_term")).distinct()
    there = asked.join(known.terms.where("_lo < _hi").select("_term"), "_term").groupBy("edited_sha256").agg(F.collect_list("_term").alias("_there"))
    rows = rows.drop("_new").join(there, "edited_sha256", "left")
    again = cells(filled(F.concat("_own", "_there"), F.col("_rarest")))
    changed = F.transform(F.arrays_zip("_sure", again.alias("again"), cells(F.col("_there")).alias("there")), lambda c: F.when(c["there"] == 0, c["_sure"]).otherwise(c["again"]))
    edited_cells = F.when(F.col("_there").isNull(), F.col("_sure")).when(F.size("_rarest") > 0, again).otherwise(changed)
    rows = rows.withColumn("_edited_cells", closed(edited_cells, F.col("_whole")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("_cells")).alias("fingerprint"),
        fingerprint(F.col("_edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("_cells"), F.col("_edited_cells")).alias("near_edited"),
        "near_next",
    )

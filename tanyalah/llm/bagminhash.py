"""Near-duplicates by BagMinHash signatures, bands and an exact check of multiset overlap.

A document is the multiset of its five-word shingles. For every shingle, the
integer weights are cut into the intervals [0,1), [1,2), [2,4), [4,8) ... and
each interval is a Poisson process of points with a rate of its length, a
register and a level inside the interval, all from a hash. A document takes
the points whose level is below its count; the first of each register is its
signature. Two registers agree with a probability of exactly the weighted
Jaccard similarity. Points come in order of time, so those after the time at
which all registers are filled are never made.

Equal texts are one class. Classes that share a band meet in a bucket. A bucket
never lists its pairs: one text of each, the one that meets most others in all
its buckets, is held against the rest, which joins a group of copies to its
source. A bucket of one component is finished, and so is one of two texts.
The texts of the others meet anew, by their rarest shingles: two texts that
are similar enough share one of the first shingles of both, in the order of
rarity among those texts, at a place that leaves enough for both behind it.
So texts that share a passage, or heavy edits of one source, hardly meet. There
the number of leaders grows from wave to wave, first the text with the most
links, and each is held against those of other components that have not led,
until every text left has led once. So each pair of different components
that can be similar has been compared, and no link between components is lost.
A pair is compared by signatures first: at a
similarity of 0.8 fewer than 60 % of 180 registers agree once in 10^10 pairs.
What is left is checked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanyalah.llm.components import components, written
from tanyalah.llm.words import blocks, mix, shingles_of, words_of

SIMILARITY = 0.8
MARGIN = 0.2
BANDS, ROWS = 30, 6
LEADERS = 4
NO_ID = 1 << 62
BITS = 1 << 26
# Bytes of text hashed at a time; what a worker holds is about 60 times that.
BLOCK = 1 << 19
_TIME, _PLACE, _DOC = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xA24BAED4963EE407)


def _points(seed: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps of rate 1 and place hashes of the points first .. first + n - 1 of each process."""
    steps = np.arange(first, first + n, dtype=np.uint64)
    each = mix(seed[:, None] + steps * _TIME)
    uniform = ((each >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(uniform), mix(each ^ _PLACE)


def _fill(doc, seed, low, width, count, until, n_docs, registers) -> tuple[np.ndarray, np.ndarray]:
    """Signatures from all points before each document's time limit, and which registers are filled."""
    now, taken = np.zeros(len(doc)), []
    first, n = 1, 1
    while len(doc):
        gaps, place = _points(seed, first, n)
        times = now[:, None] + np.cumsum(gaps / width[:, None], axis=1)
        level = low[:, None] + ((place >> np.uint64(24)) & (width[:, None].astype(np.uint64) - np.uint64(1)))
        row, col = np.nonzero((times < until[doc][:, None]) & (level < count[:, None]))
        at = doc[row] * registers + ((place[row, col] >> np.uint64(40)) % np.uint64(registers)).astype(np.int64)
        taken.append((times[row, col], at, mix(place[row, col] ^ _DOC)))
        more = times[:, -1] < until[doc]
        doc, seed, low, width, count, now = doc[more], seed[more], low[more], width[more], count[more], times[more, -1]
        first, n = first + n, min(4 * n, 256)
    signature, filled = np.zeros(n_docs * registers, np.uint64), np.zeros(n_docs * registers, bool)
    if taken:
        time, at, value = (np.concatenate(x) for x in zip(*taken))
        order = np.argsort(-time, kind="stable")
        signature[at[order]] = value[order]
        filled[at] = True
    return signature.reshape(n_docs, registers), filled.reshape(n_docs, registers)


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Registers of every document from its distinct elements and their counts; documents without any get zeros."""
    deepest = int(np.max(count, initial=1))
    parts = []
    for k in range(1 + max(0, math.ceil(math.log2(deepest)))):
        low, width = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        inside = np.flatnonzero(count > low)
        parts.append((doc[inside], mix(element[inside] ^ mix(np.full(1, k, np.uint64))), np.full(len(inside), low, np.uint64), np.full(len(inside), float(width)), count[inside].astype(np.uint64)))
    doc_, seed, low, width, count_ = (np.concatenate(x) for x in zip(*parts))
    total = np.bincount(doc, weights=count, minlength=n_docs)
    until = np.divide(registers * (math.log(registers) + 3), total, out=np.zeros(n_docs), where=total > 0)
    out = np.zeros((n_docs, registers), np.uint64)
    todo = total > 0
    while todo.any():
        mine = todo[doc_]
        signature, filled = _fill(doc_[mine], seed[mine], low[mine], width[mine], count_[mine], until, n_docs, registers)
        done = todo & filled.all(axis=1)
        out[done] = signature[done]
        todo &= ~done
        until = until * 2
    return out


def counted(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a block and their counts: text, shingle, count."""
    hashes, at = shingles_of(words)
    doc = words.doc[at]
    _, index, count = np.unique(mix(hashes ^ mix(doc.astype(np.uint64) + _DOC)), return_index=True, return_counts=True)
    return doc[index], hashes[index], count


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * _TIME + signature[:, r::rows][:, :bands] + np.uint64(r))
    return mix(keys ^ (np.arange(bands, dtype=np.uint64) * _PLACE)).view(np.int64)


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in blocks(batch.column(1), BLOCK):
                doc, element, count = counted(words_of(buf, offsets))
                n = hi - lo
                signature = signatures(doc, element, count, n, bands * rows)
                keys = band_keys(signature, bands, rows)
                registers = pa.array((signature & np.uint64(0x7FFF)).astype(np.int16).ravel())
                every = pa.array(np.arange(n + 1, dtype=np.int32) * (bands * rows))
                some = np.bincount(doc, minlength=n) > 0
                at = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), lists, pa.ListArray.from_arrays(every, registers), pa.array(np.bincount(doc, weights=count, minlength=n).astype(np.int64))], names=["_doc", "_digest", "_bands", "_sig", "_size"])

    return run


def _bits(documents: DataFrame) -> np.ndarray:
    """A table of BITS bits with those of the given ids set, 8 MB whatever their number.

    It spares most texts of other ids the way to the next join; where ids fill
    it, more texts take that way, and the join decides all the same.
    """
    place = F.pmod(F.xxhash64("_doc"), F.lit(BITS))
    marked = documents.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    table = np.zeros((BITS // 32768 + 1, 4096), np.uint8)
    for bucket, bits in marked.collect():
        table[bucket] = np.frombuffer(bits, np.uint8)
    return table


def _occurrences(box):
    """Shingles as sets, of the texts whose bit is set: the k-th occurrence of a shingle is an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = box.value
        for batch in batches:
            bucket, bit = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            batch = batch.filter(pa.array((table[bucket, bit >> 3] >> (bit & 7) & 1).astype(bool)))
            for lo, hi, buf, offsets in blocks(batch.column(1), BLOCK):
                words = words_of(buf, offsets)
                hashes, at = shingles_of(words)
                doc = words.doc[at]
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                begins = np.flatnonzero(new)
                turn = np.arange(len(hashes)) - begins[np.cumsum(new) - 1] if len(hashes) else np.zeros(0, np.int64)
                values = mix(hashes + turn.astype(np.uint64) * _TIME).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["_doc", "_digest", "_set"])

    return run


def _linked(pairs: DataFrame, signed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose multisets overlap enough."""
    left = signed.select(F.col("_rep").alias("a"), F.col("_sig").alias("_ga"))
    right = signed.select(F.col("_rep").alias("b"), F.col("_sig").alias("_gb"))
    same = F.expr("aggregate(zip_with(_ga, _gb, (x, y) -> if(x = y, 1, 0)), 0, (t, v) -> t + v)")
    near = written(pairs.join(left, "a").join(right, "b").where(same >= (similarity - MARGIN) * F.size("_ga")).select("a", "b").distinct(), "near")
    left = sets.select(F.col("_rep").alias("a"), F.col("_set").alias("_sa"))
    right = sets.select(F.col("_rep").alias("b"), F.col("_set").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    close = both >= similarity * (F.size("_sa") + F.size("_sb") - both)
    return near.join(left, "a").join(right, "b").where(close).select("a", "b")


def _prefixes(reps: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Buckets by the rarest shingles of the texts (_rep, _size): _key, _rep, _size, _shared.

    Any text similar enough to another one shares a shingle with it that stands so early in both, sorted by how
    many of the texts hold it, that what follows can still overlap enough: _shared is the number from there on.
    Shingles of one text alone come first and are no key.
    """
    held = sets.join(reps, "_rep").select("_rep", "_size", F.explode("_set").alias("_key"))
    common = held.groupBy("_key").agg(F.count("*").alias("_df")).where("_df > 1")
    listed = held.join(common, "_key").groupBy("_rep", "_size").agg(F.sort_array(F.collect_list(F.struct("_df", "_key"))).alias("_of"))
    each = listed.select("_rep", "_size", F.size("_of").alias("_most"), F.posexplode("_of").alias("_at", "_it"))
    shared = (F.col("_most") - F.col("_at")).cast("long")
    early = written(each.select(F.col("_it._key").alias("_key"), "_rep", "_size", shared.alias("_shared")).where(F.col("_shared") >= similarity * F.col("_size") - 1e-6), "early")
    # The shortest partner that a bucket has to offer asks for the least.
    least = early.groupBy("_key").agg(F.min("_size").alias("_short"), F.count("*").alias("_texts")).where("_texts > 1")
    partner = F.greatest(F.col("_short"), similarity * F.col("_size"))
    return early.join(least, "_key").where(F.col("_shared") >= similarity / (1 + similarity) * (F.col("_size") + partner) - 1e-6).select(*early.columns)


def _id(digest):
    """The doc_id, or for a null one of the text, above all real ones."""
    return F.coalesce("doc_id", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") + F.lit(NO_ID))


def _open(state: DataFrame) -> DataFrame:
    """The buckets in which two texts of different components have not been compared, with the text of the most links that has not led."""
    heads = state.groupBy("_key").agg(
        F.min("_comp").alias("_lo"),
        F.max("_comp").alias("_hi"),
        F.count_if(~F.col("_led")).alias("_to_lead"),
        F.count("*").alias("_n"),
        F.max_by("_rep", F.struct(~F.col("_led"), "_links", "_rep")).alias("_hub"),
    )
    return state.join(heads.where("_lo < _hi and _to_lead > 1").select("_key", "_n", "_hub"), "_key")


def _meetings(members: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the members and the leaders of each bucket that can overlap enough."""
    # No more than what both have left from the shared key on can overlap.
    most = F.least("_shared", "_most")
    fits = most >= similarity * (F.col("_size") + F.col("_long") - most)
    met = members.join(leaders, "_key").where((F.col("_comp") != F.col("_other")) & fits)
    return met.select(F.least("_rep", "_head").alias("a"), F.greatest("_rep", "_head").alias("b")).distinct()


def _as_leaders(rows: DataFrame) -> DataFrame:
    return rows.select("_key", F.col("_rep").alias("_head"), F.col("_comp").alias("_other"), F.col("_size").alias("_long"), F.col("_shared").alias("_most"))


def _waves(bucket: DataFrame, signed: DataFrame, sets: DataFrame, similarity: float, leaders: int) -> DataFrame:
    """Components of the texts in buckets (_key, _rep, _size, _first): node, component.

    _first marks the text that leads in the first wave.
    """
    first = bucket.select("_key", "_rep", "_size", F.col("_size").alias("_shared"), F.col("_rep").alias("_comp"), F.col("_first").alias("_led"))
    pairs = _meetings(first.where("not _led"), _as_leaders(first.where("_led")), similarity)
    edges = written(_linked(pairs, signed, sets, similarity), "links")
    left = _open(_with_components(first, edges, components(edges)))
    state = written(_prefixes(left.select("_rep", "_size").distinct(), sets, similarity), "prefixes").withColumn("_led", F.lit(False))
    wave = leaders
    while True:
        labels = components(edges)
        left = written(_open(_with_components(state, edges, labels)), "open")
        biggest = left.agg(F.max("_n")).first()[0]
        if biggest is None:
            return labels
        luck = F.pmod(F.xxhash64("_rep"), F.lit(1 << 52)) / float(1 << 52) * F.col("_n")
        leads = (luck < wave) | (F.col("_rep") == F.col("_hub"))
        waiting = left.where("not _led")
        pairs = _meetings(waiting, _as_leaders(waiting.where(leads)), similarity)
        edges = edges.union(written(_linked(pairs, signed, sets, similarity), "links"))
        if wave >= biggest:
            return components(edges)
        # A bucket is the same in all waves, but fewer are left; whether a text has led is kept by row.
        state = left.select("_key", "_rep", "_size", "_shared", (F.col("_led") | leads).alias("_led"))
        wave = 4 * wave


def _with_components(state: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets with the component and the number of links of their texts."""
    links = edges.select(F.explode(F.array("a", "b")).alias("_rep")).groupBy("_rep").agg(F.count("*").alias("_links"))
    known = labels.select(F.col("node").alias("_rep"), F.col("component").alias("_of"))
    named = state.join(known, "_rep", "left").join(links, "_rep", "left")
    return named.select("_key", "_rep", "_size", "_shared", "_led", F.coalesce("_of", "_rep").alias("_comp"), F.coalesce("_links", F.lit(0)).alias("_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, leaders: int = LEADERS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_class, class_id, n_copies.

    text_class is the least doc_id with the same text, n_copies their number,
    class_id the least doc_id of the connected component of texts with a
    weighted Jaccard similarity of five-word shingles of `similarity` or more.
    Texts below five words are alike only when equal; a null is an empty text.
    Rows of one doc_id are one document, so its texts are linked; rows with a
    null doc_id are documents by their text and come after all others, their
    ids stay null. Repeated rows are copies. An empty table gives an empty
    result; other columns are ignored. 30 bands of 6 registers miss 1 of
    9,000 pairs at 0.8.
    """
    classes = _classified(docs, similarity, bands, rows, leaders)
    names = {"_doc": "doc_id", "_rep": "text_class", "_class": "class_id"}
    return classes.select(*[F.when(F.col(c) < NO_ID, F.col(c)).alias(name) for c, name in names.items()], F.col("_copies").alias("n_copies"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with the document of the least doc_id of every class, one row of it; same columns.

    Of rows of one doc_id with different texts that of the least text hash
    stays, of rows that differ in other columns only the first in their order.
    A null doc_id is as in `near_duplicates`. Columns of any name are carried;
    an empty table stays empty.
    """
    classes = _classified(docs, similarity, BANDS, ROWS, LEADERS)
    keep = classes.where("_doc = _class").groupBy("_doc").agg(F.min("_digest").alias("_digest"))
    digest = F.md5(F.coalesce("text", F.lit("")))
    # The caller's columns travel in one struct, so their names cannot clash.
    named = docs.select(_id(digest).alias("_doc"), digest.alias("_digest"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    others = F.xxhash64(F.to_json(F.struct(*[F.col("_row")[c] for c in docs.columns if c != "text"])))
    first = named.join(keep, ["_doc", "_digest"], "left_semi").groupBy("_doc", "_digest").agg(F.min_by("_row", others).alias("_row"))
    return first.select("_row.*")


def _classified(docs: DataFrame, similarity: float, bands: int, rows: int, leaders: int) -> DataFrame:
    """_doc, _digest, _rep (least of the same text), _class (least of the component), _copies for each row."""
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(_id(F.md5(text)).alias("_doc"), text.alias("_text"), F.md5(text).alias("_digest"))
    sketch = written(plain.select("_doc", "_text", "_digest").mapInArrow(_sketch(bands, rows), "_doc long, _digest string, _bands array<long>, _sig array<short>, _size long"), "sketch")
    classes = written(sketch.groupBy("_digest").agg(F.min("_doc").alias("_rep"), F.count("*").alias("_copies")), "classes")
    least = classes.select(F.col("_rep").alias("_doc"), "_digest")
    # One row per text: repeated rows have equal bands.
    texts = sketch.select("_doc", "_digest", "_size", "_bands").join(least, ["_doc", "_digest"], "left_semi").groupBy("_doc", "_digest").agg(F.first("_size").alias("_size"), F.first("_bands").alias("_bands"))
    member = texts.select(F.col("_doc").alias("_rep"), "_size", F.explode("_bands").alias("_key"))
    size = member.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = written(member.join(size, "_key").select("_key", "_rep", "_n", "_size"), "buckets")
    # The text that meets most others leads first: the source of edited copies is nearer to them than they to each other.
    meets = shared.groupBy("_rep").agg(F.sum("_n").alias("_meets"))
    heads = shared.join(meets, "_rep").groupBy("_key").agg(F.max_by("_rep", F.struct("_meets", -F.col("_rep"))).alias("_head"))
    bucket = shared.join(heads, "_key").select("_key", "_rep", "_size", (F.col("_rep") == F.col("_head")).alias("_first"))
    involved = written(least.join(shared.select(F.col("_rep").alias("_doc")).distinct(), "_doc", "left_semi"), "involved")
    place = F.pmod(F.xxhash64("_doc"), F.lit(BITS))
    box = docs.sparkSession.sparkContext.broadcast(_bits(involved))
    hashed = plain.select("_doc", "_text", "_digest", F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")).mapInArrow(_occurrences(box), "_doc long, _digest string, _set array<long>")
    sets = hashed.join(involved, ["_doc", "_digest"], "left_semi").groupBy("_doc", "_digest").agg(F.first("_set").alias("_set"))
    sets = written(sets.select(F.col("_doc").alias("_rep"), "_set"), "sets")
    signed = sketch.select("_doc", "_digest", "_sig").join(involved, ["_doc", "_digest"], "left_semi").groupBy("_doc", "_digest").agg(F.first("_sig").alias("_sig")).select(F.col("_doc").alias("_rep"), "_sig")
    labels = _waves(written(bucket, "bucket"), written(signed, "signed"), sets, similarity, leaders)
    of_text = classes.join(labels.select(F.col("node").alias("_rep"), "component"), "_rep", "left")
    of_text = of_text.select("_digest", "_rep", F.coalesce("component", "_rep").alias("_class"), "_copies")
    return sketch.select("_doc", "_digest").join(of_text, "_digest")

"""Scoring by prediction by partial matching (PPM) over a byte-context trie, and by single words.

The trie of the training texts has one node for each context of up to ORDER
bytes; a node's counts give P(byte | context) with escape probability
T / (N + T) for T distinct bytes seen N times (method C). An escape leaves the
bytes of the longer context out of the counts of the shorter one (symbol
exclusion), so the probabilities of all continuations, the end included,
sum to one. The model is pretrained, so all of that is known per node: a node
keeps its own totals and those of its parent without its bytes, and scoring a
byte is one look-up of (context, byte), and one more per escape. Nodes are keyed by
the exact bytes in one 64-bit number.

The trie holds all training texts and is never in one place. Its top, the orders up to
SHARED, has at most 2^24 entries and is sent to the tasks. The subtrees below it
are dealt to buckets by the SHARED + 1 bytes before the byte, so a bucket has
whole subtrees and scores its bytes alone. Texts are cut into blocks; a block
asks each bucket for its distinct (context, byte) once, gets their
probabilities back, and sums them per text. Counts of words are asked for in the
same way. A bucket that many blocks ask is split by block, with a copy of
its subtrees for each part.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanyalah.llm.components import written
from tanyalah.llm.words import LOWER, blocks, words_of

ORDER = 5
SHARED = 2
FOLDS, HELD_OUT = 7, 2
WORD, GRAM = 0, 1
SCAN_CORES = "spark.sql.leafNodeDefaultParallelism"
BUCKET_KEYS, CELL_KEYS = 200_000, 4_000_000
SPREAD = 1_000_003
FLUSH = 500_000
# A block of texts that asks together, and what is worked on at a time.
BLOCK_BYTES, PART_BYTES = 1 << 22, 1 << 19
# Bytes that UTF-8 never has: before a text, and its end.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 255


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def padded(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text with `order` start bytes and an end byte; offsets of the padded texts."""
    n = len(offsets) - 1
    size = np.diff(offsets) + order + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], BEFORE, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(n) * (order + 1) + order, np.diff(offsets))] = buf
    out[at[1:] - 1] = END
    return out, at


def grams(stream: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of the texts and each end: the `order` bytes before it and itself as one number."""
    n = len(stream) - order
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(order + 1):
        key = (key << np.uint64(8)) | stream[k : k + n].astype(np.uint64)
    keep = np.ones(max(n, 0), bool)
    inner = offsets[1:-1]
    for k in range(order):
        keep[inner - order + k] = False
    return key[keep]


def _first_of_each(ordered: np.ndarray) -> np.ndarray:
    """Whether a cell of a sorted array differs from the one before it."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def distinct_keys(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct keys of all parts, sorted. One sort in place; `np.unique` hashes first, which takes longer."""
    ordered = np.concatenate([np.zeros(0, np.uint64), *parts])
    ordered.sort()
    return ordered[_first_of_each(ordered)]


class _Sums:
    """Counts by key that are merged now and then."""

    def __init__(self):
        self.keys, self.counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.pending = 0

    def add(self, keys: np.ndarray) -> None:
        unique, count = np.unique(keys, return_counts=True)
        self.keys.append(unique)
        self.counts.append(count)
        self.pending += len(unique)
        if self.pending > FLUSH:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        # Each part is sorted; a stable sort merges such runs.
        keys = np.concatenate(self.keys)
        turn = np.argsort(keys, kind="stable")
        keys = keys[turn]
        first = np.flatnonzero(_first_of_each(keys))
        keys, counts = keys[first], np.add.reduceat(np.concatenate(self.counts)[turn], first) if len(first) else np.zeros(0, np.int64)
        self.keys, self.counts, self.pending = [keys], [counts], 0
        return keys, counts


def _gather(order: int):
    """Counts of words (kind 0) and of contexts with their next byte (kind 1) in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (_Sums(), _Sums())

        def flush(kind: int):
            keys, counts = sums[kind].merge()
            sums[kind].__init__()
            step = 200_000
            for i in range(0, len(keys), step):
                part = slice(i, i + step)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(counts[part])], names=["kind", "key", "n"])

        for batch in batches:
            for _, _, buf, offsets in blocks(batch.column(0), PART_BYTES):
                sums[0].add(words_of(LOWER[buf], offsets).hash)
                sums[1].add(grams(*padded(buf, offsets, order), order))
                for kind in (0, 1):
                    if len(sums[kind].keys[0]) > FLUSH:
                        yield from flush(kind)
        for kind in (0, 1):
            yield from flush(kind)

    return run


def gather(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts over all texts of `docs`: kind (0 word hash, 1 context and byte), key, n; written once."""
    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_gather(order), "kind int, key long, n long")
    return written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def _ends_with(n: int) -> int:
    """Mask of the last n bytes of a key."""
    return (1 << (8 * n)) - 1


def _level(k: int, table: tuple[np.ndarray, np.ndarray], lower: tuple[np.ndarray, np.ndarray] | None, below: dict | None) -> dict:
    """Nodes of order k from the sorted keys and counts of that order, and of the next lower one."""
    gram, n = table
    context, first, distinct = np.unique(gram >> np.uint64(8), return_index=True, return_counts=True)
    total = np.add.reduceat(n, first) if len(n) else np.zeros(0)
    level = {"log_n": np.log10(n), "total": total, "distinct": distinct.astype(np.float64)}
    if k:
        # What is left of the parent when this node's bytes are excluded.
        at = np.searchsorted(lower[0], gram & np.uint64(_ends_with(k)))
        excluded = np.add.reduceat(lower[1][at], first) if len(n) else np.zeros(0)
        parent = np.searchsorted(below["context"], context & np.uint64(_ends_with(k - 1)))
        rest, kinds = below["total"][parent] - excluded, below["distinct"][parent] - level["distinct"]
        level["rest_den"] = np.log10(np.maximum(rest + kinds, 1))
        level["rest_esc"] = np.where(kinds > 0, np.log10(np.maximum(kinds, 1)) - level["rest_den"], 0.0)
    den = np.log10(total + level["distinct"])
    level["esc"] = np.log10(level["distinct"]) - den
    level["own"] = level["log_n"] - np.repeat(den, distinct)
    level["context"], level["index"], level["context_index"] = context, _Index(gram), _Index(context)
    return level


class Top:
    """The trie's orders up to `shared`, from all keys of the last of them and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shared: int):
        self.tables = _tables(keys, counts, range(shared, -1, -1))
        self.levels: list[dict] = []
        for k, table in enumerate(self.tables):
            self.levels.append(_level(k, table, self.tables[k - 1] if k else None, self.levels[-1] if k else None))


def _tables(keys: np.ndarray, counts: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and counts of the given orders, the least first, from those of the greatest."""
    keys, counts, out = keys.astype(np.uint64), counts.astype(np.float64), []
    for k in orders:
        gram, place = np.unique(keys & np.uint64(_ends_with(k + 1)), return_inverse=True)
        keys, counts = gram, np.bincount(place, weights=counts, minlength=len(gram))
        out.append((keys, counts))
    return out[::-1]


class Trie:
    """Nodes of all orders with their log10 probabilities: a top and some of the subtrees below it."""

    def __init__(self, top: Top, keys: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        shared = len(top.levels) - 1
        tables = top.tables + _tables(keys, counts, range(order, shared, -1))
        self.levels = list(top.levels)
        for k in range(shared + 1, order + 1):
            self.levels.append(_level(k, tables[k], tables[k - 1], self.levels[-1]))

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each number after the bytes before it."""
        place = self.levels[-1]["index"].find(gram)
        out = self.levels[-1]["own"][place] if len(self.levels[-1]["own"]) else np.zeros(len(gram))
        todo = np.flatnonzero(place < 0)
        out[todo] = 0.0
        key = gram[todo]
        above = self._escape(self.order, key, None, out, todo)
        for k in range(self.order - 1, -1, -1):
            if not len(todo):
                return out
            key = key & np.uint64((1 << (8 * (k + 1))) - 1)
            level, longer = self.levels[k], self.levels[k + 1]
            place = level["index"].find(key)
            hit = place >= 0
            new, old = hit & (above < 0), hit & (above >= 0)
            out[todo[new]] += level["own"][place[new]]
            out[todo[old]] += level["log_n"][place[old]] - longer["rest_den"][above[old]]
            todo, key, above = todo[~hit], key[~hit], above[~hit]
            above = self._escape(k, key, above, out, todo)
        # Order -1: every byte that no context has seen is as likely.
        seen = self.levels[0]["distinct"][0] if len(self.levels[0]["distinct"]) else 0
        out[todo] -= math.log10(max(SYMBOLS - seen, 1))
        return out

    def _escape(self, k: int, key: np.ndarray, above: np.ndarray | None, out: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Add the escapes from the contexts of order k; their nodes, -1 where there is none.

        `above` are the nodes of the longer contexts, whose bytes are excluded.
        """
        node = self.levels[k]["context_index"].find(key >> np.uint64(8))
        if above is None:
            above = np.full(len(node), -1)
        new, old = (above < 0) & (node >= 0), above >= 0
        out[todo[new]] += self.levels[k]["esc"][node[new]]
        if old.any():
            out[todo[old]] += self.levels[k + 1]["rest_esc"][above[old]]
        return node


class _Index:
    """Places of 64-bit keys in a sorted array, by an open hash table."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.slot_place = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slot_place[at] < 0
            self.slot_place[at[free]] = left[free]
            lost = self.slot_place[at] != left
            self.slot_key[at[~lost]] = keys[left[~lost]]
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        same = self.slot_key.take(at) == keys
        out = np.where(same, self.slot_place.take(at), -1)
        left = np.flatnonzero(~same)
        at = at[left]
        go = self.slot_place[at] >= 0
        left, at = left[go], at[go]
        while len(left):
            at = (at + 1) & self.mask
            same = self.slot_key[at] == keys[left]
            out[left[same]] = self.slot_place[at[same]]
            go = ~same & (self.slot_place[at] >= 0)
            left, at = left[go], at[go]
        return out


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte place by byte place, compressed, after their length."""
    data = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(data).to_bytes(8, "big") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "big"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, len(raw) // np.dtype(kind).itemsize).T).view(kind).ravel()


def _block_keys(kind: int, buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each word, or for each byte and end, of a block, and how many each text has."""
    if kind == WORD:
        words = words_of(LOWER[buf], offsets)
        return words.hash, np.bincount(words.doc, minlength=len(offsets) - 1)
    return grams(*padded(buf, offsets, order), order), np.diff(offsets) + 1


def _parts_keys(kind: int, buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of a block, some texts at a time, and how many each of these texts has."""
    lo, n, keys, counts = 0, len(offsets) - 1, [], []
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PART_BYTES, side="right")) - 1)
        part, count = _block_keys(kind, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], order)
        keys.append(part)
        counts.append(count)
        lo = hi
    return keys, counts


def _dealt(kind: int, keys: np.ndarray, buckets: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by bucket, and where each bucket begins in it."""
    bucket = keys % np.uint64(buckets) if kind == WORD else ((keys >> np.uint64(8)) & np.uint64(_ends_with(shared + 1))) * np.uint64(SPREAD) % np.uint64(buckets)
    turn = np.argsort(bucket, kind="stable")
    return turn, np.searchsorted(bucket[turn], np.arange(buckets + 1, dtype=np.uint64))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks of texts with a number that is the same whenever the rows are read in the same order."""
    from pyspark import TaskContext

    task, number = TaskContext.get(), 0
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch.column(2), BLOCK_BYTES):
            yield (task.partitionId() << 24) + number if task else number, batch.slice(lo, hi - lo), buf, offsets
            number += 1


def _rows(block: int, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds, bucket, n, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(kinds, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["block", "kind", "bucket", "n_keys", "data"])


def _ask(order: int, shared: int, buckets: tuple[int, int]):
    """The distinct keys that each block asks each bucket for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, buf, offsets in _numbered(batches):
            rows = []
            for kind in (WORD, GRAM):
                keys = distinct_keys(_parts_keys(kind, buf, offsets, order)[0])
                turn, cuts = _dealt(kind, keys, buckets[kind], shared)
                keys = keys[turn]
                rows += [(kind, int(b), int(cuts[b + 1] - cuts[b]), _packed(keys[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts))]
            yield _rows(block, rows)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block, kind -1."""
    for block, batch, buf, offsets in _numbered(batches):
        facts = (batch.column(0).to_pylist(), np.asarray(batch.column(1).to_pylist(), bool), _packed(buf), offsets)
        yield _rows(block, [(-1, 0, 0, pickle.dumps(facts, 5))])


def _answer(top_box, order: int, shared: int):
    """Counts of words, or log10 probabilities of bytes, for the keys that blocks ask a bucket for."""
    top: list[Top] = []

    def run(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        keys = counts["key"].to_numpy(np.int64).view(np.uint64)
        if not len(asked):
            return pd.DataFrame({"block": [], "kind": [], "bucket": [], "data": []})
        if asked["kind"].iloc[0] == WORD:
            index = _Index(keys)
            known = np.append(counts["n"].to_numpy(np.int64), 0)
            find = lambda wanted: known[index.find(wanted)]
        else:
            if not top:
                top.append(Top(*top_box.value, shared))
            trie = Trie(top[0], keys, counts["n"].to_numpy(np.float64), order)
            find = lambda wanted: trie.log10(wanted).astype(np.float32)
        data = [_packed(find(_unpacked(d, np.uint64))) for d in asked["data"]]
        return pd.DataFrame({"block": asked["block"], "kind": asked["kind"], "bucket": asked["bucket"], "data": data})

    return run


def _join(id_kind: str, order: int, shared: int, buckets: tuple[int, int], log_size: float, end: int):
    """Sums per text of a block from its texts and what the buckets answered."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, out, text, offsets = pickle.loads(rows.loc[rows["kind"] < 0, "data"].iloc[0])
        buf, n = _unpacked(text, np.uint8), len(ids)

        def values(kind: int, number: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            parts, counts = _parts_keys(kind, buf, offsets, order)
            unique = distinct_keys(parts)
            turn, _ = _dealt(kind, unique, buckets[kind], shared)
            found, index = np.empty(len(unique)), _Index(unique)
            answers = [_unpacked(d, number) for d in rows[rows["kind"] == kind].sort_values("bucket")["data"]]
            found[turn] = np.concatenate([np.zeros(0, number), *answers])
            lo = 0
            for keys, count in zip(parts, counts):
                yield found.take(index.find(keys)), np.repeat(np.arange(lo, lo + len(count)), count)
                lo += len(count)

        known, tokens = np.full(n, int(end > 0)), np.ones(n, np.int64)
        base, score = np.full(n, math.log10(end + 1.0) - log_size), np.zeros(n)
        for count, doc in values(WORD, np.int64):
            base += np.bincount(doc, weights=np.log10(count + 1.0) - log_size, minlength=n)
            known += np.bincount(doc[count > 0], minlength=n)
            tokens += np.bincount(doc, minlength=n)
        for value, doc in values(GRAM, np.float32):
            score += np.bincount(doc, weights=value, minlength=n)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64") if id_kind == "bigint" else ids, "held_out": out, "n_tokens": tokens, "n_known": known, "base_score": base, "score": score})

    return run


def score_texts(docs: DataFrame, order: int = ORDER, shared: int = SHARED) -> DataFrame:
    """Scores of every whole text of `docs` (doc_id, text), learned from the rows that are not held out.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: see
    the module for both models. A null text is an empty one; it still has its
    end. A null doc_id is hashed as an empty one. Repeated rows count as often
    as they are there. Without training rows every byte is as likely, and
    every word unknown. An empty table gives an empty result; other columns
    are ignored. Blocks are cut twice, so `docs` must give its rows in the same
    order each time, as tables in files do; if not, the sums fail. So that
    executors may come and go in between, the session's
    `spark.sql.leafNodeDefaultParallelism`, by which scans are split, is set to
    the present number of cores where it is unset. Log probabilities of bytes
    travel as 32-bit numbers.
    """
    spark = docs.sparkSession
    if spark.conf.get(SCAN_CORES, None) is None:
        spark.conf.set(SCAN_CORES, spark.sparkContext.defaultParallelism)
    marked = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    training = marked.where("not held_out")
    counts = gather(training, order)
    ends = training.count()
    found = {r["kind"]: (r["n"], r["keys"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()}
    n_words, distinct = found.get(WORD, (0, 0))
    total, distinct = n_words + ends, distinct + (1 if ends else 0)
    buckets = tuple(max(1, math.ceil(found.get(kind, (0, 0))[1] / BUCKET_KEYS)) for kind in (WORD, GRAM))
    # At most 2^24 rows for the default of three bytes.
    top = counts.where(F.col("kind") == GRAM).groupBy(F.col("key").bitwiseAND(F.lit(_ends_with(shared + 1))).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    top_box = spark.sparkContext.broadcast((top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()))

    kinds = "block long, kind int, bucket int, n_keys long, data binary"
    asked = written(marked.mapInArrow(_ask(order, shared, buckets), kinds), "asked")
    cells = asked.groupBy("kind", "bucket").agg(F.ceil(F.sum("n_keys") / CELL_KEYS).cast("int").alias("cells"))
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(_ends_with(shared + 1)))
    bucket = F.when(F.col("kind") == WORD, F.pmod(_unsigned_mod("key", buckets[WORD]), F.lit(buckets[WORD]))).otherwise(F.pmod(context * SPREAD, F.lit(buckets[GRAM])))
    model = counts.withColumn("bucket", bucket.cast("int")).join(cells, ["kind", "bucket"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    asked = asked.join(cells, ["kind", "bucket"]).withColumn("cell", F.pmod(F.xxhash64("block"), F.col("cells")).cast("int")).select("block", "kind", "bucket", "cell", "data")
    model = model.select("kind", "bucket", "cell", "key", "n")
    by = ["kind", "bucket", "cell"]
    answered = asked.groupBy(*by).cogroup(model.groupBy(*by)).applyInPandas(_answer(top_box, order, shared), "block long, kind int, bucket int, data binary")

    id_kind = dict(docs.dtypes)["doc_id"]
    joined = marked.mapInArrow(_texts, kinds).select("block", "kind", "bucket", "data").unionByName(answered).groupBy("block")
    joined = joined.applyInPandas(_join(id_kind, order, shared, buckets, math.log10(total + distinct + 1.0), ends), f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _unsigned_mod(name: str, n: int) -> Column:
    """The 64 bits of a whole number, read without a sign, modulo n."""
    high = F.pmod(F.shiftrightunsigned(name, 1), F.lit(n)) * 2
    return high + F.col(name).bitwiseAND(F.lit(1))

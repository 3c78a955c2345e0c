"""Hard negatives from an inverted multi-index, searched exactly.

Vectors are cut in two halves. Two codebooks, fitted on a bounded sample, give
each half its nearest centre; a pair of centres is a cell, and the index lists
the rows of each cell. An inner product with an anchor is at most the sum of
two half-scores, each the product with the centre plus the length of the
anchor's half times the radius of the centre's members. A heap goes through
the pairs of centres in falling order of that sum, starting at the best of
both and adding the next of either half, and stops as soon as no cell to come
can hold a row that matters. So the search is exact: the index decides how
much is read, never what is found.

All rows are indexed in shards, all anchors are cut in blocks, and every block
meets every shard in a task of its own. One pass finds the first rows of an
anchor's own label, its positives. Their scores fix the windows for negatives,
and a second pass finds the first rows of other labels in each window.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tanyalah.llm.components import written
from tanyalah.llm.vectors import bounded_sample, extent, matrix, stored, usable

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SAMPLE = 4096
BLOCK_BYTES = 32 << 20
CELL_ROWS = 64
MOST_CENTRES = 64
AT_ONCE = 2048
WAITING = 1 << 20
ROUNDS = 12
# Ids of rows without one, above all others.
LAST = (1 << 63) - 1
NOTHING = np.iinfo(np.int64).min


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components scaled and rounded down to whole numbers, as doubles."""
    return np.floor(vectors * scale)


def codebook(points: np.ndarray, centres: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a small sample by Lloyd's rounds, from points spread over it; equal points give fewer."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    at = np.linspace(0, len(points) - 1, min(centres, len(points))).astype(int)
    found = np.unique(points[np.argsort(points @ np.ones(points.shape[1]), kind="stable")[at]], axis=0)
    for _ in range(rounds):
        own = nearest(points, found)
        held = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, points)
        found = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], found)
    return found


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * points @ centres.T, axis=1)


class MultiIndex:
    """The rows of one shard by cell, and what bounds their scores."""

    def __init__(self, rows: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.rows, self.books = rows, books
        self.half = books[0].shape[1]
        halves = (rows[:, : self.half], rows[:, self.half :])
        own = [nearest(h, b) for h, b in zip(halves, books)]
        self.radii = []
        for h, b, mine in zip(halves, books, own):
            far = np.full(len(b), -np.inf)
            np.maximum.at(far, mine, np.sqrt(((h - b[mine]) ** 2).sum(axis=1)))
            self.radii.append(far)
        cell = own[0] * len(books[1]) + own[1]
        self.order = np.argsort(cell, kind="stable")
        self.cells, starts = np.unique(cell[self.order], return_index=True)
        self.starts = np.append(starts, len(rows))
        self.at = {int(c): k for k, c in enumerate(self.cells)}

    def members(self, k: int) -> np.ndarray:
        return self.order[self.starts[k] : self.starts[k + 1]]

    def bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Most that each half of each anchor can score with the members of each centre."""
        out = []
        for part, book, radius in zip((anchors[:, : self.half], anchors[:, self.half :]), self.books, self.radii):
            length = np.sqrt((part * part).sum(axis=1))
            held = radius >= 0
            bound = part @ book.T + length[:, None] * np.where(held, radius, 0)
            # Room for the rounding of the bound itself; scores are exact.
            out.append(np.where(held, bound + 1e-9 * (np.abs(bound) + length[:, None] * (1 + np.abs(book).max())) + 1e-6, -np.inf))
        return out


class Visits:
    """Cells for one anchor, in falling order of the bound of their scores, by a multi-sequence heap."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.orders = [np.argsort(-x, kind="stable").tolist() for x in (first, second)]
        self.bounds = [first[self.orders[0]].tolist(), second[self.orders[1]].tolist()]
        self.heap = [(-(self.bounds[0][0] + self.bounds[1][0]), 0, 0)]

    def best(self) -> float:
        """Bound of the next cell; minus infinity at the end."""
        return -self.heap[0][0] if self.heap else -math.inf

    def next(self) -> tuple[int, int]:
        """The next pair of centres; the one behind it in either sequence joins the heap."""
        _, i, j = heapq.heappop(self.heap)
        a, b = self.bounds
        if j + 1 < len(b) and b[j + 1] > -math.inf:
            heapq.heappush(self.heap, (-(a[i] + b[j + 1]), i, j + 1))
        # Each pair has one way to be reached: along the first column, then along its row.
        if j == 0 and i + 1 < len(a) and a[i + 1] > -math.inf:
            heapq.heappush(self.heap, (-(a[i + 1] + b[0]), i + 1, 0))
        return self.orders[0][i], self.orders[1][j]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held in doubles."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if most < 2**53:
        return (left @ right.T).astype(np.int64)
    if most < 2**62:
        return left.astype(np.int64) @ right.astype(np.int64).T
    raise ArithmeticError("inner products do not fit in 64 bits")


class Best:
    """The first `count` rows of each slot, by falling score and then by id."""

    def __init__(self, slots: int, count: int):
        self.count = count
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        # The least score of a full slot.
        self.least = np.full(slots, NOTHING)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((slot, score, ids))
        self.held += len(slot)
        if self.held >= WAITING:
            self.settle()

    def settle(self) -> None:
        found = [(self.slot, self.score, self.id), *self.waiting]
        slot, score, ids = (np.concatenate(x) for x in zip(*found))
        self.waiting, self.held = [], 0
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        begins = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        few, last = place < self.count, place == self.count - 1
        self.least[slot[last]] = score[last]
        self.slot, self.score, self.id = slot[few], score[few], ids[few]


def search(index: MultiIndex, anchors: np.ndarray, keep: Callable, needed: Callable) -> None:
    """Visit the cells of every anchor until none to come can score what it needs.

    `keep(anchor numbers, row numbers, scores)` takes what is found, `needed()` gives the
    least score that still matters to each anchor. Anchors take turns of 1, 2,
    4 ... cells, and those at the same cell are multiplied together.
    """
    first, second = index.bounds(anchors)
    visits = {k: Visits(first[k], second[k]) for k in range(len(anchors))}
    wide, turn = len(index.books[1]), 1
    while visits:
        least = needed()
        meet: dict[int, list[int]] = {}
        for k in list(visits):
            own, left = visits[k], turn
            while left and own.heap and own.best() >= least[k]:
                i, j = own.next()
                found = index.at.get(i * wide + j)
                if found is not None:
                    meet.setdefault(found, []).append(k)
                    left -= 1
            if left:
                del visits[k]
        for cell, who in meet.items():
            members, who = index.members(cell), np.array(who)
            keep(who, members, products(anchors[who], index.rows[members]))
        turn *= 2


def first_of_own_label(index: MultiIndex, anchors: np.ndarray, labels: np.ndarray, ids: np.ndarray, row_labels: np.ndarray, row_ids: np.ndarray, count: int) -> Best:
    """The first rows of each anchor's label but those of its own id; slots are anchors."""
    best = Best(len(anchors), count)

    def keep(who: np.ndarray, members: np.ndarray, scores: np.ndarray) -> None:
        able = (labels[who, None] == row_labels[members]) & (ids[who, None] != row_ids[members]) & (scores >= best.least[who, None])
        row, col = np.nonzero(able)
        best.add(who[row], scores[row, col], row_ids[members[col]])

    def needed() -> np.ndarray:
        best.settle()
        return np.where(best.least > NOTHING, best.least, -np.inf)

    search(index, anchors, keep, needed)
    return best


def first_in_windows(index: MultiIndex, anchors: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, row_labels: np.ndarray, row_ids: np.ndarray, count: int) -> Best:
    """The first rows of other labels in each window (anchor, number) of scores; slots are anchor * windows + number."""
    windows = low.shape[1]
    best = Best(low.size, count)
    open_ = low <= high

    def keep(who: np.ndarray, members: np.ndarray, scores: np.ndarray) -> None:
        other = labels[who, None] != row_labels[members]
        for w in range(windows):
            slots = who * windows + w
            able = other & (scores <= high[who, w, None]) & (scores >= np.maximum(low[who, w], best.least[slots])[:, None])
            row, col = np.nonzero(able)
            best.add(slots[row], scores[row, col], row_ids[members[col]])

    def needed() -> np.ndarray:
        best.settle()
        return np.where(open_, np.maximum(low, best.least.reshape(low.shape)), np.inf).min(axis=1)

    search(index, anchors, keep, needed)
    return best


def _meet(books: tuple, dims: int, scale: int, find: Callable):
    """What `find` gives for one block of anchors in one shard, the anchors a few at a time."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [pa.table({name: np.zeros(0, np.int64) for name in ("key", "place", "row_id", "score")})]
        if left.num_rows and right.num_rows:
            index = MultiIndex(whole(matrix(right.column("vector"), dims), scale), books)
            kinds = pa.concat_arrays([t.column("label").combine_chunks() for t in (left, right)]).dictionary_encode().indices.to_numpy()
            row_ids = right.column("row_id").to_numpy()
            for lo in range(0, left.num_rows, AT_ONCE):
                part = left.slice(lo, AT_ONCE)
                anchors = whole(matrix(part.column("vector"), dims), scale)
                best, slots = find(index, anchors, part, kinds[lo : lo + len(anchors)], kinds[left.num_rows :], row_ids)
                best.settle()
                keys = part.column("key").to_numpy()
                found.append(pa.table({"key": keys[best.slot // slots], "place": best.slot % slots, "row_id": best.id, "score": best.score}))
        return pa.concat_tables(found)

    return run


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    sample: int = SAMPLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(scale * x), a score is the inner product with
    the anchor. Positives are the first `positives` other rows of the anchor's
    label by falling score, then id; per positive the first `negatives` rows of
    other labels with low * positive <= 100 * score <= high * positive follow.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part. A shorter vector ends in zeros. Rows of the anchor's own id are never
    its partners; else repeated rows count as rows of their own. A null id comes after all others and
    stays null. An empty table, or one without anchors, gives an empty result.
    Columns beside id, label and vector are ignored, whatever their names.
    Scores that could leave 62 bits raise ArithmeticError.

    The codebooks are fitted on at most `sample` rows; every row is indexed,
    and the bounds make the result that of a full comparison. A block of
    anchors and a shard hold about `block_bytes` as doubles, less where there
    would be fewer than two tasks per core.
    """
    kind = label if isinstance(label, Column) else F.col(label)
    plain = rows.select(F.coalesce(F.col(vector_id).cast("long"), F.lit(LAST)).alias("row_id"), kind.alias("label"), F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    able = plain.where(usable("vector") & F.col("label").isNotNull()).withColumn("vector", F.col("vector").cast(stored(plain.schema["vector"].dataType)))
    able = written(able, "rows")
    # The numbers of the anchors are fixed by writing them.
    anchors = written(able.where("anchor").withColumn("key", F.monotonically_increasing_id()).select("key", "row_id", "label", "vector"), "anchors")
    (total, dims), asked = extent(able, "vector"), anchors.count()
    cores = able.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(8 * dims * asked / block_bytes))
    shards = max(1, math.ceil(8 * dims * total / block_bytes), math.ceil(2 * cores / blocks))
    spread = ["row_id", "vector"]
    picked = bounded_sample(able.select(*spread), spread, sample, total).select("vector").toArrow()
    points = whole(matrix(picked.column(0), dims), scale)
    centres = min(MOST_CENTRES, max(2, round(math.sqrt(total / shards / CELL_ROWS))))
    half = dims // 2
    books = (codebook(points[:, :half], centres), codebook(points[:, half:], centres))

    def number(column: Column, count: int) -> Column:
        return F.pmod(column, F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    # Equal rows would share a hash: their place in the table spreads them.
    place = F.xxhash64("row_id", F.monotonically_increasing_id())
    sharded = able.select("row_id", "label", "vector", number(place, shards).alias("shard")).withColumn("block", every(blocks))

    def passed(asking: DataFrame, find: Callable) -> DataFrame:
        dealt = asking.withColumn("block", number(F.xxhash64("key"), blocks)).withColumn("shard", every(shards))
        met = dealt.groupBy("block", "shard").cogroup(sharded.groupBy("block", "shard"))
        return met.applyInArrow(_meet(books, dims, scale, find), "key long, place long, row_id long, score long")

    def own(index, points, left, kinds, row_kinds, row_ids):
        return first_of_own_label(index, points, kinds, left.column("row_id").to_numpy(), row_kinds, row_ids, positives), 1

    def others(index, points, left, kinds, row_kinds, row_ids):
        score = matrix_of_longs(left.column("scores"), positives)
        lowest, highest = -((-low * score) // 100), (high * score) // 100
        # A missing positive has no window.
        missing = score == NOTHING
        lowest[missing], highest[missing] = 1, 0
        return first_in_windows(index, points, kinds, lowest, highest, row_kinds, row_ids, negatives), positives

    order = Window.partitionBy("key").orderBy(F.desc("score"), "row_id")
    partners = passed(anchors, own).withColumn("place", F.row_number().over(order).cast("long") - 1).where(F.col("place") < positives)
    partners = written(partners.select("key", "place", "row_id", "score"), "positives")
    # At most `positives` per anchor; the list is filled up to that number.
    listed = F.sort_array(F.collect_list(F.struct("place", "score")))["score"]
    filled = F.slice(F.concat(listed, F.array_repeat(F.lit(NOTHING), positives)), 1, positives)
    asking = anchors.join(partners.groupBy("key").agg(filled.alias("scores")), "key")
    found = passed(asking, others)
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "row_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = found.select("key", "place", "rank", F.col("row_id").alias("_negative"), F.col("score").alias("negative_score"))
    named = named.join(partners.select("key", "place", F.col("row_id").alias("_positive"), F.col("score").alias("positive_score")), ["key", "place"])
    named = named.join(anchors.select("key", F.col("row_id").alias("_anchor")), "key")
    ids = [F.when(F.col(c) != LAST, F.col(c)).alias(name) for c, name in (("_anchor", "anchor_id"), ("_positive", "positive_id"))]
    return named.select(*ids, "rank", F.when(F.col("_negative") != LAST, F.col("_negative")).alias("negative_id"), "positive_score", "negative_score")


def matrix_of_longs(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)

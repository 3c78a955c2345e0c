"""Embedding near-duplicates by an epsilon grid order join.

A cosine of c or more is a distance of at most e = sqrt(2 - 2 c) between unit
vectors. Those are turned onto their leading principal axes (any orthonormal
axes give right results; good ones part more) and sorted by label and the
numbers of their cells of width e. The sequence is cut into blocks by bytes.
Blocks whose boxes lie more than e apart are never joined. Of the others each
pair is one task, which halves both sequences as long as their boxes or balls
do not settle the matter: intervals provably apart are skipped, intervals
provably within e are linked as a whole, the rest ends in a small product.

A task gives back a row per linked vector at most: its number of links, and
the least vector it is connected with inside this pair of blocks. Pairs never
become rows, so a large group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanyalah.llm.components import components, written
from tanyalah.llm.vectors import NO_ID, bounded_sample, extent, matrix, stored, unit, usable

SIMILARITY = 0.98
AXES = 8
SAMPLE = 4096
BLOCK_BYTES = 4 << 20
LEAF = 256
SLACK = 1e-9


class Intervals:
    """A sequence of unit vectors cut in halves down to leaves, each with its box and ball."""

    def __init__(self, vectors: np.ndarray, turned: np.ndarray):
        self.vectors, self.turned = vectors, turned
        self.known: dict[tuple[int, int], tuple] = {}

    def bounds(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        if (lo, hi) not in self.known:
            part, box = self.vectors[lo:hi], self.turned[lo:hi]
            middle = part.mean(axis=0)
            radius = math.sqrt(((part - middle) ** 2).sum(axis=1).max())
            self.known[lo, hi] = (box.min(axis=0), box.max(axis=0), middle, radius)
        return self.known[lo, hi]


def parted(a: tuple, b: tuple) -> float:
    """Square of the least distance between two boxes."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap)


class Links:
    """Links found between the vectors of one task: their weights, and edges that connect what is linked."""

    def __init__(self, copies: np.ndarray):
        self.copies = copies
        self.count = np.zeros(len(copies), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        """All of `a` are linked with all of `b`; equal ones are one interval joined with itself."""
        if a is b:
            self.count[a] += self.copies[a].sum() - self.copies[a]
        else:
            self.count[a] += self.copies[b].sum()
            self.count[b] += self.copies[a].sum()
        both = np.concatenate([a, b])
        self.edges.append((both, np.full(len(both), both[0])))

    def some(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        if not linked.any():
            return
        self.count[a] += linked @ self.copies[b]
        if a is not b:
            self.count[b] += linked.T @ self.copies[a]
        # Least label inside this small product, so that each vector gives one edge.
        mine, theirs = a.copy(), b.copy()
        none = np.iinfo(np.int64).max
        while True:
            new_mine = np.minimum(mine, np.where(linked, theirs, none).min(axis=1))
            new_theirs = np.minimum(theirs, np.where(linked, new_mine[:, None], none).min(axis=0))
            if (new_mine == mine).all() and (new_theirs == theirs).all():
                break
            mine, theirs = new_mine, new_theirs
        rows, cols = linked.any(axis=1), linked.any(axis=0)
        self.edges += [(a[rows], mine[rows]), (b[cols], theirs[cols])]

    def roots(self) -> np.ndarray:
        """The least place connected with each place."""
        root = np.arange(len(self.copies))
        if self.edges:
            x, y = (np.concatenate(e) for e in zip(*self.edges))
            while True:
                a, b = root[x], root[y]
                apart = a != b
                if not apart.any():
                    break
                low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
        return root


def join_intervals(left: Intervals, right: Intervals, places: tuple[np.ndarray, np.ndarray], links: Links, similarity: float, leaf: int = LEAF) -> None:
    """Join two sequences, or one with itself, by halving them; `places` number their vectors in `links`."""
    reach = math.sqrt(2 - 2 * similarity) + SLACK
    same = left is right
    todo = [(0, len(left.vectors), 0, len(right.vectors))]
    while todo:
        a, b, c, d = todo.pop()
        mine, theirs = left.bounds(a, b), right.bounds(c, d)
        between = math.sqrt(((mine[2] - theirs[2]) ** 2).sum())
        if parted(mine, theirs) > reach * reach or between - mine[3] - theirs[3] > reach:
            continue
        at = places[0][a:b]
        to = at if same and (a, b) == (c, d) else places[1][c:d]
        if between + mine[3] + theirs[3] < reach - 2 * SLACK:
            links.whole(at, to)
        elif b - a <= leaf and d - c <= leaf:
            linked = left.vectors[a:b] @ right.vectors[c:d].T >= similarity
            if at is to:
                # One triangle decides for both.
                linked = np.triu(linked, 1)
                linked |= linked.T
            links.some(at, to, linked)
        else:
            halves = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > leaf else [(a, b)]
            others = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > leaf else [(c, d)]
            # Joined with itself, an interval needs each pair of its halves once.
            todo += [(*x, *y) for x in halves for y in others if not (same and (a, b) == (c, d) and x > y)]


def principal_axes(sample: np.ndarray, axes: int) -> np.ndarray:
    """Leading orthonormal axes of unit vectors, as columns."""
    centred = sample - sample.mean(axis=0)
    _, turned = np.linalg.eigh(centred.T @ centred)
    return turned[:, ::-1][:, :axes]


def _cells(axes: np.ndarray, width: float, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = unit(matrix(batch.column(batch.schema.names.index("vector")), dims))
            cells = np.floor(rows @ axes / width).astype(np.int32)
            at = np.arange(len(batch) + 1, dtype=np.int32) * cells.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(cells.ravel()))], names=[*batch.schema.names, "cells"])

    return run


def _numbered(block_rows: int):
    """Cut the sorted rows of a partition into blocks of one label each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        block, label, held = -1, None, 0
        for batch in batches:
            labels = batch.column(batch.schema.names.index("label")).to_pylist()
            numbers = np.zeros(len(batch), np.int64)
            for k, own in enumerate(labels):
                if block < 0 or own != label or held >= block_rows:
                    block, label, held = block + 1, own, 0
                held += 1
                numbers[k] = first + block
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, "block"])

    return run


def _boxes(axes: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block of the partition: its least and greatest coordinates."""
        found: dict[int, list] = {}
        kind = None
        for batch in batches:
            turned = unit(matrix(batch.column(batch.schema.names.index("vector")), dims))[0] @ axes
            blocks = batch.column(batch.schema.names.index("block")).to_numpy()
            labels = batch.column(batch.schema.names.index("label"))
            kind = labels.type
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(blocks)]):
                low, high = turned[lo:hi].min(axis=0), turned[lo:hi].max(axis=0)
                if (old := found.get(int(blocks[lo]))) is not None:
                    low, high = np.minimum(low, old[1]), np.maximum(high, old[2])
                found[int(blocks[lo])] = [labels[lo].as_py(), low, high]
        if found:
            names, low, high = zip(*found.values())
            yield pa.RecordBatch.from_pydict({"block": pa.array(found, pa.int64()), "label": pa.array(names, kind), "low": [x.tolist() for x in low], "high": [x.tolist() for x in high]})

    return run


def _joined(axes: np.ndarray, width: float, dims: int, similarity: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links of one pair of blocks; an empty right side stands for the left one again."""
        nodes, hashes, copies, sides = [], [], [], []
        for table in (left, right):
            vectors = unit(matrix(table.column("vector"), dims))[0]
            turned = vectors @ axes
            order = np.lexsort((table.column("node").to_numpy(), *np.floor(turned / width).T[::-1]))
            sides.append(Intervals(vectors[order], turned[order]))
            for out, name in ((nodes, "node"), (hashes, "hash"), (copies, "copies")):
                out.append(table.column(name).to_numpy()[order])
        n = left.num_rows
        nodes, hashes, copies = (np.concatenate(x) for x in (nodes, hashes, copies))
        links = Links(copies)
        places = (np.arange(n), np.arange(n, len(nodes)))
        if n and right.num_rows:
            join_intervals(*sides, places, links, similarity)
        elif n:
            join_intervals(sides[0], sides[0], (places[0], places[0]), links, similarity)
        some = np.flatnonzero(links.count > 0)
        return pa.table({"node": nodes[some], "hash": hashes[some], "links": links.count[some], "peer": nodes[links.roots()[some]]})

    return run


def linked_vectors(rows: DataFrame, similarity: float = SIMILARITY, vector_id: str = "vec_id", vector: str = "embedding", label: str = "label", axes: int = AXES, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `rows`: vec_id, n_links, component_id, kept.

    Vectors of one label with a cosine of `similarity` (0.5 or more) are
    linked. n_links is the number of other rows linked directly, component_id
    the least id reachable by links, the own one included, kept whether that
    is the own one.

    Rows with a null label, and vectors that are null, zero or hold a null or
    non-finite component, link with nothing. Equal vectors of a label are
    compared once and count each. A shorter vector ends in zeros. A null id
    stays null and comes after all others; such a row is kept if no id is
    reachable. Rows of one id with different vectors share the component; each
    has the links of all. Repeated rows are links of each other. An empty table gives an
    empty result; other columns, whatever their names, are ignored. The axes
    are found from at most `sample` vectors; they decide about speed alone.
    """
    plain = rows.select(F.col(vector_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    able = usable("vector") & F.col("label").isNotNull() & F.exists("vector", lambda c: c != 0)
    mark = F.struct("label", F.xxhash64(F.lit(1), "vector").alias("hash"), F.xxhash64(F.lit(2), "vector").alias("other"))
    kept = F.col("vector").cast(stored(plain.schema["vector"].dataType))
    marked = written(plain.withColumn("able", able).select("id", "label", "able", F.when(F.col("able"), mark).alias("mark"), F.when(F.col("able"), kept).alias("vector")), "vectors")
    node = F.coalesce(F.min("id"), F.lit(NO_ID) + F.pmod(F.first("mark.hash"), F.lit(NO_ID)))
    classes = marked.where("able").groupBy("mark").agg(node.alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = written(classes.select("mark", F.col("mark.hash").alias("hash"), "node", "copies", "label", "vector"), "classes")
    found = _found(classes, similarity, axes, sample, block_bytes)
    weights = found.groupBy("node", "hash").agg(F.sum("links").alias("_links"))
    edges = found.select(F.col("node").alias("a"), F.col("peer").alias("b")).unionByName(_same_id(marked, classes))
    labels = components(edges).select("node", F.col("component").alias("_class"))
    of = classes.select("mark", "hash", "node", "copies").join(weights, ["node", "hash"], "left").join(labels, "node", "left")
    of = of.select("mark", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("_class", "node").alias("_class"))
    own = F.coalesce("id", F.lit(NO_ID))
    linked = marked.where("able").select("id", "mark").join(of, "mark").select("id", "n_links", F.least("_class", own).alias("_class"))
    # The others have no part in the join, where their nulls would meet in one task.
    alone = marked.where("not able").select("id", F.lit(0).cast("long").alias("n_links"), own.alias("_class"))
    return linked.union(alone).select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.when(F.col("_class") < NO_ID, F.col("_class")).alias("component_id"),
        (F.least("_class", F.lit(NO_ID)) == own).alias("kept"),
    )


def _same_id(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of different vectors that have an id in common."""
    able = marked.where("able and id is not null")
    shared = able.groupBy("id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("id")
    nodes = able.join(shared, "id", "left_semi").select("id", "mark").distinct().join(classes.select("mark", "node"), "mark")
    return nodes.select(F.col("id").alias("a"), F.col("node").alias("b"))


def _found(classes: DataFrame, similarity: float, axes: int, sample: int, block_bytes: int) -> DataFrame:
    """(node, hash, links, peer) from every pair of blocks that are not provably distant."""
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.5 and 1")
    total, dims = extent(classes, "vector")
    axes = min(axes, dims)
    width = max(math.sqrt(2 - 2 * similarity), 1e-3)
    picked = bounded_sample(classes.select("node", "hash", "vector"), ["node", "hash"], sample, total).select("vector").toArrow()
    turned = principal_axes(unit(matrix(picked.column(0), dims))[0], axes) if total else np.eye(dims)[:, :axes]
    block_rows = max(1, block_bytes // (8 * dims))
    kept = f"node long, hash long, copies long, label {classes.schema['label'].dataType.simpleString()}, vector {classes.schema['vector'].dataType.simpleString()}"
    names = ["node", "hash", "copies", "label", "vector"]
    placed = classes.select(*names).mapInArrow(_cells(turned, width, dims), f"{kept}, cells array<int>")
    order = ["label", "cells", "node", "hash"]
    sequence = placed.repartitionByRange(max(1, math.ceil(total / block_rows)), *order).sortWithinPartitions(*order).drop("cells")
    sequence = written(sequence.mapInArrow(_numbered(block_rows), f"{kept}, block long"), "sequence")
    boxes = sequence.mapInArrow(_boxes(turned, dims), f"block long, label {classes.schema['label'].dataType.simpleString()}, low array<double>, high array<double>")
    low, high = (F.array(*[f(F.col(c)[k]) for k in range(axes)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high")))
    pairs = written(_near_blocks(written(boxes.groupBy("block", "label").agg(low, high), "boxes"), width), "pairs")
    carry = ("node", "hash", "copies", "vector")
    left = sequence.join(pairs.select(F.col("i").alias("block"), "i", "j"), "block").select("i", "j", *carry)
    right = sequence.join(pairs.where("i <> j").select(F.col("j").alias("block"), "i", "j"), "block").select(*[F.col(c).alias(c) for c in ("i", "j", *carry)])
    joined = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_joined(turned, width, dims, similarity), "node long, hash long, links long, peer long")
    return written(joined, "links")


def _near_blocks(boxes: DataFrame, width: float) -> DataFrame:
    """Pairs (i, j), i <= j, of blocks of one label whose boxes are not provably distant.

    They meet by label and strip of the first axis: a block lies in the strips
    it covers and asks in those and the next.
    """
    strip = [F.floor(F.col(c)[0] / width).cast("long") for c in ("low", "high")]
    asks = boxes.select("label", F.col("block").alias("b1"), F.col("low").alias("l1"), F.col("high").alias("h1"), F.explode(F.sequence(strip[0] - 1, strip[1] + 1)).alias("strip"))
    lies = boxes.select("label", F.col("block").alias("b2"), F.col("low").alias("l2"), F.col("high").alias("h2"), strip[0].alias("strip"))
    gap = "aggregate(zip_with(zip_with(l1, h2, (a, b) -> greatest(a - b, 0D)), zip_with(l2, h1, (a, b) -> greatest(a - b, 0D)), (a, b) -> greatest(a, b)), 0D, (t, g) -> t + g * g)"
    near = asks.join(lies, ["label", "strip"]).where(F.expr(gap) <= (width + SLACK) ** 2)
    return near.select(F.least("b1", "b2").alias("i"), F.greatest("b1", "b2").alias("j")).distinct()

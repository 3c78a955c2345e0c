"""Top-k similar vectors through inverted lists: queries meet the nearest lists only.

Centres come from a bounded sample; every vector goes to the list of its
nearest centre. A query is sent to its nearest lists, as many as a target for
the recall asks for, measured on the sample. ``similarity.top_k_similar`` is
the exact way.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..sources.scratch import fresh_folder
from .similarity import BLOCK_BYTES, best_pairs, unit_rows

register_pickle_by_value(sys.modules[__name__])

SAMPLE = 8192
ASKED = 256
ROUNDS = 12
MOST_LISTS = 1024
ROWS_PER_LIST = 4096
LEAST_LISTS = 16
RECALL = 0.95
_HASHES = 1 << 40


@dataclass(frozen=True)
class VectorIndex:
    """Unit centres as rows, the folder of the lists, their sizes, and the probes per recall measured."""

    centres: np.ndarray
    folder: str
    sizes: dict[int, int]
    dims: int
    reached: tuple[float, ...]

    def probes(self, recall: float) -> int:
        """The least number of lists with which the sample reached a recall."""
        return next((n for n, r in enumerate(self.reached, 1) if r >= recall), len(self.centres))


def nearest_lists(vectors: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest centres of unit vectors, the nearest first."""
    return np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :count]


def fit_centres(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of unit vectors, from points spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = nearest_lists(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _reached(sample: np.ndarray, centres: np.ndarray, k: int, asked: int) -> tuple[float, ...]:
    """Recall of the first 1, 2, ... lists, for some of the sample asked against all of it."""
    if len(sample) < 2:
        return (1.0,)
    queries = sample[:: max(1, len(sample) // asked)]
    scores = queries @ sample.T
    # A vector finds itself in its own list, which says nothing.
    scores[np.arange(len(queries)), np.arange(0, len(sample), max(1, len(sample) // asked))[: len(queries)]] = -2
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    own = nearest_lists(sample, centres, 1)[:, 0]
    order = np.argsort(nearest_lists(queries, centres, len(centres)), axis=1)
    place = np.take_along_axis(order, own[best], axis=1)
    return tuple(float((place < n).mean()) for n in range(1, len(centres) + 1))


def build_index(
    corpus: DataFrame,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    lists: int | None = None,
    sample: int = SAMPLE,
) -> VectorIndex:
    """Index every vector of `corpus` that is there; the lists are written below the shared folder.

    ``lists`` is by default one per ROWS_PER_LIST vectors, from LEAST_LISTS to MOST_LISTS. Centres are
    fitted on at most `sample` vectors, those of the least hash of their id,
    on the driver. Vectors have one length.
    """
    spark = corpus.sparkSession
    rows = corpus.filter(F.col(vector).isNotNull()).select(
        F.col(vector_id).alias("vector_id"), F.col(vector).alias("vector")
    )
    total, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    place = F.pmod(F.xxhash64("vector_id"), F.lit(_HASHES))
    few = rows.where(place < min(1.0, 2 * sample / max(total, 1)) * _HASHES)
    picked = few.orderBy(place, "vector_id").limit(sample).select("vector").toArrow()
    units = unit_rows(picked.column("vector")) if picked.num_rows else np.zeros((1, dims or 1))
    wanted = lists or min(MOST_LISTS, max(LEAST_LISTS, total // ROWS_PER_LIST))
    centres = fit_centres(units, max(1, min(wanted, len(units))))
    folder = fresh_folder(spark, "vector_index")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = nearest_lists(unit_rows(batch.column("vector")), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(own, pa.int32())], names=["vector_id", "vector", "list"]
                )

    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])
    rows.mapInArrow(assign, schema).hint("rebalance", "list").write.parquet(folder)
    stored = spark.read.schema(schema).parquet(folder)
    sizes = {r["list"]: r["n"] for r in stored.groupBy("list").agg(F.count("*").alias("n")).collect()}
    return VectorIndex(centres, folder, sizes, dims or 1, _reached(units, centres, k, ASKED))


def top_k_indexed(
    queries: DataFrame,
    index: VectorIndex,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    vector_id: str = "vec_id",
    recall: float = RECALL,
    probes: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (query_id, vector_id, similarity, rank) as from ``top_k_similar``, of the lists probed.

    ``probes`` is the number of lists per query, by default what reached
    ``recall`` on the sample; with all lists the answer is exact. The vectors
    of a list move once, in blocks of about ``block_bytes``, so a list that holds a large part of all
    is many tasks; a query moves to the blocks of its lists only.
    """
    spark = queries.sparkSession
    count = min(probes or index.probes(recall), len(index.centres))
    centres = index.centres
    left = queries.filter(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector")
    )
    corpus = spark.read.parquet(index.folder)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest_lists(unit_rows(batch.column("query_vector")), centres, count).astype(np.int32)
                ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * count)
                lists = pa.ListArray.from_arrays(ends, pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["query_id", "query_vector", "lists"])

    held = {n: max(1, math.ceil(8 * index.dims * rows / block_bytes)) for n, rows in index.sizes.items()}
    # One number per list, at most MOST_LISTS by default.
    blocks = F.array(*[F.lit(held.get(n, 1)) for n in range(len(centres))])
    probed = left.mapInArrow(
        probe, T.StructType([*left.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    )
    asked = probed.select("query_id", "query_vector", F.explode("lists").alias("list"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("list")) - 1)))
    dealt = corpus.withColumn(
        "block", F.pmod(F.xxhash64("vector_id"), F.get(blocks, F.col("list"))).cast("int")
    )
    schema = T.StructType(
        [left.schema["query_id"], corpus.schema["vector_id"], T.StructField("similarity", T.DoubleType())]
    )
    layout = to_arrow_schema(schema)

    def best_of_block(wanted: pa.Table, vectors: pa.Table) -> pa.Table:
        return best_pairs(wanted, [vectors], k, layout)

    best = (
        asked.groupBy("list", "block")
        .cogroup(dealt.groupBy("list", "block"))
        .applyInArrow(best_of_block, schema)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vector_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumnsRenamed({"query_id": query_id, "vector_id": vector_id})
    )


def recall_of(found: DataFrame, exact: DataFrame, query_id: str = "query_id", vector_id: str = "vec_id") -> float:
    """Share of the exact pairs that were found."""
    keys = [query_id, vector_id]
    total = exact.count()
    return exact.select(*keys).join(found.select(*keys), keys, "left_semi").count() / total if total else 1.0


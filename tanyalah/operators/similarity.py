"""The k most similar corpus vectors for each query vector, by cosine."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

# Tasks carry the functions of this module along, so the executors need no
# installed copy of the package.
register_pickle_by_value(sys.modules[__name__])

# Bytes of query vectors that may be sent to every executor.
BROADCAST_BYTES = 64 << 20
# Bytes of vectors of either side that meet in one task.
BLOCK_BYTES = 64 << 20
# Similarities held in memory at a time, per task.
CELLS = 4_000_000
DIGITS = 6


def top_k_similar(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    vector_id: str = "vec_id",
    vector: str = "embedding",
    plan: str = "blocks",
    sizes: tuple[int, int] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (query_id, vector_id, similarity, rank) with rank 1 to k, exactly.

    Similarity is rounded to six digits and then ordered together with the
    vector id, so equal vectors rank the same on every run. A zero vector has
    similarity 0 to all.

    No pair of vectors ever becomes a row: each task multiplies a batch of the
    corpus with the query vectors and keeps its k best per query. The caller
    names the plan; the result is the same.

    blocks: both sides are cut into blocks of about ``block_bytes``, and each
    block of queries meets each block of the corpus in a task of its own.
    ``sizes``, the bytes of both sides, spares the job that finds them.

    broadcast: the query vectors go to every executor and the corpus stays
    where it is, for queries whose number does not grow with the data. Their
    size is checked; beyond ``BROADCAST_BYTES`` it raises.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if plan not in ("blocks", "broadcast"):
        raise ValueError(f"unknown plan {plan!r}")
    left = queries.filter(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector")
    )
    right = corpus.filter(F.col(vector).isNotNull()).select(
        F.col(vector_id).alias("vector_id"), F.col(vector).alias("vector")
    )
    schema = T.StructType(
        [
            left.schema["query_id"],
            right.schema["vector_id"],
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    if plan == "broadcast":
        if (sizes[0] if sizes else _bytes(left, "query_vector")) > BROADCAST_BYTES:
            raise ValueError("too many query vectors to broadcast, use plan='blocks'")
        best = _against_all(left.toArrow(), right, k, schema)
    else:
        held = sizes or (_bytes(left, "query_vector"), _bytes(right, "vector"))
        counts = [max(1, math.ceil(size / block_bytes)) for size in held]
        best = _block_by_block(left, right, k, schema, *counts)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vector_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumnsRenamed({"query_id": query_id, "vector_id": vector_id})
    )


def _bytes(vectors: DataFrame, column: str) -> int:
    """Size of a column of vectors as doubles."""
    return 8 * (vectors.agg(F.sum(F.size(column).cast("bigint"))).first()[0] or 0)


def _against_all(
    queries: pa.Table, right: DataFrame, k: int, schema: T.StructType
) -> DataFrame:
    shared = right.sparkSession.sparkContext.broadcast(queries)
    layout = to_arrow_schema(schema)

    def best_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from best_pairs(shared.value, batches, k, layout).to_batches()

    return right.mapInArrow(best_of_partition, schema)


def _block_by_block(
    left: DataFrame,
    right: DataFrame,
    k: int,
    schema: T.StructType,
    query_blocks: int,
    corpus_blocks: int,
) -> DataFrame:
    """Every block of queries against every block of the corpus.

    Hashing the ids fills the blocks evenly.
    """
    layout = to_arrow_schema(schema)

    def block(column: str, count: int):
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    spread_left = left.withColumn("qb", block("query_id", query_blocks)).withColumn(
        "cb", every(corpus_blocks)
    )
    spread_right = right.withColumn("cb", block("vector_id", corpus_blocks)).withColumn(
        "qb", every(query_blocks)
    )

    def best_of_block(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        return best_pairs(queries, [vectors], k, layout)

    return (
        spread_left.groupBy("qb", "cb")
        .cogroup(spread_right.groupBy("qb", "cb"))
        .applyInArrow(best_of_block, schema)
    )


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix, scaled to length 1."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.unique(pc.list_value_length(vectors))
    if len(sizes) != 1:
        raise ValueError(f"vectors differ in length: {sizes.to_pylist()[:5]}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype("float64").reshape(len(vectors), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def best_pairs(
    queries: pa.Table,
    batches: Iterable[pa.RecordBatch | pa.Table],
    k: int,
    layout: pa.Schema,
) -> pa.Table:
    """The k best vectors per query over some batches, ties by vector id."""
    best = None
    if queries.num_rows:
        wanted = unit_rows(queries.column("query_vector"))
        keys = queries.column("query_id").to_pandas().to_numpy()
        for batch in batches:
            if batch.num_rows:
                best = _merge(best, wanted, batch, k)
    if best is None:
        return layout.empty_table()
    pairs = pd.DataFrame(
        {
            "query_id": keys[best["row"].to_numpy()],
            "vector_id": best["vector_id"].to_numpy(),
            "similarity": best["similarity"].to_numpy(),
        }
    )
    return pa.Table.from_pandas(pairs, schema=layout, preserve_index=False)


def _merge(
    best: pd.DataFrame | None,
    wanted: np.ndarray,
    batch: pa.RecordBatch | pa.Table,
    k: int,
) -> pd.DataFrame:
    batch = batch.take(pc.sort_indices(batch.column("vector_id")))
    ids = batch.column("vector_id").to_pandas().to_numpy()
    across = unit_rows(batch.column("vector")).T
    if across.shape[0] != wanted.shape[1]:
        raise ValueError("query and corpus vectors differ in length")
    step = max(1, CELLS // len(ids))
    found = [] if best is None else [best]
    for first in range(0, len(wanted), step):
        similarity = np.round(wanted[first : first + step] @ across, DIGITS) + 0.0
        rows, places = np.nonzero(_first_k(similarity, k))
        found.append(
            pd.DataFrame(
                {
                    "row": rows + first,
                    "vector_id": ids[places],
                    "similarity": similarity[rows, places],
                }
            )
        )
    merged = pd.concat(found).sort_values(
        ["row", "similarity", "vector_id"], ascending=[True, False, True]
    )
    return merged.groupby("row", sort=False).head(k)


def _first_k(similarity: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest entries per row, of equal ones the leftmost."""
    width = similarity.shape[1]
    if width <= k:
        return np.ones_like(similarity, dtype=bool)
    smallest = np.partition(similarity, width - k, axis=1)[:, width - k, None]
    above = similarity > smallest
    equal = similarity == smallest
    room = k - above.sum(axis=1, keepdims=True)
    return above | (equal & (np.cumsum(equal, axis=1) <= room))

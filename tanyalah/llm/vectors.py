"""Vector columns as NumPy matrices, and bounded samples of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

NO_ID = 1 << 62
_HASHES = 1 << 40


def usable(vector: str) -> Column:
    """True where a vector is there and all its components are finite numbers."""
    return F.expr(f"coalesce(`{vector}` is not null and forall(`{vector}`, c -> c is not null and not isnan(c) and abs(cast(c as double)) < double('infinity')), false)")


def stored(kind: DataType) -> str:
    """How the vectors of an array type travel: floats as they are, all other numbers as doubles."""
    return "array<float>" if kind.simpleString() == "array<float>" else "array<double>"


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The vectors of a column as rows of doubles; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    if len(flat) == len(column) * dims and (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def extent(rows: DataFrame, vector: str) -> tuple[int, int]:
    """Number of rows and length of the longest vector."""
    found = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    return found[0], max(1, found[1] or 1)


def bounded_sample(rows: DataFrame, by: Sequence[str], size: int, total: int) -> DataFrame:
    """At most `size` rows, those of the least hash of the columns `by`.

    A threshold on the hash leaves about twice as many before they are sorted,
    so no task sorts or receives more than that.
    """
    place = F.pmod(F.xxhash64(*by), F.lit(_HASHES))
    few = rows.where(place < min(1.0, 2 * size / max(total, 1)) * _HASHES)
    return few.orderBy(place, *by).limit(size)


def least_hashes(rows: DataFrame, by: str, size: int, total: int) -> DataFrame:
    """At most `size` of `total` rows, those of the least hash of the column `by`, sorted by it.

    Only about twice as many pass a threshold on the hash, so no task sorts or
    receives more than that.
    """
    share = min(1.0, 2 * size / max(total, 1))
    most = (1 << 63) - 1 if share == 1 else int(-(1 << 63) + share * (1 << 64))
    return rows.where(F.xxhash64(by) <= F.lit(most)).orderBy(F.xxhash64(by), by).limit(size)


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which rows are not zero."""
    most = np.abs(rows).max(axis=1, initial=0.0, keepdims=True)
    some = most[:, 0] > 0
    scaled = np.divide(rows, most, out=np.zeros_like(rows), where=most > 0)
    length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return np.divide(scaled, length, out=scaled, where=length > 0), some

"""Embedding whitening by incremental eigendecomposition.

The fit list holds each distinct vector of whole numbers once. Its sums are
exact, so every vector can be centred before anything is multiplied. A
partition starts with no spread at all and adds its vectors one by one: each
is a rank-one update of an eigendecomposition, whose new eigenvalues solve the
secular equation. Directions that the update does not touch, and eigenvalues
too close to part, are deflated. Two decompositions are combined by adding the
eigenvectors of one, times the roots of their eigenvalues, to the other as
successive rank-one updates, in a tree of small groups. A last pass over the
fit list, distributed as the first, projects the covariance on the axes found
(Rayleigh-Ritz), which frees them from the rounding of many updates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanyalah.llm.components import written
from tanyalah.llm.vectors import usable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
FAN = 16
EPS = np.finfo(np.float64).eps
# Part of the secular equation's terms at which a root is good enough; the last pass takes away what is left.
ROOT = 1e-10
MOST = 4.0e18


class Spectrum:
    """Eigenvalues, ascending, and eigenvectors (columns) of a sum of outer products."""

    def __init__(self, dims: int):
        self.values, self.axes = np.zeros(dims), np.eye(dims)

    def add(self, vector: np.ndarray) -> None:
        """Add the outer product of a vector with itself."""
        z = vector @ self.axes
        size = float(z @ z)
        if not size:
            return
        tiny = 8 * EPS * max(self.values[-1], size)
        d, q = self.values, self.axes
        # Deflation: of eigenvalues that cannot be told apart, a rotation leaves one touched.
        near = np.flatnonzero(np.diff(d) <= tiny)
        if len(near):
            d, q, z = d.copy(), q.copy(), z.copy()
            for k in near:
                length = math.hypot(z[k], z[k + 1])
                if length > 0:
                    c, s = z[k + 1] / length, z[k] / length
                    q[:, [k, k + 1]] = q[:, [k, k + 1]] @ np.array([[c, s], [-s, c]])
                    z[k], z[k + 1] = 0.0, length
        # Deflation: directions that the vector does not touch stay.
        touched = np.abs(z) * math.sqrt(size) > tiny
        live = np.flatnonzero(touched)
        if not len(live):
            return
        if len(live) == len(d):
            # The roots come in order.
            self.values, weights = secular(d, z)
            self.axes = q @ weights
            return
        root, weights = secular(d[live], z[live])
        d, q = d.copy(), q.copy()
        d[live], q[:, live] = root, q[:, live] @ weights
        order = np.argsort(d, kind="stable")
        self.values, self.axes = d[order], q[:, order]

    def join(self, other: Spectrum) -> None:
        """Add what another decomposition stands for."""
        for value, axis in zip(other.values, other.axes.T):
            if value > 0:
                self.add(math.sqrt(value) * axis)


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + z z', d ascending and parted, no z zero.

    Each root of 1 + sum z_j^2 / (d_j - x) lies between two poles, and is
    sought as a distance from the nearer one, so that differences from the
    poles lose no digits. Steps fit a rational function to the sums on either
    side; a step that leaves the bracket is halved instead. The eigenvectors
    come from the z for which the roots are exact, which keeps them orthogonal.
    """
    n = len(d)
    square = z * z
    if n == 1:
        return d + square, np.ones((1, 1))
    above = np.append(d[1:], d[-1] + square.sum())
    gap = above - d
    # The sign in the middle says which pole is nearer.
    middle = 1 + (square / (d - (d + gap / 2)[:, None])).sum(axis=1)
    upper = (middle < 0) & (np.arange(n) < n - 1)
    origin = np.where(upper, above, d)
    poles = d - origin[:, None]
    low, high = np.where(upper, -gap, 0.0), np.where(upper, 0.0, gap)
    low, high = np.where(middle < 0, np.where(upper, -gap / 2, gap / 2), low), np.where(middle < 0, high, gap / 2)
    x = (low + high) / 2
    rows = np.arange(n)
    own, after = poles[rows, rows], np.append(poles[rows[:-1], rows[1:]], gap[-1])
    left = np.tri(n)
    with np.errstate(all="ignore"):
        for _ in range(60):
            # Sums over all poles and over those to the left, as products with the squares.
            each = 1 / (poles - x[:, None])
            lower = each * left
            under, terms = lower @ square, each @ square
            f = 1 + terms
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            done = np.abs(f) <= ROOT * (1 + terms - 2 * under)
            if done.all():
                break
            psi = (lower * lower) @ square
            phi = (each * each) @ square - psi
            p, r = own - x, after - x
            c = f - p * psi - r * phi
            a = (p + r) * f - p * r * (psi + phi)
            b = p * r * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            x = np.where(done, x, np.where((new > low) & (new < high), new, (low + high) / 2))
    # The differences of roots (rows) and poles (columns).
    away = x[:, None] - poles
    spread = np.subtract.outer(d, d)
    np.fill_diagonal(spread, 1.0)
    exact = np.sqrt(np.maximum(np.prod(away / spread, axis=0), 0)) * np.sign(z)
    weights = exact / away
    weights /= np.sqrt((weights * weights).sum(axis=1, keepdims=True))
    return origin + x, -weights.T


def _pack(spectrum: Spectrum) -> bytes:
    return np.concatenate([spectrum.values, spectrum.axes.ravel()]).tobytes()


def _unpack(raw: bytes, dims: int) -> Spectrum:
    out, numbers = Spectrum(dims), np.frombuffer(raw)
    out.values, out.axes = numbers[:dims].copy(), numbers[dims:].reshape(dims, dims).copy()
    return out


def _per_partition(frame: DataFrame, start: Callable, take: Callable, pack: Callable) -> DataFrame:
    """(part, state): what one pass over each partition leaves, for partitions with rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if len(batch):
                state = take(start() if state is None else state, batch)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "state": [pack(state)]})

    return frame.mapInArrow(run, "part long, state binary")


def _combined(states: DataFrame, merge: Callable, label: str) -> bytes | None:
    """The states of all partitions in one, by a tree of groups of FAN; None if there is none."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN], pa.int64()), "state": pa.array([merge(group.column("state").to_pylist())], pa.binary())})

    states = written(states, label)
    last = states.agg(F.max("part")).first()[0]
    if last is None:
        return None
    while last > 0:
        states = states.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(run, "part long, state binary")
        last //= FAN
    return merge([states.first()["state"]])


def longs(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of `dims` whole numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as 64-bit numbers, or as Python's where those are too short."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(rows: np.ndarray) -> list[int]:
    """Sum of the squares of each row, exactly."""
    most = int(np.abs(rows).max(initial=0)) if len(rows) else 0
    exact = rows if most**2 * max(1, rows.shape[1]) < 1 << 62 else rows.astype(object)
    return (exact * exact).sum(axis=1).tolist()


def _gram(vectors: Callable, width: int) -> tuple[Callable, Callable, Callable]:
    """Sums and products of rows of doubles, for _per_partition."""

    def start():
        return [np.zeros(width), np.zeros((width, width))]

    def take(state, batch):
        rows = vectors(batch)
        return [state[0] + rows.sum(axis=0), state[1] + rows.T @ rows]

    return start, take, lambda state: np.concatenate([state[0], state[1].ravel()]).tobytes()


def _added(parts: list[bytes]) -> bytes:
    total = np.frombuffer(parts[0])
    for raw in parts[1:]:
        total = total + np.frombuffer(raw)
    return total.tobytes()


def whitened(rows: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error, variance, deviation_whole.

    A component c of a vector counts as x = floor(scale * c) + shift. The fit
    list holds every distinct vector of these once; n is its length, S its
    sums. `components` unit eigenvectors of its covariance (divisor n) are
    numbered from 1 by falling eigenvalue e. deviation is the sum of
    (n x - S)^2 over the dimensions, whitened the projection of x - S / n over
    sqrt(e), explained e over the sum of all, variance e itself, and
    identity_error the largest entry of the covariance of whitened over the
    fit list, less the identity.

    Rows whose vector is null or holds a null or non-finite entry are left
    out. All others must have the length of the longest; a shorter vector ends
    in zeros. Products beyond 2^62 in size are cut to that before rounding. Repeated rows and ids stay
    rows of their own, a null id stays null. Where a component has no variance
    (equal vectors, one row) whitened is null; without any variance explained
    and identity_error are null too. A deviation beyond 64 bits is null there
    and whole in deviation_whole, which holds 38 digits and is null beyond. An empty table
    gives an empty result; other columns, whatever their names, are ignored. One task holds three
    square matrices of the dimension.
    """
    spark = rows.sparkSession
    plain = rows.where(usable(vector)).select(F.col(vector_id).alias("vec_id"), F.col(vector).alias("_v"))
    dims = max(1, plain.agg(F.max(F.size("_v"))).first()[0] or 1)
    filled = F.concat("_v", F.array_repeat(F.lit(0).cast(plain.schema["_v"].dataType.elementType), F.lit(dims) - F.size("_v")))
    number = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))) + F.lit(shift).cast("long")
    numbered = plain.select("vec_id", F.transform(filled, number).alias("x"))
    fit = written(numbered.select("x").distinct(), "fit")
    spots = fit.select(F.posexplode("x").alias("pos", "c")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    found = sorted(spots.collect())
    kind = plain.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, deviation_whole decimal(38,0), whitened array<double>"
    if not found:
        out = numbered.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.lit(0).cast("decimal(38,0)").alias("deviation_whole"), F.array().cast("array<double>").alias("whitened"))
        return _by_component(out, 0, [], [], None)
    n, sums = found[0]["n"], [int(f["s"]) for f in found]

    def middle(batch: pa.RecordBatch) -> np.ndarray:
        return (centred(longs(batch.column(batch.schema.names.index("x")), dims), n, sums) / n).astype(np.float64)

    def update(state: Spectrum, batch: pa.RecordBatch) -> Spectrum:
        for row in middle(batch):
            state.add(row)
        return state

    def merged(parts: list[bytes]) -> bytes:
        first = _unpack(parts[0], dims)
        for raw in parts[1:]:
            first.join(_unpack(raw, dims))
        return _pack(first)

    raw = _combined(_per_partition(fit, lambda: Spectrum(dims), update, _pack), merged, "spectra")
    axes, _ = np.linalg.qr(_unpack(raw, dims).axes[:, ::-1])
    ritz = np.frombuffer(_combined(_per_partition(fit, *_gram(lambda b: middle(b) @ axes, dims)), _added, "ritz"))
    product = ritz[dims:].reshape(dims, dims) / n
    values, turn = np.linalg.eigh((product + product.T) / 2)
    values, axes = values[::-1], (axes @ turn)[:, ::-1]
    total = float(values.sum())
    shown = min(components, dims)
    able = values[:shown] > dims * EPS * max(total, 0.0)
    weights = axes[:, :shown] * np.divide(1.0, np.sqrt(np.maximum(values[:shown], 0)), out=np.zeros(shown), where=able)
    error = None
    if able.any():
        check = np.frombuffer(_combined(_per_partition(fit, *_gram(lambda b: middle(b) @ weights, shown)), _added, "check"))
        mean = check[:shown] / n
        off = check[shown:].reshape(shown, shown) / n - np.outer(mean, mean) - np.eye(shown)
        error = float(np.abs(off[np.ix_(able, able)]).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = centred(longs(batch.column(1), dims), n, sums)
            exact = squares(own)
            out = (own / n).astype(np.float64) @ weights
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * shown)
            lists = pa.ListArray.from_arrays(ends, pa.array(out.ravel(), mask=np.tile(~able, len(batch))))
            digits = pa.array([e if e < 10**38 else None for e in exact], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()), digits, lists], names=["vec_id", "deviation", "deviation_whole", "whitened"])

    shares = [float(v) / total if total > 0 else None for v in values[:shown]]
    return _by_component(numbered.mapInArrow(project, schema), n, shares, [float(v) for v in values[:shown]], error)


def _by_component(projected: DataFrame, n: int, shares: list, values: list, error: float | None) -> DataFrame:
    """One row per component of each row."""
    each = projected.select("vec_id", "deviation", "deviation_whole", F.posexplode("whitened").alias("pos", "whitened"))
    given = lambda numbers: F.get(F.array(*map(F.lit, numbers)).cast("array<double>"), F.col("pos"))
    return each.select(
        "vec_id",
        (F.col("pos") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        given(shares).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        given(values).alias("variance"),
        "deviation_whole",
    )

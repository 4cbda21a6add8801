"""Whitening of embeddings: leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration.

A block of vectors Q is improved round by round. Each round applies a polynomial in the covariance V to Q, by the three-term recurrence of the Chebyshev
polynomials of the interval between 0 and the smallest Ritz value of the block: they are small there and grow fast above, which damps the unwanted spectrum. Then
QR makes Q orthonormal and Rayleigh-Ritz turns it into the best eigenvectors within its span. Rounds end when the residuals |Vq - eq| certify the wanted ones.
V itself is never made: VQ is a pass over the table, in which each task sums its tiles' XᵀXQ of centred vectors; the passes' sums have as many rows as a vector has entries.

The fit list is each distinct vector once, in whole numbers floor(256 * c) of the entries c. What the driver holds is a few blocks of (entries x block) numbers.

Vectors that are null or hold null or non-finite entries take no part and give no rows. Shorter vectors are filled with zeros up to the longest one; numbers
beyond 64 bits become the nearest 64-bit number. Rows without an id, repeated rows and rows that share an id each give their own rows. Components whose eigenvalue is 0 (to
rounding) don't exist: a table with fewer than two different vectors has none, and one with vectors of fewer entries than components asked has fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch

#: Entries of a tile: 4 MB as doubles.
TILE = 1 << 19
#: Degree of the filter, and how much more it may raise the largest than the smallest wanted eigenvector in one round: beyond that QR would lose the small ones.
DEGREE, GROWTH = 12, 1e8
#: Vectors of the block for each one wanted.
BLOCK = 4
SCALE = 256
EPS = float(np.finfo(float).eps)
_KINDS = ("<i1", "<i2", "<i4", "<i8")


def numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a column of vectors that take part, and their entries as whole numbers, filled with zeros to `width`."""
    rows = np.flatnonzero(np.asarray(column.is_valid()))
    column = column.filter(column.is_valid())
    sizes = np.asarray(pc.list_value_length(column)).astype(np.int64)
    c = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), dtype=float)
    of, starts = np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes) - sizes
    good = np.bincount(of[~np.isfinite(c)], minlength=len(rows)) == 0
    c = np.where(np.isfinite(c), c, 0.0)
    with np.errstate(over="ignore"):
        c = np.floor(c * SCALE)
    x = np.zeros((len(rows), width), np.int64)
    high = c >= 2.0**63
    x[of, np.arange(len(c)) - starts[of]] = np.where(high, np.iinfo(np.int64).max, np.clip(np.where(high, 0.0, c), -(2.0**63), None).astype(np.int64))
    return rows[good], x[good]


def to_bytes(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them all, behind a byte that tells it: equal numbers give equal bytes."""
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in _KINDS if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return bytes([_KINDS.index(kind)]) + x.astype(kind).tobytes()


def from_bytes(b: bytes, width: int) -> np.ndarray:
    return np.frombuffer(b, _KINDS[b[0]], offset=1).reshape(-1, width).astype(np.int64)


def fit_list(vectors: DataFrame, vector_col: str, width: int) -> DataFrame:
    """Each distinct vector once, packed in tiles: columns tile binary."""
    most = max(1, TILE // max(width, 1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = numbers(batch.column(0), width)[1]
            yield pa.RecordBatch.from_arrays([pa.array([to_bytes(v) for v in x], pa.binary())], names=["x"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def out(rows: list[bytes]) -> pa.RecordBatch:
            tile = to_bytes(np.concatenate([from_bytes(b, width) for b in rows]))
            return pa.RecordBatch.from_arrays([pa.array([tile], pa.binary())], names=["tile"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= most:
                yield out(held[:most])
                held = held[most:]
        if held:
            yield out(held)

    return vectors.select(vector_col).mapInArrow(each, "x binary").distinct().mapInArrow(tiles, "tile binary")


def summed(tiles: DataFrame, width: int, per_tile: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all tiles of a matrix of doubles, each task's tiles summed first. The matrix has a bounded size whatever the table's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for tile in batch.column(0):
                y = per_tile(from_bytes(tile.as_py(), width))
                total = y if total is None else total + y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(c) for c in total.T)], names=["at", *(f"y{j}" for j in range(total.shape[1]))])

    shape = per_tile(np.zeros((1, width), np.int64)).shape
    names = [f"y{j}" for j in range(shape[1])]
    rows = tiles.mapInArrow(run, ", ".join(["at int", *(f"{n} double" for n in names)])).groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros(shape)
    out[rows["at"].to_numpy()] = rows[names].to_numpy()
    return out


def exact_sums(tiles: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sum for each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for tile in batch.column(0):
                x = from_bytes(tile.as_py(), width)
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array([0, *high.tolist()], pa.int64()), pa.array([n, *low.tolist()], pa.int64())], names=["at", "high", "low"])

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in tiles.mapInArrow(run, "at int, high long, low long").groupBy("at").agg(total("high"), total("low")).collect()}
    return rows.get(-1, 0), [rows.get(k, 0) for k in range(width)]


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S; orthonormal eigenvectors (columns) with falling eigenvalues; residuals |Vq - eq|; passes over the table that finding them took."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def basis(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def filtered(q: np.ndarray, vq: np.ndarray, e: np.ndarray, wanted: int, times: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A Chebyshev polynomial of V applied to the block of Ritz vectors q with falling values e; vq is V @ q. It is scaled to be 1 at the largest value."""
    high = max(float(e[-1]), 1e-6 * float(e[0]))
    half = middle = high / 2
    raised = np.arccosh(max(1.0, (e[0] - middle) / half)) - np.arccosh(max(1.0, (e[wanted - 1] - middle) / half))
    degree = DEGREE if raised <= 0 else int(np.clip(np.log(GROWTH) / raised, 2, DEGREE))
    sigma = half / (e[0] - middle) if e[0] > high else 1.0
    step, before, now = sigma, q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1.0 / (2.0 / sigma - step)
        before, now, step = now, (times(now) - middle * now) * (2 * following / half) - (step * following) * before, following
    return now


def fit(vectors: DataFrame, components: int = 4, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of a table of vectors; None where no component exists."""
    width = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    if width < 1:
        return None
    tiles = Scratch(vectors.sparkSession).write(fit_list(vectors, vector_col, width), "fit_list")
    n, sums = exact_sums(tiles, width)
    if n < 2:
        return None
    centre, passes = np.array([s / n for s in sums]), 0

    def times(q: np.ndarray) -> np.ndarray:
        def tile(x: np.ndarray) -> np.ndarray:
            x = x - centre
            return x.T @ (x @ q)

        nonlocal passes
        passes += 1
        return summed(tiles, width, tile) / n

    trace = float(summed(tiles, width, lambda x: ((x - centre) ** 2).sum(axis=0)[:, None]).sum()) / n
    size = min(width, max(BLOCK * components, components + 8))
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((width, size)))[0]
    certified, worst, stuck = 16 * EPS * np.sqrt(width), np.inf, 0
    while True:
        vq = times(q)
        h = q.T @ vq
        e, turn = np.linalg.eigh((h + h.T) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        if e[0] <= 0:
            return None
        wanted = min(components, int((e > 64 * EPS * width * e[0]).sum()))
        residuals = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * e[:wanted], axis=0)
        now = float(residuals.max()) / float(e[0])
        if now <= certified:
            break
        worst, stuck = (now, 0) if now < worst / 2 else (worst, stuck + 1)
        if stuck == 8:
            raise RuntimeError(f"subspace iteration stays at a relative residual of {now:.1e}, above {certified:.1e}")
        q = np.linalg.qr(filtered(q, vq, e, wanted, times))[0]
    found, values = q[:, :wanted], e[:wanted]
    basis = found / np.sqrt(values)
    mean = summed(tiles, width, lambda x: ((x - centre) @ basis).sum(axis=0)[None, :])[0] / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - centre) @ basis - mean
        return w.T @ w

    error = float(np.abs(summed(tiles, width, spread) / n - np.eye(wanted)).max())
    return Whitening(n, sums, found, values, residuals, trace, error, passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the entries of (n * x - S)^2 for each row, exactly; None where it doesn't fit 64 bits."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * n + max((abs(s) for s in sums), default=0)
    if most * most * max(x.shape[1], 1) < 2.0**62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    whole = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in whole]


def transform(vectors: DataFrame, w: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each vector that takes part. A deviation beyond 64 bits is null."""
    kind, width, centre, basis, n, sums = vectors.schema[id_col].dataType.simpleString(), len(w.sums), w.centre, w.basis, w.n, w.sums
    share, error, k = w.values / w.trace, w.identity_error, len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = numbers(batch.column(1), width)
            out = (x - centre) @ basis
            ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
            m = len(rows)
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64())]
            columns += [pa.array(out.reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """fit and transform on one table; no rows where no component exists."""
    w = fit(vectors, components, vector_col)
    if w is None:
        w, vectors = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0, 0.0, 0), vectors.where(F.lit(False))
    return transform(vectors, w, id_col, vector_col)

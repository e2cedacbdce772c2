"""Embedding whitening by a bidiagonal qd solver.

1. ``exact_sums``: count and sums per dimension, exact in whole numbers.
2. ``reduced``: blockwise QR. Every task reduces its centred rows to one
   triangular factor; factors are stacked and reduced again, ``FOLD`` at a time,
   until so few are left that the driver reduces the last (at most ``FOLD``
   small squares; the rows never leave their tasks).
3. ``singular``: Householder reflections bring the factor to bidiagonal form,
   dqds (differential quotient differences with shifts) finds its singular values
   to high relative accuracy, and for each of them a twisted factorisation of the
   shifted ``B'B`` gives the vector: top-down and bottom-up factors meet where the
   pivot is smallest. The reflections carry the vectors back.
4. ``whiten`` measures the covariance of what it returns in one pass and gives
   the rows in another.

Entries become whole numbers first (``floor(64 c) + 1000000``), so equal inputs
give equal sums in any order of rows.

Defined results: rows whose vector is null or empty, or holds null or non-finite
entries, go, and so do rows whose vector is not as long as most are (of equally
frequent lengths the longer counts); entries beyond ``MOST`` count as ``MOST``; a null id comes out as null and repeated
rows as often as they stand; a direction without variance (``RANK`` of the
largest singular value, or less) is no component, so constant, few or no vectors
give fewer components or no rows; ``deviation`` is null where it exceeds a long;
other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.plans.lineage import cut_lineage

SCALE, BASE = 64, 1_000_000
#: Larger entries count as this one, so that sums stay exact.
MOST = 1e9
COMPONENTS = 32
#: Triangular factors that are stacked at once; singular values below this share of the largest count as zero.
FOLD, RANK = 64, 1e-9
EPS = float(np.finfo(np.float64).eps)
#: Values closer than this share get vectors that are made orthogonal to each other.
CLOSE = 1e-3


# ---- rows as whole numbers -----------------------------------------------------------

def fit_rows(embeddings: DataFrame) -> DataFrame:
    """``vec_id, embedding``: the rows whose vectors count."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    size = whole.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return whole.where(F.size("embedding") == (size["size"] if size else 0))


def integers(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors as a matrix of whole numbers."""
    column = batch.column("embedding")
    flat = np.clip(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), -MOST, MOST)
    return (np.floor(SCALE * flat).astype(np.int64) + BASE).reshape(batch.num_rows, -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = integers(batch)
                n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if n:
            yield pa.record_batch({"dim": np.arange(len(total), dtype=np.int32), "n": np.full(len(total), n), "total": total})

    parts = rows.mapInArrow(run, "dim int, n long, total long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (found[0]["n"] if found else 0), [int(r["total"]) for r in found]


# ---- blockwise QR ----------------------------------------------------------------------

def _stacked(factors: Iterator[np.ndarray]) -> np.ndarray | None:
    """Triangular factor of all blocks, one above the other."""
    held = None
    for block in factors:
        held = np.linalg.qr(block if held is None else np.vstack([held, block]), mode="r")
    return held


def _factor_batch(at: int, factor: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"at": pa.array([at], pa.int64()), "factor": pa.array([np.ascontiguousarray(factor).tobytes()], pa.binary())})


def reduced(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Triangular factor of the centred rows."""
    width = len(mean)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        factor = _stacked(integers(b) - mean for b in batches if b.num_rows)
        if factor is not None:
            yield _factor_batch(TaskContext.get().partitionId(), factor)

    def reduce_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = (np.frombuffer(f, np.float64).reshape(-1, width) for b in batches for f in b.column("factor").to_pylist())
        factor = _stacked(held)
        if factor is not None:
            yield _factor_batch(TaskContext.get().partitionId(), factor)

    factors = cut_lineage(rows.mapInArrow(reduce_rows, "at long, factor binary"), "factors")
    while (n := factors.count()) > FOLD:
        dealt = factors.repartition(-(-n // FOLD), "at")
        factors = cut_lineage(dealt.mapInArrow(reduce_factors, "at long, factor binary"), "factors")
    last = _stacked(np.frombuffer(r["factor"], np.float64).reshape(-1, width) for r in factors.orderBy("at").collect())
    return np.zeros((0, width)) if last is None else last


# ---- the solver ------------------------------------------------------------------------

def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor V of ``matrix = U B V'`` by Householder reflections."""
    width = matrix.shape[1]
    a = np.zeros((max(matrix.shape[0], width), width))
    a[: matrix.shape[0]] = matrix
    right = np.eye(width)
    for k in range(width):
        _reflect(a[k:, k:])
        if k + 2 < width:
            v = _reflect(a[k:, k + 1 :].T)
            if v is not None:
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflect(block: np.ndarray) -> np.ndarray | None:
    """Turn the first column of ``block`` onto its first entry, in place; the unit normal of the mirror."""
    v = block[:, 0].copy()
    norm = np.linalg.norm(v)
    if norm == 0 or len(v) < 2:
        return None
    v[0] += np.copysign(norm, v[0])
    v /= np.linalg.norm(v)
    block -= 2 * np.outer(v, v @ block)
    return v


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One dqds transform; None if the shift was too large."""
    n = len(q)
    out_q, out_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for k in range(n - 1):
        if d < 0:
            return None
        out_q[k] = d + e[k]
        ratio = q[k + 1] / out_q[k] if out_q[k] > 0 else 0.0
        out_e[k] = e[k] * ratio
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    out_q[-1] = d
    return out_q, out_e, least


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``B'B``, falling, from the squares of B's diagonal and superdiagonal (no zero among ``e``)."""
    q, e, moved, found = q.copy(), e.copy(), 0.0, []
    tiny = (10 * EPS) ** 2
    while len(q) > 1:
        if e[-1] <= tiny * (moved + q[-1]):
            found.append(moved + q[-1])
            q, e = q[:-1], e[:-1]
            continue
        split = np.flatnonzero(e <= tiny * (moved + np.minimum(q[:-1], q[1:])))
        if len(split):  # the halves go on by themselves
            at = split[-1] + 1
            return np.sort(np.concatenate([found, moved + dqds(q[:at], e[: at - 1]), moved + dqds(q[at:], e[at:])]))[::-1]
        if len(q) == 2:
            half = (q[0] + q[1] + e[0]) / 2
            large = half + np.sqrt(max(half * half - q[0] * q[1], 0.0))
            found += [moved + q[0] * q[1] / large, moved + large]
            return np.sort(np.array(found))[::-1]
        # The smaller eigenvalue of the last two rows and columns of BB' is above the smallest of all; try it, then less.
        a, b, c = q[-2] + e[-1], np.sqrt(e[-1] * q[-1]), q[-1]
        low = (a + c) / 2 - np.hypot((a - c) / 2, b)
        # (it is at most so far away as the rest of its vector is coupled to the rows above).
        away = np.sqrt(e[-2] * q[-2]) * min(1.0, b / max(a - low, EPS * a))
        for shift in (low - away * away / max(a - low, away), low - away, low * 0.5, 0.0):
            done = _step(q, e, max(shift, 0.0))
            if done:
                q, e, _ = done
                moved += max(shift, 0.0)
                break
    return np.sort(np.array([*found, *(moved + q)]))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> Iterator[np.ndarray]:
    """Unit vectors of ``B'B`` near the eigenvalue ``value``: factors from both ends meet at the smallest pivot, then at the next.

    ``B'B = L D L'`` with the squared diagonal as D. The stationary transform
    factors ``L D L' - value`` from the top, the progressive one from the bottom;
    both work on L and D, so small values keep their relative accuracy.
    """
    n, least = len(diagonal), EPS * np.abs(diagonal).max()
    diagonal = np.where(np.abs(diagonal) < least, least, diagonal)
    low, pivot = above / diagonal[:-1], diagonal**2
    safe = lambda p: p if abs(p) > EPS * least * least else EPS * least * least
    top, lower = np.empty(n), np.empty(n - 1)
    top[0] = -value
    for k in range(n - 1):
        lower[k] = pivot[k] * low[k] / safe(top[k] + pivot[k])
        top[k + 1] = lower[k] * low[k] * top[k] - value
    bottom, upper = np.empty(n), np.empty(n - 1)
    bottom[-1] = pivot[-1] - value
    for k in range(n - 2, -1, -1):
        share = pivot[k] / safe(pivot[k] * low[k] ** 2 + bottom[k + 1])
        upper[k] = low[k] * share
        bottom[k] = bottom[k + 1] * share - value
    for at in np.argsort(np.abs(top + bottom + value), kind="stable").tolist():
        vector = np.zeros(n)
        vector[at] = 1.0
        for k in range(at - 1, -1, -1):
            vector[k] = -lower[k] * vector[k + 1]
        for k in range(at, n - 1):
            vector[k + 1] = -upper[k] * vector[k]
        yield vector / np.linalg.norm(vector)


def apart_from(vectors: Iterator[np.ndarray], near: list[np.ndarray]) -> np.ndarray:
    """The first vector of which much is left across ``near`` (else the one with most), at right angles to those."""
    best, most = None, -1.0
    for vector in vectors:
        for _ in range(2 if near else 0):
            vector = vector - sum((v @ vector) * v for v in near)
        left = float(np.linalg.norm(vector))
        if left > most:
            best, most = vector / (left or 1.0), left
        if left > 0.3:
            break
    for v in near:
        best = best - (v @ best) * v
    return best / (np.linalg.norm(best) or 1.0)


def singular(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Squared singular values, falling, with their right vectors as columns (``most`` at most), and the sum of all squares."""
    diagonal, above, right = bidiagonal(matrix)
    total = float((matrix**2).sum())
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(0), np.zeros((len(diagonal), 0)), total
    above[np.abs(above) <= EPS * np.maximum(np.abs(diagonal[:-1]), np.abs(diagonal[1:]))] = 0.0
    found: list[tuple[float, np.ndarray]] = []
    cuts = [0, *(np.flatnonzero(above == 0) + 1).tolist(), len(diagonal)]
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        d, u = diagonal[start:stop] / scale, above[start : stop - 1] / scale
        values = dqds(d**2, u**2)
        vectors: list[np.ndarray] = []
        for k, value in enumerate(values[:most]):
            if value <= RANK**2 * max(values[0], 1.0):
                break
            near = [v for v, other in zip(vectors, values[:k], strict=True) if other - value <= CLOSE * other]
            vector = apart_from(twisted(d, u, value), near)
            vectors.append(vector)
            whole = np.zeros(len(diagonal))
            whole[start:stop] = vector
            found.append((value * scale**2, whole))
    found.sort(key=lambda pair: -pair[0])
    found = [f for f in found if f[0] > RANK**2 * found[0][0]][:most]
    return np.array([v for v, _ in found]), right @ np.array([w for _, w in found]).T.reshape(len(diagonal), -1), total


# ---- whitening -------------------------------------------------------------------------

@dataclass
class Whitening:
    """Count and exact sums, unit directions as columns, variances of them and of all dimensions together."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        mean = np.array(self.sums, np.float64) / max(self.n, 1)
        return (x - mean) @ self.directions / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact."""
        most = max((abs(self.n * int(x[:, k].max()) - s) + abs(self.n * int(x[:, k].min()) - s) for k, s in enumerate(self.sums)), default=0)
        if most * most * len(self.sums) < 2**63:
            away = self.n * x - np.array(self.sums, np.int64)
            return (away * away).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact]


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening:
    """Directions and variances of ``fit_rows``."""
    n, sums = exact_sums(rows)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    values, vectors, total = singular(reduced(rows, np.array([s / n for s in sums])), most)
    return Whitening(n, sums, vectors, values / n, total / n)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows less the identity; blocks are centred before they are multiplied."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(model.variances)

    def merged(a, b):
        if a is None:
            return b
        (n, mean, square), (m, other, more) = a, b
        away = other - mean
        return n + m, mean + away * m / (n + m), square + more + np.outer(away, away) * n * m / (n + m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                w = shared.value.apply(integers(batch))
                mean = w.mean(axis=0)
                held = merged(held, (len(w), mean, (w - mean).T @ (w - mean)))
        if held:
            yield pa.record_batch({"n": [held[0]], "mean": [held[1].tobytes()], "square": [held[2].tobytes()]})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                held = merged(held, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["square"]).reshape(width, width)))
        if held:
            yield pa.record_batch({"n": [held[0]], "mean": [held[1].tobytes()], "square": [held[2].tobytes()]})

    kind = "n long, mean binary, square binary"
    parts = cut_lineage(rows.mapInArrow(run, kind), "moments")
    while (count := parts.count()) > FOLD:
        parts = cut_lineage(parts.repartition(-(-count // FOLD)).mapInArrow(fold, kind), "moments")
    held = None
    for r in parts.collect():
        held = merged(held, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["square"]).reshape(width, width)))
    return float(np.abs(held[2] / held[0] - np.eye(width)).max()) if held and width else 0.0


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row and component."""
    rows = fit_rows(embeddings)
    model = fit(rows, most)
    error = identity_error(rows, model)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)
    width = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = np.array(shared.value.variances) / (shared.value.trace or 1.0)
        for whole in batches:
            for at in range(0, whole.num_rows if width else 0, 4096):
                batch = whole.slice(at, 4096)
                x = integers(batch)
                again = pa.array(np.repeat(np.arange(len(x)), width))
                yield pa.record_batch({
                    "vec_id": batch.column("vec_id").take(again), "component": np.tile(np.arange(1, width + 1, dtype=np.int32), len(x)),
                    "n": np.full(len(x) * width, shared.value.n), "deviation": pc.take(pa.array(shared.value.deviations(x), pa.int64()), again),
                    "whitened": shared.value.apply(x).ravel(), "explained": np.tile(explained, len(x)), "identity_error": np.full(len(x) * width, error),
                })

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )

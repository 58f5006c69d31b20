"""Whitening of embeddings on the leading principal components, found by spectrum slicing.

Entries become whole numbers, so that counts, sums and second moments around the rounded mean are exact and do not depend on
how the rows are dealt. Only d x d numbers reach the driver, where the spectrum of the covariance V is sliced: the signs of D
in L D L' = V - s I count the eigenvalues above s (Sylvester's law of inertia), bisection isolates each of the leading ones,
Rayleigh quotient iteration takes it to double precision, and two more counts certify that it has the number it is given.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_thread, small_batches, staged

_BIG = 1 << 62
_LOW = (1 << 31) - 1

# --- the spectrum ---------------------------------------------------------------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above `shift`: the positive signs of D in L D L' of matrix - shift I.

    Pivots are chosen by the rule of Bunch and Parlett, 1 x 1 or 2 x 2, so the factorisation is stable for every shift.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive, bound = 0, (1 + 17**0.5) / 8

    def bring(i: int, to: int) -> None:
        a[[i, to]] = a[[to, i]]
        a[:, [i, to]] = a[:, [to, i]]

    while len(a):
        diagonal = np.abs(np.diagonal(a))
        i = int(np.argmax(diagonal))
        size = np.abs(a)
        np.fill_diagonal(size, 0)
        k = int(np.argmax(size))
        if diagonal[i] >= bound * size.flat[k]:
            if not diagonal[i]:
                break  # all that is left is zero
            bring(i, 0)
            positive += int(a[0, 0] > 0)
            column = a[1:, 0]
            a = a[1:, 1:] - np.outer(column, column / a[0, 0])
        else:  # a 2 x 2 pivot, with one positive and one negative eigenvalue
            r, s = sorted(divmod(k, len(a)))
            bring(r, 0)
            bring(s, 1)
            positive += 1
            columns = a[2:, :2]
            a = a[2:, 2:] - columns @ np.linalg.solve(a[:2, :2], columns.T)
    return positive


def _without(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def leading_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, falling, of a symmetric matrix without negative ones, and their unit vectors as rows;
    fewer where the rest are zero to double precision. Of equal eigenvalues any orthogonal vectors of their space."""
    d = len(matrix)
    trace = float(np.trace(matrix)) if d else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((0, d))
    scale = float(np.abs(matrix).sum(axis=1).max())
    tiny = 8 * d * np.finfo(float).eps * scale
    rng = np.random.default_rng(7)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    counts: dict[float, int] = {0.0: d, scale * (1 + 1e-9) + tiny: 0}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    most = min(most, above(tiny))
    while len(values) < most:
        k = len(values) + 1  # the k-th largest: low < it <= high
        low = max(s for s, n in counts.items() if n >= k)
        high = min(s for s, n in counts.items() if n < k and s > low)
        while above(low) - above(high) > 1 and high - low > tiny:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        together = min(above(low), most) - len(values)  # more than one only where they are equal to double precision
        for _ in range(together):
            value, vector = _converge(matrix, low, high, vectors, rng, tiny, lambda s, k=k: above(s) >= k)
            values.append(value)
            vectors.append(vector)
        if together == 1 and not (above(values[-1] - tiny) >= k > above(values[-1] + tiny) or high - low <= tiny):
            raise ArithmeticError(f"eigenvalue {k} could not be certified")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors)[order]


def _converge(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], rng: np.random.Generator, tiny: float, holds_above) -> tuple[float, np.ndarray]:
    """The eigenpair between low and high: Rayleigh quotient iteration, from inverse iteration with the middle as shift.

    Where the quotient leaves the interval, this is halved by another count and the iteration begins anew.
    """
    v = _without(rng.standard_normal(len(matrix)), found)
    eye = np.eye(len(matrix))

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        try:
            w = np.linalg.solve(matrix - shift * eye, v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(matrix - (shift + tiny / 2) * eye, v)
        return _without(w, found)

    while True:
        for _ in range(3):
            v = solved((low + high) / 2, v)
        for _ in range(12):
            value = float(v @ matrix @ v)
            slack = tiny if high - low <= tiny else 0.0
            if not low - slack < value <= high + slack:
                break
            if np.linalg.norm(matrix @ v - value * v) <= tiny / 4:
                v = solved(value, v)  # one step more costs little and squares what is left
                return float(v @ matrix @ v), v
            v = solved(value, v)
        if high - low <= tiny:
            return float(v @ matrix @ v), v
        middle = (low + high) / 2
        low, high = (middle, high) if holds_above(middle) else (low, middle)


# --- sums over many tasks -------------------------------------------------------------------------------------------


def _tree_sum(parts: DataFrame, add: Callable[[bytes, bytes], bytes], fan: int = 16) -> dict[int, bytes]:
    """parts: key int, part long (from 0), value binary. The sum by key; parts meet `fan` at a time, in tasks, so that one
    value a key reaches the driver."""

    def added(table: pa.Table) -> pa.Table:
        total = reduce(add, (v.as_buffer().to_pybytes() for v in table.column("value")))
        return pa.table({"key": table.column("key")[:1], "part": table.column("part")[:1], "value": pa.array([total], pa.binary())})

    parts = staged(parts, "partial-sums")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        up = parts.withColumn("part", F.floor(F.col("part") / fan))
        parts = staged(up.groupBy("key", "part").applyInArrow(added, "key int, part long, value binary"), "partial-sums")
    return {r["key"]: bytes(r["value"]) for r in parts.collect()}


def _add_whole(a: bytes, b: bytes) -> bytes:
    return json.dumps([x + y for x, y in zip(json.loads(a), json.loads(b), strict=True)]).encode()


def _add_real(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


def _partial(batches: Iterator[pa.RecordBatch], take: Callable[[dict, pa.RecordBatch], None], pack: Callable) -> Iterator[pa.RecordBatch]:
    context, state = TaskContext.get(), {}
    for batch in batches:
        for rows in small_batches(batch, 4096):
            take(state, rows)
    if state:
        part = context.partitionId() if context else 0
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(state), pa.int32()), "part": pa.array([part] * len(state), pa.int64()), "value": pa.array([pack(v) for v in state.values()], pa.binary())})


_PARTIAL = "key int, part long, value binary"

# --- operators ------------------------------------------------------------------------------------------------------


def _whole_numbers(vectors: pa.Array, scale: float, offset: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the usable vectors and floor(scale * entry) + offset of each of their entries."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    real = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * real)
    bad = ~(np.abs(x) < _BIG)
    row = np.repeat(np.arange(len(lengths)), lengths)
    ok = (lengths > 0) & (np.bincount(row, weights=bad, minlength=len(lengths)) == 0)
    x = np.where(bad, 0, x).astype(np.int64) + offset
    begins, out = np.cumsum(lengths) - lengths, {}
    for d in np.unique(lengths[ok]).tolist():
        at = np.flatnonzero(ok & (lengths == d))
        out[d] = at, x[begins[at][:, None] + np.arange(d)]
    return out


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` entries of its vectors, one row at least, so that long vectors are few at a time."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class Whitening:
    """What the fit found: n, the sums S, the components with their eigenvalues, the trace and the error of the identity."""

    def __init__(self, d: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, error: float) -> None:
        self.d, self.n, self.sums, self.values, self.vectors, self.trace, self.error = d, n, sums, values, vectors, trace, error
        self.middle = [(2 * s + n) // (2 * n) if n else 0 for s in sums]  # rounded means
        self.rest = [s - n * m for s, m in zip(sums, self.middle, strict=True)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part is exact."""
        return (x - np.array(self.middle, dtype=np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where no long can hold it."""
        y = x - np.array(self.middle, dtype=np.int64)
        most = self.n * int(np.abs(y).max(initial=0)) + self.n
        if self.d * most * most < 1 << 63:
            z = self.n * y - np.array(self.rest, dtype=np.int64)
            return (z * z).sum(axis=1).tolist()
        sums = (sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in y.tolist())
        return [s if s < 1 << 63 else None for s in sums]


def fit_whitening(vectors: DataFrame, *, components: int = 16, scale: float = 64.0, offset: int = 1_000_000) -> Whitening | None:
    """Fit on every different vector x = floor(scale * embedding) + offset once; None if there is none.

    vectors: embedding (array of float or double); other columns are ignored. Rows whose vector is null or empty, or has null
    or non-finite entries (or such that no long can hold), are left out. Vectors of another length than most of the different
    ones have (ties: the shorter) are too. Directions without variance, to double precision, are no components. The fit list
    is stored once, its copies having met within tasks first; two more passes over it give the covariance, centred
    before multiplying, and the covariance of the whitened vectors.
    """
    one_thread(vectors.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (r for batch in batches for r in _slices(batch, 0)):
            for _, x in _whole_numbers(rows.column(0), scale, offset).values():
                yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, "<i8"))]).cast(pa.binary())], names=["x"])

    fit = staged(vectors.select("embedding").mapInArrow(packed, "x binary").distinct(), "whitening-fit-list")

    def matrices(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        raw = batch.column(0).to_pylist()
        by: dict[int, list[bytes]] = {}
        for r in raw:
            by.setdefault(len(r) // 8, []).append(r)
        return {d: np.frombuffer(b"".join(rows), dtype="<i8").reshape(-1, d) for d, rows in by.items()}

    def add_sums(state: dict, batch: pa.RecordBatch) -> None:
        for d, x in matrices(batch).items():
            sums = (x >> 31).sum(axis=0).tolist(), (x & _LOW).sum(axis=0).tolist()
            new = [len(x), *((high << 31) + low for high, low in zip(*sums, strict=True))]
            state[d] = [p + q for p, q in zip(state[d], new, strict=True)] if d in state else new

    found = _tree_sum(fit.mapInArrow(lambda b: _partial(b, add_sums, lambda v: json.dumps(v).encode()), _PARTIAL), _add_whole)
    if not found:
        return None
    sums = {d: json.loads(v) for d, v in found.items()}
    d = min(sums, key=lambda k: (-sums[k][0], k))
    n, total = sums[d][0], sums[d][1:]
    none = Whitening(d, n, total, np.zeros(0), np.zeros((0, d)), 0.0, 0.0)
    fit = fit.filter(F.octet_length("x") == 8 * d)

    def add_moments(of: Callable[[np.ndarray], np.ndarray]) -> Callable[[dict, pa.RecordBatch], None]:
        def take(state: dict, batch: pa.RecordBatch) -> None:
            y = of(matrices(batch)[d])
            state[d] = state.get(d, 0) + np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

        return take

    def covariance(of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        take = add_moments(of)
        moments = _tree_sum(fit.mapInArrow(lambda b: _partial(b, take, lambda v: v.tobytes()), _PARTIAL), _add_real)
        both = np.frombuffer(moments[d])
        mean = both[:size] / n
        v = both[size:].reshape(size, size) / n - np.outer(mean, mean)
        return (v + v.T) / 2

    middle = np.array(none.middle, dtype=np.int64)
    v = covariance(lambda x: (x - middle).astype(np.float64), d)  # centred on the rounded mean: whole numbers, exact
    values, axes = leading_eigenpairs(v, components)
    done = Whitening(d, n, total, values, axes, float(np.trace(v)), 0.0)
    if len(values):
        done.error = float(np.abs(covariance(done.whitened, len(values)) - np.eye(len(values))).max())
    return done


def whiten_embeddings(vectors: DataFrame, *, components: int = 16, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error for each usable row
    and component; see fit_whitening for what is usable.

    vectors: vec_id, embedding; other columns are ignored. n: different vectors; deviation: sum over dimensions of
    (n x - S)^2, exact (null where no long can hold it); whitened: x - S / n projected on the component, over the root of its
    eigenvalue; explained: the eigenvalue's share of the trace; identity_error: the largest entry of the whitened fit list's
    covariance minus the identity. A table without variance gives no rows. Repeated rows give theirs each.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fit_whitening(vectors, components=components, scale=scale, offset=offset)
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(fit.values)
        for batch in batches:
            for rows in _slices(batch, 1):
                at, x = _whole_numbers(rows.column(1), scale, offset).get(fit.d, (np.zeros(0, dtype=np.int64), np.zeros((0, fit.d), dtype=np.int64)))
                if len(at):
                    places = pa.array(np.repeat(at, m))
                    deviation = pa.array(fit.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), m)))
                    columns = [
                        rows.column(0).cast(pa.int64()).take(places),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * m, fit.n)),
                        deviation,
                        pa.array(fit.whitened(x).ravel()),
                        pa.array(np.tile(fit.values / fit.trace, len(at))),
                        pa.array(np.full(len(at) * m, fit.error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return vectors.select("vec_id", "embedding").mapInArrow(each, schema)

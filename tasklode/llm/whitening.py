"""Whitening of embeddings: covariance by Chan's merges, principal components, and a check of the identity.

Each partition keeps count, exact integer sums and the scatter about its own mean; a tree of pairwise
merges (Chan's formula) makes one state of them, whose size is that of a covariance matrix, whatever the
number of rows. The driver takes the eigenvectors. A second pass over all rows merges the covariance of
what was whitened in the same way and holds it against the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
_SAFE = 1 << 62
#: Vectors of one step, so that temporaries stay small whatever the batch.
STEP_ROWS = 4096


def quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and their entries as longs, a row each.

    A vector that is null or holds a null, infinite or undefined entry isn't kept. Kept vectors of
    different lengths, or an entry that no long can hold, are an error.
    """
    there = np.asarray(column.is_valid())
    lists = column.filter(column.is_valid())
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.bincount(owner[~np.isfinite(flat)], minlength=len(sizes)) == 0
    there[np.flatnonzero(there)[~whole]] = False
    dims = np.unique(sizes[whole])
    if len(dims) > 1:
        raise ValueError(f"vectors of {dims[0]} and of {dims[-1]} entries")
    if not len(dims):
        return there, np.zeros((0, 0), np.int64)
    scaled = np.floor(SCALE * flat[whole[owner]])
    if len(scaled) and np.abs(scaled).max() >= _SAFE:
        raise ValueError("an entry is too large for a long")
    return there, scaled.astype(np.int64).reshape(int(whole.sum()), dims[0]) + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns, whatever their size."""
    if len(x) and int(np.abs(x).max()) * len(x) >= _SAFE:
        x = x.astype(object)
    return [int(s) for s in x.sum(0)]


#: (count, sums of the columns, scatter about the mean); sums are exact integers or doubles.
State = tuple[int, list, np.ndarray]


def state_of(x: np.ndarray, sums: list | None = None) -> State:
    """Of rows at hand."""
    sums = x.sum(0).tolist() if sums is None else sums
    centred = x - np.array([s / len(x) for s in sums])
    return len(x), sums, centred.T @ centred


def merge(a: State | None, b: State | None) -> State | None:
    """Chan's formula for two disjoint sets of rows; None has no rows."""
    if a is None or b is None:
        return a if b is None else b
    if len(a[1]) != len(b[1]):
        raise ValueError(f"vectors of {len(a[1])} and of {len(b[1])} entries")
    n = a[0] + b[0]
    apart = np.array([y / b[0] - x / a[0] for x, y in zip(a[1], b[1], strict=True)])
    return n, [x + y for x, y in zip(a[1], b[1], strict=True)], a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])


def reduced(states: DataFrame) -> State | None:
    """The merge of all rows of (state), over a tree of tasks; None if no partition had rows."""
    parts = states.rdd.mapPartitions(lambda found: [reduce(merge, map(_loaded, found), None)])
    return parts.treeReduce(merge) if parts.getNumPartitions() else None


def _dumped(state: State | None) -> Iterator[pa.RecordBatch]:
    if state is not None:
        yield pa.RecordBatch.from_pydict({"n": [state[0]], "sums": [[repr(s) for s in state[1]]], "scatter": [np.ascontiguousarray(state[2]).tobytes()]}, _STATE)


def _loaded(row) -> State:
    sums = [float(s) if "." in s or "e" in s or "n" in s else int(s) for s in row["sums"]]
    return row["n"], sums, np.frombuffer(row["scatter"], np.float64).reshape(len(sums), len(sums))


_STATE = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("scatter", pa.binary())])
STATE = "n long, sums array<string>, scatter binary"


@dataclass(frozen=True)
class Whitening:
    """What a fit found: components are rows, by falling eigenvalue; scales are 1 / sqrt(eigenvalue), or 0 where it is 0."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    scales: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S / n with one rounding, and the exact sums of (n x - S) ** 2 of each row."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < _SAFE else object
        apart = self.n * x.astype(kind) - np.array(self.sums, kind)
        squares = apart if kind is object or most * most * max(1, len(self.sums)) < _SAFE else apart.astype(object)
        return (apart / self.n).astype(np.float64), [int(s) for s in (squares * squares).sum(1)]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.components * self.scales[:, None]).T


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(start, STEP_ROWS)


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of all kept vectors of ``rows``; None if there are none.

    Null vectors and those with null or non-finite entries are left out, repeated rows count each time.
    An eigenvalue that rounding can't tell from 0 (few rows, constant or dependent entries) is 0. Ties
    between eigenvalues fall as the solver leaves them, for all rows alike.
    """

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for part in _steps(batches):
            x = quantised(part.column("vector"))[1]
            if x.size:
                state = merge(state, state_of(x, exact_sums(x)))
        yield from _dumped(state)

    state = reduced(_vectors(rows, vector_col).mapInArrow(states, STATE))
    if state is None:
        return None
    covariance = state[2] / state[0]
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    noise = max(0.0, values.max()) * len(values) * np.finfo(float).eps
    kept = np.where(values[order] > noise, values[order], 0.0)
    scales = np.divide(1.0, np.sqrt(kept), out=np.zeros_like(kept), where=kept > 0)
    return Whitening(state[0], state[1], vectors[:, order].T.copy(), kept, scales, float(np.trace(covariance)))


def _vectors(rows: DataFrame, vector_col: str, id_col: str | None = None) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>").alias("vector")
    return rows.select(*([F.col(id_col).cast("long").alias("vec_id")] if id_col else []), vector)


def identity_error(rows: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the covariance of what ``model`` whitens, less the identity: a pass over all rows.

    Components without variance have no whitened values and don't count; 0 if none is left.
    """
    live = model.scales > 0

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for part in _steps(batches):
            x = quantised(part.column("vector"))[1]
            if x.size:
                state = merge(state, state_of(model.whitened(model.centred(x)[0])[:, live]))
        yield from _dumped(state)

    if not live.any():
        return 0.0
    n, _, scatter = reduced(_vectors(rows, vector_col).mapInArrow(states, STATE))
    return float(np.abs(scatter / n - np.eye(len(scatter))).max())


_ROWS = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened) of each kept vector, one row per input row, in any order.

    ``deviation`` is the exact sum of (n x - S) ** 2, ``whitened`` has a value for each component, null
    where the component has no variance. A null id is kept, further columns aren't.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dead = np.flatnonzero(model.scales == 0)
        for part in _steps(batches):
            there, x = quantised(part.column("vector"))
            if not x.size:
                continue
            centred, deviations = model.centred(x)
            values = model.whitened(centred)
            empty = np.zeros(values.shape, bool)
            empty[:, dead] = True
            ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), mask=empty.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id").filter(pa.array(there)), pa.array(deviations, pa.decimal128(38, 0)), lists], schema=_ROWS)

    return _vectors(rows, vector_col, id_col).mapInArrow(out, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each kept vector and component.

    Components are numbered from 1. ``explained`` is the component's share of the variance (0 if there is
    none), ``identity_error`` the measure of ``identity_error``. No kept vectors, no rows; neither do vectors
    without entries have any.
    """
    model = fit(rows, vector_col, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], WHITENED)
    error = identity_error(rows, model, vector_col)
    explained = (model.eigenvalues / model.trace if model.trace > 0 else np.zeros(len(model.eigenvalues))).tolist()
    shares = F.array(*map(F.lit, explained))
    told = transform(rows, model, id_col, vector_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return told.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

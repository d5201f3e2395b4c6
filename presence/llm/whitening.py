"""Whitening of embedding vectors by spectrum slicing.

Entries become whole numbers x = floor(64 c) + 1000000. The fit list holds
each distinct x vector once. Its sums are exact whole numbers, and so are its
second moments: they are centred at the sums' nearest whole mean before
multiplying, added as decimals and corrected to the true mean in whole
numbers, so the covariance is the correctly rounded one, whatever the order
in which tasks end.

The covariance is one d x d matrix. Bunch and Kaufman's LDLt of V - sI has as
many negative pivots as V has eigenvalues below s: bisection on such counts
gives each leading eigenvalue an interval of its own, Rayleigh quotient
iteration started in it converges cubically, and two more counts just beside
the value found certify its number. Values that no double tells apart keep
one interval, whose vectors are orthogonal to each other.

Nulls: rows whose vector is null or holds a null or non-finite entry (or one
beyond 2^45, which has no exact place in the sums) are dropped, and so are
vectors of another length than most (the shorter at a tie; length 0 never
counts). A null id is kept. Repeated rows give repeated rows. Components
without variance cannot be scaled and are not returned: equal vectors, one
vector and empty tables give no rows. A deviation that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.llm.textkit import stored

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**45
COMPONENTS = 16
ROWS = 1 << 14
EPS = float(np.finfo(float).eps)
# Share of an LDLt pivot against its column, Bunch and Kaufman's choice.
PIVOT = (1 + 17**0.5) / 8

SUMS = "k int, v decimal(38,0)"
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list; unit vectors (rows), their values, the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - mean) - rest) @ (self.vectors / np.sqrt(self.values)[:, None]).T


# -- vectors in tasks ---------------------------------------------------------


def _entries(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their entries as (rows, size) x - SHIFT."""
    lengths = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    value = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    with np.errstate(over="ignore"):
        value = np.floor(value * SCALE)
    begin = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    rows = np.flatnonzero(lengths == size)
    y = value[begin[rows][:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))
    good = (np.abs(y) <= LARGEST).all(axis=1)
    return rows[good], y[good].astype(np.int64)


def _packed(y: np.ndarray) -> pa.Array:
    """Equal vectors as equal bytes: entries in the least width that holds them."""
    most = np.abs(y).max(axis=1) if y.size else np.zeros(0, np.int64)
    parts = []
    for low, high, kind in ((-1, 127, "<i1"), (127, 32767, "<i2"), (32767, 2**31 - 1, "<i4"), (2**31 - 1, 2**62, "<i8")):
        some = np.ascontiguousarray(y[(most > low) & (most <= high)].astype(kind))
        if len(some):
            offsets = np.arange(len(some) + 1, dtype=np.int32) * some[0].nbytes
            parts.append(pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(some)]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def _unpacked(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    lengths = pc.binary_length(col).to_numpy()
    for width in np.unique(lengths):
        for cells in np.array_split(np.flatnonzero(lengths == width), -(-int((lengths == width).sum()) // ROWS)):
            raw = b"".join(col.take(pa.array(cells)).to_pylist())
            yield np.frombuffer(raw, f"<i{width // size}").reshape(-1, size).astype(np.int64)


def _gram(z: np.ndarray) -> np.ndarray:
    """Exact products of whole columns, upper triangle, as Python integers:
    in doubles while every partial sum is below 2^53, else digit by digit."""
    most = int(np.abs(z).max(initial=0))
    upper = np.triu_indices(z.shape[1])
    if most >> 26:
        high, low = z >> 24, z & ((1 << 24) - 1)
        a, c = _gram(high), _gram(low)
        both = _gram(high + low)  # (h + l)(h + l)' = hh' + hl' + lh' + ll'
        return a * (1 << 48) + (both - a - c) * (1 << 24) + c
    step = max(1, (1 << 53) // max(1, most * most))
    total = np.zeros(len(upper[0]), object)
    for k in range(0, len(z), step):
        part = z[k : k + step].astype(np.float64)
        total = total + (part.T @ part)[upper].astype(np.int64).astype(object)
    return total


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _totals(fit: DataFrame, size: int, centre: list[int] | None) -> dict[int, int]:
    """Exact sums over the fit list: of rows (-1) and entries, or of the
    products of centred entries. One row a task and place, added by Spark."""

    def run(batches):
        total, n = None, 0
        for batch in batches:
            for y in _unpacked(batch.column(0), size):
                part = y.sum(axis=0).astype(object) if centre is None else _gram(y - np.array(centre, np.int64))
                total = part if total is None else total + part
                n += len(y)
        if total is not None:
            rows = [n, *total] if centre is None else total
            first = -1 if centre is None else 0
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows), dtype=np.int32)), _decimals(rows)], names=["k", "v"])

    rows = fit.mapInArrow(run, SUMS).groupBy("k").agg(F.sum("v").alias("v")).collect()  # size, or its square
    return {r["k"]: int(r["v"]) for r in rows}


# -- the spectrum -------------------------------------------------------------


def below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` lie below ``shift``: negative pivots of
    LDLt, with 2 x 2 pivots where a diagonal one would be too small."""
    a = v - shift * np.eye(len(v))
    count, k, n = 0, 0, len(v)
    while k < n:
        column = np.abs(a[k + 1 :, k])
        big = column.max(initial=0.0)
        two, swap = False, k
        if abs(a[k, k]) < PIVOT * big:
            r = k + 1 + int(column.argmax())
            other = np.abs(a[r, k:])
            other[r - k] = 0.0
            most = other.max()
            if abs(a[k, k]) * most < PIVOT * big * big:
                two = abs(a[r, r]) < PIVOT * most
                swap = r
        to = k + two
        if swap != to:
            a[[to, swap]] = a[[swap, to]]
            a[:, [to, swap]] = a[:, [swap, to]]
        if two:
            block = a[k : k + 2, k : k + 2].copy()
            side = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(block, side.T)
            count += 1  # its determinant is negative: one value on each side
            k += 2
        else:
            pivot = a[k, k]
            if pivot == 0.0:
                pivot = EPS * max(np.abs(v).max(), abs(shift), np.finfo(float).tiny)
            side = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(side, side / pivot)
            count += pivot < 0
            k += 1
    return count


def slices(v: np.ndarray, wanted: int, least: float) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last): intervals from the top down that hold the
    eigenvalues numbered first to last, one each unless no narrower interval
    parts them; none below ``least``."""
    d = len(v)
    radius = float(np.abs(v).sum(axis=1).max()) * (1 + 4 * d * EPS) + np.finfo(float).tiny
    above = {least: d - below(v, least), radius: 0}  # values at or above the point
    wanted = min(wanted, above[least])
    done, open_ = [], [(least, radius)]
    while open_:
        low, high = open_.pop()
        first, last = above[high] + 1, above[low]
        if first > last or first > wanted:
            continue
        # one value, and an interval narrow beside its distance to the next
        if (first == last and high - low <= 1e-3 * max(abs(low), abs(high))) or high - low <= 8 * d * EPS * radius:
            done.append((low, high, first, last))
            continue
        middle = low + (high - low) / 2
        if not low < middle < high:
            done.append((low, high, first, last))
            continue
        above[middle] = d - below(v, middle)
        open_ += [(low, middle), (middle, high)]  # the upper half comes first
    return sorted(done, key=lambda x: x[2])


def _solved(v: np.ndarray, shift: float, q: np.ndarray, scale: float) -> np.ndarray:
    for k in (0, 1, 2, 4, 8):
        try:
            z = np.linalg.solve(v - (shift + k * EPS * scale) * np.eye(len(v)), q)
        except np.linalg.LinAlgError:
            continue
        norm = np.linalg.norm(z)
        if np.isfinite(norm) and norm > 0:
            return z / norm
    raise ArithmeticError("the shifted covariance stays singular")


def _vector(v: np.ndarray, shift: float, near: list[np.ndarray], number: int, scale: float) -> tuple[float, float, np.ndarray]:
    """(residual, value, unit vector) that inverse iteration at ``shift`` and
    then Rayleigh quotients lead to, orthogonal to ``near``."""

    def clean(z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for x in near:
                z = z - (x @ z) * x
        return z / np.linalg.norm(z)

    q, best = clean(np.random.default_rng(number).standard_normal(len(v))), None
    for step in range(16):
        q = clean(_solved(v, shift, q, scale))
        e = float(q @ v @ q)
        error = float(np.linalg.norm(v @ q - e * q))
        if best is not None and step > 3 and error >= best[0]:
            break  # no smaller residual: as exact as doubles are
        best = (error, e, q) if best is None or error < best[0] else best
        shift = e if step > 0 else shift
    return best


def leading(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above rounding, falling, and their unit vectors
    as rows; each number certified by counts beside the value."""
    d, scale = len(v), float(np.abs(v).sum(axis=1).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(0), np.zeros((0, d))
    slack = 64 * d * EPS * scale
    found: list[tuple[float, np.ndarray]] = []
    for low, high, first, last in slices(v, wanted, 16 * d * EPS * scale):
        group: list[tuple[float, np.ndarray]] = []
        for number in range(first, last + 1):
            while True:
                near = [x for e, x in found + group if e - high <= 1e-2 * scale]
                error, e, q = _vector(v, low + (high - low) / 2, near, number, scale)
                if (error <= slack and low - slack <= e <= high + slack) or high - low <= slack:
                    break
                # a neighbour stands nearer to the middle than the value sought
                middle = low + (high - low) / 2
                low, high = (middle, high) if d - below(v, middle) >= number else (low, middle)
            group.append((e, q))
        group.sort(key=lambda x: -x[0])
        if d - below(v, group[0][0] + slack) > first - 1 or d - below(v, group[-1][0] - slack) < last:
            raise ArithmeticError(f"eigenvalues {first} to {last} fail their counts")
        found += group
    found = found[:wanted]
    return np.array([e for e, _ in found]), np.array([q for _, q in found]).reshape(-1, d)


# -- fit and apply ------------------------------------------------------------


def dimension(vectors: DataFrame, column: str) -> int:
    """The commonest length above 0, the shorter at a tie; 0 without any."""
    size = F.size(column).alias("d")
    rows = vectors.select(size).filter("d > 0").groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows[0]["d"] if rows else 0


def fit_list(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """(x binary): each distinct vector once."""

    def run(batches):
        for batch in batches:
            _, y = _entries(batch.column(0), size)
            for k in range(0, len(y), ROWS):
                yield pa.RecordBatch.from_arrays([_packed(y[k : k + ROWS])], names=["x"])

    return vectors.select(F.col(column).cast("array<double>")).mapInArrow(run, "x binary").distinct()


def fit(rows: DataFrame, size: int, wanted: int = COMPONENTS) -> Whitening | None:
    """The whitening of a stored fit list; None where no component varies."""
    sums = _totals(rows, size, None)
    n = sums.pop(-1, 0)
    if not n:
        return None
    s = [sums[k] for k in range(size)]
    centre = [(2 * x + n) // (2 * n) for x in s]
    rest = [x - n * c for x, c in zip(s, centre, strict=True)]
    products = _totals(rows, size, centre)
    v = np.zeros((size, size))
    trace = 0
    for k, (i, j) in enumerate(zip(*np.triu_indices(size), strict=True)):
        exact = n * products[k] - rest[i] * rest[j]  # n squared times the covariance
        v[i, j] = v[j, i] = exact / (n * n)
        trace += exact if i == j else 0
    values, q = leading(v, wanted)
    if not len(values):
        return None
    return Whitening(n, [x + n * SHIFT for x in s], q, values, trace / (n * n))


def identity_error(rows: DataFrame, size: int, model: Whitening) -> float:
    """Largest entry of the fit list's whitened covariance minus the identity."""
    m = len(model.values)
    upper = np.triu_indices(m)

    def run(batches):
        n, mean, square = 0, np.zeros(m), np.zeros((m, m))
        for batch in batches:
            for y in _unpacked(batch.column(0), size):
                w = model.project(y + SHIFT)
                n, mean = n + len(w), mean + w.sum(axis=0)
                square = square + w.T @ w  # w is centred: x - S/n, projected
        if n:
            values = np.r_[mean, square[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["k", "v"])

    total = {r["k"]: r["v"] for r in rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([total[k] for k in range(m)]) / model.n
    square = np.array([total[m + k] for k in range(len(upper[0]))]) / model.n
    return float(np.abs(square - mean[upper[0]] * mean[upper[1]] - (upper[0] == upper[1])).max())


def whiten(vectors: DataFrame, id_: str = "vec_id", column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of
    every remaining row and component."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_].dataType.simpleString()
    size = dimension(vectors, column)
    rows = stored(fit_list(vectors, column, size), "fit") if size else None
    model = fit(rows, size, wanted) if size else None
    if model is None:
        return spark.createDataFrame([], f"{id_} {kind}, {OUT}")
    error = identity_error(rows, size, model)
    m, sums = len(model.values), model.sums

    def run(batches):
        for batch in batches:
            at, y = _entries(batch.column(1), size)
            for k in range(0, len(y), ROWS // m + 1):
                some, x = at[k : k + ROWS // m + 1], y[k : k + ROWS // m + 1] + SHIFT
                n = len(x)
                out = {
                    id_: batch.column(0).take(pa.array(np.repeat(some, m))),
                    "component": pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)),
                    "n": pa.array(np.full(n * m, model.n)),
                    "deviation": _deviations(x, model.n, sums).take(pa.array(np.repeat(np.arange(n), m))),
                    "whitened": pa.array(model.project(x).ravel()),
                    "explained": pa.array(np.tile(model.values / model.trace, n)),
                    "identity_error": pa.array(np.full(n * m, error)),
                }
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return vectors.select(id_, F.col(column).cast("array<double>")).mapInArrow(run, f"{id_} {kind}, {OUT}")


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x - S)^2; null beyond a long."""
    if int(np.abs(x).max(initial=0)) * n + max(map(abs, sums)) < 1 << 63:
        z = n * x - np.array(sums, np.int64)
    else:
        z = n * x.astype(object) - np.array(sums, object)
    near = int(np.abs(z).max(initial=0))
    if x.shape[1] * near * near < 1 << 63:
        z = z.astype(np.int64)
        return pa.array((z * z).sum(axis=1))
    z = z.astype(object)
    return pa.array([int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1)], pa.int64())

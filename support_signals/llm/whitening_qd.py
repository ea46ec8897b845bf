"""Operator 12: embedding whitening by a bidiagonal qd solver.

Entries are read as integers ``x = floor(1024 * c) + 100000``, so sums and deviations are exact.  With the per-dimension
sums known, one pass reduces the centred rows by blockwise QR; triangular factors are stacked and reduced again, some at a
time, until one is left (its size is that of the dimension, whatever the number of rows).  Householder reflections make it
bidiagonal, dqds finds the singular values to high relative accuracy, and twisted factorisations of ``B'B - s^2`` give the
singular vectors, which the reflections carry back to the components.  ``s^2 / n`` are the eigenvalues of the covariance.
A last pass measures the covariance of the whitened rows.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; vectors of another length than
most have (ties: the longer) and empty ones are dropped too; entries beyond 2^52 count as 2^52; components whose eigenvalue
is zero up to rounding (below ``d * eps`` of the largest) cannot be whitened and have no rows; a deviation that a long
cannot hold is null; null and repeated ids are kept as they are, row by row; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table

SCALE = 1024
SHIFT = 100_000
LARGEST = 2.0**52
COMPONENTS = 8
#: Entries of the rows that one QR takes, and triangular factors that one task stacks.
BLOCK = 1 << 20
FAN_IN = 32
EPS = np.finfo(np.float64).eps


def valid(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x): the remaining rows as integers."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(finite).select(F.col(key).alias("vec_id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows.select("vec_id", F.col("v").cast("array<bigint>").alias("x"))
    scaled = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))).cast("bigint") + SHIFT)
    return rows.where(F.size("v") == sizes[0]["d"]).select("vec_id", scaled.alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the exact per-dimension sums; tasks add their own rows in Python integers first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            top, rest = x >> 24, x & 0xFFFFFF         # both halves of a batch add up within 64 bits
            top, rest = top.sum(axis=0), rest.sum(axis=0)
            n += len(x)
            s = [(int(a) << 24) + int(b) for a, b in zip(top, rest)]
            total = s if total is None else [a + b for a, b in zip(total, s)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()),
                                              pa.array([str(s) for s in total])], names=["n", "at", "s"])

    parts = rows.select("x").mapInArrow(run, "n bigint, at int, s string")
    got = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return (int(got[0]["n"]), [int(r["s"]) for r in got]) if got else (0, [])


def _packed(tables: Iterator[np.ndarray]) -> np.ndarray | None:
    """R of all the given rows, reduced block by block."""
    r = None
    for x in tables:
        if len(x):
            r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
    return r


def triangular_factor(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R with R'R = the centred rows' cross products, reduced in a tree of tasks of ``FAN_IN`` factors."""
    d = len(sums)
    # S / n as a whole part and a rest, so that centring does not round
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            x = matrix(batch.column(0))
            for lo in range(0, len(x), max(1, BLOCK // d)):
                yield (x[lo:lo + max(1, BLOCK // d)] - whole).astype(np.float64) - rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _packed(blocks(batches))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def reduce(table: pa.Table) -> pa.Table:
        r = _packed(np.frombuffer(v, dtype=np.float64).reshape(-1, d) for v in table["r"].to_pylist())
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors = write_table(rows.select("x").mapInArrow(run, "part bigint, r binary"), "triangular-factors")
    parts = factors.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        factors = factors.groupBy(F.expr(f"part div {FAN_IN}").alias("node")).applyInArrow(reduce, "part bigint, r binary")
        parts = -(-parts // FAN_IN)
    (row,) = factors.collect()
    return np.frombuffer(row["r"], dtype=np.float64).reshape(-1, d)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B = U'RW, and W (Golub and Kahan's Householder reflections from both sides)."""
    d = r.shape[1]
    a = np.zeros((d, d))
    a[:len(r)] = r
    w = np.eye(d)

    def reflect(x: np.ndarray) -> tuple[np.ndarray, float]:
        v, norm = x.copy(), np.linalg.norm(x)
        if norm == 0:
            return v, 0.0
        v[0] += np.copysign(norm, x[0])
        return v, 2.0 / (v @ v)

    for k in range(d):
        v, b = reflect(a[k:, k])
        a[k:, k:] -= np.outer(b * v, v @ a[k:, k:])
        if k < d - 2:
            v, b = reflect(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ v, b * v)
            w[:, k + 1:] -= np.outer(w[:, k + 1:] @ v, b * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _safe_shift(q: np.ndarray, e: np.ndarray) -> float:
    """Laguerre's step from 0 towards the smallest eigenvalue of the qd array: never beyond it, and close to it soon.

    The sums of 1/x and 1/x^2 over the eigenvalues come from the pivots of the unshifted transform and their first two
    derivatives by the shift."""
    m = len(q)
    t, t1, t2 = q[0], -1.0, 0.0
    first = second = 0.0
    for i in range(m):
        pivot = t + (e[i] if i < m - 1 else 0.0)
        if not pivot > 0:
            return 0.0
        x, y = t1 / pivot, t2 / pivot
        first -= x
        second += x * x - y
        if i < m - 1:
            f, g = e[i] / pivot, q[i + 1] / pivot
            t, t1, t2 = t * g, g * f * t1 - 1.0, g * f * (t2 - 2.0 * t1 * x)
    step = m / (first + np.sqrt(max(0.0, (m - 1) * (m * second - first * first))))
    return step if np.isfinite(step) and step > 0 else 0.0


def _qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """The array of the shifted matrix, or None where an entry would not be positive."""
    m = len(q)
    nq, ne, t = np.empty(m), np.empty(m - 1), q[0] - shift
    for i in range(m - 1):
        nq[i] = t + e[i]
        if not (t >= 0 and nq[i] > 0):
            return None
        ratio = q[i + 1] / nq[i]
        ne[i], t = e[i] * ratio, t * ratio - shift
    nq[m - 1] = t
    return (nq, ne) if t >= 0 and np.isfinite(ne).all() else None


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of an upper bidiagonal matrix (Fernando and Parlett's shifted quotient-difference
    steps).  Arrays fall apart where an off-diagonal entry is negligible; a shift that proves too large is made smaller."""
    out: list[float] = []
    work = [(diagonal.astype(np.float64) ** 2, upper.astype(np.float64) ** 2, 0.0)]
    small = (10 * EPS) ** 2
    while work:
        q, e, moved = work.pop()
        for _ in range(1000):
            m = len(q)
            if m == 1:
                out.append(moved + q[0])
                break
            cut = np.flatnonzero(e <= small * (moved + np.minimum(q[:-1], q[1:])))
            if len(cut):
                for lo, hi in zip(np.append(0, cut + 1), np.append(cut + 1, m)):
                    work.append((q[lo:hi], e[lo:hi - 1], moved))
                break
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()          # values come off at the smaller end
            shift = _safe_shift(q, e)
            done = _qd_step(q, e, shift)
            while done is None:
                if shift == 0:
                    raise ArithmeticError("a qd array has an entry that is not positive")
                shift = shift * 0.999 if shift > EPS * (moved + q.max()) else 0.0
                done = _qd_step(q, e, shift)
            (q, e), moved = done, moved + shift
        else:
            raise ArithmeticError("qd steps did not converge")
    return np.sort(np.array(out))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, square: float) -> np.ndarray:
    """Unit eigenvector of B'B for the eigenvalue ``square``: the stationary transform from the top and the progressive one
    from the bottom meet at the row where the twisted factorisation leaves the smallest pivot."""
    m = len(diagonal)
    q, e = diagonal**2, upper**2
    tiny = EPS * EPS * max(float(q.max()), 1e-300)
    # B'B = LDL' with D = q and L's entries b / a; shifted factors from the top ...
    s, plus = np.empty(m), np.empty(m - 1)
    s[0] = -square
    for i in range(m - 1):
        dp = s[i] + q[i]
        dp = dp if abs(dp) > tiny else -tiny
        plus[i] = diagonal[i] * upper[i] / dp
        s[i + 1] = s[i] * e[i] / dp - square
    # ... and from the bottom
    p, minus = np.empty(m), np.empty(m - 1)
    p[m - 1] = q[m - 1] - square
    for i in range(m - 2, -1, -1):
        dm = e[i] + p[i + 1]
        dm = dm if abs(dm) > tiny else -tiny
        minus[i] = diagonal[i] * upper[i] / dm
        p[i] = p[i + 1] * q[i] / dm - square
    gamma = s + p + square
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(m)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(k, m - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def components_of(r: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues of R'R, components as columns, trace), by falling eigenvalue; no more than ``wanted``, none of value zero.

    Where off-diagonal entries vanish B falls into blocks, each solved by itself.  Vectors of values that lie close together
    are made orthogonal among themselves by inverse iteration on the twisted start vectors."""
    a, b, w = bidiagonal(r)
    d = len(a)
    size = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    if size == 0:
        return np.zeros(0), np.zeros((d, 0)), 0.0
    a, b = a / size, b / size
    # a zero on the diagonal is a rounding away: B'B then has a zero eigenvalue, which is left out below
    a = np.where(np.abs(a) < EPS * EPS, EPS * EPS, a)
    ends = [i + 1 for i in range(d - 1) if abs(b[i]) <= EPS * min(abs(a[i]), abs(a[i + 1]))] + [d]
    found = []
    lo = 0
    for hi in ends:
        q, u = a[lo:hi], b[lo:hi - 1]
        t = np.diag(q**2) + np.diag(np.append(0.0, u**2)) + np.diag(q[:-1] * u, 1) + np.diag(q[:-1] * u, -1)
        near: list[tuple[float, np.ndarray]] = []
        for value in dqds(q, u):
            z = twisted(q, u, value) if hi - lo > 1 else np.ones(1)
            near = [(x, v) for x, v in near if x - value <= 1e-7 * x]
            if near:
                close = np.array([v for _, v in near])
                for step in range(3):
                    z = z - close.T @ (close @ z)
                    if np.linalg.norm(z) < 1e-3:
                        z = np.random.default_rng(len(near) + step).standard_normal(hi - lo)
                        z -= close.T @ (close @ z)
                    z = np.linalg.solve(t - (value + 4 * EPS * t.max()) * np.eye(hi - lo), z / np.linalg.norm(z))
                    z /= np.linalg.norm(z)
                for _ in range(2):
                    z -= close.T @ (close @ z)
                    z /= np.linalg.norm(z)
            near.append((value, z))
            full = np.zeros(d)
            full[lo:hi] = z
            found.append((value, w @ full))
        lo = hi
    found.sort(key=lambda x: -x[0])
    trace = sum(v for v, _ in found)
    keep = [(v, z) for v, z in found[:wanted] if v > d * EPS * found[0][0]]
    return np.array([v for v, _ in keep]) * size**2, np.array([z for _, z in keep]).T.reshape(d, -1), trace * size**2


def whitened_rows(rows: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): per row the exact deviation and its projections over the square roots of the eigenvalues."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    left = [s % n for s in sums]
    rest = np.array([s / n for s in left])
    directions = vectors / np.sqrt(values)
    kind = rows.schema["vec_id"].dataType.simpleString()
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            y = x - whole
            far = int(np.abs(y).max()) + 1
            if far * n < 2**31 and d * (far * n) ** 2 < 2**63:
                dev = ((n * y - np.array(left, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                dev = [sum((n * int(v) - s) ** 2 for v, s in zip(row, left)) for row in y]
                dev = [v if v < 2**63 else None for v in dev]
            w = (y.astype(np.float64) - rest) @ directions
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dev, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))],
                names=["vec_id", "deviation", "w"])

    return rows.mapInArrow(run, f"vec_id {kind}, deviation bigint, w array<double>")


def covariance_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of column w, minus the identity.

    Tasks centre their rows before they multiply; (count, mean, cross products) are then merged, some tasks at a time."""
    def merge(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, cross = 0, np.zeros(k), np.zeros((k, k))
        for m, other, c in parts:
            gap = other - mean
            cross = cross + c + np.outer(gap, gap) * (n * m / (n + m))
            mean = mean + gap * (m / (n + m))
            n += m
        return n, mean, cross

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            w = matrix(batch.column(0))
            if len(w):
                mean = w.mean(axis=0)
                yield len(w), mean, (w - mean).T @ (w - mean)

    def pack(n: int, mean: np.ndarray, cross: np.ndarray, part: int) -> dict:
        return {"part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64()), "m": pa.array([mean.tobytes()], pa.binary()),
                "c": pa.array([cross.tobytes()], pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, cross = merge(of(batches))
        if n:
            yield pa.RecordBatch.from_pydict(pack(n, mean, cross, TaskContext.get().partitionId()))

    def unpack(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n, m, c in zip(table["n"].to_pylist(), table["m"].to_pylist(), table["c"].to_pylist()):
            yield n, np.frombuffer(m, dtype=np.float64), np.frombuffer(c, dtype=np.float64).reshape(k, k)

    schema = "part bigint, n bigint, m binary, c binary"
    parts = write_table(white.select("w").mapInArrow(run, schema), "covariance-parts")
    level = parts.agg(F.max("part")).first()[0] + 1
    while level > 1:
        parts = parts.groupBy(F.expr(f"part div {FAN_IN}").alias("node")).applyInArrow(
            lambda t: pa.table(pack(*merge(unpack(t)), t["part"][0].as_py() // FAN_IN)), schema)
        level = -(-level // FAN_IN)
    n, _, cross = merge(unpack(parts.toArrow()))
    return float(np.abs(cross / n - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = write_table(valid(vectors, column, key), "vectors")
    n, sums = totals(rows)
    values = np.zeros(0)
    if n:
        values, directions, trace = components_of(triangular_factor(rows, n, sums), components)
    if not len(values):
        kind = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    white = write_table(whitened_rows(rows, n, sums, values / n, directions), "whitened")
    error = covariance_error(white, len(values))
    share = F.array(*[F.lit(float(v / trace)) for v in values])
    return (white.select("vec_id", F.posexplode("w").alias("at", "whitened"), "deviation")
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))

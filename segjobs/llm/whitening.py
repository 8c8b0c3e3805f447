"""Whitening directions of embeddings by a bidiagonal qd solver.

The centred rows X of the fit list are reduced by QR factorisations, block after block in each task and then over tasks
in a tree, to one triangle R with R'R = X'X; X'X itself, which squares the spread of scales, is never formed.
Householder reflections make R bidiagonal. The differential qd algorithm with shifts (dqds) finds the singular values to
high relative accuracy, and twisted factorisations of the bidiagonal's square, shifted by each value, give the
directions.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.llm import base

COMPONENTS = 4
SCALE = 256
EPS = np.finfo(np.float64).eps
#: Rows of a block of the QR reduction, and bytes of triangles that one task reduces at a time.
BLOCK, FAN_BYTES = 4096, 64 << 20


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V' for some orthogonal U: Householder reflections from both sides."""
    a, d = np.array(r, np.float64), len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        u, norm = x.copy(), float(np.linalg.norm(x))
        if norm == 0 or not x[1:].any():
            return u, 0.0
        u[0] += norm if u[0] >= 0 else -norm
        return u, 2 / float(u @ u)

    for k in range(d):
        u, t = reflector(a[k:, k])
        if t:
            a[k:, k:] -= t * np.outer(u, u @ a[k:, k:])
        if k < d - 2:
            u, t = reflector(a[k, k + 1 :])
            if t:
                a[k:, k + 1 :] -= t * np.outer(a[k:, k + 1 :] @ u, u)
                v[:, k + 1 :] -= t * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal, descending, by dqds: each sweep factors anew with a shift below
    the least value left. One over the sum of all reciprocal values is a lower bound of it, which nears it
    quadratically; a shift just below an upper bound is tried first, as values in a cluster need, and given up if a
    pivot is negative."""
    found: list[float] = []
    todo = [((diagonal**2).tolist(), (above**2).tolist(), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        for _ in range(200 + 20 * len(q)):
            n = len(q)
            small = [
                k
                for k in range(n - 1)
                if e[k] <= EPS**2 * (sigma + min(q[k], q[k + 1])) or e[k] * q[k] <= (
                    2 * EPS * (sigma + min(q[k], q[k + 1]))
                ) ** 2
            ]
            if small or n == 1:  # the parts have nothing to do with each other
                for a, b in pairwise([0, *(k + 1 for k in small), n]):
                    if b - a == 1:
                        found.append(sigma + q[a])
                    else:
                        todo.append((q[a:b], e[a : b - 1], sigma))
                break
            if q[0] < q[-1]:  # small values are found at the end
                q, e = q[::-1], e[::-1]
            low, high = _least(q, e)
            for shift in (max(high * (1 - 1 / 64), low * (1 - 4 * n * EPS)), low * (1 - 4 * n * EPS), low / 4, 0.0):
                if (made := _sweep(q, e, shift)) is not None:
                    break
            q, e = made
            sigma += shift
        else:
            raise ArithmeticError("dqds did not converge")
    return np.sort(np.array(found))[::-1]


def _least(q: list[float], e: list[float]) -> tuple[float, float]:
    """Bounds of the least squared singular value from the diagonal of the square's inverse: its sum, and its largest
    entry."""
    total = last = most = 0.0
    for k, x in enumerate(q):
        if x <= 0:
            return 0.0, 0.0
        last = (1 + (e[k - 1] * last if k else 0.0)) / x
        total, most = total + last, max(most, last)
    return 1 / total, 1 / most


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    d, new_q, new_e = q[0] - shift, [], []
    for k, x in enumerate(e):
        if d < 0:
            return None
        y = d + x
        t = q[k + 1] / y if y else 0.0
        new_q.append(y)
        new_e.append(x * t)
        d = d * t - shift if y else q[k + 1] - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


@dataclass
class Twisted:
    """A twisted factorisation of B'B - value for a bidiagonal B: from the top down to row ``at``, and from the bottom
    up."""

    down: np.ndarray
    lower: np.ndarray
    up: np.ndarray
    upper: np.ndarray
    at: int
    pivot: float

    def solve(self, y: np.ndarray) -> np.ndarray:
        y, r, n = y.copy(), self.at, len(y)
        for k in range(r):
            y[k + 1] -= self.lower[k] * y[k]
        for k in range(n - 2, r - 1, -1):
            y[k] -= self.upper[k] * y[k + 1]
        y[:r] /= self.down[:r]
        y[r] /= self.pivot
        y[r + 1 :] /= self.up[r + 1 :]
        for k in range(r - 1, -1, -1):
            y[k] -= self.lower[k] * y[k + 1]
        for k in range(r, n - 1):
            y[k + 1] -= self.upper[k] * y[k]
        return y


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> Twisted:
    """Differential stationary and progressive transforms; the twist is where the pivot is least, so that its column
    of the inverse holds most of the wanted direction."""
    n = len(diagonal)
    a, b = diagonal**2, above**2
    floor = max(EPS**2 * float(a.max(initial=0.0) + b.max(initial=0.0)), np.finfo(np.float64).tiny)
    kept = lambda x: x if abs(x) > floor else np.copysign(floor, x)
    down, lower, up, upper = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        down[k] = kept(s[k] + a[k])
        lower[k] = diagonal[k] * above[k] / down[k]
        s[k + 1] = b[k] * s[k] / down[k] - value
    p[n - 1] = a[n - 1] - value
    for k in range(n - 2, -1, -1):
        up[k + 1] = kept(b[k] + p[k + 1])
        upper[k] = diagonal[k] * above[k] / up[k + 1]
        p[k] = p[k + 1] * a[k] / up[k + 1] - value
    pivots = s + p + value
    at = int(np.abs(pivots).argmin())
    return Twisted(down, lower, up, upper, at, kept(pivots[at]))


def directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors, a column each, for squared singular values in descending order.

    One solve of a twisted factorisation gives a direction. Values closer than a thousandth share a cluster: there a
    direction is made orthogonal to those before it and solved for again, from a fixed start, until it stays.
    """
    n, out = len(diagonal), np.zeros((len(diagonal), len(values)))
    start = np.random.Generator(np.random.PCG64(11)).standard_normal((n, len(values)))
    for j, value in enumerate(values):
        factors = twisted(diagonal, above, float(value))
        first = j
        while first and values[first - 1] - value <= 1e-3 * values[first - 1]:
            first -= 1
        near = out[:, first:j]
        z = start[:, j].copy()
        if not near.shape[1]:
            z[:] = 0
            z[factors.at] = 1.0
        for _ in range(4 if near.shape[1] else 2):
            for _ in range(2):
                z -= near @ (near.T @ z)
            z = factors.solve(z / np.linalg.norm(z))
            z /= np.abs(z).max()
            z /= np.linalg.norm(z)
        for _ in range(2):
            z -= near @ (near.T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def principal(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(all eigenvalues of R'R / n, descending; the first unit eigenvectors, a column each)."""
    scale = float(np.abs(r).max(initial=0.0)) or 1.0
    diagonal, above, v = bidiagonal(r / scale)
    values = squared_values(diagonal, above)
    return values * scale**2 / n, v @ directions(diagonal, above, values[:components])


def whole(embeddings: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding) with x, the entries times SCALE rounded down; without vectors that are null, empty
    or hold an entry that is null, not finite or so large that x would not be exact."""
    fine = lambda v: F.coalesce(  # noqa: E731  NaN is above all
        F.abs(v.cast("double")) < float(1 << 53) / SCALE, F.lit(False)
    )
    kept = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(
        F.forall("embedding", fine)
    )
    return kept.select(
        "vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x")
    )


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list's vectors, all eigenvalues, the first directions (a column each), and the largest
    entry by which the whitened fit list's covariance differs from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: by whole numbers as far as they are exact."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if largest < 1 << 62:
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN where a component has no variance."""
        e = self.values[: self.directions.shape[1]]
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.spread(), 1 / np.sqrt(e), np.nan)
        return self.centred(x) @ self.directions * scale

    def spread(self) -> np.ndarray:
        """Whether each component has variance beyond rounding errors."""
        e = self.values[: self.directions.shape[1]]
        return e > (len(self.sums) * EPS) ** 2 * max(float(self.values.max(initial=0.0)), 0.0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        largest = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if largest**2 * len(self.sums) < 1 << 63:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        sums = np.array(self.sums, object)
        squares, products = (x.astype(object) ** 2).sum(axis=1), x.astype(object) @ sums
        exact = self.n**2 * squares - 2 * self.n * products + sum(s * s for s in self.sums)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _in_tasks(fit_list: DataFrame, d: int, of_task, schema: str) -> DataFrame:
    """of_task(matrices of whole numbers) gives the columns of a task's rows."""

    def rows(batches):
        out = of_task(
            _matrix(b.column(0), d)[i : i + BLOCK] for b in batches if b.num_rows for i in range(0, b.num_rows, BLOCK)
        )
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.values()], list(out))

    return fit_list.mapInArrow(rows, schema)


def _summed(rows: DataFrame) -> list:
    """Totals by place, exact for whole numbers."""
    return [r[1] for r in rows.groupBy("k").agg(F.sum("v")).orderBy("k").collect()]  # a row a place


def triangle(fit_list: DataFrame, centre: Whitening) -> np.ndarray:
    """R of the centred rows of fit_list (x), with R'R their scatter: a triangle a task, then in a tree over tasks."""
    d = len(centre.sums)

    def reduced(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        made = np.linalg.qr(np.concatenate([r, rows]), mode="r")
        return made if len(made) == d else np.concatenate([made, np.zeros((d - len(made), d))])

    def of_task(blocks):
        from pyspark import TaskContext

        r = np.zeros((d, d))
        for x in blocks:
            r = reduced(r, centre.centred(x))
        return {"task": [TaskContext.get().partitionId()], "r": pa.array([r.tobytes()], pa.binary())}

    fan = max(2, FAN_BYTES // (8 * d * d))

    def of_group(group: pa.Table) -> pa.Table:
        r = np.zeros((d, d))
        for one in group.sort_by("task").column("r"):
            r = reduced(r, np.frombuffer(one.as_py()).reshape(d, d))
        return pa.table(
            {
                "task": pa.array([group.column("task")[0].as_py() // fan], pa.int64()),
                "r": pa.array([r.tobytes()], pa.binary()),
            }
        )

    made = base.stored(_in_tasks(fit_list, d, of_task, "task bigint, r binary"))
    most = made.agg(F.max("task")).first()[0] or 0
    while most:
        last, most = made, most // fan
        made = base.stored(last.groupBy(F.floor(F.col("task") / fan)).applyInArrow(of_group, "task bigint, r binary"))
        base.discard(last)
    r = np.frombuffer(made.first()["r"]).reshape(d, d)
    base.discard(made)
    return r


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x of vectors (vec_id, x, from whole()); None if there are none.

    The fit list is written once; a vector's copies are merged before they are shuffled. The most frequent dimension
    counts (of equally frequent ones the largest); vectors of another one are left out. What reaches the driver is d
    sums, one d x d triangle and a few products, for dimension d; nothing grows with rows.
    """
    distinct = base.stored(vectors.select("x").dropDuplicates(["x"]))
    first = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if first is None:
        return None
    d, n = first
    own = distinct.where(F.size("x") == d)

    def sums(blocks):
        total = np.zeros(d, np.int64)
        for x in blocks:
            total += x.sum(axis=0)
        return {"k": np.arange(d), "v": total}

    total = [
        int(v)
        for v in _summed(
            _in_tasks(own, d, sums, "k bigint, v bigint").withColumn("v", F.col("v").cast("decimal(38,0)"))
        )
    ]
    values, found = principal(triangle(own, Whitening(n, total, np.zeros(0), np.zeros((d, 0)))), n, min(components, d))
    made = Whitening(n, total, values, found)
    live = np.flatnonzero(made.spread())
    if not len(live):
        base.discard(distinct)
        return made
    m = len(live)

    def products(blocks):
        mean, square = np.zeros(m), np.zeros((m, m))
        for x in blocks:
            w = made.projected(x)[:, live]
            mean += w.sum(axis=0)
            square += w.T @ w
        return {"k": np.arange(m + m * m), "v": np.concatenate([mean, square.ravel()])}

    got = np.array(_summed(_in_tasks(own, d, products, "k bigint, v double"))) / n
    base.discard(distinct)
    mean, square = got[:m], got[m:].reshape(m, m)
    return Whitening(n, total, values, found, float(np.abs(square - np.outer(mean, mean) - np.eye(m)).max()))


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (an array, a number for each component) of vectors of the model's dimension."""
    d = len(model.sums)

    def rows(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            w = model.projected(x)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, values)],
                ["vec_id", "deviation", "whitened"],
            )

    own = vectors.where(F.size("x") == d).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    return own.mapInArrow(rows, "vec_id bigint, deviation bigint, whitened array<double>")


_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Repeated rows and rows without a vec_id give rows of their own. A component without variance (copies of one vector,
    fewer vectors than dimensions) has a null whitened and, if there is no variance at all, a null explained and
    identity_error; the latter is over the others. No usable vector, no rows. Vectors of another dimension than the most
    frequent are left out.
    """
    vectors = whole(embeddings)
    model = fit(vectors, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _OUT)
    trace = float(model.values.sum())
    shares = F.array(
        *[F.lit(float(v) / trace if trace else None).cast("double") for v in model.values[: model.directions.shape[1]]]
    )
    rows = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("k")].alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(base.table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: No SQL: it has no eigenvectors; tests compare with a dense eigenvalue solver and, for n and deviation, with plain
#: sums.
SQL: dict[str, str] = {}

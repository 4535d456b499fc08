"""Whitening of vectors on their leading principal components, found by FEAST contour integration.

Components become whole numbers, so sums are exact. The covariance is summed in Spark: one pass for the sums, one for the
products of the centred vectors, each task adding up its own rows first.

The spectrum is then cut into intervals. How many eigenvalues lie above a value is the number of positive pivots of a
symmetric block factorisation of the shifted covariance (its inertia), so bisection finds a cut below the wanted
components and splits what is above it into intervals of a few eigenvalues. Each interval is one Spark task. It draws a
circle around its interval, solves complex shifted systems at the Gauss-Legendre points of the upper half, whose weighted
sum projects a block of vectors onto the interval's eigenvectors, and extracts them by Rayleigh-Ritz. This is repeated
until the residuals are at rounding; a task whose number of eigenvalues is not the inertia count starts again with
a wider block, and fails if that never holds. The covariance (components squared) is what is broadcast: bounded by the
vector length, not by the rows.

Rows whose vector is null, empty, or holds null or non-finite components are left out. Ids may be null or repeat: every row
has its result. Vectors of another length are a fit list of their own. Components whose eigenvalue is zero to rounding (a
constant table, a single row) can't be whitened and give no rows. Where eigenvalues are equal any basis of their space may
come. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cattedra.llm.common import ship, write_shared
from cattedra.llm.integers import as_decimal, exact, lengths, matrix, whole_vectors

POINTS, ROUNDS, WIDENINGS = 8, 30, 6
#: Eigenvalues an interval may hold before it is split.
FEW = 4
#: Cuts keep this distance to eigenvalues, as a share of the largest row sum.
NEXT_TO = 1e-11
#: Eigenvalues up to this share of the trace are zero to rounding.
NOTHING = 1e-12
COLUMNS = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def count_above(matrix_: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of the factorisation with 1 x 1 and 2 x 2 blocks, largest pivot first."""
    a, above = matrix_ - shift * np.eye(len(matrix_)), 0
    bound = (1 + np.sqrt(17)) / 8
    while len(a):
        n, size = len(a), np.abs(a)
        i = int(size.diagonal().argmax())
        off = size - np.diag(size.diagonal())
        p, q = divmod(int(off.argmax()), n)
        if size[i, i] == 0 and off[p, q] == 0:
            break  # what is left is zero: eigenvalues equal to the shift
        block = [i] if size[i, i] >= bound * off[p, q] else [p, q]
        rest = np.delete(np.arange(n), block)
        pivot, side = a[np.ix_(block, block)], a[np.ix_(rest, block)]
        above += 1 if len(block) == 2 else int(pivot[0, 0] > 0)  # a 2 x 2 pivot has one eigenvalue of each sign
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
    return above


def clean_cut(a: np.ndarray, low: float, high: float, top: float) -> tuple[float, int] | None:
    """A value well inside (low, high) with no eigenvalue next to it, and the eigenvalues above it."""
    for share in (0.5, 0.4372, 0.5714, 0.3761, 0.6393, 0.2918, 0.7236):
        cut = low + share * (high - low)
        n = count_above(a, cut - NEXT_TO * top)
        if n == count_above(a, cut + NEXT_TO * top):
            return cut, n
    return None


def intervals(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) that together hold the ``wanted`` largest eigenvalues (more where some are equal)."""
    top = float(np.abs(a).sum(axis=1).max()) or 1.0
    low, high = -1e-3 * top, (1 + 1e-3) * top
    below, above = low, high
    while wanted < len(a) and above - below > 100 * NEXT_TO * top and (found := clean_cut(a, below, above, top)):
        cut, n = found
        low, below, above = (cut, cut, above) if n >= wanted else (low, below, cut)
        if n == wanted:
            break
    out, todo = [], [(low, high, count_above(a, low), 0)]
    while todo:
        low, high, n_low, n_high = todo.pop()
        few = n_low - n_high <= FEW or high - low <= 100 * NEXT_TO * top
        found = None if few else clean_cut(a, low, high, top)
        if found:
            todo += [(low, found[0], n_low, found[1]), (found[0], high, found[1], n_high)]
        elif n_low > n_high:
            out.append((low, high, n_low - n_high))
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the symmetric ``a`` in (low, high), of which there are ``count``."""
    n, scale = len(a), float(np.abs(a).sum(axis=1).max()) or 1.0
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(1j * np.pi / 2 * (1 - nodes))  # the upper half of the circle: the lower half is its conjugate
    block = min(n, 2 * count + 4)
    for _ in range(WIDENINGS):
        y, last = np.random.default_rng(seed).normal(size=(n, block)), np.inf
        for _ in range(ROUNDS):
            q = sum(w / 2 * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(n) - a, y.astype(complex))).real
                    for w, t in zip(weights, turns))
            q = np.linalg.qr(q)[0]
            values, small = np.linalg.eigh(q.T @ a @ q)
            y = q @ small
            inside = (values > low) & (values < high)
            rest = np.linalg.norm(a @ y[:, inside] - y[:, inside] * values[inside], axis=0).max(initial=0.0)
            if inside.sum() == count and rest < 1e-14 * n * scale and rest >= last / 2:  # at rounding: it falls no more
                return values[inside], y[:, inside] / np.linalg.norm(y[:, inside], axis=0)
            last = rest
        block = min(n, 2 * block)
    raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}), but the projection did not settle on them")


def components(spark: SparkSession, a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as rows: one Spark task an interval."""
    wanted = min(wanted, len(a))
    held = spark.sparkContext.broadcast(a)

    def solve(batches):
        for batch in batches:
            for r in batch.to_pylist():
                values, vectors = feast(held.value, r["low"], r["high"], r["n"])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([x.tobytes() for x in vectors.T], pa.binary())],
                                                 names=["value", "vector"])

    cuts = intervals(a, wanted)
    todo = spark.createDataFrame(cuts, "low double, high double, n int").repartition(len(cuts), "low")
    found = todo.mapInArrow(solve, "value double, vector binary").collect()  # at most the vector length
    found.sort(key=lambda r: (-r.value, bytes(r.vector)))
    found = found[:wanted]
    return np.array([r.value for r in found]), np.array([np.frombuffer(r.vector) for r in found])


def sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension)."""
    def add(batches):
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            v = matrix(batch.column(0))
            if len(v):
                n += len(v)
                total = total + exact(v, len(v) * int(np.abs(v).max())).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(width, n)), pa.array(np.arange(width, dtype=np.int32)), as_decimal(total)],
                                         names=["n", "j", "s"])

    parts = rows.select("v").mapInArrow(add, "n long, j int, s decimal(38,0)")
    found = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("j").collect()
    return (int(found[0].n) if found else 0), [int(r.s) for r in found]


def centred(v: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Vectors less their mean: less the whole number next to it first, so nothing is lost to the size of the shift."""
    whole = [(2 * s + n) // (2 * n) for s in total]
    rest = np.array([(s - n * w) / n for s, w in zip(total, whole)])
    return (v - np.array(whole)).astype(float) - rest


def covariance(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance with divisor n, of vectors centred before multiplying; each task sends the sums of its own rows."""
    upper = np.triu_indices(len(total))

    def add(batches):
        held = np.zeros((len(total), len(total)))
        for batch in batches:
            if batch.num_rows:
                y = centred(matrix(batch.column(0)), n, total)
                held += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)),
                                          pa.array(held[upper])], names=["i", "j", "s"])

    parts = rows.select("v").mapInArrow(add, "i int, j int, s double")
    out = np.zeros((len(total), len(total)))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # vector length squared
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


def whiten(df: DataFrame, wanted: int = 8, scale: float = 1024, shift: int = 100_000, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each valid row and each of the
    ``wanted`` leading components. ``deviation`` is the exact sum of (n * x - S)^2 as a decimal of 38 digits."""
    spark = df.sparkSession
    ship(spark)
    rows = write_shared(whole_vectors(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), "v", scale, shift, "vec_id"),
                        "whole")
    kind = rows.schema["vec_id"].dataType.simpleString()
    none = spark.createDataFrame([], COLUMNS.format(kind))
    return reduce(DataFrame.unionByName, [_whiten(rows.where(F.size("v") == width), width, wanted, kind) for width in lengths(rows)], none)


def _whiten(rows: DataFrame, width: int, wanted: int, kind: str) -> DataFrame:
    spark = rows.sparkSession
    n, total = sums(rows, width)
    cov = covariance(rows, n, total)
    values, vectors = components(spark, cov, wanted)
    sure = values > NOTHING * np.trace(cov)
    values, vectors = values[sure], vectors[sure]
    if not len(values):
        return spark.createDataFrame([], COLUMNS.format(kind))
    held = spark.sparkContext.broadcast((vectors, np.sqrt(values)))
    explained = [float(e / np.trace(cov)) for e in values]
    of_sum = np.array(total, object)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                y = centred(v, n, total)
                most = n * int(np.abs(v).max()) + max(abs(s) for s in total)
                off = exact(v, max(width * most * most, most)) * n - (of_sum if width * most * most >= 1 << 62 else of_sum.astype(np.int64))
                w = (y @ held.value[0].T) / held.value[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), as_decimal((off * off).sum(axis=1)),
                     pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())],
                    names=["vec_id", "deviation", "w"])

    done = write_shared(rows.select("vec_id", "v").mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    entries = done.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    worst = max(abs(c - (i == j)) for (i, j), c in zip(pairs, entries))
    out = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(F.array(*[F.lit(x) for x in explained]), F.col("at") + 1).alias("explained"),
                      F.lit(float(worst)).alias("identity_error"))

"""Exact top-k search by inner product over integer vectors, with block-at-a-time pruning.

Vectors are ordered by the nearest of a few centres (means of a bounded sample) and, around each, by the signs of fixed random
projections of what they differ in, so that neighbours in the order are alike. They are cut into
document ranges: a *range* of ``RANGE`` vectors is one stored row, its forward index is their components in blocks of
``BLOCK`` vectors, and every block carries the largest and the smallest component of each dimension ("term maxima" for
positive and for negative query weights), its mean and the largest distance from it. A query's bound on a block is the sum over
dimensions of its weight times the fitting extreme, or, if less, its product with the mean plus its norm times that distance;
no vector of the block can score more.

Queries come in chunks, each query with a floor: its k-th best score in a bounded sample of all vectors, which can only be
too low. A chunk and a range meet once, in the cell of a grid of lanes (of ranges) and sides (of chunks); both grow with the
square root of what they hold, so that the cells, which are the tasks, grow with the number of vectors, and copies of ranges
and chunks only with its root. There a query takes the blocks in the order of their bounds and scores them
through the forward index until the next bound falls below its k-th score so far (or the floor), which a task carries from
range to range. Bounds are exact or rounded up, so the result is exact; ties are never cut off.

Components are floor(scale * x) with x as double, of any size: products go through doubles where these are exact, else
through longs, else through Python's integers. Beyond a long they are cut to the largest or smallest one; an answer with
such a score stops the search. *Wide* vectors, with components that need more than 32 bits, are stored as doubles, in
ranges of their own. Vectors that are null, empty, or hold null or non-finite components take no part; nor do rows without
an id. Vectors of another length than the query's are no candidates: each length is searched by itself. Zero vectors take
part. Every row is a candidate of its own, repeated ones too (see ``vectors``). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cattedra.llm.common import ship, write_shared
from cattedra.llm.vectors import FOUND, answers, best, by_length, classes_of, found_rows, matrix, sample_of, valid_vectors

RANGE, BLOCK, CHUNK, SAMPLE, CODE_BITS, CENTRES, HELD_CHUNKS = 2048, 64, 256, 4096, 8, 256, 512
_MOST = (1 << 63) - 1


def integers(v: np.ndarray) -> np.ndarray:
    """Whole doubles as longs, or as Python integers if one is too large for a long."""
    if np.abs(v).max(initial=0) < 2.0 ** 63:
        return v.astype(np.int64)
    return np.array([[int(x) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def packed_vectors(v: np.ndarray) -> bytes:
    """Four bytes a component, or eight (doubles) if one needs more."""
    return v.astype("<i4" if np.abs(v).max(initial=0) < 2.0 ** 31 else "<f8").tobytes()


def unpacked_vectors(data: bytes, n: int, width: int) -> np.ndarray:
    kind = "<i4" if len(data) == 4 * n * width else "<f8"
    return integers(np.frombuffer(data, kind).reshape(n, width))


def _top(v: np.ndarray) -> int:
    return int(np.abs(v).max(initial=0)) or 1


def exact_product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles, which are faster, where these are exact too. The largest or smallest
    long (``_MOST``) stands for what is beyond."""
    each = _top(v) * max(1, q.shape[1])
    top = _top(q) * each
    if top < 1 << 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return q.astype(np.int64) @ v.astype(np.int64).T
    out, wide = np.zeros((len(q), len(v)), np.int64), np.array([_top(x) * each >= 1 << 63 for x in q], bool)
    if not wide.all():
        out[~wide] = exact_product(q[~wide], v)
    large = q[wide].astype(object) @ v.astype(object).T
    out[wide] = np.clip(large, -_MOST, _MOST).astype(np.int64)
    return out


def centres_of(points: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Means of groups of alike points, at most ``CENTRES``, one for each 16 points."""
    points = points.astype(np.float64)
    centres = points[np.unique(np.linspace(0, len(points) - 1, min(CENTRES, max(1, len(points) // 16))).astype(int))]
    for _ in range(rounds):
        near = nearest_centre(points, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros(centres.shape)
        np.add.at(sums, near, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_centre(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(v @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)


def place_codes(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Where vectors lie in the order: by centre, then by signs of projections of the rest; wide ones last."""
    near = nearest_centre(v, centres)
    planes = np.random.default_rng(0).normal(size=(v.shape[1], CODE_BITS))
    signs = (((v - centres[near]) @ planes > 0) << np.arange(CODE_BITS)).sum(axis=1)
    return (near << CODE_BITS) + signs + (np.abs(v).max(axis=1, initial=0) >= 2.0 ** 31) * (CENTRES << CODE_BITS)


class RangeIndex:
    """Forward index, extremes, means and distances of one document range. ``scored`` counts (query, block) pairs scored."""

    def __init__(self, reps: np.ndarray, v: np.ndarray):
        self.reps, self.v, self.scored = reps, v, 0
        self.starts = np.arange(0, len(v), BLOCK)
        self.high = np.maximum.reduceat(v, self.starts, axis=0)
        self.low = np.minimum.reduceat(v, self.starts, axis=0)
        if _top(v) < 1 << 31:  # beyond, doubles would round by more than the margin below
            sizes = np.diff([*self.starts, len(v)])
            self.means = np.add.reduceat(v.astype(np.float64), self.starts, axis=0) / sizes[:, None]
            gaps = np.sqrt(((v - np.repeat(self.means, sizes, axis=0)) ** 2).sum(axis=1))
            self.radii = np.maximum.reduceat(gaps, self.starts)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No vector of a block scores more with a query."""
        bounds = exact_product(np.hstack([np.maximum(q, 0), np.minimum(q, 0)]), np.hstack([self.high, self.low]))
        if _top(self.v) >= 1 << 31 or _top(q) >= 1 << 31:
            return bounds
        q = q.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))[:, None]
        margin = 1e-9 * norms * (np.sqrt((self.means ** 2).sum(axis=1)) + self.radii) + 1  # far above any rounding
        ball = np.ceil(q @ self.means.T + norms * self.radii + margin)
        return np.where(ball < 2.0 ** 62, np.minimum(bounds, np.minimum(ball, 2.0 ** 62).astype(np.int64)), bounds)

    def search(self, q: np.ndarray, floors: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ``keep`` best classes of each query here that reach its floor, with scores."""
        bounds = self.bounds(q)
        order = np.argsort(-bounds, axis=1, kind="stable")
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
        bar, open_ = floors.copy(), np.arange(len(q))
        for turn in range(len(self.starts)):
            block = order[open_, turn]
            going = bounds[open_, block] >= bar[open_]  # bounds fall along the order: others are done
            open_, block = open_[going], block[going]
            if not len(open_):
                break
            for b in np.unique(block):  # queries at the same block are scored together
                own = open_[block == b]
                self.scored += len(own)
                at = slice(self.starts[b], self.starts[b] + BLOCK)
                scores = exact_product(q[own], self.v[at])
                fits = scores >= bar[own][:, None]
                for j in np.flatnonzero(fits.any(axis=1)):
                    i, fit = own[j], fits[j]
                    reps = np.concatenate([kept[i][0], self.reps[at][fit]])
                    found = np.concatenate([kept[i][1], scores[j][fit]])
                    pick = best(reps, found, keep)
                    kept[i] = (reps[pick], found[pick])
                    if len(pick) == keep:
                        bar[i] = max(bar[i], found[pick[-1]])
        return kept


def search(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, vec_id: str = "vec_id",
           vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` its ``k`` highest among all others."""
    ship(df.sparkSession)

    def whole(x: Column) -> Column:
        # beyond 2^53 every double is whole, and floor would go through a long
        x = x * F.lit(float(scale))
        return F.when(F.abs(x) < 2.0 ** 53, F.floor(F.when(F.abs(x) < 2.0 ** 53, x)).cast("double")).otherwise(x)

    rows = valid_vectors(df, vec_id, vector, whole)
    return reduce(DataFrame.unionByName, [_search(part, k, every, sample) for part in by_length(rows, every)])


def _search(rows: DataFrame, k: int, every: int, sample: int) -> DataFrame:
    """``search`` over whole vectors of one length."""
    spark, keep = rows.sparkSession, k + 1
    classes, members = classes_of(rows, keep, every)
    n = classes.count()
    points = integers(sample_of(classes, n, sample))  # bounded by ``sample``
    shared = spark.sparkContext.broadcast(points)
    width = len(classes.first().v) if n else 0
    centres = spark.sparkContext.broadcast(centres_of(points) if len(points) else np.zeros((1, width)))

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                code = place_codes(matrix(batch.column(1)), centres.value)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), *batch.columns], names=["code", "rep", "v"])

    def packed(batches):
        reps, held, size = [], [], 0

        def out():
            ids = np.concatenate(reps)
            return pa.RecordBatch.from_pydict({"n": [len(ids)], "reps": [ids.astype("<i8").tobytes()],
                                               "v": [packed_vectors(np.concatenate(held))]})

        for batch in batches:
            for start in range(0, batch.num_rows, RANGE):
                part = batch.slice(start, RANGE)
                reps.append(part.column(1).to_numpy())
                held.append(matrix(part.column(2)))
                size += part.num_rows
                if size >= RANGE:
                    yield out()
                    reps, held, size = [], [], 0
        if size:
            yield out()

    ordered = (classes.select("rep", "v").mapInArrow(coded, "code long, rep long, v array<double>")
               .repartitionByRange("code", "rep").sortWithinPartitions("code", "rep"))
    ranges = write_shared(ordered.mapInArrow(packed, "n long, reps binary, v binary"), "ranges", few=True)

    def chunked(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                q = integers(matrix(part.column(1)))
                floors = np.full(len(q), np.iinfo(np.int64).min)
                if len(shared.value) >= keep:
                    scores = exact_product(q, shared.value)
                    floors = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
                yield pa.RecordBatch.from_pydict({"q": [packed_vectors(matrix(part.column(1)))], "floors": [floors.astype("<i8").tobytes()],
                                                  "asks": [part.column(0).to_numpy().astype("<i8").tobytes()]})

    queries = classes.where("is_query").select("rep", "v")
    chunks = write_shared(queries.mapInArrow(chunked, "q binary, floors binary, asks binary"), "chunks", few=True)
    lanes, sides = (math.isqrt(max(1, part.count()) - 1) + 1 for part in (ranges, chunks))
    held = ranges.withColumns({"lane": F.pmod(F.xxhash64("reps"), F.lit(lanes)).cast("int"),
                               "side": F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))})
    asked = chunks.withColumns({"side": F.pmod(F.xxhash64("asks"), F.lit(sides)).cast("int"),
                                "lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))})

    def meet(batches):
        state = {}  # chunk -> its queries, floors and best so far

        def out():
            for ask, q, bar, kept in state.values():
                some = np.array([len(r) > 0 for r, _ in kept])
                yield from found_rows(ask[some], [g for g in kept if len(g[0])]).to_batches()  # none if all is pruned
            state.clear()

        for batch in batches:
            for reps, v, q, floors, asks in zip(*(c.to_pylist() for c in batch.columns)):
                if asks not in state:
                    if len(state) == HELD_CHUNKS:
                        yield from out()
                    ask = np.frombuffer(asks, "<i8")
                    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    state[asks] = (ask, unpacked_vectors(q, len(ask), width), np.frombuffer(floors, "<i8").copy(), [nothing] * len(ask))
                ask, q, bar, kept = state[asks]
                ids = np.frombuffer(reps, "<i8")
                for i, (r, x) in enumerate(RangeIndex(ids, unpacked_vectors(v, len(ids), width)).search(q, bar, keep)):
                    if len(r):
                        r, x = np.concatenate([kept[i][0], r]), np.concatenate([kept[i][1], x])
                        pick = best(r, x, keep)
                        kept[i] = (r[pick], x[pick])
                        if len(pick) == keep:
                            bar[i] = max(bar[i], x[pick[-1]])
        yield from out()

    pairs = held.join(asked, ["lane", "side"]).select("reps", "v", "q", "floors", "asks")
    found = answers(pairs.mapInArrow(meet, FOUND), classes, members, k, "long")
    beyond = F.raise_error(F.lit("a score leaves the range of a long")).cast("long")
    return found.withColumn("score", F.when(F.abs("score") >= _MOST, beyond).otherwise(F.col("score")))

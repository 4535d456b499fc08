"""Approximate nearest neighbours by inner product: a forest of random-projection trees, searched through one shared
priority queue, then exact reranking of the leaf candidates.

Each tree splits at the median of the projections on the difference of two random points; ``depth`` levels make
2^depth leaves, by default enough for leaves of about ``LEAF`` vectors (``MIN_DEPTH`` at least, and as many as the sample
can fit at most). Trees are fitted on a bounded sample (``sample`` vectors in expectation); every vector is indexed. To
turn inner products into angles, vectors get one more component that brings all to the largest norm; a query's is 0.

A query puts the roots of all trees into one queue keyed by the smallest margin on the way there. It pops nodes, going down
the near side first, and takes leaves until they hold ``share`` of all vectors (k + 1 at least, so that k others are found),
counted over the trees. Unless given, ``share`` is the one that finds ``TARGET`` of the true neighbours within the sample:
alike vectors need little of the table, vectors without any structure a large part. (Neighbours in a sample are farther away
than in the table, so the table's recall is rather higher.) Index and
probes meet by (tree, leaf), large leaves and popular ones cut into cells of bounded size, and each cell scores its
candidates in double precision on the original vectors. A vector carries its leaf in each tree and a query the leaves it
takes, so that a pair is scored only in the first tree in which it meets: never more pairs than all.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors
of another length than the query's are no candidates: each length is searched by itself. Every row is a candidate of its
own, repeated ones too (see ``vectors``). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cattedra.llm.common import ship, write_shared
from cattedra.llm.vectors import FOUND, answers, best, by_length, classes_of, found_rows, matrix, sample_of, valid_vectors

SAMPLE, TREES, MIN_DEPTH, LEAF, TARGET, TRIALS = 4096, 4, 6, 1024, 0.95, 256
CELL_VECTORS, CELL_QUERIES = 1024, 1024


@dataclass
class Forest:
    """Planes and thresholds of the inner nodes of each tree, in heap order."""

    planes: np.ndarray  # trees x nodes x components
    cuts: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, trees: int, depth: int, seed: int = 0) -> Forest:
        rng, nodes, width = np.random.default_rng(seed), (1 << depth) - 1, points.shape[1]
        planes, cuts = np.zeros((trees, nodes, width)), np.zeros((trees, nodes))
        for t in range(trees):
            at = {0: np.arange(len(points))}
            for node in range(nodes):
                own = at.pop(node)
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    plane = points[a] - points[b]
                else:
                    plane = np.zeros(width)
                if not plane.any():
                    plane = rng.normal(size=width)
                planes[t, node] = plane / np.linalg.norm(plane)
                side = points[own] @ planes[t, node]
                cuts[t, node] = np.median(side) if len(own) else 0.0
                at[2 * node + 1], at[2 * node + 2] = own[side < cuts[t, node]], own[side >= cuts[t, node]]
        return cls(planes, cuts)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point in each tree."""
        out = []
        for planes, cuts in zip(self.planes, self.cuts):
            node = np.zeros(len(points), np.int64)
            for _ in range(len(cuts).bit_length()):
                node = 2 * node + 1 + ((points * planes[node]).sum(axis=1) >= cuts[node])
            out.append(node - len(cuts))
        return np.stack(out)

    def search(self, point: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """Leaves of all trees through one queue, nearest margin first, until they hold ``wanted`` vectors."""
        margins = self.planes @ point - self.cuts
        inner, queue, out, held = self.cuts.shape[1], [(0.0, t, 0) for t in range(len(self.cuts))], [], 0
        while queue and held < wanted:
            gap, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(gap, abs(m)), t, far))
                node = near
            out.append((t, node - inner))
            held += sizes[t, node - inner]
        return out


def depth_for(n: int, sample: int) -> int:
    """Levels for leaves of about ``LEAF`` of ``n`` vectors; a leaf holds four of the sample's at least."""
    wanted = math.ceil(math.log2(max(1, n / LEAF)))
    return max(MIN_DEPTH, min(wanted, int(math.log2(max(1, sample))) - 2))


def share_for(forest: Forest, points: np.ndarray, norm: float, k: int, target: float = TARGET) -> float:
    """The share of the sample that queries must take to find ``target`` of their ``k`` nearest there."""
    k = min(k, len(points) - 1)
    if k < 1:
        return 1.0
    leaves = forest.leaves(_lifted(points, norm))
    sizes = np.stack([np.bincount(x, minlength=forest.cuts.shape[1] + 1) for x in leaves])
    met, trees = [], np.arange(len(leaves))[:, None]
    for i in np.unique(np.linspace(0, len(points) - 1, TRIALS).astype(int)):
        scores = points @ points[i]
        scores[i] = -np.inf
        near = np.argpartition(-scores, k - 1)[:k]
        order = np.array(forest.search(np.append(points[i], 0.0), sizes, np.inf))
        held = np.zeros(sizes.shape)
        held[order[:, 0], order[:, 1]] = np.cumsum(sizes[order[:, 0], order[:, 1]])
        met.append(held[trees, leaves[:, near]].min(axis=0))
    return min(1.0, float(np.quantile(np.concatenate(met), target)) / (len(leaves) * len(points)))


def new_scores(tree: int, q: np.ndarray, seen: np.ndarray, v: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Scores of queries (with ``seen``: query, tree, leaf -> taken) and vectors that meet in ``tree`` for the first time;
    minus infinity for pairs that met in an earlier one."""
    if tree == 0:
        return q @ v.T
    scores = np.full((len(q), len(v)), -np.inf)
    for leaf in np.unique(leaves[:, 0]):
        fresh, at = np.flatnonzero(~seen[:, 0, leaf]), np.flatnonzero(leaves[:, 0] == leaf)
        part = q[fresh] @ v[at].T
        for t in range(1, tree):
            part[seen[fresh, t][:, leaves[at, t]]] = -np.inf
        scores[np.ix_(fresh, at)] = part
    return scores


def _lifted(v: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (v * v).sum(axis=1), 0))
    return np.concatenate([v, rest[:, None]], axis=1)


def search(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           trees: int = TREES, depth: int | None = None, share: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` its ``k`` nearest found among all others."""
    ship(df.sparkSession)
    rows = valid_vectors(df, vec_id, vector).where(F.exists("v", lambda x: x != 0))
    return reduce(DataFrame.unionByName, [_search(part, k, every, trees, depth, share, sample) for part in by_length(rows, every)])


def _search(rows: DataFrame, k: int, every: int, trees: int, depth: int | None, share: float | None, sample: int) -> DataFrame:
    """``search`` over valid vectors of one length."""
    spark = rows.sparkSession
    classes, members = classes_of(rows, k + 1, every)
    n, norm = classes.agg(F.count(F.lit(1)), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    norm, depth = norm or 0.0, depth_for(n, sample) if depth is None else depth
    points = sample_of(classes, n, sample)  # bounded by ``sample``
    if not len(points):
        points = np.ones((1, len(classes.first().v) if n else 1))
    fitted = Forest.fit(_lifted(points, norm), trees, depth)
    share = share_for(fitted, points, norm, k) if share is None else share
    forest = spark.sparkContext.broadcast(fitted)

    def place(batches):
        for batch in batches:
            leaf = forest.value.leaves(_lifted(matrix(batch.column(1)), norm)).astype(np.int32)
            all_leaves = pa.array(list(leaf.T), pa.list_(pa.int32()))
            for t in range(len(leaf)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(leaf[t]), batch.column(0),
                                                  all_leaves, batch.column(1)], names=["tree", "leaf", "rep", "leaves", "v"])

    held_rows = "tree int, leaf int, rep long, leaves array<int>, v array<double>"
    index = write_shared(classes.select("rep", "v").mapInArrow(place, held_rows), "index", few=True)
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in index.groupBy("tree", "leaf").count().collect():  # one row per leaf
        sizes[r.tree, r.leaf] = r["count"]
    wanted = trees * max(share * n, min(n, k + 1))

    def probe(batches):
        for batch in batches:
            q = matrix(batch.column(1))
            lifted = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
            for start in range(0, len(lifted), 64):  # a query's rows stay in batches of bounded size
                hits, seen = [], np.zeros((min(64, len(lifted) - start), *sizes.shape), bool)
                for i, x in enumerate(lifted[start:start + 64]):
                    taken = np.array(forest.value.search(x, sizes, wanted), np.int32)
                    seen[i, taken[:, 0], taken[:, 1]] = True
                    hits.append(np.column_stack([np.full(len(taken), i, np.int32), taken]))
                at, t, leaf = np.concatenate(hits).T
                packed = pa.array([np.packbits(x).tobytes() for x in seen], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t), pa.array(leaf), batch.column(0).take(pa.array(at + start)), packed.take(pa.array(at)),
                     batch.column(1).take(pa.array(at + start))], names=["tree", "leaf", "rep", "seen", "v"])

    queries = classes.where("is_query").select("rep", "v")
    probes = write_shared(queries.mapInArrow(probe, "tree int, leaf int, rep long, seen binary, v array<double>"), "probes", few=True)
    asked = probes.groupBy("tree", "leaf").count().collect()
    # cells of a leaf: one row per leaf, at most trees * 2^depth
    cells = spark.createDataFrame([(r.tree, r.leaf, int(-(-sizes[r.tree, r.leaf] // CELL_VECTORS)) or 1,
                                    -(-r["count"] // CELL_QUERIES)) for r in asked], "tree int, leaf int, nv int, nq int")
    cells = F.broadcast(cells)
    hashed = lambda n: F.pmod(F.xxhash64(F.lit("cell"), "rep"), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.join(cells, ["tree", "leaf"]).select("tree", "leaf", "rep", "leaves", "v", hashed("nv").alias("cv"), every_one("nq").alias("cq"))
    asks = probes.join(cells, ["tree", "leaf"]).select("tree", "leaf", "rep", "seen", "v", hashed("nq").alias("cq"), every_one("nv").alias("cv"))

    def rerank(key, left, right):
        reps, v = left.column("rep").to_numpy(), left.column("v")
        ask, q = right.column("rep").to_numpy(), right.column("v")
        if not len(reps) or not len(ask):
            return found_rows(np.zeros(0, np.int64), [])
        bits = np.frombuffer(b"".join(right.column("seen").to_pylist()), np.uint8).reshape(len(ask), -1)
        seen = np.unpackbits(bits, axis=1, count=sizes.size).astype(bool).reshape(len(ask), *sizes.shape)
        picks = []
        for row in new_scores(key[0].as_py(), matrix(q), seen, matrix(v), matrix(left.column("leaves"))):
            at = np.flatnonzero(row > -np.inf)
            at = at[best(reps[at], row[at], k + 1)]
            picks.append((reps[at], row[at]))
        return found_rows(ask, picks)

    on = ["tree", "leaf", "cv", "cq"]
    found = held.groupBy(*on).cogroup(asks.groupBy(*on)).applyInArrow(rerank, FOUND)
    return answers(found, classes, members, k, "double")

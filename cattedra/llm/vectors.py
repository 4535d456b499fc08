"""Vector tables for the two searches: valid rows, classes of equal vectors, and answers for every query row.

Every row is a candidate, also one of several rows alike in id, in vector or in both; a query's candidates are all rows
but that very row. Each of several query rows alike gets its own, equal, list.

Equal vectors have equal scores, and ties go to the smaller id, so of each class of equal vectors only its ``keep``
smallest ids, repeats counted, can ever be among the nearest ``keep - 1`` of a query (one is spare: the query's own row).
Searches run over classes; a vector that a third of all rows share is one class.
Ids (vec_id) are whole numbers within a long, or texts of such; any other id stops the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cattedra.llm.common import write_shared

CLASSES = "rep long, ids array<long>, is_query boolean, v array<double>"


def valid_vectors(df: DataFrame, vec_id: str, vector: str, value=None) -> DataFrame:
    """vec_id, v (array of double): rows with an id and a vector without null or non-finite components, of one at least.
    ``value`` maps each component."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", finite))
    return rows.select("vec_id", F.transform("v", value).alias("v")) if value else rows


def by_length(rows: DataFrame, every: int) -> list[DataFrame]:
    """The rows of each vector length that a query has: only vectors of one length have inner products. One search each, so
    many lengths take many jobs. Without any query one empty frame."""
    asked = rows.where(F.col("vec_id") % every == 0).select(F.size("v").alias("n")).distinct().orderBy("n").collect()
    return [rows.where(F.size("v") == n) for n in [r.n for r in asked] or [0]]


def classes_of(rows: DataFrame, keep: int, every: int) -> tuple[DataFrame, DataFrame]:
    """(classes, query rows): classes has rep (its number: classes in the order of their smallest ids), ids (the ``keep``
    smallest, ascending, repeats kept), is_query and v; the second has query_id and rep, one row a query row. Both are stored."""
    hashed = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit("v"), "v"))
    keyed = write_shared(hashed.groupBy("k1", "k2", "vec_id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies")),
                         "vectors", few=True)
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))  # limited before the shuffle
    small = keyed.select("k1", "k2", "vec_id", "v", F.least("copies", F.lit(keep)).cast("int").alias("copies"), nth.alias("nth"))
    asks = keyed.groupBy("k1", "k2").agg(F.max(F.col("vec_id") % every == 0).alias("is_query"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "copies"))), lambda x: F.array_repeat(x["vec_id"], x["copies"]))
    classes = (small.where(F.col("nth") <= keep).groupBy("k1", "k2")
               .agg(F.slice(F.flatten(each), 1, keep).alias("ids"), F.first("v").alias("v")).join(asks, ["k1", "k2"])
               .withColumn("least", F.col("ids")[0]).repartitionByRange("least", "k1", "k2").sortWithinPartitions("least", "k1", "k2"))
    # the number rises with the order, and the written table fixes it
    classes = write_shared(classes.select("k1", "k2", F.monotonically_increasing_id().alias("rep"), "ids", "is_query", "v"),
                           "classes", few=True)
    asking = hashed.where(F.col("vec_id") % every == 0).select("k1", "k2", F.col("vec_id").alias("query_id"))
    members = write_shared(asking.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("query_id", "rep"), "queries", few=True)
    return classes.drop("k1", "k2"), members


def sample_of(classes: DataFrame, n: int, sample: int) -> np.ndarray:
    """About ``sample`` of the ``n`` classes' vectors, chosen by a hash of the vector: the same ones on every run."""
    part = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "v"), 11) < int(min(1.0, sample / max(1, n)) * (1 << 53))
    return matrix(classes.where(part).orderBy("rep").select("v").toArrow().column("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def best(reps: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best: higher score, then smaller representative."""
    if len(scores) > 4 * keep:
        cut = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        at = np.flatnonzero(scores >= cut)  # all ties at the cut
        return at[np.lexsort((reps[at], -scores[at]))[:keep]]
    return np.lexsort((reps, -scores))[:keep]


FOUND = "query long, reps binary, scores binary"


def found_rows(queries: np.ndarray, picks: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """One row for each query: its best classes here, packed."""
    return pa.table({"query": pa.array(queries, pa.int64()),
                     "reps": pa.array([r.astype("<i8").tobytes() for r, _ in picks], pa.binary()),
                     "scores": pa.array([s.tobytes() for _, s in picks], pa.binary())})


def answers(found: DataFrame, classes: DataFrame, members: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the partial results of each query class merged, then given to each query row."""
    dtype = "<f8" if kind == "double" else "<i8"

    def merge(key, group):
        reps = np.concatenate([np.frombuffer(x, "<i8") for x in group.column("reps").to_pylist()])
        scores = np.concatenate([np.frombuffer(x, dtype) for x in group.column("scores").to_pylist()])
        reps, first = np.unique(reps, return_index=True)  # a class met twice has one score
        scores = scores[first]
        at = best(reps, scores, k + 1)
        return pa.table({"query": pa.array(np.full(len(at), key[0].as_py())), "rep": pa.array(reps[at]),
                         "score": pa.array(scores[at])})

    top = found.groupBy("query").applyInArrow(merge, f"query long, rep long, score {kind}")
    ids = top.join(classes.select("rep", "ids"), "rep").select("query", "score", "rep", F.explode("ids").alias("vec_id"))
    # at most (k + 1) classes of k + 1 ids
    near = ids.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "vec_id", "rep"))), 1, k + 1).alias("near"))
    own = members.join(near, members["rep"] == near["query"]).select("query_id", "query", "near")
    mine = lambda x: (x["vec_id"] == F.col("query_id")) & (x["rep"] == F.col("query"))
    at = F.array_position(F.transform("near", mine), True)  # the query's own row, once; 0: further down
    others = F.slice(F.filter("near", lambda x, i: (at == 0) | (i + 1 != at)), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                      (-F.col("x.minus")).alias("score"))

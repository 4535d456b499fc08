"""Compression of vectors to short codes, one byte for each part, with per-dimension value dictionaries.

Components become whole numbers. The rows of each task are packed into chunks of at most ``CHUNK_VALUES`` components; a
chunk stores, for each dimension, the sorted distinct numbers that occur in it and a small index into them for each row. To
compare a chunk with a codebook, the squared differences of every distinct number to all entries are tabulated once for
each dimension; the distances of a row's part to all entries are then gathers of table rows by its dictionary indexes, added up over
the part's dimensions. Dictionaries are as long as a chunk at most, so memory is bounded whatever values come.

A codebook starts from the vectors of the smallest ids. Each round assigns all parts and replaces each entry by the
floor of its parts' mean. Vectors stay where they are: a task sends sums and counts by entry, which Spark adds up, and the
next codebook (``ENTRIES`` vectors) goes back as a broadcast. Chunks are read from a table in the shared folder in each
round, so a lost executor costs only its own tasks.

Rows whose vector is null, empty, or holds null or non-finite components are dropped. Ids may be null (they come last) and
repeat (then the smaller vector is first); every row has its code. With fewer rows than entries the codebook is as short
as the table. Vectors of another length have a codebook of their own. If the length is no multiple of the number of parts,
the first parts are longer by one. Null labels are one label. A distance or an error that leaves a long stops the query. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.llm.common import ship, write_shared
from cattedra.llm.integers import as_decimal, exact, lengths, matrix, whole_vectors

PARTS, ENTRIES, ROUNDS = 4, 256, 4
CHUNK_VALUES = 1 << 19
#: A label is hot from this share of the rows on, so there are at most as many hot labels.
HOT = 1024


def part_ends(width: int, parts: int) -> list[int]:
    """First dimension of each part, then the width."""
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(width), parts)]).tolist()]


def pack(v: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """(length of each dimension's dictionary, all dictionaries, indexes by dimension) of a chunk."""
    sizes, values, codes = [], [], []
    for column in v.T:
        distinct, code = np.unique(column, return_inverse=True)
        sizes.append(len(distinct))
        values.append(distinct)
        codes.append(code.astype("<u4"))
    return sizes, np.concatenate(values).astype("<i8").tobytes(), np.concatenate(codes).tobytes()


def unpack(sizes: list[int], values: bytes, codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """(dictionary of each dimension, indexes: dimensions x rows)."""
    return (np.split(np.frombuffer(values, "<i8"), np.cumsum(sizes)[:-1]),
            np.frombuffer(codes, "<u4").reshape(len(sizes), -1))


def distances(dictionaries: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row's part to each entry of ``book`` (entries x dimensions): one table for each
    dimension, then gathers and adds."""
    gap = max(int(max(np.abs(d).max() for d in dictionaries)) + int(np.abs(book).max()), 1)
    most = len(dictionaries) * gap * gap
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else object
    out, held = None, None
    for values, code, entries in zip(dictionaries, codes, book.T):
        table = values.astype(kind)[:, None] - entries.astype(kind)[None, :]
        table *= table
        if out is None:
            out, held = table[code], np.empty((len(code), len(book)), kind)
        else:
            out += np.take(table, code, axis=0, out=held, mode="clip")
    return out


def assign(dictionaries: list[np.ndarray], codes: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, its distance) of each part and row; ties to the lower index."""
    ends, near, far = np.cumsum([0, *[b.shape[1] for b in books]]), [], []
    for a, b, book in zip(ends, ends[1:], books):
        d = distances(dictionaries[a:b], codes[a:b], book)
        at = d.argmin(axis=1)
        near.append(at)
        far.append(d[np.arange(len(at)), at])
    return np.stack(near), np.stack(far)


def to_chunks(rows: DataFrame, width: int) -> DataFrame:
    """ids, labels, sizes, values, codes: the rows of each task, packed. A stored table."""
    most = max(1, CHUNK_VALUES // width)
    kinds = [rows.schema[c].dataType for c in ("vec_id", "label")]
    schema = T.StructType([T.StructField("ids", T.ArrayType(kinds[0])), T.StructField("labels", T.ArrayType(kinds[1])),
                           T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("values", T.BinaryType()),
                           T.StructField("codes", T.BinaryType())])

    def one(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        sizes, values, codes = pack(matrix(table.column(2)))
        whole = [pa.ListArray.from_arrays([0, table.num_rows], table.column(i).chunk(0)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*whole, pa.array([sizes], pa.list_(pa.int32())), pa.array([values], pa.binary()),
                                           pa.array([codes], pa.binary())], names=schema.fieldNames())

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece, batch = batch.slice(0, most - n), batch.slice(most - n)
                held.append(piece)
                n += piece.num_rows
                if n == most:
                    yield one(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield one(pa.Table.from_batches(held))

    return write_shared(rows.select("vec_id", "label", "v").mapInArrow(run, schema), "chunks")


def refine(chunks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks: the floor of the mean of the parts that each entry is nearest to; unused entries stay."""
    shared = chunks.sparkSession.sparkContext.broadcast(books)  # ENTRIES vectors
    entries, ends = len(books[0]), np.cumsum([0, *[b.shape[1] for b in books]])

    def run(batches):
        counts = np.zeros((len(shared.value), entries), np.int64)
        sums = np.zeros((ends[-1], entries), object)
        for batch in batches:
            for sizes, values, codes in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                dictionaries, at = unpack(sizes, values, codes)
                near, _ = assign(dictionaries, at, shared.value)
                for p, (a, b) in enumerate(zip(ends, ends[1:])):
                    counts[p] += np.bincount(near[p], minlength=entries)
                    order = np.argsort(near[p], kind="stable")
                    starts = np.searchsorted(near[p][order], np.arange(entries))
                    for j in range(a, b):
                        v = exact(dictionaries[j], at.shape[1] * int(np.abs(dictionaries[j]).max()))[at[j][order]]
                        run_ = np.concatenate([np.zeros(1, v.dtype), np.cumsum(v)])
                        sums[j] += run_[np.append(starts[1:], len(v))] - run_[starts]
        used_part, used = np.nonzero(counts)
        for p in range(len(counts)):
            own = used[used_part == p]
            dims = np.arange(ends[p], ends[p + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(dims, len(own)).astype(np.int32)), pa.array(np.tile(own, len(dims)).astype(np.int32)),
                 pa.array(np.tile(counts[p][own], len(dims))), as_decimal(sums[np.ix_(dims, own)])], names=["j", "entry", "n", "s"])

    parts = chunks.select("sizes", "values", "codes").mapInArrow(run, "j int, entry int, n long, s decimal(38,0)")
    total = parts.groupBy("j", "entry").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    out = [b.copy() for b in books]  # ENTRIES vectors came back
    place = [(p, j - a) for p, (a, b) in enumerate(zip(ends, ends[1:])) for j in range(a, b)]
    for r in total:
        p, j = place[r.j]
        out[p][r.entry, j] = int(r.s) // r.n
    return out


def with_label_error(rows: DataFrame) -> DataFrame:
    """Append label_error: the sum of ``error`` over the rows of the same label, null labels together. The sums of hot
    labels (at most ``HOT``) are broadcast, so their rows don't meet; the others are joined."""
    sums = write_shared(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    n = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT >= n
    few = F.broadcast(sums.where(hot).select(F.col("label").alias("l"), "label_error"))
    rest = sums.where(~hot).select(F.col("label").alias("l"), "label_error")
    on = F.col("label").eqNullSafe(F.col("l"))
    common = rows.join(few, on).drop("l")
    others = rows.join(few.select("l"), on, "left_anti").join(rest, on).drop("l")
    return common.unionByName(others)


def compress(df: DataFrame, scale: float = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part), error, label_error, codebooks_sha256: one row for each
    valid row. ``entries`` is 256 at most."""
    spark = df.sparkSession
    ship(spark)
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    named = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = whole_vectors(named, "v", scale, 0, "vec_id", "label")
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"vec_id {id_kind}, label {label_kind}, code string, error long, codebooks_sha256 string"
    done = [_compress(rows.where(F.size("v") == width), width, parts, entries, rounds, schema) for width in lengths(rows)]
    if not done:
        return spark.createDataFrame([], f"{schema}, label_error long")
    return with_label_error(reduce(DataFrame.unionByName, done))


def _compress(rows: DataFrame, width: int, parts: int, entries: int, rounds: int, schema: str) -> DataFrame:
    ends = part_ends(width, min(parts, width))
    chunks = to_chunks(rows, width)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    first = np.array([r.v for r in first], np.int64)
    books = [first[:, a:b] for a, b in zip(ends, ends[1:])]
    for _ in range(rounds):
        books = refine(chunks, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                near, far = assign(*unpack(*[batch.column(c)[i].as_py() for c in (2, 3, 4)]), shared.value)
                codes = ["".join(f"{x:02x}" for x in row) for row in near.T.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(codes), pa.array(far.astype(object).sum(axis=0).tolist(), pa.int64()),
                     pa.array([digest] * len(codes))], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return write_shared(chunks.mapInArrow(run, schema), "codes")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cattedra.session import scratch_path

#: Characters that separate words and are stripped from lines (ASCII white space).
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on them (local mode, shared checkout)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that by itself on ASCII strings, and much faster than ``translate``."""
    return F.when(F.char_length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def lower_text(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


#: Bytes of what a table is worked out from (as stored) for each of its files.
BYTES_A_FILE = 16 << 20


def bytes_read(df: DataFrame) -> int:
    """Stored bytes of the tables that a plan reads. Rows that come from the driver have no known size and count as none."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), 0
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        total += size if size < 1 << 62 else 0
    return total


def fewer_files(df: DataFrame) -> DataFrame:
    """One task for each ``BYTES_A_FILE`` of the tables that ``df`` reads, so a task's work does not grow with the input, but four
    for each core at least, or an eighth of the shuffle partitions: small inputs dealt over hundreds of partitions would
    otherwise make many files that cost more than they hold."""
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, shuffled // 8, bytes_read(df) // BYTES_A_FILE))


#: Open ``temporary`` blocks, innermost last: what each may delete.
_blocks: list[list[tuple[str, str]]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, which the innermost ``temporary`` block deletes."""
    path = scratch_path(spark, name)
    if _blocks:
        _blocks[-1].append((name, path))
    return path


@contextmanager
def temporary(spark: SparkSession, keep: str | None = None) -> Iterator[None]:
    """Delete the folders that operators write inside this block when it ends, also by an error, but for those called ``keep``
    (they go to the block around, if any). Frames read from the others must not be used after it: write what is to stay."""
    _blocks.append([])
    try:
        yield
    finally:
        for name, path in _blocks.pop():
            if name != keep:
                remove_shared(spark, path)
            elif _blocks:
                _blocks[-1].append((name, path))


def write_shared(df: DataFrame, name: str, partition_by: list[str] | None = None, few: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to a fresh folder under the shared checkpoint folder and read it back.
    ``few``: see ``fewer_files``."""
    path = shared_folder(df.sparkSession, name)
    writer = (fewer_files(df) if few else df).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder that one of these operators wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int = 512,
           max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that each holds about ``max_bytes`` of ``column`` at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = [x or 0 for x in pc.binary_length(col).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def no_clash(df: DataFrame, *names: str) -> DataFrame:
    """Input columns that carry the name of an output column give way to it."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null ids: null)."""
    return F.crc32(col.cast("string").cast("binary")) % n

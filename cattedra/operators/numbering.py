"""Exact row numbers without a single-task window (W2, T5 deep pages).

``row_number()`` over an un-partitioned window, or over a partition holding a
third of the data, runs in one task. Here rows are range-partitioned on the
order (balanced by sampling), sorted inside each partition and numbered
locally with ``monotonically_increasing_id``; per-partition counts (one row
per partition, a proven bound) give each partition's offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = (1 << 33) - 1


def _cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _ranged(df: DataFrame, order: Sequence[Column | str], num_partitions: int | None) -> DataFrame:
    """Range-partitioned, sorted rows with their partition id and local position.

    Numbering needs two passes over these rows (counts, then offsets joined
    back). They are stored once in the shared checkpoint folder (as Parquet, which takes
    a fraction of a checkpoint's space) with the positions fixed, so the range shuffle
    and sort run once, not per pass, and a lost executor cannot renumber anything."""
    from cattedra.session import stored
    cols = _cols(order)
    # without an explicit count AQE may coalesce neighbouring ranges (order is kept)
    ranged = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    ranged = ranged.sortWithinPartitions(*cols)
    mid = F.monotonically_increasing_id()
    voids = [c for c, kind in df.dtypes if kind == "void"]  # no Parquet type
    kept = stored(ranged.withColumn("_mid", mid).drop(*voids), "numbered")
    return kept.select(*[F.lit(None).alias(c) if c in voids else c for c in df.columns], "_mid",
                       F.shiftright("_mid", 33).alias("_pid"), F.col("_mid").bitwiseAND(_LOW_BITS).alias("_local"))


def with_global_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_index",
                      num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (make the order total)."""
    ranged = _ranged(df, order, num_partitions)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_local")).drop("_mid", "_pid", "_local", "_off")


def with_group_index(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str],
                     name: str = "row_index", num_partitions: int | None = None) -> DataFrame:
    """0-based position inside each group (``row_number() - 1``), skew-safe:
    a hot group spans many range partitions and is numbered in all of them."""
    ranged = _ranged(df, [*groups, *order], num_partitions)
    per = ranged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"),
                                               F.min("_local").alias("_first"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_pid", *groups, "_first",
                         F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per (partition, group) present: joined by key, not broadcast;
    # NULL groups are groups too, hence the null-safe equality
    r, o = ranged.alias("_r"), offsets.alias("_o")
    cond = F.col("_r._pid") == F.col("_o._pid")
    for g in groups:
        cond = cond & F.col(f"_r.{g}").eqNullSafe(F.col(f"_o.{g}"))
    out = r.join(o, cond).select(
        "_r.*", (F.col("_o._off") + F.col("_r._local") - F.col("_o._first")).alias(name))
    return out.drop("_mid", "_pid", "_local")

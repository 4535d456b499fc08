"""Keep one row per key by an explicit order.

The reference leans on row order ("first", "last"); Spark has none, so every
pick takes an explicit total order. The pick is an aggregation, not a window:
``groupBy(keys).agg(min(struct(order..., payload...)))``. The aggregation runs
partially on the map side, so a key holding a third of all rows is reduced to
one row per map task before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.functions._col import as_col
from cattedra.session import CODEC, remove_path, scratch_path


@dataclass(frozen=True)
class Order:
    """One sort key: ``descending`` only for numeric columns (negated)."""

    col: Column | str
    descending: bool = False
    nulls_last: bool = False


def asc(col, nulls_last: bool = False) -> Order:
    return Order(col, False, nulls_last)


def desc(col, nulls_last: bool = True) -> Order:
    return Order(col, True, nulls_last)


def _oriented(df: DataFrame, spec: Order) -> list[Column]:
    c = as_col(spec.col)
    if spec.descending:
        if isinstance(spec.col, str):
            dtype = df.schema[spec.col].dataType
            if not isinstance(dtype, T.NumericType):
                raise TypeError(f"descending pick needs a numeric column, got {spec.col}: {dtype}")
        c = -c
    # Spark orders NULL first inside a struct; a leading flag moves NULLs last.
    return [c.isNull(), c] if spec.nulls_last else [c]


def distinct_in_rounds(df: DataFrame, rounds: int = 3, source: str | None = None) -> DataFrame:
    """``SELECT DISTINCT *``, stored: the rows are written in ``rounds`` folders by a hash of all columns, and one folder after
    the other is de-duplicated, so that a part of the rows is shuffled at once. ``df`` is read once; then its folder ``source``
    is deleted, if named."""
    spark, staged, path = df.sparkSession, scratch_path(df.sparkSession, "repeats"), scratch_path(df.sparkSession, "distinct")
    part = F.pmod(F.xxhash64(*df.columns), F.lit(rounds)).cast("int")
    df.withColumn("_round", part).write.option("compression", CODEC).partitionBy("_round").parquet(staged)
    if source:
        remove_path(spark, source)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_round", T.IntegerType())])).parquet(staged)
    for i in range(rounds):
        one = rows.where(F.col("_round") == i).drop("_round").distinct()
        one.write.mode("append").option("compression", CODEC).parquet(path)
    remove_path(spark, staged)
    return spark.read.schema(df.schema).parquet(path)


def keep_first(df: DataFrame, keys: list[str], order: list[Order]) -> DataFrame:
    """One row per ``keys``: the smallest by ``order``, ties broken by the whole
    row. NULL keys form one group (as in pandas ``drop_duplicates``)."""
    order_cols = []
    for i, spec in enumerate(order):
        for j, c in enumerate(_oriented(df, spec)):
            order_cols.append(c.alias(f"_o{i}_{j}"))
    payload = [c for c in df.columns if c not in keys]
    packed = F.struct(*order_cols, *[F.col(c) for c in payload])
    picked = df.groupBy(*keys).agg(F.min(packed).alias("_pick"))
    return picked.select(*[F.col(k) for k in keys], *[F.col(f"_pick.{c}").alias(c) for c in payload]) \
        .select(*df.columns)

"""Vector tables of whole numbers, shared by whitening and vector codes: valid rows, floors of scaled components, sums."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components stay whole in a double up to here.
MOST = float(1 << 53)
DECIMAL = pa.decimal128(38, 0)


def whole_vectors(df: DataFrame, vector: str, scale: float, shift: int, *carry: str) -> DataFrame:
    """The ``carry`` columns and v (array of long): floor(scale * x) + shift of each component x, for rows with a vector of
    one component at least and without null or non-finite ones. A component beyond 2^53 / scale stops the query."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x
        return F.when(F.abs(y) <= MOST, F.floor(y) + F.lit(shift)).otherwise(
            F.raise_error(F.lit("a component is too large for a whole number")).cast("long"))

    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(*[F.col(c) for c in carry], doubles.alias("v")).where("v is not null and size(v) > 0")
    return rows.where(F.forall("v", finite)).select(*carry, F.transform("v", whole).alias("v"))


def lengths(rows: DataFrame) -> list[int]:
    """The vector lengths there are. Vectors of different lengths have no common dimensions: each length is a table of its
    own, so a table of many lengths takes many jobs."""
    return sorted(r.n for r in rows.select(F.size("v").alias("n")).distinct().collect())


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact(values: np.ndarray, most: int) -> np.ndarray:
    """``values`` in a type that holds results up to ``most``: long, else Python integers (slow, but exact)."""
    return values.astype(np.int64 if most < 1 << 62 else object, copy=False)


def as_decimal(values: np.ndarray) -> pa.Array:
    """Whole numbers as decimals of 38 digits."""
    flat = values.ravel()
    if flat.dtype == object:
        return pa.array([Decimal(int(x)) for x in flat], DECIMAL)
    return pa.array(flat, pa.int64()).cast(DECIMAL)

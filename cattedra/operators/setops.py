"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: the tuple compared between years. ---
NEW_ADOPTION_KEY = ["uni_cod", "laurea_nome", "insegnamento_prof", "isbn", "laurea_matricole"]
# --- end of fixed values ---


def new_adoptions(df: DataFrame, year: int, key: Sequence[str] = NEW_ADOPTION_KEY,
                  year_col: str = "a_a") -> DataFrame:
    """Tuples of year ``y`` that are absent in ``y - 1`` (EXCEPT DISTINCT).

    ``subtract`` is null-safe, so a NULL enrolment does not make every tuple new
    (D12). With the default key a kept book whose enrolment changed is new.
    """
    cols = list(key)
    # de-duplicate each side first: repeated tuples collapse in the map-side
    # partial aggregation instead of reaching one anti-join partition
    cur = df.filter(F.col(year_col) == F.lit(int(year))).select(*cols).distinct()
    prev = df.filter(F.col(year_col) == F.lit(int(year) - 1)).select(*cols).distinct()
    return cur.subtract(prev)


def new_adoptions_by_key(df: DataFrame, year: int, match_key: Sequence[str],
                         output: Sequence[str] = NEW_ADOPTION_KEY, year_col: str = "a_a") -> DataFrame:
    """U1, documented meaning: output tuples of year ``y`` whose ``match_key``
    (e.g. degree and book, without the enrolment) does not occur in ``y - 1``.
    A null-safe ``left_anti`` join on the match key."""
    cur = df.filter(F.col(year_col) == F.lit(int(year))).select(*output).distinct()
    prev = df.filter(F.col(year_col) == F.lit(int(year) - 1)).select(*match_key).distinct()
    c, p = cur.alias("_c"), prev.alias("_p")
    cond = reduce(lambda a, b: a & b, [F.col(f"_c.{k}").eqNullSafe(F.col(f"_p.{k}")) for k in match_key])
    return c.join(p, cond, "left_anti").select(*[F.col(f"_c.{k}").alias(k) for k in output])


def bag_union(*frames: DataFrame) -> DataFrame:
    """Bag union by column name (missing columns are NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """``UNION`` (distinct)."""
    return bag_union(*frames).distinct()

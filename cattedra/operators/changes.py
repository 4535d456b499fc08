"""Row changes in batch form (M1-M8, K5).

The reference edits single rows by rowid; here a DataFrame of changes keyed by
``record_id`` is applied with joins, and the result is a new snapshot (written
by the caller), never an in-place overwrite of the table being read.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cattedra.operators.dedup import asc, desc, keep_first
from cattedra.operators.numbering import with_global_index
from cattedra.schemas import CONTACT_COLUMNS, MAILING_COLUMNS
from cattedra.session import remove_path, stored_at

UPSERT_KEY = ["uni_cod", "prof_id"]
# --- Fixed values: natural key of a contact for idempotent appends (D1). ---
CONTACT_NATURAL_KEY = ["uni_cod", "prof_id", "insegnamento_id", "isbn"]
# --- end of fixed values ---


def upsert(new: DataFrame, old: DataFrame, key: Sequence[str] = UPSERT_KEY, mode: str = "as_is",
           order_col: str = "record_id") -> DataFrame:
    """New U old, one row per ``key``.

    ``as_is`` reproduces the reference: sort by (key, name desc, NULLs first),
    keep the last, i.e. the alphabetically smallest non-NULL name, and on equal
    names the old row (it came later in the concatenation; among old rows the
    highest ``order_col``). ``new_wins`` is the documented meaning: the new row
    replaces the old one (M8 uses it on prof_id).
    """
    n = new.withColumn("_src", F.lit(0))
    o = old.withColumn("_src", F.lit(1))
    if order_col not in new.columns:
        n = n.withColumn(order_col, F.lit(None).cast("bigint"))
    if order_col not in old.columns:
        o = o.withColumn(order_col, F.lit(None).cast("bigint"))
    both = n.unionByName(o, allowMissingColumns=True)
    if mode == "as_is":
        order = [asc("insegnamento_prof", nulls_last=True), desc("_src"), desc(order_col)]
    elif mode == "new_wins":
        order = [asc("_src"), desc(order_col)]
    else:
        raise ValueError(f"unknown upsert mode {mode!r}")
    return keep_first(both, list(key), order).drop("_src")


class DuplicateChange(ValueError):
    """More than one change for one row id."""


def assign_ids(df: DataFrame, rows: DataFrame, key: str = "record_id") -> DataFrame:
    """``rows`` with ids for those that have none: the largest id of ``df`` (or of ``rows``) plus their place in the order
    of all columns, numbered over range partitions. A frame without the id column passes unchanged."""
    if key not in df.columns:
        return rows
    named = rows if key in rows.columns else rows.withColumn(key, F.lit(None).cast("bigint"))
    named, folder = stored_at(named, "new-rows")  # read several times below; ``rows`` may be a join
    top = max([x for f in (df, named) for x in [f.agg(F.max(key)).first()[0]] if x is not None], default=0)
    order = [F.col(c).asc_nulls_first() for c in named.columns if c != key]
    fresh = with_global_index(named.where(F.col(key).isNull()), order, "_place")
    fresh = fresh.withColumn(key, F.col("_place") + F.lit(top + 1)).drop("_place").select(*named.columns)
    if named.where(F.col(key).isNotNull()).isEmpty():
        remove_path(df.sparkSession, folder)  # the numbered rows are stored themselves
        return fresh
    return named.where(F.col(key).isNotNull()).unionByName(fresh)


def update_by_id(df: DataFrame, changes: DataFrame, key: str = "record_id",
                 set_columns: Sequence[str] = ()) -> DataFrame:
    """M2/M6: apply changes by id. ``changes`` has ``key`` plus any subset of the columns. Columns in ``set_columns``
    are set as given, NULL included (a whole-row edit lists them all); in the others a NULL leaves the value as it
    was. Two changes for one id are refused."""
    if not changes.groupBy(key).count().where("count > 1").isEmpty():
        raise DuplicateChange(f"more than one change for one {key}")
    cols = [c for c in changes.columns if c != key and c in df.columns]
    ch = changes.select(F.col(key), F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = df.join(ch, key, "left")

    def value(c: str):
        new = F.col(f"_new_{c}").cast(df.schema[c].dataType)
        return F.when(F.col("_changed"), new).otherwise(F.col(c)) if c in set_columns else F.coalesce(new, F.col(c))

    return joined.select(*[value(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def delete_by_id(df: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """M3: drop the rows whose ``key`` is listed."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def insert_rows(df: DataFrame, rows: DataFrame, required: str = "insegnamento_prof") -> DataFrame:
    """M4: append rows under new ids; a row without the mandatory name is rejected."""
    ok = rows.filter(F.col(required).isNotNull() & (F.trim(F.col(required)) != ""))
    return df.unionByName(assign_ids(df, ok).select(*df.columns))


def append_new(df: DataFrame, rows: DataFrame, key: Sequence[str] = CONTACT_NATURAL_KEY) -> DataFrame:
    """M5 (D1): append only rows whose natural key is not present yet, so a
    repeated run is idempotent. Null-safe key comparison. Repeated rows are dropped after the join, which leaves fewer."""
    r, d = rows.alias("_r"), df.select(*key).alias("_d")
    cond = None
    for k in key:
        c = F.col(f"_r.{k}").eqNullSafe(F.col(f"_d.{k}"))
        cond = c if cond is None else cond & c
    fresh, folder = r.join(d, cond, "left_anti").select("_r.*"), None
    if "record_id" in df.columns:
        fresh, folder = stored_at(fresh, "fresh")  # the shuffles of the join are gone before those of the repeats
    fresh = fresh.distinct()
    named = assign_ids(df, fresh)
    if folder and named is not fresh:
        remove_path(df.sparkSession, folder)  # the named rows are stored themselves
    return df.unionByName(named.select(*df.columns))


def append_upload(resolved_upload: DataFrame, selected: DataFrame) -> DataFrame:
    """M7: resolved upload U selected lecturers, in the contact layout (``with_ids`` numbers them for storing)."""
    return resolved_upload.select(*CONTACT_COLUMNS).unionByName(selected.select(*CONTACT_COLUMNS))


def with_ids(rows: DataFrame, key: str = "record_id") -> DataFrame:
    """``rows`` with an id each, so that they can be edited and deleted; ids already there stay."""
    named = rows if key in rows.columns else rows.withColumn(key, F.lit(None).cast("bigint"))
    return assign_ids(named, named, key)


def merge_directory(new: DataFrame, old: DataFrame, key: str = "prof_id") -> DataFrame:
    """M8: directory "update and add": new rows replace old ones on ``key``."""
    return upsert(new, old, [key], mode="new_wins")


def audience(contacts: DataFrame, name: str, on: date) -> DataFrame:
    """K5/Q7: the matching contacts as mailing rows named ``name`` on ``on``.
    Eight columns are appended; ``note`` stays NULL as in the reference."""
    return contacts.select(
        *[F.col(c) for c in MAILING_COLUMNS if c not in ("nome", "data", "note")],
        F.lit(name).alias("nome"), F.lit(None).cast("string").alias("note"), F.lit(on).alias("data"),
    ).select(*MAILING_COLUMNS)

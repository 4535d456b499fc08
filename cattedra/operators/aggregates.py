"""Aggregations and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cattedra.functions.scalars import isbn_or_label, space_concat, sqlite_int_of
from cattedra.operators.dedup import asc, keep_first

# --- Fixed values: column sets of the summary and of the per-book student count. ---
SUMMARY_COLUMNS = ["uni_cod", "isbn", "materia_ssd_cod", "insegnamento_prof"]
SUMMARY_VALUE_LIST_COLUMNS = ["uni_cod", "materia_ssd_cod"]
DEGREE_BOOK_KEY = ["uni_cod", "laurea_nome", "isbn", "laurea_matricole"]
# --- end of fixed values ---


def students_per_book(df: DataFrame) -> DataFrame:
    """A1 + J3: first-year students of every degree that adopts a book.

    DISTINCT (uni_cod, laurea_nome, isbn, laurea_matricole) then SUM per isbn,
    so a degree counts once per book however many courses adopt it; joined to
    the distinct book attributes (a book with two title spellings gives two
    rows, each with the full total). Both sides aggregate before the join, so
    the join input is one row per book (per spelling).
    """
    degrees = df.select(*DEGREE_BOOK_KEY).distinct()
    totals = degrees.groupBy("isbn").agg(
        F.sum(sqlite_int_of(degrees, "laurea_matricole")).alias("studenti"))
    books = df.select("isbn", "titolo", space_concat("autori", "curatori").alias("autore"),
                      "editore").distinct()
    return totals.join(books, "isbn").select("isbn", "titolo", "autore", "editore", "studenti")


def students_one_book(df: DataFrame, isbn: str) -> DataFrame:
    """A5: students for one book, keyed by (laurea_nome, laurea_matricole)."""
    one = df.filter(F.col("isbn") == F.lit(isbn)).select("laurea_nome", "laurea_matricole").distinct()
    return one.agg(F.sum("laurea_matricole").alias("totale_studenti"))


def summary_counts(df: DataFrame, columns: list[str] = SUMMARY_COLUMNS) -> DataFrame:
    """A3: non-null count and distinct count per column, one row.

    NULLs are not values (D10). Each column is counted by value first (a partial aggregate over one pruned column), so
    no row is copied once per distinct count.
    """
    rows = None
    for c in columns:
        per_value = df.where(F.col(c).isNotNull()).groupBy(c).count()
        one = per_value.agg(F.lit(c).alias("column"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"),
                            F.count(F.lit(1)).alias("distinct"))
        rows = one if rows is None else rows.unionByName(one)
    of = lambda c, n: F.max(F.when(F.col("column") == c, F.col(n)))  # noqa: E731 - one row for each column
    return rows.agg(*[of(c, n).alias(f"{c}_{label}") for c in columns for n, label in (("n", "count"), ("distinct", "unique"))])


def distinct_values(df: DataFrame, columns: list[str] = SUMMARY_VALUE_LIST_COLUMNS) -> DataFrame:
    """A3/C14: one row per (column, distinct value), for domains of any size."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             .where(F.col("value").isNotNull()).distinct() for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_contact_per_pair(contacts: DataFrame, order_col: str = "record_id") -> DataFrame:
    """A4: one contact per (insegnamento_prof, isbn), the first by record id (rows without
    an id come last); a missing isbn shows as 'Nessun saggio'. NULLs form one group."""
    first = keep_first(contacts, ["insegnamento_prof", "isbn"], [asc(order_col, nulls_last=True)])
    return first.withColumn("isbn", isbn_or_label("isbn"))

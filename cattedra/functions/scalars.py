"""Small scalar rules (P2-P4, C6-C8, C11-C14) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.functions._col import as_col, number_of_text

# --- Fixed values ---
NO_SAMPLE_LABEL = "Nessun saggio"   # shown for a contact without a sample copy (C6)
ACADEMIC_YEAR_START_MONTH = 9       # academic year starts in September (C11)
# --- end of fixed values ---


def id_or_zero(c: Column | str) -> Column:
    """NULL or non-numeric id -> 0, as bigint; ``'123.0'`` -> 123."""
    col = as_col(c)
    return F.coalesce(number_of_text(col.cast("string")), F.lit(0).cast("bigint"))


def sector_spaces(c: Column | str) -> Column:
    """``;`` separators of sector codes become spaces."""
    return F.translate(as_col(c), ";", " ")


def blank_if_null(c: Column | str) -> Column:
    """A NULL lecturer name becomes ``' '`` before cleaning."""
    return F.coalesce(as_col(c), F.lit(" "))


def isbn_or_label(c: Column | str) -> Column:
    """``coalesce(isbn, 'Nessun saggio')``."""
    return F.coalesce(as_col(c).cast("string"), F.lit(NO_SAMPLE_LABEL))


def space_concat(a: Column | str, b: Column | str) -> Column:
    """``a || ' ' || b`` -- NULL when either side is NULL."""
    return F.concat(as_col(a), F.lit(" "), as_col(b))


def sqlite_int(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """SQLite ``CAST(x AS INTEGER)``.

    Integral input is returned as is, fractional input truncates; text takes its
    leading integer (``'12abc'`` -> 12, ``'3.9'`` -> 3) or 0; NULL stays NULL.
    """
    col = as_col(c)
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return col.cast("bigint")
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return col.try_cast("bigint")
    text = col.cast("string")
    lead = F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit(""))  # a cast of '' would cost an exception
    return F.when(col.isNull(), F.lit(None).cast("bigint")).otherwise(
        F.coalesce(lead.try_cast("bigint"), F.lit(0).cast("bigint")))


def sqlite_int_of(df: DataFrame, name: str) -> Column:
    return sqlite_int(F.col(name), df.schema[name].dataType)


def academic_year(d: Column | str) -> Column:
    """C11: calendar year, minus one before September."""
    col = as_col(d)
    return (F.year(col) - F.when(F.month(col) < ACADEMIC_YEAR_START_MONTH, 1).otherwise(0)).cast("int")


def tenant_key(c: Column | str) -> Column:
    """md5 hex of the tenant id."""
    return F.md5(as_col(c).cast("string"))


def json_keys(c: Column | str) -> Column:
    """Keys of a JSON object (``json_each`` ... ``key``)."""
    return F.json_object_keys(as_col(c))


def json_values(c: Column | str) -> Column:
    """Values of a JSON array of strings (``json_each`` ... ``value``)."""
    return F.from_json(as_col(c), T.ArrayType(T.StringType()))

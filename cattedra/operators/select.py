"""Selections and predicates.

Predicates are built from literals, never from SQL text. A key list becomes an
``In``/``InSet`` predicate that reaches the Parquet scan; a key *DataFrame*
becomes a ``left_semi`` join whose strategy (broadcast or shuffle) AQE picks
from the runtime size of the key side.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.functions.scalars import json_keys, json_values
from cattedra.functions.text import contains_ci

# --- Fixed values: how the filter builder treats each parameter. ---
MULTI_VALUE_PARAMS = ("materia_ssd_cod",)          # list -> OR of equalities (trimmed)
CONTAINS_PARAMS = ("facolta", "materia_nome", "insegnamento_prof")  # substring, any case
COMMA_LIST_PARAMS = ("isbn",)                       # 'a, b' -> OR of equalities (trimmed)
# New-adoption filter: these are substring matches there, the rest equalities.
NEW_ADOPTION_CONTAINS = ("laurea_nome", "insegnamento_prof", "titolo")
# --- end of fixed values ---


def is_blank(value: Any) -> bool:
    """Blank parameters are dropped: '', [''] and None (D5: None always)."""
    return value is None or value == "" or (isinstance(value, (list, tuple)) and list(value) == [""])


def _typed_lit(df: DataFrame, col: str, value: Any) -> Column:
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    return F.lit(str(value)).try_cast(dtype.simpleString())


def _isin(df: DataFrame, col: str, values: Iterable[Any]) -> Column:
    dtype = df.schema[col].dataType
    vals = list(values)
    if isinstance(dtype, T.StringType):
        return F.col(col).isin([str(v) for v in vals])
    return F.col(col).isin([_typed_lit(df, col, v) for v in vals])


def active_set(base: DataFrame, selection: DataFrame | None) -> DataFrame:
    """The current selection, or the whole base when it is empty.

    ``isEmpty`` is a LIMIT-1 probe, not a count."""
    if selection is None or selection.isEmpty():
        return base
    return selection


def select_by(df: DataFrame, column: str, keys: Sequence[Any] | DataFrame) -> DataFrame:
    """Keep rows whose ``column`` is one of ``keys``.

    A Python list (the choices of one request) is a pushed-down ``IN``; a
    DataFrame of keys (one column) is a ``left_semi`` join.
    """
    if isinstance(keys, DataFrame):
        kcol = keys.columns[0]
        k = keys.select(F.col(kcol).cast("string").try_cast(df.schema[column].dataType.simpleString()).alias("_key")).distinct()
        return df.join(k, df[column] == k["_key"], "left_semi")
    return df.filter(_isin(df, column, keys))


def keys_from_json(spark: SparkSession, payload: str, part: str = "keys") -> DataFrame:
    """The keys of a JSON object or the values of a JSON array as a
    one-column DataFrame (``json_each``), parsed by Spark, not by the driver."""
    src = spark.range(1).select(F.lit(payload).alias("j"))
    fn = json_keys if part == "keys" else json_values
    return src.select(F.explode(fn(F.col("j"))).alias("key"))


def _listed(name: str, value: Any) -> list[Any]:
    """The values a parameter allows: list parameters are trimmed, comma lists split first."""
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if name in COMMA_LIST_PARAMS:
        values = [part for v in values for part in str(v).split(",")]
    trimmed = name in COMMA_LIST_PARAMS or name in MULTI_VALUE_PARAMS
    return [str(v).strip() if trimmed else v for v in values]


def param_predicates(df: DataFrame, params: Sequence[tuple[str, Any]],
                     contains: Sequence[str] = CONTAINS_PARAMS) -> list[Column]:
    """One predicate per non-blank ``(param, value)``: a substring match or a value list."""
    given = [(name, value) for name, value in params if not is_blank(value)]
    return [contains_ci(name, str(value)) if name in contains else _isin(df, name, _listed(name, value))
            for name, value in given]


def where_params(df: DataFrame, params: Sequence[tuple[str, Any]],
                 contains: Sequence[str] = CONTAINS_PARAMS) -> DataFrame:
    """conjunction of the parameter predicates; no parameter -> all rows."""
    preds = param_predicates(df, params, contains)
    return df.filter(reduce(and_, preds)) if preds else df


def year_window(year: int, col: str = "a_a") -> Column:
    """``a_a = y OR a_a = y - 1``."""
    return F.col(col).isin(int(year), int(year) - 1)


def search_predicate(df: DataFrame, needle: str, columns: Sequence[str] | None = None) -> Column:
    """case-insensitive substring over any column; NULL never matches."""
    cols = list(columns) if columns else df.columns
    return reduce(or_, [contains_ci(c, needle) for c in cols])


def free_text_search(df: DataFrame, needle: str, columns: Sequence[str] | None = None) -> DataFrame:
    return df.filter(search_predicate(df, needle, columns))


def search_last_query(df: DataFrame, needle: str) -> DataFrame:
    """like F13 but the needle is not lower-cased, so upper-case needles
    never match (the stored behaviour of the unused last-query search)."""
    return df.filter(reduce(or_, [F.lower(F.col(c).cast("string")).contains(F.lit(needle))
                                  for c in df.columns]))


# --- Fixed values: fields of the adoption request form (F15). ---
REQUEST_FIELDS = ("uni_cod", "a_a", "laurea_nome", "laurea_tipo", "laurea_classe_cod", "curr_nome",
                  "materia_nome", "materia_ssd_cod", "curr_materia_anno", "curr_materia_periodo",
                  "insegnamento_prof", "isbn", "autori", "titolo", "editore", "testo_obb",
                  "page", "ult_agg")
# --- end of fixed values ---


def request_filter(df: DataFrame, request: dict[str, Any]) -> DataFrame:
    """the adoption request over landed data. The year is mandatory;
    list-valued fields (sectors, isbns, publishers) are ``IN`` lists; paging
    fields of the remote service (``page``, ``ult_agg``) do not filter rows."""
    if is_blank(request.get("a_a")):
        raise ValueError("a_a (academic year) is required")
    preds = []
    for name in REQUEST_FIELDS:
        value = request.get(name)
        if is_blank(value) or name in ("page", "ult_agg"):
            continue
        if isinstance(value, (list, tuple)):
            preds.append(_isin(df, name, [str(v).strip() for v in value]))
        else:
            preds.append(F.col(name) == _typed_lit(df, name, value))
    return df.filter(reduce(and_, preds))

"""Name cleaning and matching keys (C1, C2, C9, C10) as native expressions.

The rules follow Python ``re``/``str`` semantics and are written for Java's
regex engine: ``(?d)`` makes ``\\n`` the only line terminator (like Python's
``.``), ``(?U)`` gives Unicode ``\\b``/``\\s``/case folding (like Python 3
``str`` patterns), ``\\z`` is Python's ``\\Z``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cattedra.functions._col import as_col

# --- Fixed values: lecturer-name placeholders that mean "no lecturer". ---
PLACEHOLDER_PREFIXES = ("docente", "docenti", "assegnazione", "000000 00000", "not assigned")
NOT_ASSIGNED_PATTERN = r"\bnon\s(.)*(assegnato|definito|assegnati|definiti|Not Assigned)"
BLANK_PATTERN = r"^da definire|^da nominare|Assegnazione|^[0\s]+"
TRAILING_NOTE_PATTERN = r"\(.+\)\z"
# --- end of fixed values ---

# Python's str.isspace() also counts the separators U+001C..U+001F.
_PY_SPACE = r"[\s\x{1c}-\x{1f}]"


def py_strip(c: Column | str) -> Column:
    """``str.strip()`` with no argument: Unicode whitespace at both ends."""
    return F.regexp_replace(as_col(c), rf"(?U)^{_PY_SPACE}+|{_PY_SPACE}+\z", "")


def strip_chars(c: Column | str, chars: str) -> Column:
    """``str.strip(chars)``."""
    cls = "".join("\\" + ch if not ch.isalnum() else ch for ch in chars)
    return F.regexp_replace(as_col(c), rf"(?d)^[{cls}]+|[{cls}]+\z", "")


def py_title(c: Column | str) -> Column:
    """C9 ``str.title()``: upper-case a letter that follows a non-letter.

    ``initcap`` alone only capitalises after spaces (``D'angelo``); splitting at
    every non-letter -> letter boundary first gives ``D'Angelo``, ``Maria-Rosa``.
    """
    col = as_col(c)
    pieces = F.split(col, r"(?<=\P{L})(?=\p{L})")
    by_pieces = F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")
    # initcap already equals title() unless a letter follows a non-letter other
    # than a space; only those names take the (lambda) piecewise path
    return F.when(col.rlike(r"[^\p{L} ]\p{L}"), by_pieces).otherwise(F.initcap(col))


def clean_prof_name(c: Column | str) -> Column:
    """Drop a trailing ``(...)``, trim `` -``, blank placeholder names,
    turn commas into spaces, strip and title-case. NULL stays NULL."""
    col = as_col(c)
    step1 = strip_chars(F.regexp_replace(col, "(?d)" + TRAILING_NOTE_PATTERN, ""), " -")
    lowered = F.lower(step1)
    placeholder = None
    for prefix in PLACEHOLDER_PREFIXES:
        cond = lowered.startswith(F.lit(prefix))
        placeholder = cond if placeholder is None else (placeholder | cond)
    blank = (placeholder
             | step1.rlike("(?iUd)" + NOT_ASSIGNED_PATTERN)
             | step1.rlike("(?iUd)" + BLANK_PATTERN))
    commas = F.replace(F.replace(step1, F.lit(", "), F.lit(" ")), F.lit(","), F.lit(" "))
    return F.when(col.isNull(), F.lit(None).cast("string")).when(blank, F.lit("")).otherwise(
        py_title(py_strip(commas)))


def name_key(c: Column | str, empty_as_null: bool = True) -> Column:
    """Order-free name key: whitespace tokens, sorted, joined by a space.

    ``sorted`` compares code points; ``sort_array`` on strings compares UTF-8
    bytes, which orders the same way. Stripping both ends first means the
    split yields no empty tokens, so no lambda is needed and the whole key
    stays in generated code. With ``empty_as_null`` an empty name gets a NULL
    key so blank names never match each other (D3).
    """
    tokens = F.split(py_strip(c), rf"(?U){_PY_SPACE}+")
    key = F.array_join(F.sort_array(tokens), " ")
    if empty_as_null:
        return F.nullif(key, F.lit(""))
    return key


def contains_ci(c: Column | str, needle: str) -> Column:
    """case-insensitive substring; ``%``/``_`` are literal (D6), Unicode folding."""
    return F.lower(as_col(c).cast("string")).contains(F.lit(needle.lower()))

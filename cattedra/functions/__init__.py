"""Native-expression scalar functions (no Python UDFs)."""

from cattedra.functions.isbn import isbn13, isbn13_valid, isbn_strip, isbn_to_number
from cattedra.functions.scalars import (
    academic_year, blank_if_null, id_or_zero, isbn_or_label, json_keys,
    json_values, sector_spaces, space_concat, sqlite_int, sqlite_int_of, tenant_key,
)
from cattedra.functions.text import clean_prof_name, contains_ci, name_key, py_strip, py_title

__all__ = [
    "academic_year", "blank_if_null", "clean_prof_name", "contains_ci", "id_or_zero",
    "isbn13", "isbn13_valid", "isbn_or_label", "isbn_strip", "isbn_to_number",
    "json_keys", "json_values", "name_key", "py_strip", "py_title",
    "sector_spaces", "space_concat", "sqlite_int", "sqlite_int_of", "tenant_key",
]

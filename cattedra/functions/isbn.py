"""ISBN functions (C3, C4, C5, C15) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cattedra.functions._col import as_col, number_of_text

# --- Fixed values: ISBN rules. ---
ISBN13_PREFIX = "978"
# Punctuation class of the contacts upload; the range ':' .. '[' also takes A-Z.
ISBN_PUNCT_CLASS = r"[!-/:-\[\-`{-~]"
# --- end of fixed values ---


def _digit(ch: Column) -> Column:
    """The value of one digit; NULL for any other character."""
    return F.when(ch.between("0", "9"), ch.try_cast("int"))


def ean_check_digit(body: Column) -> Column:
    """Check digit for a string of digits: weights 1,3,1,3,... from the left,
    ``(10 - sum % 10) % 10``. NULL if any character is not a digit.

    The string is split into characters once; the lambdas only see elements,
    so the input expression is not re-evaluated per position."""
    chars = F.split(body, "")
    weighted = F.transform(chars, lambda ch, i: _digit(ch) * F.when(i % 2 == 1, F.lit(3)).otherwise(F.lit(1)))
    total = F.aggregate(weighted, F.lit(0).cast("int"), lambda acc, x: acc + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def ean13_check_digit(body12: Column) -> Column:
    """Check digit of exactly 12 digits, as twelve plain terms (no lambdas,
    so the expression stays inside generated code)."""
    terms = [_digit(body12.substr(i, 1)) * (3 if i % 2 == 0 else 1) for i in range(1, 13)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _with_check(body: Column) -> Column:
    return F.concat(body, ean_check_digit(body))


def isbn13(c: Column | str) -> Column:
    """ISBN-10 (bare, or hyphenated 13 characters) -> 13 digits with a new
    check digit; hyphenated 17 characters -> hyphens removed; another
    hyphenated length -> NULL; anything else unchanged. NULL -> NULL."""
    s = as_col(c)
    digits = F.replace(s, F.lit("-"), F.lit(""))
    has_dash = F.instr(s, "-") > 0
    n = F.length(s)
    from_ten = _with_check(F.concat(F.lit(ISBN13_PREFIX), digits.substr(F.lit(1), F.length(digits) - 1)))
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(has_dash & (n == 13), from_ten)
            .when(has_dash & (n == 17), digits)
            .when(has_dash, F.lit(None).cast("string"))
            .when(n == 10, from_ten)
            .otherwise(s))


def isbn13_valid(c: Column | str) -> Column:
    """13 digits, no hyphens or spaces, and a correct check digit."""
    s = as_col(c)
    ok_form = s.rlike(r"^\d{13}\z")
    return F.coalesce(ok_form & (s.substr(13, 1) == ean13_check_digit(s)), F.lit(False))


def isbn_strip(c: Column | str) -> Column:
    """C4: remove the punctuation class (which also removes A-Z, incl. ``X``)."""
    return F.regexp_replace(as_col(c), ISBN_PUNCT_CLASS, "")


def isbn_to_number(c: Column | str) -> Column:
    """Blank or NULL -> 0; text written as a float (``978...0``) is read as a
    number first; otherwise the stripped text as a number (NULL if not numeric)."""
    s = as_col(c).cast("string")
    float_text = s.rlike(r"^\s*\d+\.0+\s*$")
    return (F.when(s.isNull() | (F.trim(s) == ""), F.lit(0).cast("bigint"))
            .when(float_text, s.try_cast("double").try_cast("bigint"))
            .otherwise(number_of_text(isbn_strip(s))))

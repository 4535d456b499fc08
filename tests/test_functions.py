"""Scalar functions (C1-C15, P2-P4) on the fixture cases."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.functions import (
    academic_year, clean_prof_name, id_or_zero, isbn13, isbn13_valid, isbn_or_label, isbn_strip,
    isbn_to_number, name_key, py_title, sector_spaces, space_concat, sqlite_int, tenant_key,
)


def one_col(spark, values, dtype=T.StringType()):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", dtype)])
    return spark.createDataFrame(list(enumerate(values)), schema)


def apply(spark, fn, values, dtype=T.StringType()):
    df = one_col(spark, values, dtype)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_prof_name_fixture_names(spark):
    names = ["ROSSI, MARIO", "Mario Rossi", "d'angelo maria-rosa", "Bianchi Anna (supplente)",
             "Docente da definire", "non ancora assegnato", "000000 00000", "", None,
             "Prof. Non assegnato", "da nominare", "  - Verdi Luca -  ", "Nessuna Assegnazione",
             "Docenti vari", "NOT ASSIGNED", "0Rossi", "Rossi (a) (b)", "Neri,Paolo", "Conti (x\ny)", "Conti (x\ry)", "Conti\n(x)"]
    assert apply(spark, clean_prof_name, names) == [
        "Rossi Mario", "Mario Rossi", "D'Angelo Maria-Rosa", "Bianchi Anna",
        "", "", "", "", None,
        "", "", "Verdi Luca", "",
        "", "", "", "Rossi", "Neri Paolo", "Conti (X\nY)", "Conti", "Conti"]


def test_title_case_after_non_letters(spark):
    assert apply(spark, py_title, ["d'angelo maria-rosa", "ROSSI MARIO", "1st x", "àlvaro ñu", ""]) == [
        "D'Angelo Maria-Rosa", "Rossi Mario", "1St X", "Àlvaro Ñu", ""]


def test_name_key_order_free_and_blank(spark):
    out = apply(spark, name_key, ["Mario Rossi", "Rossi  Mario", " Rossi\tMario ", "", "   ", None, "b a c"])
    assert out == ["Mario Rossi", "Mario Rossi", "Mario Rossi", None, None, None, "a b c"]


def test_name_key_case_sensitive(spark):
    assert apply(spark, name_key, ["rossi mario", "Rossi Mario"]) == ["mario rossi", "Mario Rossi"]


def test_isbn13_forms(spark):
    vals = ["0306406157", "0-306-40615-7", "978-0-306-40615-7", "9780306406157", "030640615X",
            "junk", "12-34", None, ""]
    assert apply(spark, isbn13, vals) == [
        "9780306406157", "9780306406157", "9780306406157", "9780306406157", "9780306406157",
        "junk", None, None, ""]


def test_isbn13_output_passes_check(spark):
    df = spark.range(0, 3000).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("v"))
    out = df.select(isbn13_valid(isbn13("v")).alias("ok"))
    assert out.filter(~F.col("ok")).count() == 0


def test_isbn13_valid_rejects(spark):
    assert apply(spark, isbn13_valid, ["9780306406157", "9780306406158", "978030640615", "978-0306406157",
                                       None]) == [True, False, False, False, False]


def test_isbn_strip_class(spark):
    assert apply(spark, isbn_strip, ["978-0-306-40615-7", "030640615X", "isbn 12", "a\\b]c^d_e", "{x}~"]) == [
        "9780306406157", "030640615", "isbn 12", "a\\b]c^d_e", "x"]


def test_isbn_to_number(spark):
    assert apply(spark, isbn_to_number, ["", None, "9780306406157.0", "978-0-306-40615-7", " 88 ", "abc"]) == [
        0, 0, 9780306406157, 9780306406157, 88, None]


def test_sqlite_int_text(spark):
    assert apply(spark, sqlite_int, ["12abc", "3.9", "", "abc", " -5x", "+7", None]) == [12, 3, 0, 0, -5, 7, None]


def test_sqlite_int_numbers(spark):
    df = spark.createDataFrame([(3.9,), (None,)], "v double")
    assert [r[0] for r in df.select(sqlite_int(F.col("v"), T.DoubleType())).collect()] == [3, None]


def test_id_or_zero(spark):
    assert apply(spark, id_or_zero, ["123", "123.0", None, "x", ""]) == [123, 123, 0, 0, 0]


def test_small_rules(spark):
    assert apply(spark, sector_spaces, ["M-GGR/01;M-GGR/02"]) == ["M-GGR/01 M-GGR/02"]
    assert apply(spark, isbn_or_label, [None, "1"]) == ["Nessun saggio", "1"]
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(space_concat("x", "y")).collect()] == ["a b", None]
    assert apply(spark, tenant_key, ["1"]) == ["c4ca4238a0b923820dcc509a6f75849b"]


def test_academic_year(spark):
    vals = [dt.date(2024, 8, 31), dt.date(2024, 9, 1), dt.date(2025, 1, 10)]
    assert apply(spark, academic_year, vals, T.DateType()) == [2023, 2024, 2024]


def test_numbers_in_text(spark):
    """Cells of every kind: whole numbers, decimals, blanks, signs, outer blanks, numbers too large, words."""
    from cattedra.functions._col import number_of_text
    cells = {"12": 12, " +7 ": 7, "-3": -3, "4.0": 4, "4.9": 4, "": None, " ": None, "x": None, "1e3": 1000, "99999999999999999999": None,
             "12a": None, "NaN": None, None: None, "0012": 12, "\t5\n": 5}
    df = spark.createDataFrame([(k,) for k in cells], "t string")
    assert {r.t: r.n for r in df.select("t", number_of_text(F.col("t")).alias("n")).collect()} == cells
    assert {r.t: r.n for r in df.select("t", F.coalesce(F.col("t").try_cast("bigint"), F.col("t").try_cast("double").try_cast(
        "bigint")).alias("n")).collect()} == cells

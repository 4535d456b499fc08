"""Distinct listings, ordering and paging."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.session import remove_path, scratch_path

# --- Fixed values: listing column sets, page sizes, preview sizes. ---
LISTINGS: dict[str, list[str]] = {
    "adoptions": ["uni_cod", "laurea_nome", "materia_nome", "materia_ssd_cod", "insegnamento_prof",
                  "isbn", "autori", "curatori", "titolo", "editore", "testo_obb"],
    "courses": ["uni_cod", "laurea_nome", "materia_nome", "materia_ssd_cod", "insegnamento_prof",
                "insegnamento_id", "prof_id"],
    "lecturers": ["prof_id", "materia_ssd_cod", "insegnamento_prof", "uni_cod", "sede", "facolta"],
    "books": ["isbn", "autori", "curatori", "titolo", "editore"],
    "dashboard_adoptions": ["a_a", "uni_cod", "laurea_nome", "materia_nome", "materia_ssd_cod",
                            "insegnamento_prof", "isbn", "titolo", "editore", "testo_obb",
                            "laurea_matricole"],
    "dashboard_lecturers": ["prof_id", "materia_ssd_cod", "insegnamento_prof", "insegnamento_prof_www",
                            "uni_cod", "sede", "facolta"],
    "new_adoption_base": ["a_a", "uni_cod", "laurea_nome", "laurea_tipo", "laurea_classe_cod",
                          "insegnamento_prof", "isbn", "titolo", "editore", "laurea_matricole"],
    "sector_lecturers": ["insegnamento_prof"],
    "lecturer_books": ["isbn", "titolo"],
}
COURSES_ORDER = ["uni_cod", "laurea_nome", "materia_nome"]
PREVIEW_COLUMNS = ["uni_cod", "laurea_nome", "materia_nome", "materia_ssd_cod", "insegnamento_prof",
                   "isbn", "titolo", "editore"]
PAGE_SIZE = 100
CONTACT_PAGE_SIZE = 20
PREVIEW_SIZES = (5, 10, 20)
# --- end of fixed values ---

# Rows a file of a ranked listing holds at most, so a page sorts at most two such files.
FILE_ROWS = 50_000


def listing(df: DataFrame, name: str) -> DataFrame:
    """``SELECT DISTINCT <columns>`` over the active set."""
    return df.select(*LISTINGS[name]).distinct()


def courses(df: DataFrame) -> DataFrame:
    """L2 + T1: course listing ordered by university, degree, subject."""
    return listing(df, "courses").orderBy(*COURSES_ORDER, *LISTINGS["courses"][3:])


def total_order(df: DataFrame, first: Sequence[str | Column] = ()) -> list[Column]:
    """``first`` then every remaining column ascending: a total order, so pages
    and previews are reproducible."""
    named = [c for c in first if isinstance(c, str)]
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c not in named]
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in first] + rest


@dataclass
class Page:
    rows: DataFrame
    number: int
    num_pages: int
    count: int

    @property
    def has_next(self) -> bool:
        return self.number < self.num_pages

    @property
    def has_previous(self) -> bool:
        return self.number > 1


def page_number(requested: Any, num_pages: int) -> int:
    """T5: what is no whole number means the first page; numbers outside 1..last mean the last one."""
    try:
        wanted = int(requested)
    except (TypeError, ValueError):
        return 1
    return wanted if wanted in range(1, num_pages + 1) else num_pages


@dataclass
class Ranked:
    """A listing stored once in its order, with a directory of its files: the rows of each and how many come before.

    A page looks its files up in the directory and reads these alone (two at most, of ``FILE_ROWS`` rows), whatever its
    number; the listing itself is not evaluated again. ``open_ranked`` finds it again from its folder."""

    spark: SparkSession
    path: str
    order: list[str]
    schema: T.StructType

    def _directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory")

    @property
    def count(self) -> int:
        return self._directory().agg(F.max(F.col("before") + F.col("rows"))).first()[0] or 0

    def frame(self) -> DataFrame:
        """All rows of the listing."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def slice(self, start: int, size: int) -> DataFrame:
        """``size`` rows from place ``start`` on, in order."""
        held = (F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)
        files = self._directory().where(held).orderBy("before").collect()  # two, or as many as ``size`` rows fill
        if not files:
            return self.frame().limit(0)
        rows = self.spark.read.schema(self.schema).parquet(*[f.file for f in files])
        return rows.orderBy(*_nulls_first(self.order)).offset(start - files[0].before).limit(size)

    def page(self, number: Any = 1, size: int = PAGE_SIZE) -> Page:
        count = self.count
        pages = math.ceil(max(1, count) / size)
        n = page_number(number, pages)
        return Page(self.slice((n - 1) * size, size), n, pages, count)


def _nulls_first(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def store_ranked(df: DataFrame, path: str | None = None, first: Sequence[str] = (), file_rows: int = FILE_ROWS) -> Ranked:
    """Write ``df`` ordered by ``first``, then by every other column (a total order), with its directory.

    ``df`` is evaluated once: its rows are staged, since finding the ranges of the order reads them twice. Ranges are cut on
    all columns, so a value that a third of all rows share is spread over many tasks."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "ranked")
    order = [*first, *[c for c in df.columns if c not in first]]
    df.write.mode("errorifexists").parquet(f"{path}/staged")
    staged = spark.read.schema(df.schema).parquet(f"{path}/staged")
    ranged = staged.repartitionByRange(*_nulls_first(order)).sortWithinPartitions(*_nulls_first(order))
    ranged.write.mode("errorifexists").option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    remove_path(spark, f"{path}/staged")
    out = Ranked(spark, path, order, df.schema)
    files = out.frame().groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # task and piece of the file's name are its place in the order
    place = [F.regexp_extract("file", pattern, 1).cast("int") for pattern in (r"part-(\d+)-[^/]*$", r"-c(\d+)\.[^/]*$")]
    earlier = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))  # one row a file
    files.write.mode("errorifexists").parquet(f"{path}/directory")
    return out


def open_ranked(spark: SparkSession, path: str, first: Sequence[str] = ()) -> Ranked:
    """A listing stored by ``store_ranked`` with the same ``first``."""
    schema = spark.read.parquet(f"{path}/rows").schema
    return Ranked(spark, path, [*first, *[c for c in schema.fieldNames() if c not in first]], schema)


def page(df: DataFrame, number: Any = 1, size: int = PAGE_SIZE,
         order: Sequence[str] = ()) -> Page:
    """T5: one page of a listing plus the paging facts. For more pages of it keep what ``store_ranked`` returns."""
    return store_ranked(df, first=list(order)).page(number, size)


def preview(df: DataFrame, n: int = 5, order: Sequence[str | Column] = ()) -> DataFrame:
    """The first ``n`` rows in a total order."""
    return df.orderBy(*total_order(df, order)).limit(n)


def newest_first(df: DataFrame, col: str = "date") -> DataFrame:
    """Newest first."""
    return df.orderBy(F.col(col).desc_nulls_last(), *[F.col(c) for c in df.columns if c != col])


def by_lecturer(df: DataFrame, col: str = "insegnamento_prof") -> DataFrame:
    """Sort by lecturer, NULL first (SQLite's order)."""
    return df.orderBy(F.col(col).asc_nulls_first())

"""Lecturer directory build and lecturer selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cattedra.functions.scalars import id_or_zero
from cattedra.operators.dedup import asc, desc, keep_first
from cattedra.operators.select import where_params
from cattedra.schemas import CONTACT_COLUMNS, DIRECTORY_COLUMNS

# --- Fixed values: contact fields blank on a lecturer taken into the selection. ---
CONTACT_ONLY_FIELDS = ["facolta", "email", "indirizzo", "citta", "telefono", "note", "isbn", "titolo", "data"]
ADOPTION_SIDE_BLANK = ["materia_nome", "email", "indirizzo", "citta", "telefono", "note", "isbn", "titolo", "data"]
LECTURER_COLUMNS = ["uni_cod", "facolta", "materia_ssd_cod", "materia_nome", "insegnamento_prof",
                    "insegnamento_prof_www", "prof_id", "insegnamento_id"]
# --- end of fixed values ---


def directory_chain(work_prof_id: DataFrame, insegnamento_prof_id: DataFrame, insegnamenti: DataFrame,
                    materia_ssd: DataFrame, materie: DataFrame,
                    step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Lecturer -> course -> subject -> sector, four inner equi-joins.

    Written fact-first: the course assignments (the large side) stream through
    the joins and the lecturer, sector and subject tables are the build sides,
    so the work spreads over the large side's partitions. ``step`` takes what the
    first and the second join give: one that stores it frees their shuffles before the next."""
    return (step(step(insegnamento_prof_id.join(insegnamenti, "insegnamento_id"))
                 .join(work_prof_id, "prof_id"))
            .join(materia_ssd, "materia_id")
            .join(materie, "materia_id")
            .select("prof_id", "uni_cod", F.col("prof_nome").alias("insegnamento_prof"),
                    "insegnamento_id", "insegnamento_prof_www", "materia_ssd_cod", "materia_nome",
                    "materia_id"))


def latest_course(chain: DataFrame) -> DataFrame:
    """The course with the highest id per lecturer; ties (one course,
    several subjects) go to the smallest sector, subject and subject id.

    A partial aggregation (map-side) instead of ``row_number() = 1``, so a
    lecturer with very many courses never sits in one task."""
    picked = keep_first(chain, ["prof_id"], [desc("insegnamento_id"), asc("materia_ssd_cod"),
                                             asc("materia_nome"), asc("materia_id")])
    return picked.select(*DIRECTORY_COLUMNS)


def build_directory(sources: dict[str, DataFrame], year_filter: Any = None,
                    step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Q9 (S8 + J4 + W1): the directory table from the upstream tables.

    ``year_filter`` (a Column over the chain) is applied before the window,
    the second variant of the build (J6). ``step``: see ``directory_chain``."""
    chain = directory_chain(sources["work_prof_id"], sources["insegnamento_prof_id"],
                            sources["insegnamenti"], sources["materia_ssd"], sources["materie"], step)
    if year_filter is not None:
        chain = chain.filter(year_filter)
    return latest_course(chain)


def courses_of_year(sources: dict[str, DataFrame], year: int) -> DataFrame:
    """Ids of the courses that a degree of ``year`` teaches: course -> curriculum subject -> curriculum -> degree.
    Distinct, so a course in several curricula is one row."""
    degrees = sources["lauree"].where(F.col("laurea_aa") == F.lit(int(year))).select("laurea_id")
    curricula = sources["curricula"].join(degrees, "laurea_id", "left_semi").select("curr_id")
    subjects = sources["curricula_materie"].join(curricula, "curr_id", "left_semi").select("curr_materia_id")
    return (sources["curr_materie_insegnamenti"].join(subjects, "curr_materia_id", "left_semi")
            .select("insegnamento_id").distinct())


def latest_course_of_year(sources: dict[str, DataFrame], year: int) -> DataFrame:
    """Per lecturer the latest of the year's courses and its page; lecturers without one are left out."""
    taught = sources["insegnamento_prof_id"].join(courses_of_year(sources, year), "insegnamento_id", "left_semi")
    paged = taught.join(sources["insegnamenti"], "insegnamento_id", "left")
    last = keep_first(paged.select("prof_id", "insegnamento_id", "insegnamento_prof_www"), ["prof_id"],
                      [desc("insegnamento_id"), asc("insegnamento_prof_www")])
    return sources["work_prof_id"].select("prof_id", "uni_cod", "prof_nome").join(last, "prof_id")


def directory_as_contacts(directory: DataFrame) -> DataFrame:
    """Directory rows in the contact layout, contact fields ``''``."""
    d = directory.select(*[F.col(c) for c in DIRECTORY_COLUMNS])
    d = d.withColumns({"prof_id": id_or_zero("prof_id"), "insegnamento_id": id_or_zero("insegnamento_id")})
    d = d.withColumns({c: F.lit("") for c in CONTACT_ONLY_FIELDS})
    return d.select(*CONTACT_COLUMNS)


def adoption_lecturers(adoptions: DataFrame) -> DataFrame:
    """Adoption side of Q4: lecturer columns of the active set, contact fields
    ``''``. ``materia_nome`` is blanked as in the reference; ``insegnamento_id``
    keeps its own value (D11)."""
    a = adoptions.select(*LECTURER_COLUMNS)
    a = a.withColumns({"prof_id": id_or_zero("prof_id"), "insegnamento_id": id_or_zero("insegnamento_id")})
    a = a.withColumns({c: F.lit("") for c in ADOPTION_SIDE_BLANK})
    return a.select(*CONTACT_COLUMNS)


def select_lecturers(directory: DataFrame, adoptions: DataFrame, mode: int | None,
                     params: Sequence[tuple[str, Any]] = ()) -> DataFrame | None:
    """Q4 lecturer selection.

    mode 2: directory rows matching ``params``; mode 1: those plus the
    lecturers of the adoptions, one row per (prof_id, insegnamento_id) with the
    directory row first (A7); mode 0: adoption lecturers only, de-duplicated;
    no mode: nothing is selected (``None``).
    """
    if mode is None:
        return None
    dir_side = directory_as_contacts(where_params(directory, params))
    if mode == 2:
        return dir_side
    ado_side = adoption_lecturers(adoptions)
    if mode == 1:
        both = dir_side.withColumn("_src", F.lit(0)).unionByName(ado_side.withColumn("_src", F.lit(1)))
    elif mode == 0:
        both = ado_side.withColumn("_src", F.lit(1))
    else:
        raise ValueError(f"unknown lecturer selection mode {mode!r}")
    picked = keep_first(both, ["prof_id", "insegnamento_id"], [asc("_src")])
    return picked.drop("_src")

"""Registered queries: one per operator family of the inventory.

Each query takes ``(spark, sf_dir)``, reads the driver's tables through the
test-data mapping and returns a DataFrame over the whole tables (queries of
sources and sinks land files first).
Parameters are fixed values (years, keys, dates) so results are reproducible;
nothing reads the clock. Each query sits next to its DuckDB oracle SQL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cattedra.functions import (
    academic_year, clean_prof_name, isbn13, isbn13_valid, isbn_strip, isbn_to_number, name_key,
    py_title, sqlite_int, tenant_key,
)
from cattedra.operators import aggregates as agg
from cattedra.operators import changes as chg
from cattedra.operators import directory as dirs
from cattedra.operators import listings as lst
from cattedra.operators import select as sel
from cattedra.operators import setops
from cattedra.operators.numbering import with_group_index
from cattedra.operators.resolve import resolve_adoptions, resolve_contacts
from cattedra.plans import oracle as O
from cattedra.plans import testdata as td
from cattedra.plans.oracle import ADOPTIONS_CTE as A_CTE
from cattedra.plans.oracle import CONTACTS_CTE as C_CTE
from cattedra.plans.oracle import DIRECTORY_CTE as D_CTE
from cattedra.plans.oracle import LOG_CTE as L_CTE
from cattedra.schemas import ADOPTION_COLUMNS, CONTACT_COLUMNS, TABLES
from cattedra.session import apply_runtime_conf, size_tasks, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# --- Fixed values: query parameters (keys present at every scale factor). ---
UNI_KEYS_JSON = '{"NATION_1": "on", "NATION_7": "on", "NATION_12": "on"}'
SECTOR_VALUES_JSON = '["ECONOMY", "PROMO"]'
LECTURER_IDS_JSON = '["1", "2", "3", "5", "8"]'
BOOK_KEYS = ["7", "8", "9", "31"]
ONE_BOOK = "7"
YEAR = 1997
ONE_LECTURER = "Supplier 000000001"
AUDIENCE_NAME = "Promo autunno"
AUDIENCE_DATE = dt.date(2025, 1, 15)
DRILL_LECTURER_DATE = "1998-10-01"
DRILL_BOOK_DATE = "1998-03-01"
SEARCH_NEEDLE = "blue"
DOC_NEEDLE = "license"
JSON_EVENT_KEYS = '{"click": "on", "purchase": "on"}'
ADHOC_SQL = ("SELECT uni_cod, a_a, COUNT(*) AS n_rows, SUM(laurea_matricole) AS studenti "
             "FROM adozioni WHERE a_a >= :y GROUP BY uni_cod, a_a")
ADHOC_YEAR = 1996
# --- end of fixed values ---


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_runtime_conf(spark)
            size_tasks(spark, td.input_bytes(spark, sf_dir))
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def _cols(cols) -> str:
    return ", ".join(cols)


def _directory(spark, sf_dir):
    """The stored directory table (built by Q9 once per session)."""
    return td.directory(spark, sf_dir)


# ------------------------------------------------------------ reports (A)
#: One enrolment for each degree of a university that adopts a book, however many courses adopt it: the first row of
#: (book, university, degree, number) counts, and a book's total is a running window over its rows.
_ENROLMENTS = """iscrizioni AS (
  SELECT isbn, uni_cod, laurea_nome, titolo, autori, curatori, editore, laurea_matricole,
         row_number() OVER (PARTITION BY isbn, uni_cod, laurea_nome, laurea_matricole) AS volta,
         row_number() OVER (PARTITION BY isbn, laurea_nome, laurea_matricole) AS volta_nel_libro
  FROM adozioni WHERE isbn IS NOT NULL)"""
_BOOK_TOTALS = """
SELECT DISTINCT isbn, titolo, CASE WHEN curatori IS NOT NULL THEN autori || ' ' || curatori END AS autore, editore,
       CAST(sum(laurea_matricole) FILTER (WHERE volta = 1) OVER (PARTITION BY isbn) AS BIGINT) AS studenti
FROM iscrizioni"""


@register("students_per_book", O.with_ctes(_BOOK_TOTALS, A_CTE, _ENROLMENTS))
def q_students_per_book(spark, sf_dir):
    """A1 + J3: students per book over all adoptions."""
    return agg.students_per_book(td.adoptions(spark, sf_dir))


@register("students_one_book", O.with_ctes(f"""
SELECT CAST(sum(laurea_matricole) FILTER (WHERE isbn = '{ONE_BOOK}' AND volta_nel_libro = 1) AS BIGINT) AS totale_studenti
FROM iscrizioni""", A_CTE, _ENROLMENTS))
def q_students_one_book(spark, sf_dir):
    """A5: students for one book."""
    return agg.students_one_book(td.adoptions(spark, sf_dir), ONE_BOOK)


@register("summary_counts", O.with_ctes("""
SELECT count(uni_cod) AS uni_cod_count, count(DISTINCT uni_cod) AS uni_cod_unique,
       count(isbn) AS isbn_count, count(DISTINCT isbn) AS isbn_unique,
       count(materia_ssd_cod) AS materia_ssd_cod_count, count(DISTINCT materia_ssd_cod) AS materia_ssd_cod_unique,
       count(insegnamento_prof) AS insegnamento_prof_count,
       count(DISTINCT insegnamento_prof) AS insegnamento_prof_unique
FROM adozioni""", A_CTE))
def q_summary_counts(spark, sf_dir):
    """A3: per-column counts of the dashboard summary."""
    return agg.summary_counts(td.adoptions(spark, sf_dir))


@register("distinct_values", O.with_ctes("""
SELECT DISTINCT 'uni_cod' AS column_name, CAST(uni_cod AS VARCHAR) AS value FROM adozioni WHERE uni_cod IS NOT NULL
UNION ALL
SELECT DISTINCT 'materia_ssd_cod', CAST(materia_ssd_cod AS VARCHAR) FROM adozioni WHERE materia_ssd_cod IS NOT NULL""",
                                        A_CTE))
def q_distinct_values(spark, sf_dir):
    """A3/C14: the distinct values of the summary's code columns, one row each."""
    return agg.distinct_values(td.adoptions(spark, sf_dir)).withColumnRenamed("column", "column_name")


@register("first_contact_per_pair", O.with_ctes(f"""
SELECT {_cols(c if c != 'isbn' else "coalesce(isbn, 'Nessun saggio') AS isbn" for c in CONTACT_COLUMNS)}
FROM (SELECT *, row_number() OVER (PARTITION BY insegnamento_prof, isbn ORDER BY record_id) AS rn
      FROM docenti_router) t WHERE rn = 1""", C_CTE))
def q_first_contact_per_pair(spark, sf_dir):
    """A4: one contact per (lecturer, sample copy), the first by record id."""
    return agg.first_contact_per_pair(td.contacts(spark, sf_dir)).select(*CONTACT_COLUMNS)


# ---------------------------------------------------------- selections (F)
_ALL_A = _cols(ADOPTION_COLUMNS)


@register("select_university", O.with_ctes(f"""
SELECT {_ALL_A} FROM adozioni WHERE uni_cod IN ('NATION_1', 'NATION_7', 'NATION_12')""", A_CTE))
def q_select_university(spark, sf_dir):
    """F1 + J5: universities chosen as JSON object keys (semi-join)."""
    keys = sel.keys_from_json(spark, UNI_KEYS_JSON, "keys")
    return sel.select_by(td.adoptions(spark, sf_dir), "uni_cod", keys)


@register("select_sector", O.with_ctes(f"""
SELECT {_ALL_A} FROM adozioni WHERE materia_ssd_cod IN ('ECONOMY', 'PROMO')""", A_CTE))
def q_select_sector(spark, sf_dir):
    """F2 + J5: sectors chosen as JSON array values."""
    keys = sel.keys_from_json(spark, SECTOR_VALUES_JSON, "values")
    return sel.select_by(td.adoptions(spark, sf_dir), "materia_ssd_cod", keys)


@register("select_lecturer", O.with_ctes(f"""
SELECT {_ALL_A} FROM adozioni WHERE prof_id IN (1, 2, 3, 5, 8)""", A_CTE))
def q_select_lecturer(spark, sf_dir):
    """lecturer ids sent as text, compared as numbers."""
    keys = sel.keys_from_json(spark, LECTURER_IDS_JSON, "values")
    return sel.select_by(td.adoptions(spark, sf_dir), "prof_id", keys)


@register("select_book", O.with_ctes(f"""
SELECT {_ALL_A} FROM adozioni WHERE isbn IN ('7', '8', '9', '31')""", A_CTE))
def q_select_book(spark, sf_dir):
    """a literal key list, pushed down as IN."""
    return sel.select_by(td.adoptions(spark, sf_dir), "isbn", BOOK_KEYS)


@register("selection_chain", O.with_ctes(f"""
SELECT {_ALL_A} FROM adozioni
WHERE uni_cod IN ('NATION_1', 'NATION_7', 'NATION_12') AND materia_ssd_cod IN ('ECONOMY', 'PROMO')""", A_CTE))
def q_selection_chain(spark, sf_dir):
    """Q1: university step, then sector step on the active set."""
    base = td.adoptions(spark, sf_dir)
    step1 = sel.select_by(base, "uni_cod", sel.keys_from_json(spark, UNI_KEYS_JSON, "keys"))
    step2 = sel.select_by(sel.active_set(base, step1), "materia_ssd_cod",
                          sel.keys_from_json(spark, SECTOR_VALUES_JSON, "values"))
    return step2


@register("filter_builder", O.with_ctes(f"""
SELECT {_ALL_A} FROM adozioni
WHERE materia_ssd_cod IN ('ECONOMY', 'PROMO') AND contains(lower(insegnamento_prof), 'plier 00000001')
  AND contains(lower(facolta), 'urgent') AND a_a = 1997""", A_CTE))
def q_filter_builder(spark, sf_dir):
    """List, substring (any case), equality; blanks dropped."""
    params = [("materia_ssd_cod", ["ECONOMY", " PROMO"]), ("insegnamento_prof", "PLIER 00000001"),
              ("facolta", "Urgent"), ("isbn", ""), ("uni_cod", None), ("laurea_nome", [""]),
              ("a_a", "1997")]
    return sel.where_params(td.adoptions(spark, sf_dir), params)


@register("isbn_list_filter", O.with_ctes(f"""
SELECT {_ALL_A} FROM adozioni WHERE isbn IN ('7', '8', '9')""", A_CTE))
def q_isbn_list_filter(spark, sf_dir):
    """comma-separated isbn list, trimmed."""
    return sel.where_params(td.adoptions(spark, sf_dir), [("isbn", "7, 8 ,9")])


@register("request_filter", O.with_ctes(f"""
SELECT {_ALL_A} FROM adozioni
WHERE a_a = 1997 AND materia_ssd_cod IN ('ECONOMY', 'SMALL') AND editore IN ('Brand#1', 'Brand#2', 'Brand#3')""",
                                        A_CTE))
def q_request_filter(spark, sf_dir):
    """the adoption request form over landed data."""
    req = {"a_a": str(YEAR), "materia_ssd_cod": ["ECONOMY", "SMALL"], "isbn": [""],
           "editore": ["Brand#1", "Brand#2", "Brand#3"], "page": "2", "ult_agg": "2024-01-01"}
    return sel.request_filter(td.adoptions(spark, sf_dir), req)


_SEARCH = " OR ".join(f"contains(lower(CAST({c} AS VARCHAR)), '{SEARCH_NEEDLE}')" for c in ADOPTION_COLUMNS)


@register("free_text_search", O.with_ctes(f"SELECT {_ALL_A} FROM adozioni WHERE {_SEARCH}", A_CTE))
def q_free_text_search(spark, sf_dir):
    """substring in any column of the adoptions."""
    return sel.free_text_search(td.adoptions(spark, sf_dir), SEARCH_NEEDLE)


@register("free_text_search_documents", f"""
SELECT doc_id, lang, source, n_chars FROM documents
WHERE contains(lower(CAST(doc_id AS VARCHAR)), '{DOC_NEEDLE}') OR contains(lower(text), '{DOC_NEEDLE}')
   OR contains(lower(lang), '{DOC_NEEDLE}') OR contains(lower(source), '{DOC_NEEDLE}')
   OR contains(lower(CAST(n_chars AS VARCHAR)), '{DOC_NEEDLE}')""")
def q_free_text_search_documents(spark, sf_dir):
    """F13 over whole document texts."""
    docs = td.table(spark, sf_dir, "documents")
    return sel.free_text_search(docs, DOC_NEEDLE).select("doc_id", "lang", "source", "n_chars")


@register("json_param_select", f"""
SELECT event_id, user_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_type IN (SELECT unnest(json_keys('{JSON_EVENT_KEYS}')))""")
def q_json_param_select(spark, sf_dir):
    """Keys of a JSON parameter select rows; a JSON field is extracted."""
    ev = td.table(spark, sf_dir, "events")
    keys = sel.keys_from_json(spark, JSON_EVENT_KEYS, "keys")
    out = sel.select_by(ev, "event_type", keys)
    return out.select("event_id", "user_id", "event_type",
                      F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# ------------------------------------------------------------ listings (L)
def _listing_sql(name: str) -> str:
    return O.with_ctes(f"SELECT DISTINCT {_cols(lst.LISTINGS[name])} FROM adozioni", A_CTE)


for _name, _key in [("list_adoptions", "adoptions"), ("list_lecturers", "lecturers"), ("list_books", "books"),
                    ("dashboard_adoptions", "dashboard_adoptions"),
                    ("dashboard_lecturers", "dashboard_lecturers"),
                    ("new_adoption_base", "new_adoption_base")]:
    def _make(key):
        def q(spark, sf_dir):
            return lst.listing(td.adoptions(spark, sf_dir), key)
        q.__doc__ = f"L: distinct {key} listing."
        return q
    register(_name, _listing_sql(_key))(_make(_key))


@register("list_courses", _listing_sql("courses"))
def q_list_courses(spark, sf_dir):
    """L2 + T1: courses ordered by university, degree, subject."""
    return lst.courses(td.adoptions(spark, sf_dir))


@register("sector_lecturers", O.with_ctes(
    "SELECT DISTINCT insegnamento_prof FROM adozioni WHERE materia_ssd_cod = 'ECONOMY'", A_CTE))
def q_sector_lecturers(spark, sf_dir):
    """Lecturers of a sector."""
    ado = sel.where_params(td.adoptions(spark, sf_dir), [("materia_ssd_cod", ["ECONOMY"])])
    return lst.listing(ado, "sector_lecturers")


@register("lecturer_books", O.with_ctes(
    f"SELECT DISTINCT isbn, titolo FROM docenti_router WHERE insegnamento_prof = '{ONE_LECTURER}'", C_CTE))
def q_lecturer_books(spark, sf_dir):
    """Books sent to a lecturer."""
    c = td.contacts(spark, sf_dir).filter(F.col("insegnamento_prof") == F.lit(ONE_LECTURER))
    return lst.listing(c, "lecturer_books")


_BOOK_ORDER = ", ".join(f"{c} NULLS FIRST" for c in lst.LISTINGS["books"])
_COURSE_ORDER = ", ".join(f"{c} NULLS FIRST" for c in lst.LISTINGS["courses"])


@register("page_3", O.with_ctes(f"""
SELECT {_cols(lst.LISTINGS['books'])} FROM (
  SELECT *, row_number() OVER (ORDER BY {_BOOK_ORDER}) - 1 AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT {_cols(lst.LISTINGS['books'])} FROM adozioni) b) t
WHERE rn >= (least(3, greatest(1, CAST(ceil(n / 100.0) AS BIGINT))) - 1) * 100
  AND rn < least(3, greatest(1, CAST(ceil(n / 100.0) AS BIGINT))) * 100""", A_CTE))
def q_page_3(spark, sf_dir):
    """T5: page 3 of the book listing (100 per page)."""
    return lst.page(lst.listing(td.adoptions(spark, sf_dir), "books"), 3).rows


@register("page_indexed", O.with_ctes(f"""
SELECT * FROM (SELECT DISTINCT {_cols(lst.LISTINGS['courses'])} FROM adozioni) b
ORDER BY {_COURSE_ORDER} LIMIT 100 OFFSET 1000""", A_CTE))
def q_page_indexed(spark, sf_dir):
    """T5: page 11 of the course listing."""
    courses = lst.listing(td.adoptions(spark, sf_dir), "courses")
    return lst.store_ranked(courses).slice(1000, 100)


@register("preview_5", O.with_ctes(f"""
SELECT {_cols(lst.PREVIEW_COLUMNS)} FROM adozioni
ORDER BY {", ".join(f"{c} NULLS FIRST" for c in lst.PREVIEW_COLUMNS)} LIMIT 5""", A_CTE))
def q_preview_5(spark, sf_dir):
    """T6 + P5: 8-column preview, first five rows (the limit is the feature)."""
    return lst.preview(td.adoptions(spark, sf_dir).select(*lst.PREVIEW_COLUMNS), 5)


# ------------------------------------------------------- new adoptions
_NA_KEY = _cols(setops.NEW_ADOPTION_KEY)


@register("new_adoptions", O.with_ctes(f"""
SELECT {_NA_KEY} FROM adozioni WHERE a_a = {YEAR}
EXCEPT SELECT {_NA_KEY} FROM adozioni WHERE a_a = {YEAR - 1}""", A_CTE))
def q_new_adoptions(spark, sf_dir):
    """Tuples of the year absent the year before (null-safe EXCEPT)."""
    return setops.new_adoptions(td.adoptions(spark, sf_dir), YEAR)


@register("new_adoptions_by_key", O.with_ctes(f"""
SELECT DISTINCT {_NA_KEY} FROM adozioni c WHERE a_a = {YEAR} AND NOT EXISTS (
  SELECT 1 FROM adozioni p WHERE p.a_a = {YEAR - 1}
    AND p.laurea_nome IS NOT DISTINCT FROM c.laurea_nome AND p.isbn IS NOT DISTINCT FROM c.isbn)""", A_CTE))
def q_new_adoptions_by_key(spark, sf_dir):
    """U1 documented meaning: degree and book not adopted the year before."""
    return setops.new_adoptions_by_key(td.adoptions(spark, sf_dir), YEAR, ["laurea_nome", "isbn"])


@register("new_adoptions_filtered", O.with_ctes(f"""
SELECT {_NA_KEY} FROM adozioni WHERE a_a = {YEAR} AND uni_cod = 'NATION_3' AND contains(lower(laurea_nome), 'build')
EXCEPT SELECT {_NA_KEY} FROM adozioni WHERE a_a = {YEAR - 1} AND uni_cod = 'NATION_3'
  AND contains(lower(laurea_nome), 'build')""", A_CTE))
def q_new_adoptions_filtered(spark, sf_dir):
    """Q3: new adoptions with optional filters over the L7 base (F12 window)."""
    from cattedra.plans.reports import new_adoption_report
    return new_adoption_report(td.adoptions(spark, sf_dir), YEAR,
                               [("uni_cod", "NATION_3"), ("laurea_nome", "build"), ("titolo", ""),
                                ("editore", None)])


# ------------------------------------------------- directory and lecturers
_DIR_COLS = "prof_id, uni_cod, insegnamento_prof, insegnamento_id, insegnamento_prof_www, materia_ssd_cod, materia_nome"


@register("directory_latest", O.with_ctes(f"SELECT {_DIR_COLS} FROM tuttidocenti", D_CTE))
def q_directory_latest(spark, sf_dir):
    """Q9: 5-table chain + latest course per lecturer (J4 + W1), from the sources."""
    return dirs.build_directory(td.directory_sources(spark, sf_dir))


_LECT_TIES = ", ".join(f"{c} NULLS FIRST" for c in CONTACT_COLUMNS if c not in ("prof_id", "insegnamento_id"))
_DIR_AS_CONTACT = ("SELECT uni_cod, '' AS facolta, materia_ssd_cod, materia_nome, insegnamento_prof, "
                   "insegnamento_prof_www, prof_id, insegnamento_id, '' AS email, '' AS indirizzo, '' AS citta, "
                   "'' AS telefono, '' AS note, '' AS isbn, '' AS titolo, '' AS data, 0 AS src FROM tuttidocenti")
_ADO_AS_CONTACT = ("SELECT uni_cod, facolta, materia_ssd_cod, '' AS materia_nome, insegnamento_prof, "
                   "insegnamento_prof_www, prof_id, insegnamento_id, '' AS email, '' AS indirizzo, '' AS citta, "
                   "'' AS telefono, '' AS note, '' AS isbn, '' AS titolo, '' AS data, 1 AS src FROM adozioni")


@register("lecturers_union_dedupe", O.with_ctes(f"""
SELECT {_cols(CONTACT_COLUMNS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY prof_id, insegnamento_id ORDER BY src, {_LECT_TIES}) AS rn
  FROM ({_DIR_AS_CONTACT} WHERE materia_ssd_cod IN ('ECONOMY', 'PROMO')
        UNION ALL {_ADO_AS_CONTACT}) u) t WHERE rn = 1""", A_CTE, D_CTE))
def q_lecturers_union_dedupe(spark, sf_dir):
    """Q4 mode 1: directory filter U adoption lecturers, directory row first."""
    return dirs.select_lecturers(_directory(spark, sf_dir), td.adoptions(spark, sf_dir), 1,
                                 [("materia_ssd_cod", ["ECONOMY", "PROMO"])])


@register("lecturers_from_adoptions", O.with_ctes(f"""
SELECT {_cols(CONTACT_COLUMNS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY prof_id, insegnamento_id ORDER BY src, {_LECT_TIES}) AS rn
  FROM ({_ADO_AS_CONTACT}) u) t WHERE rn = 1""", A_CTE))
def q_lecturers_from_adoptions(spark, sf_dir):
    """Q4 mode 0: adoption lecturers only, one per (prof_id, course)."""
    return dirs.select_lecturers(_directory(spark, sf_dir), td.adoptions(spark, sf_dir), 0)


_KEY_A = O.name_key_sql("a.insegnamento_prof")
_KEY_D = O.name_key_sql("insegnamento_prof")


@register("name_resolution", O.with_ctes(f"""
SELECT {_cols('a.' + c for c in ADOPTION_COLUMNS if c not in ('prof_id', 'insegnamento_id'))},
       COALESCE(d.prof_id, 0) AS prof_id, COALESCE(d.insegnamento_id, 0) AS insegnamento_id
FROM adozioni a LEFT JOIN (SELECT {_KEY_D} AS k, prof_id, insegnamento_id FROM tuttidocenti) d
  ON {_KEY_A} = d.k""", A_CTE, D_CTE))
def q_name_resolution(spark, sf_dir):
    """J2 + C2: adoptions take directory ids by order-free name key, over their own."""
    return resolve_adoptions(td.adoptions(spark, sf_dir), _directory(spark, sf_dir), overwrite_ids=True)


_KEY_C = O.name_key_sql("c.insegnamento_prof")


@register("contact_resolution", O.with_ctes(f"""
SELECT c.record_id, {_cols('c.' + c for c in CONTACT_COLUMNS if c not in ('prof_id', 'insegnamento_id'))},
       d.prof_id AS prof_id, d.insegnamento_id AS insegnamento_id
FROM docenti_router c LEFT JOIN (SELECT {_KEY_D} AS k, prof_id, insegnamento_id FROM tuttidocenti) d
  ON {_KEY_C} = d.k""", C_CTE, D_CTE))
def q_contact_resolution(spark, sf_dir):
    """Contacts take directory ids by name key, over their own (NULL when unmatched)."""
    return resolve_contacts(td.contacts(spark, sf_dir), _directory(spark, sf_dir), overwrite_ids=True)


_CONTACT_IDS = f"""
SELECT c.record_id, {_cols('c.' + c for c in CONTACT_COLUMNS if c not in ('prof_id', 'insegnamento_id'))},
       d.prof_id AS prof_id, d.insegnamento_id AS insegnamento_id
FROM %s c LEFT JOIN (SELECT {_KEY_D} AS k, prof_id, insegnamento_id FROM tuttidocenti) d
  ON {_KEY_C} = d.k"""


@register("contacts_by_index", O.with_ctes(_CONTACT_IDS % "docenti_router", C_CTE, D_CTE))
def q_contacts_by_index(spark, sf_dir):
    """K8 + J1: contacts take ids from the directory bucketed by name key; the directory is not shuffled."""
    from cattedra.sources.store import write_directory_index
    path = _scratch(spark, "directory-index")
    index = write_directory_index(_directory(spark, sf_dir), "indice_" + path.rpartition("-")[2], path)
    return resolve_contacts(td.contacts(spark, sf_dir), index, overwrite_ids=True)


@register("hot_names", O.with_ctes(_CONTACT_IDS % "caldi", C_CTE, D_CTE, f"""caldi AS (
  SELECT * REPLACE (CASE WHEN record_id % 3 = 0 THEN '{ONE_LECTURER}' WHEN record_id % 3 = 1 AND record_id % 5 = 0 THEN NULL
                    ELSE insegnamento_prof END AS insegnamento_prof) FROM docenti_router)"""))
def q_hot_names(spark, sf_dir):
    """J1 with a third of all contacts under one name: only hot names are found, counted and spread."""
    n, name, directory = F.col("record_id"), F.col("insegnamento_prof"), _directory(spark, sf_dir)
    contacts = td.contacts(spark, sf_dir).withColumn("insegnamento_prof", F.when(n % 3 == 0, ONE_LECTURER).when(
        ~((n % 3 == 1) & (n % 5 == 0)), name))
    return resolve_contacts(contacts, directory, overwrite_ids=True, spread_hot=True)


@register("union_courses", O.with_ctes(f"""
SELECT uni_cod, materia_nome FROM adozioni a WHERE {_KEY_A} = {O.name_key_sql("'" + ONE_LECTURER + "'")}
UNION
SELECT uni_cod, materia_nome FROM tuttidocenti WHERE {_KEY_D} = {O.name_key_sql("'" + ONE_LECTURER + "'")}""",
                                        A_CTE, D_CTE))
def q_union_courses(spark, sf_dir):
    """Q10 + U3: courses of a lecturer in adoptions and directory (UNION)."""
    from cattedra.plans.reports import courses_of_lecturer
    return courses_of_lecturer(td.adoptions(spark, sf_dir), _directory(spark, sf_dir), ONE_LECTURER)


# ------------------------------------------------------------ changes (M)
_CONTACT_TIES = ", ".join(f"{c} NULLS FIRST" for c in CONTACT_COLUMNS if c not in ("uni_cod", "prof_id",
                                                                                   "insegnamento_prof"))


@register("upsert_contacts", O.with_ctes(f"""
SELECT {_cols(CONTACT_COLUMNS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY uni_cod, prof_id
           ORDER BY insegnamento_prof ASC NULLS LAST, src DESC, record_id DESC NULLS LAST, {_CONTACT_TIES}) AS rn
  FROM (SELECT {_cols(CONTACT_COLUMNS)}, CAST(NULL AS BIGINT) AS record_id, 0 AS src
        FROM ({_DIR_AS_CONTACT}) n
        UNION ALL SELECT {_cols(CONTACT_COLUMNS)}, record_id, 1 AS src FROM docenti_router) u) t
WHERE rn = 1""", C_CTE, D_CTE))
def q_upsert_contacts(spark, sf_dir):
    """M1: directory rows upserted into contacts on (uni_cod, prof_id)."""
    new = dirs.directory_as_contacts(_directory(spark, sf_dir))
    return chg.upsert(new, td.contacts(spark, sf_dir)).select(*CONTACT_COLUMNS)


@register("delete_contacts", O.with_ctes("""
SELECT * FROM docenti_router d
WHERE NOT EXISTS (SELECT 1 FROM docenti_router x WHERE x.isbn IS NULL AND x.record_id = d.record_id)""", C_CTE))
def q_delete_contacts(spark, sf_dir):
    """M3: delete the contacts listed by id (those without a sample copy)."""
    c = td.contacts(spark, sf_dir)
    return chg.delete_by_id(c, c.filter(F.col("isbn").isNull()).select("record_id"))


_UPD_COLS = _cols("COALESCE(ch.email, d.email) AS email" if c == "email" else
                  "COALESCE(ch.note, d.note) AS note" if c == "note" else f"d.{c}"
                  for c in ["record_id", *CONTACT_COLUMNS])


@register("update_contacts", O.with_ctes(f"""
SELECT {_UPD_COLS} FROM docenti_router d
LEFT JOIN (SELECT record_id, 'da inviare' AS note, min(upper(email)) AS email FROM docenti_router
           WHERE isbn IS NULL GROUP BY record_id) ch ON d.record_id = ch.record_id""", C_CTE))
def q_update_contacts(spark, sf_dir):
    """M2/M6: sparse change map by id (note and e-mail of some contacts)."""
    c = td.contacts(spark, sf_dir)
    changes = c.filter(F.col("isbn").isNull()).groupBy("record_id").agg(
        F.lit("da inviare").alias("note"), F.min(F.upper("email")).alias("email"))  # one change for each id
    return chg.update_by_id(c, changes)


_ID_ORDER = ", ".join(f"{c} NULLS FIRST" for c in CONTACT_COLUMNS)
_ROWS_SQL = ("SELECT uni_cod, facolta, materia_ssd_cod, materia_nome, insegnamento_prof, insegnamento_prof_www, "
             "prof_id, insegnamento_id, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS indirizzo, "
             "CAST(NULL AS VARCHAR) AS citta, CAST(NULL AS VARCHAR) AS telefono, CAST(NULL AS VARCHAR) AS note, "
             "isbn, titolo, CAST(NULL AS VARCHAR) AS data FROM adozioni")


@register("append_new", O.with_ctes(f"""
SELECT record_id, {_cols(CONTACT_COLUMNS)} FROM docenti_router
UNION ALL
SELECT (SELECT max(record_id) FROM docenti_router) + row_number() OVER (ORDER BY {_ID_ORDER}) AS record_id, {_cols(CONTACT_COLUMNS)}
FROM (SELECT DISTINCT * FROM ({_ROWS_SQL})) r WHERE NOT EXISTS (
  SELECT 1 FROM docenti_router d WHERE d.uni_cod IS NOT DISTINCT FROM r.uni_cod
    AND d.prof_id IS NOT DISTINCT FROM r.prof_id AND d.insegnamento_id IS NOT DISTINCT FROM r.insegnamento_id
    AND d.isbn IS NOT DISTINCT FROM r.isbn)""", A_CTE, C_CTE))
def q_append_new(spark, sf_dir):
    """M5 (D1): append adoption lecturers as contacts, only new natural keys."""
    c = td.contacts(spark, sf_dir)
    a = td.adoptions(spark, sf_dir)
    rows = a.select(*[F.col(x) if x not in ("email", "indirizzo", "citta", "telefono", "note", "data")
                      else F.lit(None).cast("string").alias(x) for x in CONTACT_COLUMNS])
    rows = rows.withColumn("record_id", F.lit(None).cast("bigint"))
    return chg.append_new(c, rows)


@register("audience", O.with_ctes(f"""
SELECT uni_cod, materia_ssd_cod, insegnamento_prof, prof_id, insegnamento_id, email,
       '{AUDIENCE_NAME}' AS nome, CAST(NULL AS VARCHAR) AS note, DATE '{AUDIENCE_DATE.isoformat()}' AS data
FROM docenti_router WHERE materia_ssd_cod = 'ECONOMY' AND contains(lower(insegnamento_prof), 'supplier 00000000')""",
                                 C_CTE))
def q_audience(spark, sf_dir):
    """Q7 + K5: filtered contacts as a named mailing audience."""
    c = sel.where_params(td.contacts(spark, sf_dir),
                         [("materia_ssd_cod", ["ECONOMY"]), ("insegnamento_prof", "Supplier 00000000"),
                          ("citta", ""), ("isbn", None)])
    return chg.audience(c, AUDIENCE_NAME, AUDIENCE_DATE)


# --------------------------------------------------------- drill-downs (Q6)
_L5 = _cols(lst.LISTINGS["dashboard_adoptions"])


@register("drilldown_lecturer", O.with_ctes(f"""
SELECT {_L5} FROM adozioni WHERE insegnamento_prof = '{ONE_LECTURER}' AND a_a = 1998""", A_CTE))
def q_drilldown_lecturer(spark, sf_dir):
    """Q6: a lecturer's adoptions in the academic year of a given date."""
    from cattedra.plans.reports import drilldown
    return drilldown(td.adoptions(spark, sf_dir), "insegnamento_prof", ONE_LECTURER, DRILL_LECTURER_DATE)


@register("drilldown_book", O.with_ctes(f"""
SELECT {_L5} FROM adozioni WHERE isbn = '{ONE_BOOK}' AND a_a = 1997""", A_CTE))
def q_drilldown_book(spark, sf_dir):
    """Q6: a book's adoptions in the academic year of a given date."""
    from cattedra.plans.reports import drilldown
    return drilldown(td.adoptions(spark, sf_dir), "isbn", ONE_BOOK, DRILL_BOOK_DATE)


# ----------------------------------------------------- scalar functions (C)
def _isbn10_spark():
    return F.lpad(F.col("p_partkey").cast("string"), 10, "0")


def _hyphenated(s):
    return F.concat_ws("-", s.substr(1, 1), s.substr(2, 3), s.substr(5, 5), s.substr(10, 1))


_ISBN10 = "lpad(CAST(p_partkey AS VARCHAR), 10, '0')"
_BODY10 = f"('978' || substr({_ISBN10}, 1, 9))"
_ISBN13_SQL = f"({_BODY10} || {O.check_digit_sql(_BODY10, 12)})"


@register("isbn13", f"""
SELECT p_partkey, {_ISBN10} AS isbn10, {_ISBN13_SQL} AS isbn13, {_ISBN13_SQL} AS isbn13_from_hyphenated,
       true AS valid
FROM part""")
def q_isbn13(spark, sf_dir):
    """C3 + C15: ISBN-10 (bare and hyphenated) to ISBN-13 with check digit."""
    p = td.table(spark, sf_dir, "part")
    ten = _isbn10_spark()
    out = p.select("p_partkey", ten.alias("isbn10"), isbn13(ten).alias("isbn13"),
                   isbn13(_hyphenated(ten)).alias("isbn13_from_hyphenated"))
    return out.withColumn("valid", isbn13_valid("isbn13"))


_RAW_SQL = (f"CASE WHEN p_size <= 12 THEN {_ISBN10} "
            f"WHEN p_size <= 25 THEN substr({_ISBN10},1,1) || '-' || substr({_ISBN10},2,3) || '-' || "
            f"substr({_ISBN10},5,5) || '-' || substr({_ISBN10},10,1) "
            f"WHEN p_size <= 38 THEN {_ISBN13_SQL} ELSE '97800000' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') END")


def _raw_isbn_spark():
    ten = _isbn10_spark()
    return (F.when(F.col("p_size") <= 12, ten).when(F.col("p_size") <= 25, _hyphenated(ten))
            .when(F.col("p_size") <= 38, isbn13(ten))
            .otherwise(F.concat(F.lit("97800000"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))))


_NORM = f"(CASE WHEN p_size <= 25 THEN {_ISBN13_SQL} ELSE raw END)"
_VALID = f"(regexp_matches({_NORM}, '^[0-9]{{13}}$') AND substr({_NORM}, 13, 1) = {O.check_digit_sql(_NORM, 12)})"


@register("isbn_quality", f"""
SELECT p_brand, count(*) AS n_books,
       CAST(sum(CASE WHEN {_NORM} <> raw THEN 1 ELSE 0 END) AS BIGINT) AS n_converted,
       CAST(sum(CASE WHEN {_VALID} THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
       CAST(sum(CASE WHEN {_VALID} THEN 0 ELSE 1 END) AS BIGINT) AS n_invalid
FROM (SELECT p_brand, p_size, p_partkey, {_RAW_SQL} AS raw FROM part) t GROUP BY p_brand""")
def q_isbn_quality(spark, sf_dir):
    """Q11 + C15: normalise raw ISBNs, then converted/valid/invalid per publisher."""
    from cattedra.plans.reports import isbn_quality
    p = td.table(spark, sf_dir, "part").select("p_brand", _raw_isbn_spark().alias("raw"))
    return isbn_quality(p, "raw", "p_brand")


_STRIP_RAW = (f"'ISBN: ' || substr({_ISBN10},1,1) || '-' || substr({_ISBN10},2,3) || '-' || "
              f"substr({_ISBN10},5,5) || '-' || substr({_ISBN10},10,1) || '.'")


@register("isbn_strip", f"""
SELECT p_partkey, regexp_replace(raw, '[!-/:-\\[\\-`{{-~]', '', 'g') AS isbn_stripped,
       TRY_CAST(trim(regexp_replace(raw, '[!-/:-\\[\\-`{{-~]', '', 'g')) AS BIGINT) AS isbn_number,
       CAST(0 AS BIGINT) AS blank_number
FROM (SELECT p_partkey, {_STRIP_RAW} AS raw FROM part) t""")
def q_isbn_strip(spark, sf_dir):
    """C4 + C5: punctuation strip of uploaded ISBNs and the numeric form."""
    p = td.table(spark, sf_dir, "part")
    raw = F.concat(F.lit("ISBN: "), _hyphenated(_isbn10_spark()), F.lit("."))
    return p.select("p_partkey", isbn_strip(raw).alias("isbn_stripped"),
                    isbn_to_number(raw).alias("isbn_number"),
                    isbn_to_number(F.lit("")).alias("blank_number"))


_NAME_VARIANTS_SQL = """
SELECT s.s_suppkey,
       upper(n.n_name) || ', ' || upper(translate(s.s_name, '#', ' ')) AS v_upper,
       lower(translate(s.s_name, '#', ' ')) || ' (supplente)' AS v_note,
       'd''' || lower(n.n_name) || ' maria-rosa' AS v_apostrophe,
       'Docente ' || s.s_name AS v_docente,
       'prof. non ancora assegnato ' || n.n_name AS v_not_assigned,
       '000000 00000 ' || CAST(s.s_suppkey AS VARCHAR) AS v_zero,
       ' - ' || lower(s.s_name) || ' - ' AS v_dash
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey"""
_VARIANTS = ["v_upper", "v_note", "v_apostrophe", "v_docente", "v_not_assigned", "v_zero", "v_dash"]


@register("clean_names", f"""
SELECT s_suppkey, {_cols(O.clean_name_sql(v) + ' AS ' + v for v in _VARIANTS)},
       {O.title_sql('v_apostrophe')} AS title_case
FROM ({_NAME_VARIANTS_SQL}) t""")
def q_clean_names(spark, sf_dir):
    """C1 + C9: lecturer-name cleaning over name variants of every supplier."""
    s = td.table(spark, sf_dir, "supplier")
    n = td.table(spark, sf_dir, "nation")
    v = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        "s_suppkey",
        F.concat(F.upper("n_name"), F.lit(", "), F.upper(F.translate("s_name", "#", " "))).alias("v_upper"),
        F.concat(F.lower(F.translate("s_name", "#", " ")), F.lit(" (supplente)")).alias("v_note"),
        F.concat(F.lit("d'"), F.lower("n_name"), F.lit(" maria-rosa")).alias("v_apostrophe"),
        F.concat(F.lit("Docente "), F.col("s_name")).alias("v_docente"),
        F.concat(F.lit("prof. non ancora assegnato "), F.col("n_name")).alias("v_not_assigned"),
        F.concat(F.lit("000000 00000 "), F.col("s_suppkey").cast("string")).alias("v_zero"),
        F.concat(F.lit(" - "), F.lower("s_name"), F.lit(" - ")).alias("v_dash"),
    )
    return v.select("s_suppkey", *[clean_prof_name(c).alias(c) for c in _VARIANTS],
                    py_title("v_apostrophe").alias("title_case"))


@register("academic_year", """
SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END AS INTEGER)
       AS academic_year
FROM orders""")
def q_academic_year(spark, sf_dir):
    """C11: academic year of each order date."""
    o = td.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", academic_year("o_orderdate").alias("academic_year"))


@register("lenient_int", """
SELECT l_orderkey, l_linenumber,
       COALESCE(TRY_CAST(regexp_extract(CAST(l_linenumber AS VARCHAR) || '.' || CAST(l_partkey AS VARCHAR),
                '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS from_decimal,
       COALESCE(TRY_CAST(regexp_extract(' +' || CAST(l_suppkey AS VARCHAR) || 'x', '^\\s*([+-]?\\d+)', 1)
                AS BIGINT), 0) AS from_suffixed,
       COALESCE(TRY_CAST(regexp_extract(CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END,
                '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS from_text
FROM lineitem""")
def q_lenient_int(spark, sf_dir):
    """SQLite integer cast of text (leading integer, else 0)."""
    li = td.table(spark, sf_dir, "lineitem")
    t1 = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_partkey").cast("string"))
    t2 = F.concat(F.lit(" +"), F.col("l_suppkey").cast("string"), F.lit("x"))
    t3 = F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.col("l_returnflag"))
    return li.select("l_orderkey", "l_linenumber", sqlite_int(t1).alias("from_decimal"),
                     sqlite_int(t2).alias("from_suffixed"), sqlite_int(t3).alias("from_text"))


@register("tenant_key", """
SELECT user_id, md5(CAST(user_id AS VARCHAR)) AS tenant_key, count(*) AS n_events FROM events GROUP BY user_id""")
def q_tenant_key(spark, sf_dir):
    """C12 + K9: md5 tenant key per tenant with its row count."""
    ev = td.table(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events")) \
        .select("user_id", tenant_key("user_id").alias("tenant_key"), "n_events")


# ------------------------------------------------------------- the log (W)
@register("log_steps", O.with_ctes("""
SELECT event_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY date, event_id) - 1 AS q
FROM msg""", L_CTE))
def q_log_steps(spark, sf_dir):
    """Step number of each log row within its tenant (skew-safe numbering)."""
    log = td.log_events(spark, sf_dir).select("event_id", "tenant_id", "date")
    return with_group_index(log, ["tenant_id"], ["date", "event_id"], "q").select("event_id", "tenant_id", "q")


@register("log_latest", O.with_ctes("""
SELECT tenant_id, event_id AS last_event_id, message AS last_message, n AS next_q FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY date DESC, event_id DESC) AS rn,
         count(*) OVER (PARTITION BY tenant_id) AS n FROM msg) t WHERE rn = 1""", L_CTE))
def q_log_latest(spark, sf_dir):
    """The newest log row per tenant and the next step number."""
    from cattedra.plans.reports import latest_log_entry
    return latest_log_entry(td.log_events(spark, sf_dir))


# ------------------------------------------------------------- ad hoc (Q8)
@register("adhoc_sql", O.with_ctes(f"""
SELECT uni_cod, a_a, COUNT(*) AS n_rows, CAST(SUM(laurea_matricole) AS BIGINT) AS studenti
FROM adozioni WHERE a_a >= {ADHOC_YEAR} GROUP BY uni_cod, a_a""", A_CTE))
def q_adhoc_sql(spark, sf_dir):
    """Q8: user SQL over the tenant's tables, with a parameter marker."""
    from cattedra.plans.adhoc import run_sql
    return run_sql(spark, ADHOC_SQL, {"adozioni": td.adoptions(spark, sf_dir)}, {"y": ADHOC_YEAR}).frame


@register("universities_by_year", O.with_ctes("""
SELECT uni_cod, 'Universita ' || upper(substr(uni_cod, 1, 1)) || lower(substr(uni_cod, 2)) AS uni_nome,
       max(a_a) AS max
FROM adozioni GROUP BY uni_cod HAVING max(a_a) >= 1998""", A_CTE))
def q_universities_by_year(spark, sf_dir):
    """Universities with data up to the year asked (max >= a_a)."""
    from cattedra.sources.paged import universities_with_year
    return universities_with_year(td.universities(spark, sf_dir), 1998)


# ------------------------------------------- sources, sinks and streams (S, K, G)
# These queries land data that Spark derives from the given tables (CSV files,
# JSON pages, a tenant-partitioned store) in a fresh folder under the shared
# checkpoint dir, then read it back through the library's loaders.
def _scratch(spark, name):
    from cattedra.session import scratch_path
    return scratch_path(spark, name)


_KEY_P = O.name_key_sql("p.insegnamento_prof")


@register("csv_load", O.with_ctes(f"""
SELECT {_cols('p.' + c for c in ADOPTION_COLUMNS if c not in ('prof_id', 'insegnamento_id'))},
       CASE WHEN p.prof_id <> 0 THEN p.prof_id ELSE COALESCE(e.prof_id, 0) END AS prof_id, p.insegnamento_id
FROM pulite p LEFT JOIN (SELECT {_KEY_D} AS k, prof_id, insegnamento_id FROM elenco) e
  ON {_KEY_P} = e.k""", A_CTE, D_CTE, O.DIRTY_CTE, O.DIRTY_DIRECTORY_CTE))
def q_csv_load(spark, sf_dir):
    """S1 + K1: dirty adoptions exported as CSV, loaded back: cleaned (P1-P4, C1), missing ids from the directory (J2),
    where some names stand at two universities."""
    from cattedra.sources.files import load_adoptions_csv
    from cattedra.sources.store import export_csv
    path = _scratch(spark, "adoptions-csv")
    directory = td.dirty_directory(spark, sf_dir)  # landed before the files lie there
    export_csv(td.dirty_adoptions(spark, sf_dir), path, compression="gzip")
    return load_adoptions_csv(spark, path, directory)


@register("directory_csv", O.with_ctes("""
SELECT prof_id, uni_cod, insegnamento_prof, insegnamento_id, insegnamento_prof_www, materia_ssd_cod, materia_nome
FROM tuttidocenti""", D_CTE))
def q_directory_csv(spark, sf_dir):
    """The directory as a file, loaded back."""
    from cattedra.sources.files import load_directory_csv
    from cattedra.sources.store import export_csv
    path = _scratch(spark, "directory-csv")
    export_csv(_directory(spark, sf_dir).select(*dirs.DIRECTORY_COLUMNS), path)
    return load_directory_csv(spark, path).select(*dirs.DIRECTORY_COLUMNS)


@register("wide_csv", O.with_ctes(f"SELECT {_cols('CAST(' + c + ' AS VARCHAR) AS ' + c for c in ADOPTION_COLUMNS)}, "
                                  "CAST(NULL AS VARCHAR) AS prezzo FROM sporche", A_CTE, O.DIRTY_CTE))
def q_wide_csv(spark, sf_dir):
    """K3: dirty adoptions in the 39-column layout, every cell as it was."""
    from cattedra.sources.files import read_csv
    from cattedra.sources.store import export_wide_csv
    path = _scratch(spark, "wide-csv")
    export_wide_csv(td.dirty_adoptions(spark, sf_dir), path)
    return read_csv(spark, path).select(*ADOPTION_COLUMNS, "prezzo")


@register("paged_source", O.with_ctes(f"SELECT DISTINCT {_ALL_A} FROM pulite", A_CTE, O.DIRTY_CTE))
def q_paged_source(spark, sf_dir):
    """S5-S7 + A6: dirty adoptions, some of them twice, landed as linked JSON pages of 1,000 records per university,
    read back (explode), conformed, cleaned, de-duplicated."""
    from cattedra.sources.files import load_api_pages
    from cattedra.sources.paged import checked_pages, read_pages, records
    path = _scratch(spark, "pages")
    dirty = td.dirty_adoptions(spark, sf_dir)
    td.write_pages(dirty.unionByName(dirty.where("insegnamento_id % 4 = 0")), path)
    pages = checked_pages(read_pages(spark, path, one_per_line=True))
    return load_api_pages(records(pages), stored=True, source=path)


_CONTACT_UPLOAD = ", ".join(
    "CAST(COALESCE(TRY_CAST(c.isbn AS BIGINT), 0) AS VARCHAR) AS isbn" if c == "isbn" else
    f"COALESCE(CAST(d.{c} AS VARCHAR), '') AS {c}" if c in ("prof_id", "insegnamento_id") else
    f"COALESCE(c.{c}, '') AS {c}" for c in CONTACT_COLUMNS)


@register("contacts_upload", O.with_ctes(f"""
SELECT {_CONTACT_UPLOAD}
FROM docenti_router c LEFT JOIN (SELECT {_KEY_D} AS k, prof_id, insegnamento_id FROM tuttidocenti) d
  ON {_KEY_C} = d.k""", C_CTE, D_CTE))
def q_contacts_upload(spark, sf_dir):
    """S3 (replace): contacts CSV with isbn strip (C4, C5), name cleaning (C1),
    ids by name (J1), NULL text -> '' (P8)."""
    from cattedra.sources.files import load_contacts, read_csv
    from cattedra.sources.store import export_csv
    path = _scratch(spark, "contacts-csv")
    directory = _directory(spark, sf_dir)  # landed before the files lie there
    export_csv(td.contacts(spark, sf_dir).select(*CONTACT_COLUMNS), path, compression="gzip")
    out = load_contacts(read_csv(spark, path, line_breaks=False), directory, "replace", overwrite_ids=True)
    return _text_ids(out)


def _text_ids(contacts: DataFrame) -> DataFrame:
    return contacts.select(*[F.col(c).cast("string").alias(c) if c in ("prof_id", "insegnamento_id") else F.col(c)
                             for c in CONTACT_COLUMNS]).na.fill("", ["prof_id", "insegnamento_id"])


_BLANKS = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in CONTACT_COLUMNS)
_UPSERT_REST = ", ".join(f"{c} NULLS FIRST" for c in CONTACT_COLUMNS if c not in chg.UPSERT_KEY)


def _dirty_upload(spark, sf_dir) -> DataFrame:
    """Dirty contacts of every other id as a CSV upload, read by splits."""
    from cattedra.sources.files import read_csv
    from cattedra.sources.store import export_csv
    path = _scratch(spark, "contacts-dirty")
    export_csv(td.dirty_contacts(spark, sf_dir).where("record_id % 2 = 0").select(*CONTACT_COLUMNS), path)
    return read_csv(spark, path, line_breaks=False)


@register("contacts_append", O.with_ctes(f"""
SELECT {_BLANKS} FROM caricati WHERE record_id % 2 = 0
UNION ALL
SELECT {_BLANKS.replace("CAST(isbn AS VARCHAR), ''", "nullif(isbn, ''), '0'")} FROM ({_DIR_AS_CONTACT}) n""",
                                         C_CTE, D_CTE, O.DIRTY_CONTACTS_CTE))
def q_contacts_append(spark, sf_dir):
    """S3 (append): dirty contacts, cleaned and resolved, U the selected lecturers."""
    from cattedra.sources.files import load_contacts
    directory = _directory(spark, sf_dir)
    return _text_ids(load_contacts(_dirty_upload(spark, sf_dir), directory, "append",
                                   selected=dirs.directory_as_contacts(directory)))


@register("contacts_update", O.with_ctes(f"""
SELECT {_BLANKS} FROM (
  SELECT *, row_number() OVER (PARTITION BY uni_cod, prof_id
           ORDER BY insegnamento_prof NULLS LAST, src DESC, id DESC NULLS LAST, {_UPSERT_REST}) AS rn
  FROM (SELECT {_cols(CONTACT_COLUMNS)}, 0 AS src, NULL::BIGINT AS id FROM caricati WHERE record_id % 2 = 0
        UNION ALL SELECT {_cols(CONTACT_COLUMNS)}, 1, record_id FROM docenti_router) u) t WHERE rn = 1""",
                                         C_CTE, D_CTE, O.DIRTY_CONTACTS_CTE))
def q_contacts_update(spark, sf_dir):
    """S3 (update): dirty contacts upserted into the current ones on university and lecturer."""
    from cattedra.sources.files import load_contacts
    return _text_ids(load_contacts(_dirty_upload(spark, sf_dir), _directory(spark, sf_dir), "update",
                                   current=td.contacts(spark, sf_dir)))


@register("tenant_store", """
SELECT event_id, user_id, event_type, value, md5(CAST(user_id AS VARCHAR)) AS tenant
FROM events WHERE user_id = 7""")
def q_tenant_store(spark, sf_dir):
    """K9: events stored partitioned by md5(tenant); one tenant read back with
    partition pruning."""
    from cattedra.sources.store import read_tenant, write_tenants
    path = _scratch(spark, "tenants")
    write_tenants(td.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"),
                  path, "user_id", mode="errorifexists")
    return read_tenant(spark, path, 7).select("event_id", "user_id", "event_type", "value", "tenant")


@register("log_feed_stream", O.with_ctes("""
SELECT event_id, tenant_id, date, message FROM msg""", L_CTE))
def q_log_feed_stream(spark, sf_dir):
    """G1 + T7: the log as a file stream (availableNow), read newest first."""
    from cattedra.streaming.log_feed import read_feed, start_log_feed
    src = _scratch(spark, "log-src")
    td.log_events(spark, sf_dir).select("event_id", "tenant_id", "date", "message").write.parquet(src)
    schema = spark.read.parquet(src).schema
    sink, ckpt = _scratch(spark, "log-sink"), _scratch(spark, "log-ckpt")
    q = start_log_feed(spark, src, schema, sink, ckpt, available_now=True, max_files_per_trigger=2)
    q.awaitTermination()
    return read_feed(spark, sink)


@register("incremental_load_stream", O.with_ctes(f"""
SELECT {_ALL_A} FROM pulite UNION ALL SELECT {_ALL_A} FROM pulite WHERE insegnamento_id % 11 = 0""", A_CTE, O.DIRTY_CTE))
def q_incremental_load_stream(spark, sf_dir):
    """Dirty adoption CSV files, landed by year and course, loaded incrementally, each file once, cleaned and
    de-duplicated per micro-batch. Every fifth row stands twice in its file (one is dropped); files with every eleventh row
    come again later and are loaded again, by a second run on the same checkpoint."""
    from cattedra.sources.store import export_csv
    from cattedra.streaming.incremental import read_loaded, start_incremental_load
    landing = _scratch(spark, "landing")
    sink, ckpt = _scratch(spark, "loaded"), _scratch(spark, "load-ckpt")
    dirty = td.dirty_adoptions(spark, sf_dir)
    files = max(4, 2 * spark.sparkContext.defaultParallelism)  # a file is one task: enough of them for every core
    for part in (dirty, dirty.where("insegnamento_id % 11 = 0")):
        # both copies of a row are in one file: a row is doubled where it was dealt to, and files are not cut
        copies = F.explode(F.when(F.col("insegnamento_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        for years in td.rounds(part, F.col("a_a")):
            twice = years.repartitionByRange("a_a", "insegnamento_id").withColumn("_copy", copies).drop("_copy")
            export_csv(twice, landing, mode="append", file_rows=None, compression="gzip")
        start_incremental_load(spark, landing, sink, ckpt, available_now=True, max_files_per_trigger=files).awaitTermination()
    return read_loaded(spark, sink)


# ------------------------------------------------------- more changes and reports
@register("lecturers_directory_filter", O.with_ctes(f"""
SELECT {_cols(CONTACT_COLUMNS)} FROM ({_DIR_AS_CONTACT}
  WHERE materia_ssd_cod IN ('ECONOMY', 'PROMO') AND contains(lower(insegnamento_prof), '0000000')) t""", D_CTE))
def q_lecturers_directory_filter(spark, sf_dir):
    """Q4 mode 2: directory rows matching the form, in the contact layout."""
    return dirs.select_lecturers(_directory(spark, sf_dir), td.adoptions(spark, sf_dir), 2,
                                 [("materia_ssd_cod", ["ECONOMY", "PROMO"]), ("insegnamento_prof", "0000000"),
                                  ("prof_id", ""), ("uni_cod", [""])])


@register("merge_directory", O.with_ctes(f"""
SELECT {_DIR_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY prof_id ORDER BY src,
           {", ".join(c + " NULLS FIRST" for c in ["uni_cod", "insegnamento_prof", "insegnamento_id",
                                                    "insegnamento_prof_www", "materia_ssd_cod", "materia_nome"])})
           AS rn
  FROM (SELECT {_DIR_COLS}, 0 AS src FROM tuttidocenti WHERE materia_ssd_cod = 'ECONOMY'
        UNION ALL
        SELECT prof_id, uni_cod, insegnamento_prof, insegnamento_id, insegnamento_prof_www, materia_ssd_cod,
               materia_nome, 1 AS src
        FROM adozioni) u) t WHERE rn = 1""", A_CTE, D_CTE))
def q_merge_directory(spark, sf_dir):
    """M8: "update and add": new directory rows replace old ones on prof_id."""
    directory = _directory(spark, sf_dir)
    new = directory.filter(F.col("materia_ssd_cod") == "ECONOMY")
    old = td.adoptions(spark, sf_dir).select(*dirs.DIRECTORY_COLUMNS)
    return chg.merge_directory(new, old).drop("record_id").select(*dirs.DIRECTORY_COLUMNS)


@register("insert_contacts", O.with_ctes(f"""
SELECT record_id, {_cols(CONTACT_COLUMNS)} FROM docenti_router
UNION ALL
SELECT (SELECT max(record_id) FROM docenti_router) + row_number() OVER (ORDER BY {_ID_ORDER}) AS record_id, {_cols(CONTACT_COLUMNS)} FROM ({_DIR_AS_CONTACT}) n
WHERE insegnamento_prof IS NOT NULL AND trim(insegnamento_prof) <> ''""", C_CTE, D_CTE))
def q_insert_contacts(spark, sf_dir):
    """M4: insert contacts (the name is mandatory)."""
    new = dirs.directory_as_contacts(_directory(spark, sf_dir)).withColumn("record_id", F.lit(None).cast("bigint"))
    return chg.insert_rows(td.contacts(spark, sf_dir), new)


@register("directory_of_year", f"""
SELECT s_suppkey AS prof_id, n_name AS uni_cod, split_part(s_name, '#', 2) || ' ' || split_part(s_name, '#', 1) AS prof_nome,
       last AS insegnamento_id, 'corso/' || CAST(last // 8 AS VARCHAR) AS insegnamento_prof_www
FROM (SELECT l_suppkey, max(l_orderkey * 8 + l_linenumber) AS last FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE year(o_orderdate) = {YEAR} GROUP BY l_suppkey) t
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def q_directory_of_year(spark, sf_dir):
    """The latest course of one year per lecturer, through curricula and degrees."""
    return dirs.latest_course_of_year(td.directory_sources(spark, sf_dir), YEAR)


def _content_sql(table: str, state: str, source: str, columns: list[str], copies: int = 1) -> str:
    """Rows of a stored table as (state, name, digest of all columns, number)."""
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in columns)
    return (f"SELECT '{table}' AS name, '{state}' AS state, md5(concat_ws(chr(31), {cells})) AS digest, {copies} * count(*) AS n "
            f"FROM {source} GROUP BY ALL")


_ADO_COLUMNS, _RES_COLUMNS = (TABLES[t].fieldNames() for t in ("adozioni", "adozioni_res"))
_MARKER = "(SELECT TIMESTAMP '2000-01-01 00:00:00' AS date, 'Parametri cancellati' AS message, 0 AS q) m"


@register("stored_tables", O.with_ctes(" UNION ALL ".join([
    _content_sql("adozioni", "first", "adozioni", _ADO_COLUMNS),
    _content_sql("adozioni", "snapshot", "adozioni", _ADO_COLUMNS, 2),
    _content_sql("adozioni_res", "snapshot", "(SELECT * FROM adozioni WHERE a_a = 1997) r", _RES_COLUMNS),
    _content_sql("tuttidocenti_res", "snapshot", f"({_DIR_AS_CONTACT}) d", CONTACT_COLUMNS),
    _content_sql("tuttidocenti_res", "reset", f"({_DIR_AS_CONTACT}) d", CONTACT_COLUMNS),
    _content_sql("msg", "reset", _MARKER, ["date", "message", "q"]),
    _content_sql("adozioni", "again", "(SELECT * FROM adozioni WHERE a_a = 1996) r", _ADO_COLUMNS)]), A_CTE, D_CTE))
def q_stored_tables(spark, sf_dir):
    """K7 + K2 + K4 + K6: typed tables filled in modes append and replace, named as a snapshot, reset to level adoptions, filled
    anew; all rows of each table as it is at an old version, at the snapshot and now."""
    from cattedra.sources.versions import TableStore
    store = TableStore(spark, _scratch(spark, "store"))
    store.create(("adozioni", "adozioni_res", "tuttidocenti_res", "msg"))
    directory, adoptions = _directory(spark, sf_dir), td.adoptions(spark, sf_dir)  # landed before the store fills
    first = store.save(adoptions, "adozioni", "append")
    store.save(adoptions, "adozioni", "append")
    store.commit({"adozioni_res": ("replace", adoptions.where(F.col("a_a") == 1997)),
                  "tuttidocenti_res": ("replace", dirs.directory_as_contacts(directory))})
    store.snapshot_and_reset("19970101T000000", "adoptions")
    reset = store.version()
    store.save(adoptions.where(F.col("a_a") == 1996), "adozioni", "append")

    def content(name, state, df):
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in df.columns]
        # grouped as 16 bytes, half of what their hexadecimal digits take in the shuffle
        rows = df.groupBy(F.unhex(F.md5(F.concat_ws("\x1f", *cells))).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
        return rows.select(F.lit(name).alias("name"), F.lit(state).alias("state"), F.lower(F.hex("digest")).alias("digest"), "n")

    out = content("adozioni", "first", store.read("adozioni", version=first))
    for name in ("adozioni", "adozioni_res", "tuttidocenti_res", "msg"):
        out = out.unionByName(content(name, "snapshot", store.read(name, snapshot="19970101T000000")))
        out = out.unionByName(content(name, "reset", store.read(name, version=reset)))
    return out.unionByName(content("adozioni", "again", store.read("adozioni")))


_STEPS = [("uni_cod", ["NATION_1", "NATION_7", "NATION_12"]), ("materia_ssd_cod", ["ECONOMY", "PROMO"]), ("isbn", ["-"]),
          ("a_a", [1997])]
_STEP_SQL = ["uni_cod IN ('NATION_1', 'NATION_7', 'NATION_12')", "uni_cod IN ('NATION_1', 'NATION_7', 'NATION_12') AND "
             "materia_ssd_cod IN ('ECONOMY', 'PROMO')", "false", "a_a = 1997"]


@register("selection_log", O.with_ctes(" UNION ALL ".join(
    f"SELECT {q} AS q, 'passo {q}' AS message, TIMESTAMP '2000-01-01 00:00:0{q}' AS date, count(*) AS n, "
    f"CAST(coalesce(sum(laurea_matricole), 0) AS BIGINT) AS studenti FROM adozioni WHERE {cond}"
    for q, cond in enumerate(_STEP_SQL)), A_CTE))
def q_selection_log(spark, sf_dir):
    """Q1 + W2 + T3: four steps, each by a session opened anew on the same root; the stored log with what each step left."""
    from cattedra.plans.reports import SelectionSession
    root, base, left = _scratch(spark, "selection"), td.adoptions(spark, sf_dir), None
    for i, (column, keys) in enumerate(_STEPS):
        session = SelectionSession(spark, base, root)
        chosen = session.step(column, keys, f"passo {i}")
        q = session.last().q
        one = chosen.agg(F.lit(q).cast("long").alias("q"), F.count(F.lit(1)).alias("n"),
                         F.coalesce(F.sum("laurea_matricole"), F.lit(0)).alias("studenti"))
        left = one if left is None else left.unionByName(one)
    return session.log().join(left, "q").select("q", "message", "date", "n", "studenti")


@register("edit_chain", O.with_ctes(f"""
SELECT * FROM (
  SELECT record_id, coalesce(isbn, 'Nessun saggio') AS isbn, insegnamento_prof, email,
         row_number() OVER (PARTITION BY insegnamento_prof, isbn ORDER BY record_id) AS rn
  FROM (SELECT record_id, isbn, insegnamento_prof, CASE WHEN nuovo AND materia_ssd_cod = 'ECONOMY' THEN NULL
                                                        WHEN nuovo THEN 'nuovo@uni.example' ELSE email END AS email
        FROM (SELECT record_id, isbn, insegnamento_prof, email, materia_ssd_cod, false AS nuovo FROM docenti_router
              UNION ALL
              SELECT (SELECT max(record_id) FROM docenti_router) + row_number() OVER (ORDER BY {_ID_ORDER}),
                     isbn, insegnamento_prof, email, materia_ssd_cod, true
              FROM ({_DIR_AS_CONTACT}) n WHERE trim(insegnamento_prof) <> '') a
        WHERE NOT (nuovo AND materia_ssd_cod = 'PROMO')) e) f WHERE rn = 1""".replace("SELECT * FROM (", "SELECT record_id, isbn, insegnamento_prof, email FROM (", 1), C_CTE, D_CTE))
def q_edit_chain(spark, sf_dir):
    """M4 + M2 + M3 + A4: insert contacts, edit and delete the new ones by their new ids, first contact per pair."""
    old = td.contacts(spark, sf_dir)
    top = old.agg(F.max("record_id")).first()[0]
    now = chg.insert_rows(old, dirs.directory_as_contacts(_directory(spark, sf_dir)).withColumn("record_id", F.lit(None).cast("bigint")))
    fresh = now.where(F.col("record_id") > top)
    edits = fresh.select("record_id", F.when(F.col("materia_ssd_cod") != "ECONOMY", "nuovo@uni.example").alias("email"))
    now = chg.update_by_id(now, edits, set_columns=["email"])
    # stored, so that the shuffles of the edits are gone before the picking
    now = stored(chg.delete_by_id(now, fresh.where("materia_ssd_cod = 'PROMO'")), "edited")
    return agg.first_contact_per_pair(now).select("record_id", "isbn", "insegnamento_prof", "email")


@register("stored_edits", O.with_ctes(f"""
SELECT record_id, {_cols(c if c != 'email' else "CASE WHEN record_id BETWEEN 1000 AND 5000 AND record_id % 7 = 0 THEN 'nuovo' "
                                                "ELSE email END AS email" for c in CONTACT_COLUMNS)}
FROM docenti_router WHERE record_id NOT BETWEEN 8000 AND 9000
UNION ALL
SELECT (SELECT max(record_id) FROM docenti_router) + row_number() OVER (ORDER BY {_ID_ORDER}) AS record_id, {_cols(CONTACT_COLUMNS)}
FROM ({_DIR_AS_CONTACT}) n WHERE trim(insegnamento_prof) <> ''""", C_CTE, D_CTE))
def q_stored_edits(spark, sf_dir):
    """M2 + M3 + M4, stored (D2): contacts in blocks of ids; an update, a deletion and an insertion each write the touched
    blocks anew and leave the files of the others in place."""
    from cattedra.sources.id_table import IdTable
    contacts = td.contacts(spark, sf_dir)
    blocks = max(1, contacts.agg(F.max("record_id")).first()[0] // 50)
    table = IdTable(spark, _scratch(spark, "editable"), "contatti", block=blocks)
    table.write(contacts)
    changed = contacts.where("record_id between 1000 and 5000 and record_id % 7 = 0")
    table.update(changed.select("record_id", F.lit("nuovo").alias("email")).distinct())
    table.delete(contacts.where("record_id between 8000 and 9000"))
    table.insert(dirs.directory_as_contacts(_directory(spark, sf_dir)))
    return table.read()


@register("log_steps_stream", O.with_ctes("""
SELECT event_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY date, event_id) - 1 AS q
FROM msg""", L_CTE))
def q_log_steps_stream(spark, sf_dir):
    """W2 + G1: step numbers on the stream; the log arrives in four parts by time, each taken by a run that goes on from the
    last one's state."""
    from cattedra.streaming.log_steps import start_step_numbers
    src, sink, ckpt = (_scratch(spark, f"steps-{x}") for x in ("src", "sink", "ckpt"))
    log = td.log_events(spark, sf_dir).select("event_id", "tenant_id", "date")
    at = F.unix_micros(F.col("date").cast("timestamp"))
    cuts = [None, *log.select(at.cast("double").alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01), None]
    for low, high in zip(cuts, cuts[1:]):
        part = log.where(F.lit(True) if low is None else at >= int(low)).where(F.lit(True) if high is None else at < int(high))
        part.write.mode("append").parquet(src)
        start_step_numbers(spark, src, log.schema, sink, ckpt, available_now=True).awaitTermination()
    return spark.read.schema("event_id long, tenant_id long, q long").parquet(sink)


def _part_sql(name: str, source: str, columns: list[str]) -> str:
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in columns)
    return f"SELECT '{name}' AS part, md5(concat_ws(chr(31), {cells})) AS digest, count(*) AS n FROM {source} GROUP BY ALL"


_D_ADO, _D_LECT = (lst.LISTINGS[n] for n in ("dashboard_adoptions", "dashboard_lecturers"))
_SUMMARY = [f"{c}_{label}" for c in agg.SUMMARY_COLUMNS for label in ("count", "unique")]
_SUMMARY_SQL = ", ".join(f"count({c}) AS {c}_count, count(DISTINCT {c}) AS {c}_unique" for c in agg.SUMMARY_COLUMNS)


@register("dashboard_summary", O.with_ctes(" UNION ALL ".join([
    _part_sql("adoptions", f"(SELECT DISTINCT {_cols(_D_ADO)} FROM attive) x", _D_ADO),
    _part_sql("lecturers", f"(SELECT DISTINCT {_cols(_D_LECT)} FROM attive) x", _D_LECT),
    _part_sql("books", f"({_BOOK_TOTALS}) x", ["isbn", "titolo", "autore", "editore", "studenti"]),
    _part_sql("values", "(SELECT DISTINCT 'uni_cod' AS k, uni_cod AS v FROM attive UNION "
                        "SELECT DISTINCT 'materia_ssd_cod', materia_ssd_cod FROM attive) x WHERE v IS NOT NULL", ["k", "v"]),
    _part_sql("summary", f"(SELECT {_SUMMARY_SQL} FROM attive) x", _SUMMARY)]), A_CTE,
    "attive AS (SELECT * FROM adozioni WHERE uni_cod IN ('NATION_1', 'NATION_7', 'NATION_12'))",
    _ENROLMENTS.replace("FROM adozioni", "FROM attive")))
def q_dashboard_summary(spark, sf_dir):
    """Q1 + Q2: the dashboard of a selection, all rows of each of its parts (as digests)."""
    from cattedra.plans.reports import SelectionSession, dashboard
    session = SelectionSession(spark, td.adoptions(spark, sf_dir))
    session.step("uni_cod", ["NATION_1", "NATION_7", "NATION_12"])
    d, out = dashboard(session.active()), None
    for name, df in (("adoptions", d.adoptions), ("lecturers", d.lecturers), ("books", d.students), ("values", d.values),
                     ("summary", d.summary)):
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in df.columns]
        part = df.select(F.lit(name).alias("part"), F.md5(F.concat_ws("\x1f", *cells)).alias("digest"))
        part = part.groupBy("part", "digest").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@register("search_last_query", O.with_ctes(f"""
SELECT {_ALL_A} FROM adozioni WHERE contains(lower(concat_ws(chr(31), {_cols(f'CAST({c} AS VARCHAR)' for c in ADOPTION_COLUMNS)})), 'blue')""",
                                           A_CTE))
def q_search_last_query(spark, sf_dir):
    """the last query's rows that hold the needle in any column."""
    return sel.search_last_query(td.adoptions(spark, sf_dir), "blue")


@register("append_upload", O.with_ctes(f"""
SELECT {_cols(CONTACT_COLUMNS)} FROM docenti_router
UNION ALL SELECT {_cols(CONTACT_COLUMNS)} FROM ({_DIR_AS_CONTACT}) n""", C_CTE, D_CTE))
def q_append_upload(spark, sf_dir):
    """M7: resolved upload U selected lecturers, in the contact layout."""
    selected = dirs.directory_as_contacts(_directory(spark, sf_dir))
    return chg.append_upload(td.contacts(spark, sf_dir), selected)


_SAMPLE_ORDER = ", ".join(f"{c} NULLS FIRST" for c in CONTACT_COLUMNS)


@register("sample_copy_page", O.with_ctes(f"""
SELECT * FROM (
  SELECT {_cols(c if c != 'isbn' else "coalesce(isbn, 'Nessun saggio') AS isbn" for c in CONTACT_COLUMNS)}
  FROM (SELECT *, row_number() OVER (PARTITION BY insegnamento_prof, isbn ORDER BY record_id) AS rn
        FROM docenti_router) t WHERE rn = 1) r
ORDER BY insegnamento_prof NULLS FIRST, {", ".join(f"{c} NULLS FIRST" for c in CONTACT_COLUMNS
                                                  if c != "insegnamento_prof")}
LIMIT 20 OFFSET 40""", C_CTE))
def q_sample_copy_page(spark, sf_dir):
    """Q5: sample-copy dashboard, page 3 of 20 rows ordered by lecturer."""
    from cattedra.plans.reports import sample_copy_dashboard
    selected = dirs.directory_as_contacts(_directory(spark, sf_dir))
    return sample_copy_dashboard(td.contacts(spark, sf_dir), selected, 3).page.rows


@register("select_contacts_by_name", O.with_ctes(f"""
SELECT record_id, {_cols(CONTACT_COLUMNS)} FROM docenti_router
WHERE insegnamento_prof IN ('Supplier 000000001', 'Supplier 000000002')""", C_CTE))
def q_select_contacts_by_name(spark, sf_dir):
    """F6 + S10: contacts (or selected lecturers when there are none) chosen by
    lecturer name; these rows are appended to the contacts and exported."""
    from cattedra.plans.reports import select_contacts
    selected = dirs.directory_as_contacts(_directory(spark, sf_dir))
    return select_contacts(td.contacts(spark, sf_dir), selected, ["Supplier 000000001", "Supplier 000000002"])


@register("students_per_book_one", O.with_ctes(_BOOK_TOTALS + f" QUALIFY isbn = '{ONE_BOOK}'", A_CTE, _ENROLMENTS))
def q_students_per_book_one(spark, sf_dir):
    """The per-book student report for one isbn (the filter reaches both
    sides of the join and the scan)."""
    return agg.students_per_book(td.adoptions(spark, sf_dir)).filter(F.col("isbn") == F.lit(ONE_BOOK))

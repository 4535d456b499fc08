"""Table schemas and the ``conform`` projection.

Every table has one ``StructType``. Files are read with an all-string schema and
then conformed: missing columns become typed NULLs, extra columns are dropped,
the order is fixed and every value is converted with a lenient (``try_cast``)
conversion, so ANSI mode never fails a load on a bad cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.functions._col import number_of_text

S, I, L = T.StringType(), T.IntegerType(), T.LongType()

# --- Fixed values: required column lists per table, in the reference's order. ---
ADOPTION_COLUMNS = [
    "uni_cod", "a_a", "laurea_nome", "laurea_tipo", "laurea_classe_cod", "sede",
    "facolta", "curr_nome", "materia_ssd_cod", "materia_cfu", "curr_materia_anno",
    "curr_materia_periodo", "materia_nome", "insegnamento_prof",
    "insegnamento_prof_www", "isbn", "autori", "curatori", "titolo", "editore",
    "testo_obb", "testo_uso", "testo_freq", "laurea_iscritti", "laurea_matricole",
    "prof_id", "insegnamento_id",
]
SELECTION_COLUMNS = [
    "uni_cod", "a_a", "facolta", "laurea_nome", "laurea_tipo", "sede",
    "laurea_classe_cod", "curr_nome", "materia_nome", "materia_ssd_cod",
    "materia_cfu", "curr_materia_anno", "curr_materia_periodo",
    "insegnamento_prof", "insegnamento_prof_www", "isbn", "autori", "curatori",
    "titolo", "editore", "testo_obb", "testo_uso", "testo_freq",
    "laurea_iscritti", "laurea_matricole", "prof_id", "insegnamento_id",
]
WIDE_EXTRA_COLUMNS = [
    "modulo_nome", "sub_modulo_gruppo", "sub_modulo_nome", "modulo_cfu",
    "modulo_periodo", "traduttori", "edizione", "anno_pub", "tipo_copertina",
    "pagg", "lingua", "prezzo",
]
CONTACT_COLUMNS = [
    "uni_cod", "facolta", "materia_ssd_cod", "materia_nome", "insegnamento_prof",
    "insegnamento_prof_www", "prof_id", "insegnamento_id", "email", "indirizzo",
    "citta", "telefono", "note", "isbn", "titolo", "data",
]
DIRECTORY_COLUMNS = [
    "prof_id", "uni_cod", "insegnamento_prof", "insegnamento_id",
    "insegnamento_prof_www", "materia_ssd_cod", "materia_nome",
]
UNIVERSITY_COLUMNS = ["uni_cod", "uni_nome", "max"]
MAILING_COLUMNS = [
    "uni_cod", "materia_ssd_cod", "insegnamento_prof", "prof_id",
    "insegnamento_id", "email", "nome", "note", "data",
]
LOG_COLUMNS = ["date", "message", "q"]
# --- end of fixed values ---

_LONG_COLS = {"laurea_iscritti", "laurea_matricole", "prof_id", "insegnamento_id",
              "record_id", "q"}
_INT_COLS = {"a_a", "max"}


def _type_of(col: str) -> T.DataType:
    if col in _LONG_COLS:
        return L
    if col in _INT_COLS:
        return I
    if col == "data":
        return S
    if col == "date":
        return T.TimestampType()
    return S


def struct_for(columns: list[str], overrides: dict[str, T.DataType] | None = None) -> T.StructType:
    overrides = overrides or {}
    return T.StructType([T.StructField(c, overrides.get(c, _type_of(c)), True) for c in columns])


ADOPTIONS = struct_for(ADOPTION_COLUMNS)
ADOPTIONS_RES = struct_for(SELECTION_COLUMNS)
ADOPTIONS_WIDE = struct_for(ADOPTION_COLUMNS + WIDE_EXTRA_COLUMNS,
                            {c: S for c in ADOPTION_COLUMNS + WIDE_EXTRA_COLUMNS})
CONTACTS = struct_for(CONTACT_COLUMNS)
DIRECTORY = struct_for(DIRECTORY_COLUMNS)
UNIVERSITIES = struct_for(UNIVERSITY_COLUMNS)
MAILING = struct_for(MAILING_COLUMNS, {"data": T.DateType()})
LOG = struct_for(LOG_COLUMNS)

TABLES: dict[str, T.StructType] = {
    "adozioni": ADOPTIONS,
    "adozioni_res": ADOPTIONS_RES,
    "adozioni_wide": ADOPTIONS_WIDE,
    "docenti_router": CONTACTS,
    "tuttidocenti_res": CONTACTS,
    "tuttidocenti": DIRECTORY,
    "universita": UNIVERSITIES,
    "mailing": MAILING,
    "msg": LOG,
}


def all_string(schema: T.StructType) -> T.StructType:
    """The read schema for text files: every field as string."""
    return T.StructType([T.StructField(f.name, S, True) for f in schema.fields])


def lenient_cast(col: Column, target: T.DataType, source: T.DataType = S) -> Column:
    """Convert without failing: bad values become NULL.

    Integral targets go through ``double`` as a fallback because a nullable id
    column written by a pandas tool reads back as ``123.0``.
    """
    if isinstance(target, (T.LongType, T.IntegerType)):
        name = target.simpleString()
        return number_of_text(col, name) if isinstance(source, T.StringType) else col.try_cast(name)
    if isinstance(target, T.StringType):
        return col.cast("string")
    return col.try_cast(target.simpleString())


def conform(df: DataFrame, table: str | T.StructType) -> DataFrame:
    """Required columns of ``table``, missing -> NULL, extra dropped, typed."""
    if isinstance(table, str):
        if table not in TABLES:
            raise ValueError(f"unknown table {table!r}")
        schema = TABLES[table]
    else:
        schema = table
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for field in schema.fields:
        if field.name not in present:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif present[field.name] == field.dataType:
            cols.append(F.col(field.name))
        else:
            cols.append(lenient_cast(F.col(field.name), field.dataType, present[field.name]).alias(field.name))
    return df.select(*cols)


def empty(spark, table: str | T.StructType) -> DataFrame:
    """An empty typed frame (K6/K7)."""
    schema = TABLES[table] if isinstance(table, str) else table
    return spark.createDataFrame([], schema)

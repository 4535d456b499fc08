"""Composite reports (Q1, Q2, Q5, Q8), F14, K3, S2, J6."""

import datetime as dt
import os

from pyspark.sql import functions as F

from cattedra.operators import directory as dirs
from cattedra.operators import select as sel
from cattedra.plans import adhoc, reports
from cattedra.schemas import ADOPTION_COLUMNS, CONTACT_COLUMNS, DIRECTORY_COLUMNS, WIDE_EXTRA_COLUMNS, conform
from cattedra.sources import files, store
from tests.conftest import rows


def adoptions(spark):
    data = [("U1", 2024, "Fisica", "1", 10, "S1", "Rossi Mario", 1, "T1", "A", "C", "E"),
            ("U1", 2024, "Fisica", "2", 10, "S2", "Rossi Mario", 1, "T2", "A", None, "E"),
            ("U2", 2024, "Chimica", "1", 20, "S1", "Bianchi Anna", 2, "T1", "A", "C", "E"),
            ("U2", 2023, "Chimica", "3", 20, "S2", "Bianchi Anna", 2, "T3", "B", "C", "F")]
    df = spark.createDataFrame(data, "uni_cod string, a_a int, laurea_nome string, isbn string, "
                                     "laurea_matricole long, materia_ssd_cod string, insegnamento_prof string, "
                                     "prof_id long, titolo string, autori string, curatori string, editore string")
    return conform(df, "adozioni")


def test_selection_session_survives_its_driver(spark, scratch):
    root = os.path.join(scratch, "sel")
    again = lambda: reports.SelectionSession(spark, adoptions(spark), root=root)  # noqa: E731 - as after a restart
    assert again().last() is None
    a = again().step("uni_cod", ["U1"], when=dt.datetime(2025, 1, 1, 10))
    assert a.count() == 2
    b = again().step("materia_ssd_cod", ["S2"], when=dt.datetime(2025, 1, 1, 11))
    assert rows(b, "isbn") == [("2",)] and a.count() == 2  # the old version is still there
    # an empty step empties the selection: the next step starts from everything
    assert again().step("uni_cod", ["U9"]).count() == 0
    assert again().step("uni_cod", ["U2"]).count() == 2
    s = again()
    assert [r.q for r in s.feed().collect()] == [3, 2, 1, 0]
    assert s.last().q == 3 and s.last().date == dt.datetime(2025, 1, 1, 11, 0, 2)
    s.reset()
    assert again().active().count() == 4 and [r.q for r in again().log().collect()] == [0]


def test_selection_log_is_compacted(spark, scratch, monkeypatch):
    monkeypatch.setattr(reports.SelectionSession, "LOG_FOLDERS", 2)
    s = reports.SelectionSession(spark, adoptions(spark), root=os.path.join(scratch, "sel"))
    for i in range(5):
        s.step("uni_cod", ["U1", "U2"], f"m{i}")
    assert len(s.store.state()["tables"]["msg"]) <= 2
    assert rows(s.log(), "q", "message") == [(i, f"m{i}") for i in range(5)]


def test_dashboard_parts(spark):
    d = reports.dashboard(adoptions(spark))
    assert d.adoptions.count() == 4 and d.lecturers.count() == 4  # one row per lecturer and sector
    assert rows(d.students, "isbn", "studenti") == [("1", 30), ("2", 10), ("3", 20)]
    assert d.summary.collect()[0]["uni_cod_unique"] == 2


def test_sample_copy_dashboard_falls_back_to_selection(spark):
    sel_rows = conform(spark.createDataFrame([("U1", "Rossi", "1"), ("U1", "Rossi", "1"), ("U1", "Alfa", None)],
                                             "uni_cod string, insegnamento_prof string, isbn string"),
                       "tuttidocenti_res")
    empty = conform(spark.createDataFrame([], "uni_cod string"), "docenti_router").withColumn(
        "record_id", F.lit(None).cast("long"))
    dash = reports.sample_copy_dashboard(empty, sel_rows, page="x")
    assert [(r.insegnamento_prof, r.isbn) for r in dash.rows.collect()] == [("Alfa", "Nessun saggio"),
                                                                             ("Rossi", "1")]
    assert dash.page.number == 1 and dash.page.num_pages == 1 and dash.page.count == 2
    picked = reports.select_contacts(empty, sel_rows, ["Rossi"])
    assert picked.count() == 2


def test_adhoc_sql_queries_only(spark):
    views = {"adozioni": adoptions(spark)}
    ok = adhoc.run_sql(spark, "SELECT uni_cod, count(*) AS n FROM adozioni WHERE a_a = :y GROUP BY uni_cod",
                       views, {"y": 2024})
    assert ok.names == ["uni_cod", "n"] and ok.n_columns == 2 and rows(ok.frame) == [("U1", 2), ("U2", 1)]
    for bad in ["DROP TABLE adozioni", "SELECT 1; DROP TABLE x", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
                "SELECT * FROM missing_table"]:
        res = adhoc.run_sql(spark, bad, views)
        assert res.frame is None and res.message == adhoc.QUERY_ERROR
    for good in ["SELECT 'drop' AS w", "SELECT uni_cod AS load FROM adozioni WHERE titolo LIKE '%;%'",
                 "WITH a AS (SELECT * FROM adozioni) SELECT count(*) AS n FROM a;",
                 "SELECT n FROM (SELECT count(*) AS n FROM adozioni WHERE isbn IN (SELECT isbn FROM adozioni)) s"]:
        assert adhoc.run_sql(spark, good, views).frame is not None, good
    spark.range(3).createOrReplaceTempView("foreign_view")
    for bad in ["SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM foreign_view",
                "SELECT * FROM adozioni WHERE EXISTS (SELECT 1 FROM foreign_view)", "SET spark.x = 1", "SHOW TABLES",
                "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') AS d", "CREATE TEMP VIEW v AS SELECT 1",
                "INSERT INTO adozioni SELECT * FROM adozioni", "SELECT * FROM adozioni; SELECT 1", ""]:
        assert adhoc.run_sql(spark, bad, views).frame is None, bad
    empty = adhoc.run_sql_checked(spark, "SELECT * FROM adozioni WHERE a_a = 1900", views)
    assert empty.message == adhoc.NO_DATA


def test_search_last_query_keeps_needle_case(spark):
    df = spark.createDataFrame([("Rossi",), ("bianchi",)], "n string")
    assert rows(sel.search_last_query(df, "ross")) == [("Rossi",)]
    assert sel.search_last_query(df, "Ross").count() == 0


def test_wide_csv_and_directory_csv(spark, scratch):
    out = os.path.join(scratch, "wide")
    store.export_wide_csv(adoptions(spark), out)
    back = files.read_csv(spark, out)
    assert back.columns == ADOPTION_COLUMNS + WIDE_EXTRA_COLUMNS and back.count() == 4
    path = os.path.join(scratch, "dir.csv")
    with open(path, "w") as f:
        f.write("prof_id,insegnamento_prof,uni_cod,unused\n7.0,Rossi Mario,U1,x\n")
    d = files.load_directory_csv(spark, path)
    assert d.columns == DIRECTORY_COLUMNS and d.collect()[0].prof_id == 7


def test_directory_year_filter_before_window(spark):
    src = {
        "work_prof_id": spark.createDataFrame([(1, "U", "A B")], "prof_id long, uni_cod string, prof_nome string"),
        "insegnamento_prof_id": spark.createDataFrame([(1, 10), (1, 20)], "prof_id long, insegnamento_id long"),
        "insegnamenti": spark.createDataFrame([(10, 100, "w10"), (20, 200, "w20")],
                                              "insegnamento_id long, materia_id long, insegnamento_prof_www string"),
        "materia_ssd": spark.createDataFrame([(100, "S1"), (200, "S2")], "materia_id long, materia_ssd_cod string"),
        "materie": spark.createDataFrame([(100, "M1"), (200, "M2")], "materia_id long, materia_nome string"),
    }
    assert dirs.build_directory(src).collect()[0].insegnamento_id == 20
    filtered = dirs.build_directory(src, year_filter=F.col("insegnamento_id") < 15)
    assert filtered.collect()[0].insegnamento_id == 10
    assert set(dirs.directory_as_contacts(filtered).columns) == set(CONTACT_COLUMNS)


def test_latest_course_of_a_year_through_curricula(spark):
    src = {
        "work_prof_id": spark.createDataFrame([(1, "U", "A B"), (2, "U", "C D")], "prof_id long, uni_cod string, prof_nome string"),
        "insegnamento_prof_id": spark.createDataFrame([(1, 10), (1, 20), (1, 30), (2, 40)], "prof_id long, insegnamento_id long"),
        "insegnamenti": spark.createDataFrame([(10, "w10"), (20, "w20"), (30, "w30")], "insegnamento_id long, insegnamento_prof_www string"),
        "curr_materie_insegnamenti": spark.createDataFrame([(10, 1), (20, 1), (20, 2), (30, 3), (40, 9)], "insegnamento_id long, curr_materia_id long"),
        "curricula_materie": spark.createDataFrame([(1, 100), (2, 100), (3, 300)], "curr_materia_id long, curr_id long"),
        "curricula": spark.createDataFrame([(100, 7), (300, 8)], "curr_id long, laurea_id long"),
        "lauree": spark.createDataFrame([(7, 2024), (8, 2025)], "laurea_id long, laurea_aa int"),
    }
    assert rows(dirs.latest_course_of_year(src, 2024), "prof_id", "insegnamento_id", "insegnamento_prof_www") == [(1, 20, "w20")]
    assert rows(dirs.latest_course_of_year(src, 2025), "prof_id", "insegnamento_id") == [(1, 30)]
    assert dirs.latest_course_of_year(src, 1990).count() == 0

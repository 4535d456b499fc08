"""Sources, sinks and streams: round trips on small files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from cattedra.schemas import ADOPTION_COLUMNS, CONTACT_COLUMNS, DIRECTORY, conform
from cattedra.sources import files, paged, store
from cattedra.streaming.incremental import read_loaded, start_incremental_load
from cattedra.streaming.log_feed import read_feed, start_log_feed
from tests.conftest import rows


from cattedra.plans import testdata  # noqa: E402


def write_text(path, name, text):
    path, name = os.path.split(os.path.join(path, name))
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(text)
    return os.path.join(path, name)


def directory(spark):
    d = spark.createDataFrame([(7, "U1", "Rossi Mario", 70), (8, "U1", "D'Angelo Maria-Rosa", 80)],
                              "prof_id long, uni_cod string, insegnamento_prof string, insegnamento_id long")
    return conform(d, DIRECTORY)


def test_adoption_csv_missing_extra_columns_and_semicolon(spark, scratch):
    text = ("uni_cod;a_a;insegnamento_prof;materia_ssd_cod;isbn;prof_id;extra\n"
            'U1;2024;ROSSI, MARIO;"MAT/01;MAT/02";9780306406157;;x\n'
            "U1;2024;d'angelo maria-rosa (supplente);BIO/01;123;12.0;y\n"
            "U1;2024;Docente da definire;BIO/01;124;;z\n"
            "U1;2024;;BIO/01;125;;z\n")
    path = write_text(scratch, "a.csv", text)
    out = files.load_adoptions_csv(spark, path, directory(spark), sep=";")
    assert out.columns == ADOPTION_COLUMNS
    got = rows(out, "insegnamento_prof", "prof_id", "insegnamento_id", "materia_ssd_cod")
    assert got == [("", 0, 0, "BIO/01"), ("", 0, 0, "BIO/01"), ("D'Angelo Maria-Rosa", 12, 80, "BIO/01"),
                   ("Rossi Mario", 7, 70, "MAT/01 MAT/02")]


def test_sector_semicolons_become_spaces(spark, scratch):
    path = write_text(scratch, "b.csv", 'uni_cod,materia_ssd_cod\nU1,"M-GGR/01;M-GGR/02"\n')
    out = files.clean_adoptions(files.read_csv(spark, path))
    assert out.collect()[0].materia_ssd_cod == "M-GGR/01 M-GGR/02"


def test_contacts_upload_modes(spark, scratch):
    header = ",".join(CONTACT_COLUMNS)
    line = "U1,,,,rossi mario,,,,r@x,,,,,978-0-306-40615-7,,"
    blank = "U1,,,,Bianchi Anna,,,,b@x,,,,,,,"
    path = write_text(scratch, "c.csv", f"{header}\n{line}\n{blank}\n")
    up = files.read_csv(spark, path)
    replaced = files.load_contacts(up, directory(spark), "replace")
    got = {r.insegnamento_prof: (r.isbn, r.prof_id, r.email, r.note) for r in replaced.collect()}
    assert got == {"Rossi Mario": ("9780306406157", 7, "r@x", ""), "Bianchi Anna": ("0", None, "b@x", "")}
    current = conform(spark.createDataFrame([("U1", 7, "Zeta", "old@x")],
                                            "uni_cod string, prof_id long, insegnamento_prof string, email string"),
                      "docenti_router")
    updated = files.load_contacts(up, directory(spark), "update", current=current)
    assert {(r.prof_id, r.email) for r in updated.collect()} == {(7, "r@x"), (None, "b@x")}
    bad = write_text(scratch, "bad.csv", "uni_cod,email\nU1,x\n")
    with pytest.raises(files.ColumnMismatch):
        files.load_contacts(files.read_csv(spark, bad), directory(spark), "replace")


def page(url, recs, nxt):
    return json.dumps({"page_url": url, "data": recs, "next_page_url": nxt})


def test_paged_source_chains(spark, scratch):
    rec = lambda u, i: {"uni_cod": u, "a_a": "2024", "isbn": str(i), "prezzo": "10"}
    lines = [page("A/0", [rec("A", 1)], "")]                                       # 1 page
    lines += [page("B/0", [rec("B", 2)], "B/1"), page("B/1", [rec("B", 3), rec("B", 3)], "B/2"),
              page("B/2", [rec("B", 4)], "")]                                        # 3 pages
    lines += [page("C/0", [], "")]                                                   # empty university
    write_text(scratch, "pages.json", "\n".join(lines) + "\n")
    pages = paged.read_pages(spark, scratch, one_per_line=True)
    assert paged.broken_chains(pages).count() == 0
    recs = paged.records(pages)
    assert recs.count() == 5
    loaded = files.load_api_pages(recs)
    assert rows(loaded, "uni_cod", "isbn") == [("A", "1"), ("B", "2"), ("B", "3"), ("B", "4")]
    assert loaded.columns == ADOPTION_COLUMNS
    broken = spark.createDataFrame([("X/0", "X/1")], "page_url string, next_page_url string")
    assert paged.broken_chains(broken).count() == 1


def test_write_pages_round_trip(spark, scratch):
    df = spark.range(0, 2500).select(F.when(F.col("id") < 2100, "U1").otherwise("U2").alias("uni_cod"),
                                     F.col("id").cast("string").alias("isbn"))
    out = os.path.join(scratch, "landed")
    testdata.write_pages(conform(df, "adozioni"), out, page_size=1000)
    pages = paged.read_pages(spark, out, one_per_line=True)
    assert pages.count() == 4 and paged.broken_chains(pages).count() == 0
    assert max(len(r.data) for r in pages.collect()) <= 1000
    assert rows(paged.records(pages), "isbn") == rows(df, "isbn")


def test_save_modes_tenants_and_layouts(spark, scratch):
    df = conform(spark.createDataFrame([("U1",)], "uni_cod string"), "adozioni")
    store.save(df, os.path.join(scratch, "a"), "fail", table="adozioni")
    store.save(df, os.path.join(scratch, "a"), "append", table="adozioni")
    assert spark.read.parquet(os.path.join(scratch, "a")).count() == 2
    with pytest.raises(Exception):
        store.save(df, os.path.join(scratch, "a"), "fail")
    name = "saved_" + os.path.basename(scratch).replace("-", "_")
    spark.conf.set("spark.sql.sources.default", "parquet")
    spark.sql(f"CREATE DATABASE db_{name} LOCATION 'file://{scratch}/warehouse'")
    for mode, n in (("fail", 1), ("append", 2), ("replace", 1)):
        store.save_table(df.select("uni_cod"), f"db_{name}.t", mode, table="adozioni")
        assert spark.table(f"db_{name}.t").count() == n and spark.table(f"db_{name}.t").columns == ADOPTION_COLUMNS
    with pytest.raises(Exception):
        store.save_table(df, f"db_{name}.t", "fail")
    spark.sql(f"DROP DATABASE db_{name} CASCADE")
    ev = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "tenant_id long, v string")
    store.write_tenants(ev, os.path.join(scratch, "ten"))
    one = store.read_tenant(spark, os.path.join(scratch, "ten"), 1)
    assert rows(one, "v") == [("a",), ("c",)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tenant" in plan
    store.export_csv(df, os.path.join(scratch, "csv"), single_file=True)
    assert len([f for f in os.listdir(os.path.join(scratch, "csv")) if f.endswith(".csv")]) == 1
    store.write_directory_layout(directory(spark), os.path.join(scratch, "dir"), 2)
    assert spark.read.parquet(os.path.join(scratch, "dir")).count() == 2


def test_log_feed_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "log")
    for i in range(3):
        spark.createDataFrame([(dt.datetime(2025, 1, 1, 10, i), f"m{i}", i)], "date timestamp, message string, q long") \
            .write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    sink, ckpt = os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt")
    q = start_log_feed(spark, src, schema, sink, ckpt, available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    assert [r.message for r in read_feed(spark, sink).collect()] == ["m2", "m1", "m0"]
    # a restart on the same checkpoint takes nothing twice
    q = start_log_feed(spark, src, schema, sink, ckpt, available_now=True)
    q.awaitTermination()
    assert read_feed(spark, sink).count() == 3


def test_incremental_load_each_file_once(spark, scratch):
    landing = os.path.join(scratch, "landing")
    header = ",".join(ADOPTION_COLUMNS)
    blank = "," * (len(ADOPTION_COLUMNS) - 1)

    def line(u, name, isbn):
        vals = blank.split(",")
        vals[0], vals[13], vals[15] = u, name, isbn
        return ",".join(vals)

    write_text(landing, "f1.csv", f"{header}\n{line('U1', '"ROSSI, MARIO"', '1')}\n{line('U1', '"ROSSI, MARIO"', '1')}\n")
    write_text(landing, "f2.csv", f"{header}\n{line('U1', '"ROSSI, MARIO"', '1')}\n{line('U2', 'x', '2')}\n")
    sink, ckpt = os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt")
    q = start_incremental_load(spark, landing, sink, ckpt, available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    got = rows(read_loaded(spark, sink), "uni_cod", "insegnamento_prof", "isbn", "prof_id")
    # de-duplicated inside a file's batch, not across loads
    assert got == [("U1", "Rossi Mario", "1", 0), ("U1", "Rossi Mario", "1", 0), ("U2", "X", "2", 0)]
    q = start_incremental_load(spark, landing, sink, ckpt, available_now=True)
    q.awaitTermination()
    assert read_loaded(spark, sink).count() == 3


def test_half_written_and_repeated_batches(spark, scratch):
    """Readers see batches that the pointer names: not one whose write broke off, and one run twice once."""
    from cattedra.sources.versions import TableStore
    tables = TableStore(spark, f"{scratch}/s")
    one = lambda u: conform(spark.createDataFrame([(u,)], "uni_cod string"), "adozioni")
    tables.append_epoch(one("A"), "adozioni", "ckpt", 0)
    tables.stage(one("lost"), "adozioni")  # the driver died before it committed
    assert rows(read_loaded(spark, f"{scratch}/s"), "uni_cod") == [("A",)]
    tables.append_epoch(one("B"), "adozioni", "ckpt", 1)
    tables.append_epoch(one("B2"), "adozioni", "ckpt", 1)  # the same batch again
    tables.append_epoch(one("C"), "adozioni", "other ckpt", 0)
    assert rows(read_loaded(spark, f"{scratch}/s"), "uni_cod") == [("A",), ("B2",), ("C",)]
    with pytest.raises(ValueError):
        tables.append_epoch(one("A"), "adozioni", "ckpt", 0)
    tables.compact("adozioni")
    tables.append_epoch(one("B3"), "adozioni", "ckpt", 1)
    assert rows(read_loaded(spark, f"{scratch}/s"), "uni_cod") == [("A",), ("B3",), ("C",)]


def test_university_list_by_year(spark, scratch):
    write_text(scratch, "unis.json", json.dumps({"data": [{"uni_cod": "U1", "uni_nome": "Uno", "max": 2024},
                                                          {"uni_cod": "U2", "uni_nome": "Due", "max": 2021}]}) + "\n")
    unis = paged.read_universities(spark, scratch)
    assert rows(paged.universities_with_year(unis, 2023), "uni_cod") == [("U1",)]


def test_paged_data_source_walks_chains_per_university(spark, scratch):
    """The live source: one input partition per university, each walking its
    page chain. Pages are files reached through file:// URLs (no server)."""
    base = f"file://{scratch}/p_"
    rec = lambda u, i: {"uni_cod": u, "isbn": str(i), "a_a": "2024"}
    write_text(scratch, "p_uni_cod=A", json.dumps({"data": [rec("A", 1), rec("A", 2)],
                                                   "next_page_url": f"file://{scratch}/A_2"}))
    write_text(scratch, "A_2", json.dumps({"data": [rec("A", 3)], "next_page_url": ""}))
    write_text(scratch, "p_uni_cod=B", json.dumps({"data": [], "next_page_url": ""}))
    write_text(scratch, "p_uni_cod=C", json.dumps({"data": [rec("C", 9)], "next_page_url": ""}))
    paged.register_paged_source(spark)
    df = (spark.read.format("paged_adoptions").option("url", base)
          .option("universities", json.dumps(["A", "B", "C"])).load())
    assert df.rdd.getNumPartitions() == 3
    assert rows(df, "uni_cod", "isbn") == [("A", "1"), ("A", "2"), ("A", "3"), ("C", "9")]
    assert conform(df, "adozioni").filter("a_a = 2024").count() == 4


def test_csv_cells_survive_export_and_reload(spark, scratch):
    cells = ['Il "nuovo" testo, vol. 1', "  Rossi ", "two\nlines", "", None, '"', "back\\slash"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "k int, v string")
    out = os.path.join(scratch, "cells")
    store.export_csv(df, out)
    assert {int(r.k): r.v for r in files.read_csv(spark, out).collect()} == dict(enumerate(cells))


def test_csv_headers_and_ragged_rows(spark, scratch):
    a, b = write_text(scratch, "a/1.csv", "x,y\n1,2\n"), write_text(scratch, "b/2.csv", "y,x\n4,3\n")
    assert rows(files.read_csv(spark, [a, b]), "x", "y") == [("1", "2"), ("3", "4")]
    write_text(scratch, "mixed/1.csv", "x,y\n1,2\n")
    write_text(scratch, "mixed/2.csv", "y,x\n4,3\n")
    with pytest.raises(Exception):
        files.read_csv(spark, os.path.join(scratch, "mixed")).collect()
    ragged = write_text(scratch, "r.csv", "x,y\n1,2\n1\n")
    with pytest.raises(Exception):
        files.read_csv(spark, ragged).collect()


def test_page_chains_that_are_not_whole(spark, scratch):
    def problems(*pages):
        df = spark.createDataFrame(pages, "page_url string, next_page_url string")
        return sorted((r.page_url, r.problem) for r in paged.broken_chains(df).collect())

    assert problems(("A/0", "A/1"), ("A/1", "")) == []
    assert problems(("A/0", "A/1")) == [("A/1", "missing")]
    assert problems(("A/1", "")) == [("A/1", "unreached")]
    assert problems(("A/0", None)) == [("A/0", "no end mark")]
    with pytest.raises(paged.BadPages):
        paged.checked_pages(spark.createDataFrame([("A/0", "A/1")], "page_url string, next_page_url string"))
    pretty = write_text(scratch, "pretty/p.json", json.dumps(json.loads(page("A/0", [{"uni_cod": "A"}], "")), indent=1))
    assert paged.records(paged.read_pages(spark, pretty)).count() == 1
    bad = write_text(scratch, "bad/p.json", '{"page_url": "A/0", "data": [')
    with pytest.raises(Exception):
        paged.read_pages(spark, bad).collect()


def test_checkpoint_folder_is_refused_on_a_cluster_without_one(monkeypatch):
    from cattedra import session

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session)


def test_csv_by_splits(spark, scratch):
    """Files without line breaks in cells are read by splits, with the same rows; a cell that has one stops the read."""
    df = spark.range(20_000).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(
        F.col("id") % 3 == 1, "").otherwise(F.concat(F.lit(' "q", '), F.col("id").cast("string"), F.lit(" "))).alias("b"))
    store.export_csv(df, f"{scratch}/flat", single_file=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        split, whole = (files.read_csv(spark, f"{scratch}/flat", line_breaks=x) for x in (False, True))
        assert split.rdd.getNumPartitions() > 3 and whole.rdd.getNumPartitions() == 1
        assert split.exceptAll(df).isEmpty() and df.exceptAll(split).isEmpty() and whole.exceptAll(df).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    store.export_csv(spark.createDataFrame([("1", "x\ny")], "a string, b string"), f"{scratch}/broken")
    assert files.read_csv(spark, f"{scratch}/broken").collect()[0].b == "x\ny"
    with pytest.raises(Exception):
        files.read_csv(spark, f"{scratch}/broken", line_breaks=False).collect()

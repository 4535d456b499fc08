"""What a query leaves on the disks on its way."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from cattedra import session
from cattedra.operators import changes as chg
from cattedra.operators.dedup import distinct_in_rounds
from cattedra.operators.numbering import with_global_index
from cattedra.plans import testdata
from cattedra.sources import files, store

SMOKE = "/root/testdata/sf0.001"
smoke = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver test data not present")


def _folders(spark, name):
    base = session.checkpoint_dir(spark).removeprefix("file:")
    return set(glob.glob(f"{base}/cattedra/{name}-*"))


def _shuffle_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_their_execution(spark):
    session.apply_runtime_conf(spark)
    before = _shuffle_files(spark)
    kept = session.stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "grouped")
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert kept.count() == 10
    again = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    assert len(again.collect()) == len(again.collect()) == 10  # the files are gone, the rows are worked out again


def test_rounds_hold_each_row_once(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") % 9 > 0, 1990 + F.col("id") % 9))
    parts = testdata.rounds(df, F.col("y"))
    assert len(parts) == testdata.ROUNDS and all(not p.isEmpty() for p in parts)
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(1000))
    assert [len(testdata.rounds(x, F.col("y"))) for x in (df.where("y = 1991"), df.where("y is null"), df.where("false"))] == [1, 1, 1]


@smoke
def test_landing_leaves_the_tables_alone(spark):
    before = _folders(spark, "rows-*")
    testdata.refresh(SMOKE)
    for table in (testdata.adoptions, testdata.contacts, testdata.directory):
        assert all(f.endswith(".zstd.parquet") for f in table(spark, SMOKE).inputFiles())
    assert _folders(spark, "rows-*") == before


def test_numbered_rows_are_stored_as_parquet(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("v"), F.lit(None).alias("nothing"))
    got = with_global_index(df, ["v", "id"], "n")
    assert got.columns == ["id", "v", "nothing", "n"] and dict(got.dtypes)["nothing"] == "void"
    assert "FileScan parquet" in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(range(50), key=lambda i: (i % 7, i))
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.n)] == want


def test_distinct_in_rounds(spark, scratch):
    df = spark.range(300).select(F.when(F.col("id") % 10 > 0, F.col("id") % 10).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"))
    df.write.parquet(f"{scratch}/source")
    got = distinct_in_rounds(spark.read.parquet(f"{scratch}/source"), source=f"{scratch}/source")
    want = sorted({(r.a, r.b) for r in df.collect()}, key=str)
    assert sorted(((r.a, r.b) for r in got.collect()), key=str) == want and got.schema == df.schema
    assert not os.path.exists(f"{scratch}/source")


def test_compressed_csv_is_read_back(spark, scratch):
    df = spark.range(0, 250, 1, 1).select(F.concat(F.lit("a\n"), "id").alias("a"), F.lit("").alias("b"))
    store.export_csv(df, f"{scratch}/gz", file_rows=100, compression="gzip")
    assert len(glob.glob(f"{scratch}/gz/*.csv.gz")) == 3
    back = files.read_csv(spark, f"{scratch}/gz")
    assert back.count() == 250 and back.exceptAll(df).isEmpty()


def test_appended_rows_are_stored_once(spark):
    """Of the new rows only the numbered ones stay."""
    schema = "record_id long, uni_cod string, prof_id long, insegnamento_id long, isbn string"
    old = spark.createDataFrame([(1, "A", 1, 1, None), (7, "A", 2, 1, "y")], schema)
    new = spark.createDataFrame([(None, "A", 1, 1, None), (None, "C", 1, None, "x"), (None, "B", 1, None, "x"), (None, "B", 1, None, "x")], schema)
    before = {n: _folders(spark, n) for n in ("fresh", "new-rows", "numbered")}
    got = sorted((r.record_id, r.uni_cod) for r in chg.append_new(old, new).collect())
    assert got == [(1, "A"), (7, "A"), (8, "B"), (9, "C")]
    assert [len(_folders(spark, n) - before[n]) for n in before] == [0, 0, 1]


@smoke
@pytest.mark.parametrize("name, folder", [("csv_load", "adoptions-csv"), ("contacts_upload", "contacts-csv"),
                                          ("incremental_load_stream", "landing")])
def test_landed_csv_files_are_compressed(spark, name, folder):
    from cattedra.plans.queries import QUERIES
    before = _folders(spark, folder)
    QUERIES[name](spark, SMOKE)
    found = [f for p in _folders(spark, folder) - before for f in glob.glob(f"{p}/*.csv*")]
    assert found and all(f.endswith(".gz") for f in found)


@smoke
def test_pages_go_when_they_are_read(spark):
    from cattedra.plans.queries import QUERIES
    before = {n: _folders(spark, n) for n in ("pages", "repeats", "page-rows")}
    QUERIES["paged_source"](spark, SMOKE)
    assert all(_folders(spark, n) == before[n] for n in before)

"""What one task reads, sorts and holds does not grow with the input."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from cattedra import session
from cattedra.plans import testdata
from cattedra.schemas import ADOPTION_COLUMNS, CONTACT_COLUMNS, conform
from cattedra.sources import files, paged, store

SMOKE = "/root/testdata/sf0.001"
smoke = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver test data not present")


@pytest.fixture()
def sizes(spark):
    keys = [session._PARTITIONS, *session._TASK_SIZES]
    before = {k: spark.conf.get(k, None) for k in keys}
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tasks_follow_the_input(spark, sizes):
    small = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    session.size_tasks(spark, 1000)
    assert session.shuffle_tasks(spark) == small
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == f"{session.TASK_BYTES}b"
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "1m"  # finer already
    session.size_tasks(spark, 100 * session.TASK_BYTES + 1)
    assert session.shuffle_tasks(spark) == 101
    assert "rangepartitioning(id#" in (plan := spark.range(9).repartitionByRange("id")._jdf.queryExecution().toString()) and ", 101)" in plan


@smoke
def test_queries_size_their_tasks(spark, sizes):
    from cattedra.plans.queries import QUERIES
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert testdata.input_bytes(spark, SMOKE) == sum(os.path.getsize(f"{SMOKE}/{t}.parquet") for t in (
        "customer", "supplier", "part", "orders", "lineitem", "events"))
    QUERIES["academic_year"](spark, SMOKE)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == f"{session.TASK_BYTES}b"


def test_buckets_follow_the_input(spark, scratch, sizes):
    session.size_tasks(spark, 30 * session.TASK_BYTES)
    name = "sized_" + os.path.basename(scratch).replace("-", "_")
    store.write_bucketed(spark.range(1000).withColumn("k", F.col("id") % 500), name, "k", path=f"{scratch}/b")
    assert f"Num Buckets" in (text := str(spark.sql(f"describe extended {name}").collect())) and "'30'" in text
    spark.sql(f"DROP TABLE {name}")


@smoke
def test_landing_deals_the_source_columns(spark):
    """The rows that are dealt and sorted have fewer columns than the table, which has several of them twice."""
    for rows, view, columns in ((testdata._adoption_rows, testdata.adoptions_view, ADOPTION_COLUMNS),
                                (testdata._contact_rows, testdata.contacts_view, ["record_id", *CONTACT_COLUMNS])):
        assert len(rows(spark, SMOKE).columns) < len(columns) and view(spark, SMOKE).columns == columns
    landed, view = testdata.adoptions(spark, SMOKE), testdata.adoptions_view(spark, SMOKE)
    assert landed.schema.simpleString() == view.schema.simpleString()
    assert landed.exceptAll(view).isEmpty() and view.exceptAll(landed).isEmpty()


def test_csv_files_are_cut(spark, scratch):
    df = spark.range(0, 250, 1, 1).select(F.concat(F.lit("a\n"), "id").alias("a"))
    store.export_csv(df, f"{scratch}/cut", file_rows=100)
    assert len(glob.glob(f"{scratch}/cut/*.csv")) == 3
    assert files.read_csv(spark, f"{scratch}/cut").exceptAll(df).isEmpty() and files.read_csv(spark, f"{scratch}/cut").count() == 250
    store.export_csv(df, f"{scratch}/whole", file_rows=None)
    store.export_csv(df, f"{scratch}/single", single_file=True, file_rows=100)
    assert [len(glob.glob(f"{scratch}/{x}/*.csv")) for x in ("whole", "single")] == [1, 1]


def test_pages_are_full_and_compressed(spark, scratch):
    """Rows of three universities (one without a code) in several tasks: all pages but a chain's last are full."""
    n = F.col("id")
    df = conform(spark.range(0, 3500, 1, 5).select(F.when(n % 7 == 0, None).when(n % 2 == 0, "U1").otherwise("U2").alias("uni_cod"),
                                                   n.cast("string").alias("isbn")), "adozioni")
    testdata.write_pages(df, f"{scratch}/pages", page_size=400)
    assert not glob.glob(f"{scratch}/pages/*.json") and glob.glob(f"{scratch}/pages/*.json.gz")
    pages = paged.read_pages(spark, f"{scratch}/pages", one_per_line=True)
    assert sorted((r.page_url, r.next_page_url, len(r.data)) for r in paged.checked_pages(pages).collect()) == sorted(
        (f"pages/{u}/{p}", f"pages/{u}/{p + 1}" if p < last else "", 400 if p < last else rest)
        for u, last, rest in (("", 1, 100), ("U1", 3, 300), ("U2", 3, 300)) for p in range(last + 1))
    assert sorted(int(r.isbn) for r in paged.records(pages).collect()) == list(range(3500))


@smoke
def test_incremental_load_gives_every_core_a_file(spark, monkeypatch):
    from cattedra.plans.queries import QUERIES
    from cattedra.streaming import incremental
    seen, start = [], incremental.start_incremental_load

    def watched(*args, **kw):
        seen.append(kw["max_files_per_trigger"])
        return start(*args, **kw)

    monkeypatch.setattr(incremental, "start_incremental_load", watched)
    QUERIES["incremental_load_stream"](spark, SMOKE)
    assert len(seen) == 2 and min(seen) >= spark.sparkContext.defaultParallelism


def test_step_numbers_ask_the_state_once():
    from pyspark.sql import Row

    from cattedra.streaming.log_steps import StepNumbers

    class State:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

    numbers = StepNumbers(("date",))
    numbers.next = state = State()
    for first in (0, 2):
        got = list(numbers.handleInputRows((1,), iter([Row(tenant_id=1, date=5), Row(tenant_id=1, date=None)]), None))
        assert [(r.date, r.q) for r in got] == [(None, first), (5, first + 1)]
    assert state.calls == 4


def test_new_rows_are_joined_before_repeats_are_dropped(spark, monkeypatch):
    from cattedra.operators import changes as chg
    seen = []
    monkeypatch.setattr(chg, "assign_ids", lambda df, rows: seen.append(rows) or rows)
    schema = "record_id long, uni_cod string, prof_id long, insegnamento_id long, isbn string"
    old = spark.createDataFrame([(1, "A", 1, 1, None), (2, "A", 1, 1, None)], schema)
    new = spark.createDataFrame([(None, "A", 1, 1, None), (None, "B", 1, None, "x"), (None, "B", 1, None, "x")], schema)
    assert sorted(r.uni_cod for r in chg.append_new(old, new).collect()) == ["A", "A", "B"]
    lines = seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [x for x in lines if "Aggregate" in x or "Join" in x][0].lstrip("+-: ").startswith("Aggregate")

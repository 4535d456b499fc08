"""W2 on the stream: numbers go on across micro-batches and restarts, as in the batch form."""

import datetime as dt

from pyspark.sql import functions as F

from cattedra.operators.numbering import with_group_index
from cattedra.streaming.log_steps import start_step_numbers

SCHEMA = "event_id long, tenant_id long, date timestamp, message string"


def land(spark, folder, ids):
    """One file; a third of the rows are one tenant's, dates have ties, and some rows have no tenant."""
    rows = [(i, None if i % 10 == 9 else 1 if i % 3 == 0 else i % 7, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i // 4), f"m{i}") for i in ids]
    spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_numbers_go_on_across_batches_and_restarts(spark, scratch):
    src, sink, ckpt = (f"{scratch}/{x}" for x in ("src", "sink", "ckpt"))
    for first in range(0, 60, 20):
        land(spark, src, range(first, first + 20))
    schema = spark.read.parquet(src).schema
    run = lambda: start_step_numbers(spark, src, schema, sink, ckpt, available_now=True, max_files_per_trigger=1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    query = run()
    query.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert spark.read.parquet(sink).groupBy(F.input_file_name()).count().count() >= 3
    land(spark, src, range(60, 100))
    run().awaitTermination()  # a restart on the same checkpoint
    got = spark.read.parquet(sink)
    want = with_group_index(spark.read.parquet(src), ["tenant_id"], ["date", "event_id"], "q")
    assert got.count() == 100 and got.select(*want.columns).exceptAll(want).isEmpty()
    assert got.where("tenant_id is null").agg(F.max("q")).first()[0] == 9

"""Step numbers on the log stream (W2 + G1).

Each log row of a tenant gets the next number of that tenant, across micro-batches: the state of a tenant is its last number, kept
in the stream's state store, so a restart goes on where the last batch ended. Inside a micro-batch rows are numbered by
(date, event id), as in the batch form (``operators.numbering``); rows that arrive in a later batch come after all earlier
ones, as they did in the reference, which numbered a row when it was written. The sink is the exactly-once file sink.

The number needs the one before it, so the rows of one tenant in one micro-batch meet in one task: bound a batch by
``max_files_per_trigger``. For the whole stored log the batch form spreads a hot tenant over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class StepNumbers(StatefulProcessor):
    """State of a tenant: the number of its next row."""

    def __init__(self, order: tuple[str, ...]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", T.StructType([T.StructField("q", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # missing values first, as Spark orders them
        found = sorted(rows, key=lambda r: [(r[c] is not None, r[c] if r[c] is not None else 0) for c in self.order])
        held = self.next.get()  # one call of the state a group, and one to set it
        start = held[0] if held else 0
        self.next.update((start + len(found),))
        if found:
            numbered_row = Row(*found[0].__fields__, "q")
            for q, row in enumerate(found, start):
                yield numbered_row(*row, q)

    def close(self) -> None:
        pass


def numbered(stream: DataFrame, tenant: str = "tenant_id", order: tuple[str, ...] = ("date", "event_id"), name: str = "q") -> DataFrame:
    """The stream with each row's step number within its tenant."""
    fields = [f for f in stream.schema.fields if f.name != name]
    schema = T.StructType([*fields, T.StructField("q", T.LongType())])
    out = stream.select(*[f.name for f in fields]).groupBy(tenant).transformWithState(
        StepNumbers(order), schema, outputMode="Append", timeMode="None")
    return out.withColumnRenamed("q", name)


def start_step_numbers(spark: SparkSession, source_dir: str, schema: T.StructType, sink_path: str, checkpoint: str,
                       available_now: bool = False, max_files_per_trigger: int | None = None,
                       trigger: str = "4 seconds") -> StreamingQuery:
    """Number the log rows that arrive as Parquet files in ``source_dir``. The state lies in RocksDB, on the executors'
    disks with changes in the checkpoint; the setting is put back once the query has started."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    writer = (numbered(reader.parquet(source_dir)).writeStream.format("parquet").option("path", sink_path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        return writer.start()
    finally:
        spark.conf.set(PROVIDER, before)

"""Incremental adoption load.

New CSV files in a landing folder are each taken once (file-source progress in
the checkpoint), cleaned with the batch load's expressions (S1 cleaning), and
de-duplicated within the micro-batch (A6, as one API load is de-duplicated in
the reference; loads are never de-duplicated against each other). Every batch
is written to a folder of its own, which becomes part of the table only when
the store's pointer names it: readers never see half a batch, and a batch that
is run again after a failure takes the place of its first run: exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cattedra.schemas import ADOPTIONS, ADOPTIONS_WIDE, all_string
from cattedra.sources.files import CSV_DIALECT, clean_adoptions
from cattedra.sources.versions import TableStore

TABLE = "adozioni"


def start_incremental_load(spark: SparkSession, landing_dir: str, sink_path: str, checkpoint: str,
                           sep: str = ",", available_now: bool = False,
                           max_files_per_trigger: int | None = None,
                           trigger: str = "1 minute", layout: str = "adoptions") -> StreamingQuery:
    """Landing files carry a header and the columns of ``layout`` in order:
    ``adoptions`` (27 columns, as exported) or ``wide`` (39 columns). A
    stream cannot rename by header, so the header is checked against the
    layout (``enforceSchema=false``) and a file in another order fails."""
    schema = all_string(ADOPTIONS_WIDE if layout == "wide" else ADOPTIONS)
    reader = (spark.readStream.schema(schema).option("header", True)
              .options(**CSV_DIALECT).option("sep", sep).option("enforceSchema", False).option("mode", "FAILFAST"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.csv(landing_dir)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        TableStore(batch.sparkSession, sink_path).append_epoch(clean_adoptions(batch).distinct(), TABLE, checkpoint, epoch_id)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


def read_loaded(spark: SparkSession, sink_path: str) -> DataFrame:
    """All loaded adoptions: the batches that the store's pointer names."""
    return TableStore(spark, sink_path).read(TABLE)

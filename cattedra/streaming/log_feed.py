"""Selection-log feed (G1).

The reference re-reads the whole log every 4 seconds and sends it newest
first. Here the log folder is a streaming file source: each micro-batch takes
only the new files, appends them through the exactly-once Parquet file sink,
and the feed is the sink read newest first (T7). Tests and batch catch-up use
the ``availableNow`` trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cattedra.operators.listings import newest_first

# --- Fixed values: the reference's poll period. ---
POLL_PERIOD = "4 seconds"
# --- end of fixed values ---


def start_log_feed(spark: SparkSession, source_dir: str, schema: T.StructType, sink_path: str,
                   checkpoint: str, available_now: bool = False, glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(source_dir)
    writer = (stream.writeStream.format("parquet").option("path", sink_path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=POLL_PERIOD)
    return writer.start()


def read_feed(spark: SparkSession, sink_path: str, date_col: str = "date") -> DataFrame:
    """The feed as sent to the page: every log row, newest first."""
    return newest_first(spark.read.parquet(sink_path), date_col)

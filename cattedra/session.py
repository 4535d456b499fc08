"""Session helpers.

The library never creates a cluster session by itself in production code paths:
callers pass their own ``SparkSession``. ``local_session`` is for tests, the
bench and the driver smoke check.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every operator relies on. They are session-level and safe
# to set on an existing session (no static conf among them).
RUNTIME_CONF = {
    # AQE re-plans joins from runtime sizes (size-checked broadcast), coalesces
    # small shuffle partitions and splits skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffle files go when the execution that wrote them ends (what reads them again works them out again), or those of
    # every step of a query would lie on the disks until the driver collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # NTZ timestamps in the inputs are zone-free; pin the zone for the rest.
    "spark.sql.session.timeZone": "UTC",
}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Stored bytes (compressed) that one task is to take from a scan or a shuffle.
TASK_BYTES = 8 << 20
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_TASK_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def size_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Let the number of tasks follow the input, so that what one task reads, sorts and holds does not grow with it: a shuffle
    begins with a partition for each ``TASK_BYTES`` of input (adaptive execution joins small ones), and a scan or a joined
    partition takes that many bytes at most. Settings that deal the rows finer stay."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // TASK_BYTES))
    spark.conf.set(_PARTITIONS, str(tasks))
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key in _TASK_SIZES:
        if size(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, f"{TASK_BYTES}b")


def shuffle_tasks(spark: SparkSession) -> int:
    """Partitions that a shuffle begins with."""
    return int(spark.conf.get(_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cattedra")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. Where it is unset a local master (tests, laptops) gets a
    fresh scratch folder; a cluster is refused, as its executors would not see it.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext on this client: use the setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name the shared folder") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="cattedra-ckpt-")  # one machine: tests and laptops
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


ensure_checkpoint_dir = checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local)."""
    base = checkpoint_dir(spark).rstrip("/")
    token = os.urandom(6).hex()
    return f"{base}/cattedra/{name}-{token}"


#: Codec of the Parquet files that queries write on their way.
CODEC = "zstd"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared checkpoint folder and read it back: evaluated once, lineage cut."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the folder, for who deletes it when its rows are no longer read."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "support_signals",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session with the settings the jobs are tuned for.

    On a cluster the session comes from the launcher; only unset options are
    filled in there (see :func:`ensure_checkpoint_dir`).
    """
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it.  Where it is unset, a local session gets a scratch
    folder; on a cluster that would be a different folder on every machine, so
    there it is an error.
    """
    sc = spark.sparkContext
    active = sc.getCheckpointDir()            # already registered (with Spark's own sub-folder)
    if active:
        return active
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="ss-ckpt-", dir=os.environ.get("SS_SCRATCH", "/tmp"))
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def write_table(df, name: str, sort_by: str | None = None):
    """Write ``df`` as a parquet table in a fresh folder under the shared
    checkpoint directory and return it read back: lineage is cut, and later
    reads get column pruning and filter pushdown (row-group min/max on the
    sort column)."""
    import uuid

    root = ensure_checkpoint_dir(df.sparkSession)
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
    out = df.sortWithinPartitions(sort_by) if sort_by else df
    out.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_buckets(df, name: str, key: str, buckets: int):
    """Write ``df`` as a table in ``buckets`` buckets of ``key`` under the shared checkpoint directory and return it read back:
    later groupings and joins by ``key`` and further columns need no shuffle.  Rows that are partitioned by ``key`` into as
    many partitions are written where they are."""
    import uuid

    table = f"{name}_{uuid.uuid4().hex[:12]}"
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), table)
    # read back under its own name only: a union keeps the partitioning of a column that is not the table's
    stored = f"{key}_bucket"
    # wide enough a dictionary for the tickets of a category-week
    (df.withColumnRenamed(key, stored).write.format("parquet").bucketBy(buckets, stored).option("path", path).option("parquet.dictionary.page.size", 8 << 20)
     .option("compression", "zstd").saveAsTable(table))
    return df.sparkSession.table(table).withColumnRenamed(stored, key)

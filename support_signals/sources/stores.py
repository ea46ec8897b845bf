"""Keyed stores as append-only logs.

A write appends ``(key..., payload..., written_at, seq)`` rows to a parquet
log; a read keeps the last write per key with ``max_by`` (partial
aggregation: no sort, no single-task gather, skew-safe).  Compaction rewrites
the latest state into a new folder and swaps the pointer file through the
Hadoop FileSystem API (write + rename, on the shared file system), so readers
never see a half-written state (the atomic-rename of the reference).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str] = ("written_at", "seq")) -> DataFrame:
    payload = [c for c in log.columns if c not in set(keys) | set(order)]
    agg = F.max_by(F.struct(*payload), F.struct(*order)).alias("_v")
    return log.groupBy(*keys).agg(agg).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in payload])


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def compact(spark, log_path: str, state_root: str, keys: Sequence[str],
            order: Sequence[str] = ("written_at", "seq")) -> str:
    """Write the latest state to a fresh folder and point ``CURRENT`` at it."""
    log = spark.read.parquet(log_path)
    target = os.path.join(state_root, f"state-{uuid.uuid4().hex}")
    latest_per_key(log, keys, order).write.mode("errorifexists").parquet(target)
    _point(spark, state_root, target)
    return target


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _overwrite(spark):
    """The one-element array of Hadoop rename options that replaces the target."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    return options


def _point(spark, state_root: str, target: str) -> None:
    """Write ``CURRENT`` -> target through the Hadoop FileSystem API (works on
    the shared cluster file system): write a temporary file, then rename it
    over the pointer."""
    jvm = spark.sparkContext._jvm
    fs, tmp = _fs(spark, os.path.join(state_root, f"CURRENT.{uuid.uuid4().hex}.tmp"))
    out = fs.create(tmp, True)
    out.write(bytearray(target.encode("utf-8")))
    out.close()
    # an overwriting rename: readers find the old pointer or the new one at any time
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(tmp), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(os.path.join(state_root, "CURRENT"))),
        _overwrite(spark))


def read_state(spark, state_root: str) -> DataFrame | None:
    """Current compacted state, or None when nothing was written (as the reference)."""
    fs, cur = _fs(spark, os.path.join(state_root, "CURRENT"))
    if not fs.exists(cur):
        return None
    target = spark.read.text(cur.toString()).first()[0].strip()
    return spark.read.parquet(target)


def publish(df: DataFrame, state_root: str) -> str:
    """Write a full new version (e.g. the issue backlog) and swap the
    ``CURRENT`` pointer; readers see the old or the new version, never a mix."""
    target = os.path.join(state_root, f"state-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(target)
    _point(spark=df.sparkSession, state_root=state_root, target=target)
    return target


def _exists(spark, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def load_json_or_empty(spark, path: str, schema, multiline: bool = True) -> DataFrame:
    """A JSON source; a missing file gives an empty table (as the reference)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.json(path, schema=schema, multiLine=multiline)


def load_issues(spark, runtime_path: str, seed_path: str, schema) -> DataFrame:
    """The runtime backlog if it exists, otherwise the seed file."""
    return load_json_or_empty(spark, runtime_path if _exists(spark, runtime_path) else seed_path, schema)


def dedupe_last(df: DataFrame, key: str) -> DataFrame:
    """When a key repeats in a list source, the last occurrence wins
    (input order = partition order; monotonically increasing ids keep it)."""
    d = df.withColumn("_order", F.monotonically_increasing_id())
    return latest_per_key(d, [key], order=("_order",))

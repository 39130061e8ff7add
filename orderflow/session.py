"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession

# One reducer should get about this much shuffled data.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024
# More partitions than this cost the driver more than they save a reducer.
MAX_PARTITIONS = 50_000
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

_SETTINGS = {
    # Driver timestamps are zone-free; a fixed zone keeps casts reproducible.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot order even if that costs one more shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows already partitioned by order stay put in joins on (order, idx) and
    # (order, phase). Groups too large for that leave the numbering unpartitioned
    # and are spread by all join keys.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the settings above; size the first shuffle by the input if known.

    Adaptive execution merges small partitions afterwards, so starting with
    many is safe while starting with too few makes every reducer spill.
    """
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes:
        base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        wanted = min(math.ceil(input_bytes / TARGET_PARTITION_BYTES), MAX_PARTITIONS)
        if wanted > base:
            spark.conf.set(_INITIAL, str(wanted))
        else:  # what an earlier, larger query set does not stay
            spark.conf.unset(_INITIAL)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, as in tests, may fall back to a temporary folder:
    on a cluster a machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = context._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            context.setCheckpointDir(named)
        return named
    if not current.isEmpty():
        return str(current.get())
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads is a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def numbered_folders(spark: SparkSession, path: str, prefix: str) -> list[tuple[int, str]]:
    """(number, path) of the folders below a path that are named by a prefix and a number."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = [(f.getPath().getName(), str(f.getPath().toString())) for f in found]
    return sorted((int(n.removeprefix(prefix)), p) for n, p in names if n.startswith(prefix))


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def input_bytes(df: DataFrame) -> int | None:
    """Size of the files and tables a DataFrame reads, None where unknown.

    Adds up the leaves of the optimized plan: the files are already listed, so
    this costs no job, and joins do not inflate it as the estimate of the
    whole plan would.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
        return sum(int(str(size)) for size in sizes)
    except Exception:
        return None

"""Session settings and lineage cuts.

Lineage is cut only through reliable storage (``DataFrame.checkpoint`` into the
directory named by ``spark.checkpoint.dir``), never through executor-local
blocks, so a lost executor costs a re-read and not the job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of input files for each partition a shuffle starts with.
PART_BYTES = 8 << 20
#: Folder of this process in local mode without the setting, which can't be changed once a session runs.
_local_root: dict[str, str | None] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "segue") -> SparkSession:
    """Session with the settings the engine relies on; the cluster sets the rest."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Runtime settings of long scoring expressions.

    Generated methods above 8 kB of bytecode are never compiled by the JVM; below this
    limit Spark splits such expressions into smaller methods instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def spread(spark: SparkSession, folder: str) -> None:
    """Start shuffles with one partition for each ``PART_BYTES`` of input, so that a task's share doesn't grow with the input.

    Adaptive execution joins small partitions again but never splits one that only sorts or aggregates. Only the
    list of files is read; small inputs keep the session's number.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    size = files.agg(F.sum("length")).first()[0] or 0
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))))


def fan(spark: SparkSession) -> int:
    """Partitions for few rows that much work follows; adaptive execution would join them to one."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    return max(int(spark.conf.get(name, None) or 1) for name in names)


def shared_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only when that is unset (local
    tests) does the engine pick a temporary folder of its own.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        root = _local_root.get("path") or tempfile.mkdtemp(prefix="spark-segue-")
        _local_root["path"] = root
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and forget how it was computed."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder name under the shared root for sinks and stream checkpoints."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on at scale. Skew joins are split and small shuffle
# partitions merged at run time; written checkpoints go when nothing refers to them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Shuffles start from partitions of about this size; fewer come from merging, never more.
PARTITION_BYTES = 128 * 2**20
LEAST_PARTITIONS, MOST_PARTITIONS = 200, 200_000


def initial_partitions(input_bytes: int) -> int:
    """How many partitions a shuffle of the whole input starts from."""
    return min(MOST_PARTITIONS, max(LEAST_PARTITIONS, -(-input_bytes // PARTITION_BYTES)))


def build_session(app: str = "fieldwater", master: str | None = None, input_bytes: int | None = None, **conf: str) -> SparkSession:
    """Return a session with the library defaults; keyword arguments override them.

    ``input_bytes`` is the size of the tables to be read. It sets the number of
    partitions shuffles start from, which run-time merging can only lower.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    made = dict(DEFAULTS)
    if input_bytes is not None:
        made["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(initial_partitions(input_bytes))
    for key, value in {**made, **{k: str(v) for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context when needed.

    The folder named by ``spark.checkpoint.dir`` always wins. A folder of our
    own is made only in local mode with the setting absent.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="fieldwater-")
    context.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

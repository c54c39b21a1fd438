"""Session settings the engine relies on; all of them are plain Spark SQL options."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle: a sheet or a file
    # may hold a third of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A plan made from file sizes takes a table of many derived rows for a small one, so sides
    # are broadcast only by their measured size.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Joins whose one side is in partitions of at most this measured size hash that side instead of sorting both; skewed ones are still sorted and split.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
    # A checkpoint has no known size and counts as endless, so every side with a filter would be made twice, once for a Bloom filter.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
    # Rows are costly to judge, so even small inputs are worth spreading over all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Cells compress to a tenth or less, and a task may sort its share several times over: partitions that
    # are put together to the default of 64 MB become gigabytes in one task.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # The JVM never compiles methods of more than 8000 bytes of code; stages that would get one run as operators of smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    # ``encode`` and ``decode`` take every charset of the JVM and replace what does not fit (see ``repair_name``).
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}

# Static options, for sessions that are built here. Recording the Python call site of
# every column expression costs seconds for long plans.
STATIC = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go with the results that need them
}


def build(app: str, master: str | None = None, **options: str) -> SparkSession:
    """A session with the engine's options; ``options`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC, **SETTINGS, **{k.replace("__", "."): v for k, v in options.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's folder below ``spark.checkpoint.dir``, which all executors see.

    Without that setting only a local session (tests) gets a temporary folder; on a cluster
    executors would not see each other's files, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veritab-checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and cut its lineage.

    A lost executor costs nothing but a re-read.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def measured(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A side of a join, written and counted; sent to all tasks if it has few rows, so that the other side is not shuffled."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= rows else df

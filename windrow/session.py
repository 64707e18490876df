"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the library relies on.  Sizes (shuffle partitions, memory) belong to the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows here often cost much more CPU than bytes (kernels, unfolding joins), so small shuffles keep their parallelism
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "windrow", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # recording the Python line of every column expression costs more than planning does
    static = {"spark.python.sql.dataFrameDebugging.enabled": "false"}
    for key, value in {**SESSION_CONF, **static, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: settings results depend on; the others are preferences
REQUIRED_CONF = ("spark.sql.session.timeZone", "spark.sql.timestampType")


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime part of the defaults on a session somebody else built; what that somebody has chosen stays, except
    for the settings that results depend on."""
    for key, value in SESSION_CONF.items():
        if key in REQUIRED_CONF or spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partition by the columns into the session's full number of shuffle partitions.

    For stages whose rows unfold into many more: a plain ``repartition`` may be coalesced to fit the small input.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names no folder gets a scratch one; on a cluster a missing setting is an error, because a
    folder on one machine does not survive the loss of that machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="windrow-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet to the shared folder and read back: smaller than a checkpoint, and as lasting."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (a local scratch folder in local mode)."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="windrow-scratch-")
    return f"{base.rstrip('/')}/windrow-{name}-{uuid.uuid4().hex}"

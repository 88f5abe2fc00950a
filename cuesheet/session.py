"""Session settings the plans in this package are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Bytes of a batch that goes to a Python task. Bound by rows alone (10,000), a batch of texts has tens of MB,
# and an executor's JVM and its workers keep the largest buffers they ever took.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = 4 << 20

# Temporary folder of each application that runs in local mode without a shared one.
_LOCAL: dict[str, str] = {}


def build_session(app_name: str = "cuesheet", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting switched on.

    Shuffle width is left to adaptive coalescing: ``spark.sql.shuffle.partitions`` is the
    upper bound, so set it to two or three times the cores of the cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        BATCH_BYTES: str(MOST_BATCH_BYTES),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of Python tasks by bytes, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(MOST_BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only when that setting is unset, as in tests, is a fresh temporary folder used, and then
    only in local mode: elsewhere executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        folder = _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="cuesheet-"))
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back.

    Cuts the lineage like a checkpoint, but columns stay prunable and a join of two stored
    tables can be split where one key is hot. Tables live below a folder of the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

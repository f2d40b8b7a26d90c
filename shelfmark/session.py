"""Session settings and the shared folder used for checkpoints and staging."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


_made: list[str] = []


def build_session(app: str = "shelfmark", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; ``clear_shared`` removes what was written there."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what was written at ``path``, wherever the session's file systems reach it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_shared(spark: SparkSession) -> None:
    """Delete the intermediate tables this process has written, once its results no longer need them."""
    while _made:
        remove_path(spark, _made.pop())


def cut_lineage(df):
    """Reliable checkpoint: survives executor loss and fixes the row order once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset and all runs on
    one machine (as in tests) a temporary folder is made and set."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A place of its own in the shared folder, that goes when the driver ends."""
    path = f"{shared_dir(spark)}/sparkloom-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: it is computed once however often it is used,
    and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; the shared folder's own clean-up applies
            return

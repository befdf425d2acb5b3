"""Tables that a query writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a temporary one, on one machine only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidebook-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once: what follows reads the table, and lost executors cost no more than that. It goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidebook-{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for path, spark in _WRITTEN.items():
        if spark.sparkContext._jsc is None:
            return
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may have ended first
            return

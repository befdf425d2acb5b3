"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch at most: what a Python worker and its JVM hold at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new temporary one only where none is set and all is one machine (as in tests).

    Arrow batches larger than BATCH are made that small from here on: the
    defaults let a batch of long texts outgrow a small executor."""
    sc = spark.sparkContext
    for key, most in BATCH.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    sc.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidebook-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidebook-{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df once and read it back: whatever follows survives lost executors without recomputing df."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidebook_path = path
    return out


def _bytes(field) -> Column:
    """About how many bytes a value takes."""
    kind, own = field.dataType.simpleString(), F.col(f"`{field.name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(own), F.lit(0)) + 16
    return F.coalesce(F.octet_length(F.to_json(F.struct(own))), F.lit(0)) + 16 if kind.startswith(("array", "struct", "map")) else F.lit(8)


def small(df: DataFrame, most: int = 300_000, most_bytes: int = 64 << 20) -> DataFrame:
    """df, to be broadcast if it has at most ``most`` rows and about ``most_bytes`` bytes; else joins shuffle it."""
    rows, size = df.agg(F.count("*"), F.sum(sum((_bytes(f) for f in df.schema.fields), F.lit(0)))).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= most_bytes else df


def drop(*tables: DataFrame | str) -> None:
    """Delete tables of save() that nothing reads any more."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_tidebook_path", None)
        spark = _WRITTEN.pop(path, None)
        if spark is None:
            continue
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_WRITTEN.items()):
        if spark.sparkContext._jsc is not None:
            try:
                drop(path)
            except Exception:  # noqa: BLE001  the JVM may have ended first
                return

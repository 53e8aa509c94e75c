"""Reading test tables, cutting lineage, and small session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where that is unset and there is one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(spark.sparkContext, "_provspark_dir", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="provspark-")
            spark.sparkContext._provspark_dir = at
    return at.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner cleans it
        pass


def _forget() -> None:
    for spark, path in _written:
        _delete(spark, path)
    _written.clear()


atexit.register(_forget)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: its lineage ends there, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/provspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what ``cut`` wrote for this frame, once nothing that is still to run reads it (loops keep one step, not all)."""
    path = getattr(df, "_cut_at", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]

"""Cutting lineage for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the cuts that are still there, oldest first.
_folders: list[str] = []


def _path(spark: SparkSession, folder: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the session's ``spark.checkpoint.dir`` (a temporary folder where none is set) and read again.

    Columns are packed, which takes a tenth of a checkpoint of rows; the size is known to the planner, and filters reach the
    files. Folders go by ``release`` or ``release_since``, or when the session's process ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="weft-"))
    folder = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    fs, path = _path(spark, folder)
    fs.deleteOnExit(path)
    _folders.append(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._cut = folder
    return out


def release(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; no frame built on it may be evaluated afterwards."""
    _delete(df.sparkSession, [x for x in _folders if x == df._cut])


def mark() -> int:
    return len(_folders)


def release_since(spark: SparkSession, at: int) -> None:
    """Delete all cuts made since ``mark`` gave ``at``."""
    _delete(spark, _folders[at:])


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        fs, path = _path(spark, folder)
        fs.delete(path, True)
        _folders.remove(folder)

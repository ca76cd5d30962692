"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contract of the operators has it: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Only a local session may have none, and gets a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return base or tempfile.mkdtemp(prefix="weft-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Collect the driver's garbage, so that shuffles and checkpoints nobody refers to are removed now.

    Long plans otherwise pile up their files and their metadata until the driver's heap is full.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def ship(df: DataFrame) -> None:
    """Send this package to the Python workers, once a session (as ``--py-files`` would)."""
    sc, root = df.sparkSession.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_weft_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="weft-")) / f"{root.name}.zip"  # only the driver reads it: it serves the file to the workers
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(path))
    sc._weft_shipped = True


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_RUN), "")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Equi-join in which a hot key of ``big`` is dealt to ``salts`` partitions.

    ``small`` has one narrow row a key and is repeated once a salt; nothing is broadcast,
    so neither side needs a size bound.
    """
    b = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [*keys, "_salt"], how).drop("_salt")

"""Shared folders, tables written between steps, and small helpers of the operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
#: Of a worker: the one thing that it keeps from task to task.
_kept: dict[Hashable, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``; only where that setting is absent (tests on one machine) a local temporary
    folder is made and set. The folder is removed when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
        _made.append((spark, root))
    path = f"{root.rstrip('/')}/brindle-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing needs any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the session may have ended before; then nothing can be removed through it
            return


#: Shuffle files go as soon as the table that needed them is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "t", by: str | None = None) -> str:
    """Write ``df`` as a Parquet table in the shared folder and return its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return path


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def trim() -> None:
    """Give freed memory back, since the driver and the workers live on."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library has no such call
        return


def kept(key: Hashable, make: Callable):
    """What a worker keeps from task to task under ``key``; what it kept under another key goes first."""
    if key not in _kept:
        _kept.clear()
        trim()
        _kept[key] = make()
    return _kept[key]


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str):
    """crc32 of an integer id written as decimal text; of the empty text for null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""Helpers shared by the corpus operators: shared storage, hashing and worker-side caches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWNED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors both see, as ``spark.checkpoint.dir`` names it.

    Only in local mode, and where the session names none, a temporary folder is made and set; on a cluster that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="motifloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/motifloom-{name}-{uuid.uuid4().hex}"
    if not _OWNED:
        atexit.register(_remove_owned)
    _OWNED.append((spark, path))
    return path


def _remove_owned() -> None:
    for spark, path in _OWNED:
        try:
            remove_path(spark, path)
        except Exception:  # the JVM may be gone before the interpreter ends
            return


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing reads any more."""
    for df in frames:
        remove_path(df.sparkSession, df.written_path)
        _OWNED[:] = [own for own in _OWNED if own[1] != df.written_path]


def drawn_share(share: Column | float, *columns: Column | str) -> Column:
    """Whether a row is drawn with probability ``share``, by a hash of some columns over its whole range."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 62)).cast("double") < (share if isinstance(share, Column) else F.lit(float(share))) * float(1 << 62)


def id_crc(column: str | Column) -> Column:
    """Unsigned crc32 of an id written as text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(col.cast("string").cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Written intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; only a local master without the setting gets one of its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="linkspark-core-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path that goes when the application ends."""
    path = f"{shared_dir(spark)}/core/{uuid.uuid4().hex}-{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that outlives lost executors and cuts the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """A path and its file system, whichever Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table stands at ``path``."""
    at, fs = _at(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def copy(spark: SparkSession, path: str, to: str) -> None:
    """A folder or file into another place, which it replaces."""
    (a, one), (b, other) = _at(spark, path), _at(spark, to)
    other.delete(b, True)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(one, a, other, b, False, spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file of some text."""
    at, fs = _at(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is no file."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def finished(spark: SparkSession, path: str, settings: str = "") -> bool:
    """Whether a finished table that was made under these settings stands at ``path``."""
    return exists(spark, path) and (read_text(spark, f"{path}.settings") or "") == settings


def stage(spark: SparkSession, path: str, make, mirror: str | None = None, settings: str = "") -> DataFrame:
    """The table at ``path``, made and written only if no finished one of the same settings is there.

    With ``mirror``, a lasting place for the same table, it is brought back from there if it can be, and a new table is copied there.
    """
    if not finished(spark, path, settings) and mirror and finished(spark, mirror, settings):
        copy(spark, mirror, path)
        write_text(spark, settings, f"{path}.settings")
    if not finished(spark, path, settings):
        make().write.mode("overwrite").parquet(path)
        write_text(spark, settings, f"{path}.settings")
        if mirror:
            copy(spark, path, mirror)
            write_text(spark, settings, f"{mirror}.settings")
    return spark.read.parquet(path)

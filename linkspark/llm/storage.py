"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again: the table outlives
a lost executor, is compressed, and later readers prune its columns. The tables go when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkspark.sources.storage import new_path


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str) -> list[str]:
    """The finished tables in a folder, which need not be there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(x.getPath().getParent().toString() for x in found or [])


def partitions(spark: SparkSession) -> int:
    """The shuffle width that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows that go to Python at once. Texts are some KB on average and up to MB, and a batch stands in memory four times.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to BATCH_ROWS rows, for operators that send whole texts to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def spare(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from winnow.session import short_shuffles


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Only a session on a local master, where driver and executors are one machine, may leave that
    setting out; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/winnow-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table and read again.

    Later steps read the file, so a lost executor costs a read instead of all work before it, and
    each reader takes the columns it needs.
    """
    return written(df, shared_folder(df.sparkSession))


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again; its shuffle files go with the query."""
    with short_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the table that ``df`` reads, which ``saved`` or ``written`` has made and nothing reads again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(master: str | None = None, app: str = "winnow", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE and AQE skew handling.

    On a cluster leave ``master`` unset, so that spark-submit decides, and let AQE coalesce from a
    generous ``spark.sql.shuffle.partitions``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local master, where driver
    and executors share one disk, falls back to a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files behind.

    Spark keeps the shuffle files of a query until the driver happens to collect its plan. A query whose result is a table is not
    read through its shuffles again, so they can go when it ends; while it runs they serve retries as always.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame, *observed: Column) -> DataFrame:
    """``df`` as a table in the shared folder, so that iterations stay short plans and a lost executor costs a
    re-read instead of a recomputation of all rounds. Unlike a checkpoint it is computed once and read by column.

    With aggregates as ``observed`` the result is a pair of the table and their values, taken while writing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    watch = Observation() if observed else None
    out = df.observe(watch, *observed) if watch else df
    with short_shuffles(df.sparkSession):
        out.write.option("compression", "lz4").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return (back, watch.get) if watch else back

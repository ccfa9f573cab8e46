"""Columns that are costly and filtered on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    A filter on a computed column is pushed below its projection, which copies the expression and
    evaluates it again. Passing the columns through a one-row ``inline_outer`` keeps the filter
    above them; it runs inside the same stage and shuffles nothing.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline_outer(packed))


def spread(df: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """Repartition an input that is too small to give every core a split.

    CPU-heavy text work on one small file would run in one task. The size comes from the plan's
    statistics, so nothing is read; inputs with a split per core are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split_bytes else df

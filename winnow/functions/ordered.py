"""Ordered-group helpers that stay distributed when one key holds a large share of all rows.

A plain window puts a whole group into one task. Here a rank filter lets Spark prune each group on
the map side first (``WindowGroupLimit``), and row-to-row comparisons run per time slice, with only
one row per slice crossing slice borders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark keeps at most ``n`` rows per key and map task before the
    shuffle, so a hot key never reaches one task whole."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def with_previous(
    df: DataFrame,
    keys: list[str],
    at: str,
    ties: list[str],
    values: list[str],
    slice_seconds: int = 86400,
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``prev_<value>`` columns of the preceding row per key, ordered by ``at`` then ``ties``.

    Equal to ``lag`` over the whole group, but the group is cut into time slices: ``lag`` runs per
    (key, slice), and only the last row of each slice is carried to the next non-empty slice.
    """
    sl = F.floor(F.unix_timestamp(F.col(at)) / F.lit(slice_seconds)).cast("bigint")
    cut = df.withColumn("_sl", sl)
    w = W.partitionBy(*keys, "_sl").orderBy(at, *ties)
    packed = F.struct(*[F.col(v) for v in values])
    inner = cut.withColumn("_p", F.lag(packed).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    tail = (
        cut.groupBy(*keys, "_sl")
        .agg(F.max_by(packed, F.struct(at, *ties)).alias("_t"))
        .withColumn("_t", F.lag("_t").over(W.partitionBy(*keys).orderBy("_sl")))
        .filter(F.col("_t").isNotNull())
    )
    cond = [F.col(f"i.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    joined = inner.alias("i").join(
        tail.alias("t"), [*cond, F.col("i._sl") == F.col("t._sl"), F.col("i._first")], "left"
    )
    prev = F.coalesce(F.col("i._p"), F.col("t._t"))
    return joined.select(
        *[F.col(f"i.{c}") for c in df.columns],
        *[prev[v].alias(prefix + v) for v in values],
    )


def previous_by_range(df: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str = "prev_") -> DataFrame:
    """Add ``<prefix><value>`` columns of the preceding row per key, in the order of the columns ``order``.

    Equal to ``lag`` over the whole group. Rows are dealt by ranges of (keys, order), so a key is cut by the number of its
    rows, however they lie in time; ``lag`` runs per range, and one row per range and key is carried to the next range.
    """
    from winnow.session import cut_lineage

    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    packed = F.struct(*[F.col(v) for v in values])
    w = W.partitionBy("_range", *keys).orderBy(*order)
    inner = dealt.withColumn("_p", F.lag(packed).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = dealt.groupBy("_range", *keys).agg(F.max_by(packed, F.struct(*order)).alias("_t"))
    # At most one key per border between ranges has a row to carry.
    carried = last.withColumn("_t", F.lag("_t").over(W.partitionBy(*keys).orderBy("_range"))).filter(F.col("_t").isNotNull())
    cond = [F.col(f"i.{k}").eqNullSafe(F.col(f"t.{k}")) for k in ("_range", *keys)]
    joined = inner.alias("i").join(carried.alias("t"), [*cond, F.col("i._first")], "left")
    prev = F.coalesce(F.col("i._p"), F.col("t._t"))
    return joined.select(*[F.col(f"i.{c}") for c in df.columns], *[prev[v].alias(prefix + v) for v in values])


def with_next_mark(rows: DataFrame, marks: DataFrame, ties: list[str], few: int = 256) -> DataFrame:
    """Add ``_mark``: the first of ``marks`` (one column) that is not before ``_t``, or, where ``_late`` is true, the first one after it.

    Up to ``few`` marks travel with the plan as a sorted array. More of them are swept together with the rows in ranges of time;
    a range hands its first mark to the ranges before it. ``ties`` are columns that part the rows of one moment. Neither is
    multiplied by the other; null where no mark follows.
    """
    from winnow.session import cut_lineage

    mark = marks.columns[0]
    listed = [r[0] for r in marks.filter(F.col(mark).isNotNull()).distinct().limit(few + 1).collect()]
    if len(listed) <= few:
        times = F.array(*[F.lit(x) for x in sorted(listed)]).cast("array<timestamp>")
        after = F.filter(times, lambda m: F.when(F.col("_late"), m > F.col("_t")).otherwise(m >= F.col("_t")))
        return rows.withColumn("_mark", F.get(after, F.lit(0)))
    place = F.when(F.col("_late"), 2).otherwise(0)
    both = rows.withColumn("_place", place).unionByName(
        marks.filter(F.col(mark).isNotNull()).distinct().select(F.col(mark).alias("_t"), F.lit(1).alias("_place"), F.col(mark).alias("_mark")), allowMissingColumns=True
    )
    dealt = cut_lineage(both.repartitionByRange("_t", "_place", *ties).withColumn("_range", F.spark_partition_id()))
    # From the end on: a running value, which costs one step a row.
    back = W.partitionBy("_range").orderBy(F.col("_t").desc(), F.col("_place").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = dealt.withColumn("_near", F.last("_mark", ignorenulls=True).over(back)).filter("_place <> 1")
    # One row per range.
    heads = dealt.groupBy("_range").agg(F.min("_mark").alias("_head"))
    later = W.partitionBy(F.lit(0)).orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    heads = heads.withColumn("_far", F.last("_head", ignorenulls=True).over(later)).select("_range", "_far")
    return near.join(heads, "_range").select(*rows.columns, F.coalesce("_near", "_far").alias("_mark"))


def values_at_ranks(df: DataFrame, keys: list[str], value: str, **ranks: Callable[[Column], Column]) -> DataFrame:
    """Per key the number ``n`` of its non-null values and the values at given ranks, counted from 0 in ascending order.

    Each rank is a function of ``n``. Counts per distinct value are dealt by ranges of (keys, value) and summed up to each value,
    first within the ranges, then over them, so no task holds all values of a key.
    """
    from winnow.session import cut_lineage

    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    dealt = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    upto = F.sum("_c").over(W.partitionBy("_range", *keys).orderBy(value))
    sums = dealt.groupBy("_range", *keys).agg(F.sum("_c").alias("_s"))
    group = W.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("_s").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("_s").over(group))
    cond = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("_range", *keys)]
    rows = dealt.withColumn("_upto", upto).alias("d").join(sums.alias("s"), cond).select("d.*", "s.n", (F.col("s._before") + F.col("_upto")).alias("_end"))
    n = F.col("n")
    picked = [F.max(F.when((r(n) < F.col("_end")) & (r(n) >= F.col("_end") - F.col("_c")), F.col(value))).alias(name) for name, r in ranks.items()]
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *picked)


#: The two middle ranks, of which a median is the mean.
MIDDLE = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2)}


def keep_first_per_gap(
    df: DataFrame, keys: list[str], at: str, gap_seconds: int, cut=None
) -> DataFrame:
    """Greedy thinning: per key keep the first row, then the first row more than ``gap_seconds``
    after the last kept one. ``(keys, at)`` must be unique.

    The chain of kept rows is followed by pointer doubling, so a key with a long history needs
    logarithmically many joins and never one task of its own.
    """
    from winnow.session import cut_lineage

    cut = cut or cut_lineage
    gap = F.expr(f"interval {int(gap_seconds)} seconds")
    base = cut(df.select(*keys, F.col(at).alias("_at")))
    slice_no = lambda c: F.floor(F.unix_timestamp(c) / F.lit(gap_seconds)).cast("bigint")

    # The next kept row after `x` is the first row strictly later than x + gap: either in the slice
    # of x + gap, or the first row of the next non-empty slice after it.
    rows = base.select(*keys, F.col("_at").alias("_t"), F.col("_at").alias("_e"), F.lit(None).cast("timestamp").alias("_src"))
    probes = base.select(*keys, (F.col("_at") + gap).alias("_t"), F.lit(None).cast("timestamp").alias("_e"), F.col("_at").alias("_src"))
    mix = rows.unionByName(probes).withColumn("_sl", slice_no(F.col("_t")))
    # At equal time the row sorts before the probe: it is not strictly later.
    w = (
        W.partitionBy(*keys, "_sl")
        .orderBy(F.col("_t"), F.col("_src").asc_nulls_first())
        .rowsBetween(1, W.unboundedFollowing)
    )
    near = (
        mix.withColumn("_n", F.first("_e", ignorenulls=True).over(w))
        .filter(F.col("_src").isNotNull())
        .select(*keys, "_sl", F.col("_src").alias("_at"), "_n")
    )
    heads = mix.groupBy(*keys, "_sl").agg(F.min("_e").alias("_h"))
    after = heads.withColumn(
        "_far",
        F.first("_h", ignorenulls=True).over(
            W.partitionBy(*keys).orderBy("_sl").rowsBetween(1, W.unboundedFollowing)
        ),
    ).select(*keys, "_sl", "_far")
    jump = cut(
        near.join(after, [*keys, "_sl"])
        .select(*keys, "_at", F.coalesce("_n", "_far").alias("_to"))
        .filter(F.col("_to").isNotNull())
    )
    kept = base.groupBy(*keys).agg(F.min("_at").alias("_at"))
    size = -1
    while True:
        reached = kept.join(jump, [*keys, "_at"]).select(*keys, F.col("_to").alias("_at"))
        kept = cut(kept.unionByName(reached).distinct())
        n = kept.count()
        if n == size:
            break
        size = n
        jump = cut(
            jump.alias("a")
            .join(jump.alias("b"), [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], F.col("a._to") == F.col("b._at")])
            .select(*[F.col(f"a.{k}") for k in keys], F.col("a._at"), F.col("b._to").alias("_to"))
        )
    return df.join(kept.withColumnRenamed("_at", at), [*keys, at], "left_semi")

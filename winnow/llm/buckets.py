"""Linked pairs among the members of hash buckets, without all pairs of a bucket.

``bucket_links``: each bucket holds its members against one of them, its representative. What is not linked to it meets
others of its bucket in the next round, up to ``MORE`` times as many in each, until what is left of a bucket is one component; only
members of different components meet. The distance is a metric, so a
member that is linked to a representative can be linked to one that is not only if their distances to it differ by no
more than the reach of a link: those pairs, if still in different components, are compared too. Every pair
that shares a bucket is so either compared, connected through others, or impossible. ``bucket_edges`` does without a metric.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.components import connected_components
from winnow.llm.store import dropped, saved, shared_folder, written

#: Representatives of a bucket in each round: so many times more than in the round before.
MORE = 8

Compare = Callable[..., DataFrame]
#: Whether two members of a bucket can be linked, by the facts of each and the key.
May = Callable[[Column, Column, Column], Column]


def may_link(a: Column, b: Column, reach: float) -> Column:
    """Whether two sets can be within ``reach`` of each other; ``a`` and ``b`` have their ``size`` and how many elements are their ``own``, in no other set."""
    rest = lambda x: x["size"] - x["own"]
    return F.least(rest(a), rest(b)) >= (1 - reach - 1e-9) * (F.greatest(rest(a), rest(b)) + a["own"] + b["own"])


def bucket_members(bands: DataFrame, slices: int = 1) -> DataFrame:
    """(key, node, score) of the buckets with more than one member; a node's ``score`` is the number of members in all its buckets.

    The text that others were copied from shares more buckets with the copies than they share with each
    other, so the greatest score marks the member that is linked to most. The keys are dealt
    in ``slices``, one after the other.
    """
    path = shared_folder(bands.sparkSession)
    for k in range(slices):
        dealt = bands.filter(F.pmod("key", F.lit(slices)) == k).repartition("key") if slices > 1 else bands.repartition("key")
        sizes = dealt.groupBy("key").agg(F.count("node").alias("n")).filter("n > 1")  # not of "*": with the same columns both sides read one shuffle
        found = dealt.join(sizes.hint("merge"), "key")
        written(found, f"{path}/slice={k}")
    shared = bands.sparkSession.read.schema(found.schema).parquet(*[f"{path}/slice={k}" for k in range(slices)])
    scores = shared.groupBy("node").agg(F.sum("n").alias("score"))
    members = saved(shared.drop("n").join(scores, "node"))
    dropped(shared)
    return members


def first_reps(dealt: DataFrame) -> DataFrame:
    """(key, rep, rep_facts, rep_component): of each bucket the member of greatest score."""
    best = F.min(F.struct("facts.own", (-F.col("score")).alias("s"), F.col("node").alias("rep"), F.col("facts").alias("rep_facts"), F.col("component").alias("rep_component")))
    return dealt.groupBy("key").agg(best.alias("r")).select("key", "r.rep", "r.rep_facts", "r.rep_component")


def first_pairs(members: DataFrame, may: May) -> DataFrame:
    """(key, rep, node): the members of a bucket with its first representative, if they lie in different components."""
    dealt = members.repartition("key")
    apart = (F.col("node") != F.col("rep")) & (F.col("component") != F.col("rep_component"))
    return dealt.join(first_reps(dealt).hint("merge"), "key").filter(apart & may(F.col("facts"), F.col("rep_facts"), F.col("key"))).select("key", "rep", "node")


def further_reps(rest: DataFrame, n: int) -> DataFrame:
    """(key, rep, rep_component, rep_facts, place): up to ``n`` representatives of each bucket of ``rest`` that holds two components.

    These are the members outside the bucket's largest component, if they are so few, and the bucket is done with them; else those of
    fewest own elements and greatest score, which are linked to most.
    """
    sizes = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    few = F.col("all") - F.col("most.n") <= n
    taken = rest.join(most.hint("merge"), "key").filter(~few | (F.col("component") != F.col("most.component")))
    place = F.row_number().over(Window.partitionBy("key").orderBy("facts.own", F.desc("score"), "node"))
    ranked = taken.select("key", F.col("node").alias("rep"), F.col("component").alias("rep_component"), F.col("facts").alias("rep_facts"), place.alias("place"))
    return ranked.filter(F.col("place") <= n)


def further_pairs(rest: DataFrame, reps: DataFrame, may: May) -> DataFrame:
    """(key, rep, node): the members with the representatives of their bucket that lie in another component; of two representatives one order.

    Members are distinct texts and each is in many buckets, so the largest bucket is a small
    share of all rows; its rows stream past the representatives.
    """
    own = reps.select("key", F.col("rep").alias("node"), F.col("place").alias("own"))
    placed = rest.join(own.hint("merge"), ["key", "node"], "left")
    apart = (F.col("component") != F.col("rep_component")) & (F.coalesce("own", F.lit(1 << 30)) > F.col("place"))
    met = placed.join(reps.hint("merge"), "key").filter(apart & may(F.col("facts"), F.col("rep_facts"), F.col("key")))
    return met.select("key", "rep", "node")


def bucket_links(bands: DataFrame, prepare: Callable[[DataFrame], tuple[Compare, DataFrame | None, DataFrame | None]], reach: float) -> DataFrame:
    """Edges (``src``, ``dst``) with the components of all linked pairs that share a bucket of ``bands`` (key, node).

    ``prepare`` gets the nodes that share buckets and returns the comparison, which adds ``far`` and ``linked``
    to distinct (``rep``, ``node``) pairs (``odd``: they share an odd key; null if unknown, which only the last call, ``late``, has), and, if nodes are sets, (node, size, own) of them for ``may_link`` and the (src, dst) of the
    linked ones that it leaves out. Linked pairs are within ``reach`` in the metric ``far``.
    """
    spark = bands.sparkSession
    path = shared_folder(spark)
    members = bucket_members(bands)
    may = lambda a, b, _: may_link(a, b, reach)
    compare, sets, known = prepare(members.select("node").distinct())
    facts, whole = F.struct("size", "own"), F.struct(F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("own"))
    if sets is None:
        members, named = members.withColumn("facts", whole), spark.createDataFrame([], "node long, component long")
    else:
        # A set with too many elements of its own is linked with nothing else.
        sets = sets.filter(may_link(facts, F.struct((F.col("size") - F.col("own")).alias("size"), F.lit(0).alias("own")), reach))
        members = members.join(sets.select("node", facts.alias("facts")).hint("merge"), "node")
        named = saved(connected_components(known))

    def placed(rows: DataFrame) -> DataFrame:
        found = rows.join(named.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        return saved(found.select("key", "node", "score", "facts", F.coalesce("component", "node").alias("component")).repartition("key"))

    rest, number = placed(members), 0
    pairs = saved(first_pairs(rest, may))
    reps = pairs.select("key", F.col("rep").alias("node")).distinct()
    while True:
        dist = saved(compare(pairs.groupBy("rep", "node").agg(F.max(F.pmod("key", F.lit(2)) == 1).alias("odd"))))
        # One folder for all rounds keeps later plans small.
        met = pairs.join(dist, ["rep", "node"])
        written(met, f"{path}/round={number}")
        seen = spark.read.schema(met.schema).parquet(f"{path}/round={number}")
        number += 1
        edges = seen.filter("linked").select(F.col("rep").alias("src"), F.col("node").alias("dst")).distinct()
        named = saved(connected_components(edges.unionByName(named.toDF("src", "dst"))))
        # A member that is linked to a representative, or is one, has met all it has to; members of one component need not meet.
        done = seen.filter("linked").select("key", "node").unionByName(reps).distinct()
        rest = placed(rest.drop("component").join(done, ["key", "node"], "left_anti"))
        chosen = saved(further_reps(rest, MORE**number))
        if chosen.isEmpty():
            break
        pairs, reps = saved(further_pairs(rest, chosen, may)), chosen.select("key", F.col("rep").alias("node"))
    seen = spark.read.schema(met.schema).parquet(*[f"{path}/round={k}" for k in range(number)])
    y = named.select(F.col("node").alias("y"), F.col("component").alias("y_c"))
    r = named.select(F.col("node").alias("rep"), F.col("component").alias("rep_c"))
    # What a member has not met in a bucket has met all representatives it is linked to there, so the nearest one will do.
    nearest = seen.filter("linked").groupBy("key", F.col("node").alias("x")).agg(F.min(F.struct("far", "rep")).alias("r"))
    ins = nearest.select("r.rep", "x", F.col("r.far").alias("x_far")).distinct()
    outs = seen.filter(~F.col("linked") & (F.col("far") <= 2 * reach + 1e-9)).select("rep", F.col("node").alias("y"), F.col("far").alias("y_far")).distinct()
    # Only those that nothing has brought into the component of the representative.
    apart = outs.join(r, "rep").join(y, "y", "left").filter(~F.col("rep_c").eqNullSafe(F.col("y_c"))).drop("rep_c", "y_c")
    possible = F.abs(F.col("x_far") - F.col("y_far")) <= reach + 1e-9
    if sets is not None:
        of = lambda s: sets.select(F.col("node").alias(s), facts.alias(f"{s}_facts")).hint("merge")
        apart, ins = apart.join(of("y"), "y"), ins.join(of("x"), "x")
        possible &= may_link(F.col("x_facts"), F.col("y_facts"), reach)
    close = apart.join(ins, "rep").filter(possible)
    more = close.select(F.col("x").alias("rep"), F.col("y").alias("node")).distinct()
    late = saved(compare(more.withColumn("odd", F.lit(None).cast("boolean")), late=True).filter("linked").select(F.col("rep").alias("src"), F.col("node").alias("dst")))
    return named.toDF("src", "dst").unionByName(late)


def bucket_edges(members: DataFrame, may: May, compare: Compare) -> DataFrame:
    """Edges (``src``, ``dst``) with the components of all linked pairs that share a bucket of ``members`` (key, node, score, facts).

    For comparisons whose distances say nothing about third members. ``compare`` gets distinct pairs (``rep``, ``node``), ``rep`` the smaller, for
    which ``may`` holds, and returns the linked ones. A representative leaves its bucket when it has met all members of other components there,
    and a bucket is done when what is left of it is one component; so each pair that shares a bucket is compared, connected through others or impossible.
    No pair is compared twice. The table of ``members`` goes when it has been read.
    """
    spark = members.sparkSession
    path = shared_folder(spark)

    def open_buckets(rows: DataFrame) -> DataFrame:
        """``rows`` of the buckets that hold two components."""
        key = Window.partitionBy("key")
        ends = rows.withColumns({"low": F.min("component").over(key), "high": F.max("component").over(key)})
        return saved(ends.filter("low < high").drop("low", "high"))

    rest, named, number = members.withColumn("component", F.col("node")), spark.createDataFrame([], "node long, component long"), 0
    while not rest.isEmpty():
        if number:
            chosen = saved(further_reps(rest, MORE**number))
            pairs, reps = further_pairs(rest, chosen, may), chosen
        else:
            pairs, reps = first_pairs(rest, may), first_reps(rest.repartition("key"))
        new = pairs.select(F.least("rep", "node").alias("rep"), F.greatest("rep", "node").alias("node")).distinct()
        if number:
            met = spark.read.schema(new.schema).parquet(*[f"{path}/round={k}" for k in range(number)])
            new = new.join(met.hint("merge"), ["rep", "node"], "left_anti")
        edges = compare(written(new, f"{path}/round={number}")).select(F.col("rep").alias("src"), F.col("node").alias("dst"))
        number += 1
        named = saved(connected_components(edges.unionByName(named.toDF("src", "dst"))))
        before, left = rest, rest.drop("component").join(reps.select("key", F.col("rep").alias("node")).hint("merge"), ["key", "node"], "left_anti")
        found = left.join(named.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left")
        rest = open_buckets(found.select("key", "node", "score", "facts", F.coalesce("component", "node").alias("component")))
        dropped(before)
    return named.toDF("src", "dst")

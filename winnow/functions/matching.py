"""First come, first served over two keys, decided in parallel.

Rows arrive in a total order. A row is accepted if no accepted row before it has its first key or its second key. Let ``p`` say
that the first key is taken before the row, and ``q`` the same of the second key. After it they are

    first key taken:  p or not q        second key taken:  q or not p

so a row is a gate with two inputs, each the output of the row before it with the same key, or "not taken". As soon as one
input is known, or both come from one place, both outputs are known, or equal to an input, or to its opposite. Rounds replace
inputs by what they are equal to, which doubles the reach each time (pointer jumping with parity): a chain of n conflicts
takes about log2(n) rounds. A gate with two open inputs waits for one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.ordered import previous_by_range
from winnow.session import cut_lineage


def _certain(rows: DataFrame, first: list[str], second: list[str], order: list[str]) -> DataFrame:
    """``rows`` without those that are rejected whatever else happens.

    After a row that comes first in one of its keys, the other key is taken: by the row or by one before it. What follows
    there is rejected. This cuts long groups short with nothing but minima, which combine before the shuffle.
    """
    at = F.struct(*order)
    heads = rows.groupBy(*first).agg(F.min(at).alias("_a"))
    tails = rows.groupBy(*second).agg(F.min(at).alias("_b"))
    both = cut_lineage(rows.join(heads, first).join(tails, second))
    until_b = both.filter(at == F.col("_a")).groupBy(*second).agg(F.min(at).alias("_cut_b"))
    until_a = both.filter(at == F.col("_b")).groupBy(*first).agg(F.min(at).alias("_cut_a"))
    cut = both.join(until_a, first, "left").join(until_b, second, "left")
    open_a = F.col("_cut_a").isNull() | (at <= F.col("_cut_a"))
    open_b = F.col("_cut_b").isNull() | (at <= F.col("_cut_b"))
    return cut.filter(open_a & open_b).select(*rows.columns)


def _outputs() -> tuple[tuple[Column, Column, Column], tuple[Column, Column, Column]]:
    """For both outputs of a gate: is it known, the place it equals (null for none), and the value or the opposite sign."""
    p, q, np, nq = F.col("p"), F.col("q"), F.col("np"), F.col("nq")
    yes = (F.lit(None).cast("bigint"), F.lit(True))

    def output(own: tuple[Column, Column], other: tuple[Column, Column]) -> tuple[Column, Column, Column]:
        (a, na), (b, nb) = own, other  # the output is: a or not b
        ways = [
            (a.isNull() & na, yes), (b.isNull() & ~nb, yes),
            (a.isNull(), (b, ~nb)), (b.isNull(), (a, na)),
            ((a == b) & (na == nb), yes), ((a == b) & (na != nb), (a, na)),
        ]
        known = reduce(lambda x, y: x | y, [F.coalesce(c, F.lit(False)) for c, _ in ways])
        place, sign = (reduce(lambda rest, w: F.when(w[0], w[1][k]).otherwise(rest), reversed(ways), F.lit(None)) for k in (0, 1))
        return known, place, sign

    return output((p, np), (q, nq)), output((q, nq), (p, np))


def first_come(rows: DataFrame, first: list[str], second: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """The accepted rows, and the number of rounds it took. ``order`` must tell rows of one key apart; no key or order is null."""
    kept = cut_lineage(_certain(rows, first, second, order).withColumn("_id", F.monotonically_increasing_id()))
    a = previous_by_range(kept, first, order, ["_id"], "_a")
    gates = previous_by_range(a, second, order, ["_id"], "_b")
    # Places: twice the number of a row for its first key, one more for its second key.
    gates = gates.select(
        "_id", (F.col("_a_id") * 2).alias("p"), F.lit(False).alias("np"), (F.col("_b_id") * 2 + 1).alias("q"), F.lit(False).alias("nq")
    )
    is_open = F.count_if(F.col("p").isNotNull() | F.col("q").isNotNull()).alias("open")
    gates, seen = cut_lineage(gates, is_open)
    rounds = 0
    (know_a, place_a, sign_a), (know_b, place_b, sign_b) = _outputs()
    # Rows that are decided stay: others may come to refer to them.
    while seen["open"]:
        rounds += 1
        known = gates.select(
            F.inline(F.array(
                F.struct((F.col("_id") * 2).alias("v"), place_a.alias("to"), sign_a.alias("sign"), know_a.alias("known")),
                F.struct((F.col("_id") * 2 + 1).alias("v"), place_b.alias("to"), sign_b.alias("sign"), know_b.alias("known")),
            ))
        ).filter("known")
        x = known.select(F.col("v").alias("p"), F.col("to").alias("_p"), F.col("sign").alias("_np"))
        y = known.select(F.col("v").alias("q"), F.col("to").alias("_q"), F.col("sign").alias("_nq"))
        step = gates.join(x, "p", "left").join(y, "q", "left")
        step = step.select(
            "_id",
            F.when(F.col("_np").isNull(), F.col("p")).otherwise(F.col("_p")).alias("p"), (F.col("np") != F.coalesce("_np", F.lit(False))).alias("np"),
            F.when(F.col("_nq").isNull(), F.col("q")).otherwise(F.col("_q")).alias("q"), (F.col("nq") != F.coalesce("_nq", F.lit(False))).alias("nq"),
        )
        gates, seen = cut_lineage(step, is_open)
    return kept.join(gates.filter("NOT np AND NOT nq").select("_id"), "_id", "left_semi").drop("_id"), rounds

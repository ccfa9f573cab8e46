"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component as its name.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round only takes
    minima per node, which combine on the map side, and joins them back, which AQE splits for hot
    nodes. Rounds grow with the logarithm of the graph; each ends in the checkpoint folder.
    """
    marks = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x"))

    def downward(pairs: DataFrame) -> DataFrame:
        links = pairs.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        return links.distinct()

    e, now = cut_lineage(downward(edges), *marks)
    mark = None
    while mark != now:
        mark = now
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = (
            both.join(low, "src").filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .filter(F.col("src") != F.col("dst")).distinct()
        )
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(
            least.select("src", F.col("m").alias("dst"))
        )
        e, now = cut_lineage(downward(small), *marks)
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )

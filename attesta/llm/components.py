"""Connected components as alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the smallest id of its component for every id that has a link to another id.

    Each round links larger neighbours to the least one on both sides of every edge; minima are combined before
    they are shuffled and hot hubs are left to the split of skewed joins. Rounds grow with the logarithm of the
    longest chain and there is no limit on them: the loop ends when a round changes nothing.
    Nulls, self links and repeated links have no effect; an empty table gives an empty one.
    """
    x, y = F.col(a), F.col(b)
    pairs = cut(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    )
    before = None
    while True:
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())

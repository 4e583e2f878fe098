"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from frameops.llm.store import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """The smallest reachable id of every linked id: columns ``id``, ``component``.

    ``links`` has two id columns ``a`` and ``b``; self-links and nulls are ignored, and no links give no rows.
    Every round hangs each id's larger neighbours under its smallest one, then each id and its
    smaller neighbours under the smallest. The links turn into stars in a number of rounds that grows
    with the logarithm of the longest path. A hub of any degree only meets a minimum, which is
    combined before the shuffle, and a join that adaptive execution may split.
    """
    current = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()
    )
    before = None
    while True:
        both = current.select(F.col("big").alias("id"), F.col("small").alias("near")).union(
            current.select(F.col("small").alias("id"), F.col("big").alias("near")))
        lowest = both.groupBy("id").agg(F.least(F.min("near"), F.col("id")).alias("low"))
        # larger neighbours go under the smallest neighbour, the id itself included
        large = current.join(lowest, current.small == lowest.id).select("big", F.col("low").alias("small"))
        large = stored(large.distinct())
        lowest = large.groupBy("big").agg(F.min("small").alias("low"))
        # the id and its smaller neighbours go under the smallest of them
        small = large.join(lowest, "big").select(
            F.explode(F.array(
                F.struct(F.col("big"), F.col("low").alias("small")), F.struct(F.col("small").alias("big"), F.col("low").alias("small"))
            )).alias("e")).select("e.big", "e.small").filter("big <> small").distinct()
        following = stored(small)
        state = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("big", "small") % 1_000_000_007)).first()
        dropped(current)
        dropped(large)
        current = following
        if tuple(state) == before:
            return current.select(F.col("big").alias("id"), F.col("small").alias("component")).union(
                current.select(F.col("small").alias("id"), F.col("small").alias("component"))).distinct()
        before = tuple(state)

"""Connected components of an edge table, by hooking to the smallest neighbour and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, comp`` for every id in ``edges``: ``comp`` is the smallest id that can be reached.

    Each round takes the smallest label among a node and its neighbours, then that label's own label; labels are
    written to a shared table after each round, so that a lost executor costs one round at most. The rounds grow
    with the logarithm of the longest path, and only counts come to the driver.
    """
    both = saved(edges.select(F.col(a).alias("id"), F.col(b).alias("near")).union(edges.select(F.col(b), F.col(a))).where("id <> near").distinct(), "edges")
    labels = saved(both.groupBy("id").agg(F.least(F.col("id"), F.min("near")).alias("comp")), "labels")
    while True:
        label = labels.select(F.col("id").alias("near"), F.col("comp").alias("near_comp"))
        hooked = both.join(label, "near").groupBy("id").agg(F.min("near_comp").alias("least")).join(labels, "id")
        hooked = hooked.select("id", "comp", F.least("least", "comp").alias("next"))
        own = labels.select(F.col("id").alias("next"), F.col("comp").alias("next_comp"))
        moved = saved(hooked.join(own, "next", "left").select("id", F.least("next", F.coalesce("next_comp", "next")).alias("comp"), F.col("comp").alias("was")), "labels")
        labels = moved.select("id", "comp")
        if not moved.where("comp <> was").limit(1).count():
            return labels

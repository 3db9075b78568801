"""Choice of the node that takes a batch of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routed(batches: DataFrame, hits: DataFrame, usage: DataFrame, batch: str, node: str, n: str, used: str) -> DataFrame:
    """For each of ``batches`` the node with the best score: its hits, reduced by mean usage / usage where it is fuller than the mean (a whole number).

    hits: batch, node, n (summed here; from any number of filters); hits on nodes without usage do not count. usage: node, used; a table of
    nodes, of which the mean is one row. A batch without any hit goes to the node whose rank among nodes the batch's hash names, with a null
    score. Of equals the smallest node. Without nodes all have a null one. Null batches are left out.
    """
    total = hits.groupBy(batch, node).agg(F.sum(n).alias("__h")).where("__h > 0")
    mean = usage.agg(F.floor(F.avg(used)).alias("mean"), F.array_sort(F.collect_set(node)).alias("nodes"))
    scored = total.join(usage.select(node, used), node).crossJoin(F.broadcast(mean.select("mean")))
    score = F.when(F.col(used) > F.col("mean"), F.col("__h") * F.col("mean") / F.col(used)).otherwise(F.col("__h").cast("double"))
    best = scored.groupBy(batch).agg(F.min_by(F.struct(node, score.alias("score")), F.struct(-score, F.col(node))).alias("__b"))
    every = batches.where(F.col(batch).isNotNull()).select(batch).distinct().join(best, batch, "left").crossJoin(F.broadcast(mean.select("nodes")))
    rank = F.pmod(F.conv(F.substring(F.md5(F.col(batch).cast("string").cast("binary")), 1, 4), 16, 10).cast("bigint"), F.greatest(F.size("nodes"), F.lit(1)).cast("bigint"))
    spare = F.get("nodes", rank.cast("int"))
    return every.select(batch, F.when(F.col("__b.score") > 0, F.col(f"__b.{node}")).otherwise(spare).alias(node), F.round("__b.score", 6).alias("score"))

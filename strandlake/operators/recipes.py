"""Reading files back from their chunk maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlapping(requests: DataFrame, recipes: DataFrame, key: str, offset: str, size: str, start: str, length: str, cell: int = 65_536) -> DataFrame:
    """Each request with each chunk of its file that it overlaps, and the part to take: from_byte (in the chunk) and take.

    A range join as an equi-join: both sides are spread over cells of ``cell`` bytes of the file, so a large file is many keys and no
    request meets all its chunks; a pair is kept in the first cell that it shares. Empty requests and chunks overlap nothing.
    """
    cells = lambda at, n: F.explode(F.sequence(F.expr(f"{at} div {cell}"), F.expr(f"({at} + {n} - 1) div {cell}")))
    q = requests.where(F.col(length) > 0).withColumn("__cell", cells(start, length))
    r = recipes.where(F.col(size) > 0).withColumn("__cell", cells(offset, size))
    j = q.join(r, [key, "__cell"]).where((F.col(offset) + F.col(size) > F.col(start)) & (F.col(offset) < F.col(start) + F.col(length)))
    j = j.where(F.col("__cell") == F.expr(f"greatest({start}, {offset}) div {cell}")).drop("__cell")
    lo, hi = F.greatest(F.col(start), F.col(offset)), F.least(F.col(start) + F.col(length), F.col(offset) + F.col(size))
    return j.withColumns({"from_byte": (lo - F.col(offset)).cast("int"), "take": (hi - lo).cast("int")})


def node_runs(recipes: DataFrame, key: str, order: str, node: str) -> DataFrame:
    """Runs of neighbouring chunks of a file on one node: key, run_no, node, chunks, from and to offset."""
    by = W.partitionBy(key).orderBy(order)
    step = F.when(F.col(node).eqNullSafe(F.lag(node).over(by)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    runs = recipes.withColumn("run_no", F.sum(step).over(by))
    return runs.groupBy(key, "run_no").agg(F.first(node).alias(node), F.count(F.lit(1)).alias("chunks"), F.min(order).alias("first_offset"), F.max(order).alias("last_offset")).withColumn("run_no", F.col("run_no").cast("int"))


def zip_positions(positions: DataFrame, shas: DataFrame, key: str) -> DataFrame:
    """key, ord, position, sha: two arrays of a key joined by place; the shorter one is filled up with nulls."""
    j = positions.join(shas, key, "full")
    each = j.select(key, F.posexplode(F.arrays_zip(F.coalesce("positions", F.array()).alias("position"), F.coalesce("shas", F.array()).alias("sha"))).alias("ord", "x"))
    return each.select(key, "ord", F.col("x.position").alias("position"), F.col("x.sha").alias("sha"))


def reassembled(pieces: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """key and the column ``data``: each object's pieces (binary) put together in order. An object is one value here, so one task holds an object at a time."""
    hexed = F.transform(F.array_sort(F.collect_list(F.struct(order, F.hex(data).alias("h")))), lambda x: x["h"])
    return pieces.groupBy(key).agg(F.unhex(F.array_join(hexed, "")).alias(data))

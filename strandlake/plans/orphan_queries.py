"""Problem 1: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.fingerprints import cid_given, cid_part
from strandlake.operators.orphans import find_orphans, orphans_by_period
from strandlake.plans.tables import table

GRACE_SECONDS = 3600


def _orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    """src_table, row_id, at: each orphan row once."""
    index = table(spark, folder, "fp_index").where((F.col("container_id") != 0) & (F.col("ref_count") > 0))
    index = index.select(F.col("entry_id").alias("row_id"), "container_id", F.col("indexed_at").alias("at"))
    containers = table(spark, folder, "containers")
    lost = find_orphans(index, containers, ["container_id"], ["container_id"], "simple", "at", "created_at", F.col("deleted_at").isNull(), GRACE_SECONDS)

    recipes = table(spark, folder, "recipes").where(cid_given("inode_cid"))
    parts = lambda c: (cid_part(c, 1).alias("inode"), cid_part(c, 2).alias("client"))
    recipes = recipes.select(F.col("recipe_id").alias("row_id"), *parts("inode_cid"), F.col("mapped_at").alias("at"))
    files = table(spark, folder, "files").select(*parts("inode_cid"), "registered_at", "deleted_at")
    # an id in which no number can be read is still a reference; as an empty inode it meets nothing and is no all-null reference
    recipes = recipes.withColumn("inode", F.when(F.col("inode").isNull() & F.col("client").isNull(), F.lit("")).otherwise(F.col("inode")))
    unmet = find_orphans(recipes, files, ["inode", "client"], ["inode", "client"], "full", "at", "registered_at", F.col("deleted_at").isNull(), GRACE_SECONDS)

    pick = lambda df, name: df.select(F.lit(name).alias("src_table"), "row_id", "at")
    return pick(lost, "fp_index").unionByName(pick(unmet, "recipes")).dropDuplicates(["src_table", "row_id"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphan_rows(spark, folder).select("src_table", "row_id")


def p1_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphans_by_period(_orphan_rows(spark, folder), "src_table", "at", "month")


_CID = r"""regexp_extract(inode_cid, '^[\s\x00]*0*([0-9]+)_0*([0-9]+)[\s\x00]*$', 1) || '_' || regexp_extract(inode_cid, '^[\s\x00]*0*([0-9]+)_0*([0-9]+)[\s\x00]*$', 2)"""
_ORPHANS = f"""
    with f as (select {_CID} as cid, min(registered_at) as since from files where deleted_at is null group by 1),
         c as (select container_id, min(created_at) as since from containers where deleted_at is null group by 1),
         o as (select distinct 'fp_index' as src_table, entry_id as row_id, indexed_at as since_at
               from fp_index i left join c using (container_id)
               where container_id <> 0 and ref_count > 0 and not coalesce(c.since <= indexed_at + interval 1 hour, false)
               union all
               select distinct 'recipes', recipe_id, mapped_at as since_at
               from (select recipe_id, mapped_at, {_CID} as cid from recipes where regexp_replace(inode_cid, '[\\s\\x00]', '', 'g') <> '') r left join f using (cid)
               where not coalesce(f.since <= mapped_at + interval 1 hour and cid <> '_', false))"""

QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month}
SQL = {
    "p1_found": f"{_ORPHANS} select src_table, row_id from o",
    "p1_by_month": f"{_ORPHANS} select src_table, date_trunc('month', since_at) as period_start, count(*) as orphans from o group by 1, 2",
}

"""Access to the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: DuckDB: the fingerprint of column sha as 40 lower-case hex digits, '' for none.
FP_SQL = r"lower(regexp_extract(sha, '^[ \t]*(?:0[xX])?([0-9a-fA-F]{40})[ \t]*$', 1))"

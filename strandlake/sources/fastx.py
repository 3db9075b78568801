"""FASTQ and FASTA text as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUPER_BLOCK = 16_384
BLOCK = 32


def lines_of(blocks: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, line_no (from 0), line of each text, carriage returns at line ends dropped; the empty piece after a last newline is no line."""
    body = F.regexp_replace(F.col(text), r"\n\z", "")
    each = blocks.where(F.col(text).isNotNull()).select(*key, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    return each.withColumn("line", F.regexp_replace("line", r"\r+$", ""))


def fastq_records(blocks: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, rec_no, title, seq, plus, qual of the four-line records of each block; a block cut off in a record gives nulls for what is missing."""
    k = F.col("line_no") % 4
    pick = lambda i, n: F.max(F.when(k == i, F.col("line"))).alias(n)
    lines = lines_of(blocks, key, text)
    return lines.groupBy(*key, F.expr("line_no div 4").alias("rec_no")).agg(pick(0, "title"), pick(1, "seq"), pick(2, "plus"), pick(3, "qual"))


def valid_record(title: Column, seq: Column, qual: Column) -> Column:
    """Title begins with @, sequence is not empty, and the quality is as long as it. Nulls are not valid."""
    return F.coalesce(title.startswith("@") & (F.length(seq) > 0) & (F.length(seq) == F.length(qual)), F.lit(False))


def until_first_error(records: DataFrame, key: list[str]) -> DataFrame:
    """The records of each block before its first that is not valid: a scan stops there."""
    bad = F.min(F.when(~valid_record(F.col("title"), F.col("seq"), F.col("qual")), F.col("rec_no")))
    stop = records.groupBy(*key).agg(bad.alias("__stop"))
    return records.join(stop, key).where(F.col("__stop").isNull() | (F.col("rec_no") < F.col("__stop"))).drop("__stop")


def fastq_text(title: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """The four lines of a record, each ended by a newline."""
    return F.concat(F.concat_ws("\n", title, seq, plus, qual), F.lit("\n"))


def fasta_sequences(blocks: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, seq_no, header, seq of each FASTA record: lines after a header, joined. Lines before the first header have seq_no 0 and no header."""
    lines = lines_of(blocks, key, text).withColumn("head", F.col("line").startswith(">"))
    no = lines.withColumn("seq_no", F.sum(F.col("head").cast("int")).over(W.partitionBy(*key).orderBy("line_no")).cast("int"))
    rows = no.groupBy(*key, "seq_no").agg(
        F.max(F.when(F.col("head"), F.expr("substring(line, 2)"))).alias("header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: x["line"]), "").alias("seq"),
    )
    return rows


def reference_fragments(sequences: DataFrame, order: list[str], seq: str, size: int = 1_000_000) -> DataFrame:
    """ref_seq_no, bases, len: sequences without N, cut into fragments of ``size``; each sequence starts its own fragments, numbered in order."""
    bare = sequences.withColumn("__s", F.regexp_replace(F.upper(seq), "[^ACGT]", "")).where(F.length("__s") > 0)
    cut = bare.select(*order, "__s", F.explode(F.sequence(F.lit(0), F.expr(f"(length(__s) - 1) div {size}"))).alias("part"))
    rows = cut.select(*order, "part", F.expr(f"substring(__s, part * {size} + 1, {size})").alias("bases"))
    # numbers by a count per leading key, so that no task sorts all rows
    lead = order[0]
    per = rows.groupBy(lead).agg(F.count(F.lit(1)).alias("n"))
    before = per.select(lead, (F.sum("n").over(W.orderBy(lead)) - F.col("n")).alias("before"))
    mine = F.row_number().over(W.partitionBy(lead).orderBy(*order[1:], "part"))
    return rows.withColumn("mine", mine).join(before, lead).select((F.col("before") + F.col("mine") - 1).cast("int").alias("ref_seq_no"), "bases", F.length("bases").alias("len"))


def wrapped(seq: Column, width: int = 60) -> Column:
    """A sequence in lines of ``width`` letters."""
    return F.regexp_replace(seq, rf"(.{{{width}}})(?=.)", "$1\n")



"""Statistics of reads that choose encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.formatting import bit_length
from strandlake.sources.fastx import BLOCK, SUPER_BLOCK

SEPARATORS = r"[ ._,=:/\-]"


def _letters(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, pos (from 0), c: one row a letter."""
    return df.where(F.length(text) > 0).select(*keep, F.posexplode(F.split(text, "")).alias("pos", "c")).where("c <> ''")


def base_histogram(reads: DataFrame, seq: str) -> DataFrame:
    """sym, n, code: letters, counts, and each letter's rank among those that occur."""
    n = _letters(reads, seq).groupBy(F.col("c").alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("code", (F.dense_rank().over(W.orderBy("sym")) - 1).cast("int"))  # at most one row a letter


def quality_by_position(reads: DataFrame, qual: str, truncated: bool = False) -> DataFrame:
    """pos, q, n: counts by place, and over all places where pos is null; in one pass by grouping sets. truncated: without trailing #."""
    rows = _letters(reads.withColumn(qual, F.left(qual, kept_length(F.col(qual)))) if truncated else reads, qual)
    by = rows.groupBy("pos", "c").agg(F.count(F.lit(1)).alias("n"))
    return by.groupingSets([["pos", "c"], ["c"]], "pos", "c").agg(F.sum("n").alias("n")).select("pos", F.col("c").alias("q"), "n")


def quality_transitions(reads: DataFrame, qual: str) -> DataFrame:
    """prev, q, n: how often one letter follows another inside a record."""
    pairs = reads.where(F.length(qual) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(qual) - 1), lambda i: F.substring(F.col(qual), i, F.lit(2)))).alias("p"))
    n = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.substring("p", 1, 1).alias("prev"), F.substring("p", 2, 1).alias("q"), "n")


def quality_runs(reads: DataFrame, rec: str, qual: str, longest: int = 255) -> DataFrame:
    """block, run_no, q, run: runs of equal letters in each block of 32 records, across records, none longer than ``longest``."""
    rows = _letters(reads.withColumn("block", F.expr(f"{rec} div {BLOCK}")), qual, "block", rec)
    by = W.partitionBy("block").orderBy(rec, "pos")
    new = F.coalesce(F.col("c") != F.lag("c").over(by), F.lit(True)).cast("int")
    runs = rows.withColumn("new", new).withColumn("r", F.sum("new").over(by))
    size = runs.groupBy("block", "r").agg(F.first("c").alias("q"), F.count(F.lit(1)).alias("n"))
    cut = size.select("block", "r", "q", "n", F.posexplode(F.sequence(F.lit(0), F.expr(f"int((n - 1) div {longest})"))).alias("k", "_"))
    out = cut.select("block", "r", "k", "q", F.least(F.lit(longest), F.col("n") - F.col("k") * longest).cast("int").alias("run"))
    return out.select("block", (F.row_number().over(W.partitionBy("block").orderBy("r", "k")) - 1).cast("int").alias("run_no"), "q", "run")


def run_histogram(runs: DataFrame) -> DataFrame:
    """q, run, n: how many runs of each letter and length there are."""
    return runs.groupBy("q", "run").agg(F.count(F.lit(1)).alias("n"))


def unrun(runs: DataFrame) -> DataFrame:
    """block, letters: the qualities of a block from its runs."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", F.expr("repeat(q, run)").alias("t")))), lambda x: x["t"]), "")
    return runs.groupBy("block").agg(text.alias("letters"))


def kept_length(qual: Column) -> Column:
    """Length without trailing #, 1 at least."""
    return F.greatest(F.length(F.regexp_replace(qual, "#+$", "")), F.lit(1))


def encoder_choice(reads: DataFrame, rec: str, qual: str) -> DataFrame:
    """sb_id, raw_len, th_len, rle_len, method of each super-block, from the first record of each block: 2 run lengths, 1 plain, 3 plain without trailing #."""
    block = F.expr(f"{rec} div {BLOCK}")
    first = reads.where(F.length(qual) > 0).groupBy(F.expr(f"{rec} div {SUPER_BLOCK}").alias("sb_id"), block.alias("b")).agg(F.min_by(qual, rec).alias("q"))
    raw, th = F.length("q"), F.greatest(F.length(F.regexp_replace("q", "#+$", "")) - 1, F.lit(0))
    rle = F.length(F.regexp_replace("q", r"(.)\1*", "x")) - F.when(F.col("q").endswith("#"), 1).otherwise(0)
    s = first.groupBy("sb_id").agg(F.sum(raw).alias("raw_len"), F.sum(th).alias("th_len"), F.sum(rle).alias("rle_len"), F.count(F.lit(1)).alias("blocks"))
    method = F.when(F.col("th_len") > 1.25 * F.col("rle_len"), 2).when(F.col("raw_len") - F.col("th_len") < 3 * F.col("blocks"), 1).otherwise(3)
    return s.select("sb_id", "raw_len", "th_len", "rle_len", method.cast("int").alias("method"))


def title_fields(reads: DataFrame, rec: str, title: str) -> DataFrame:
    """sb_id, rec, field_no, value: the pieces of each title between separators."""
    return reads.where(F.col(title).isNotNull()).select(F.expr(f"{rec} div {SUPER_BLOCK}").alias("sb_id"), rec, F.posexplode(F.split(title, SEPARATORS)).alias("field_no", "value"))


def title_profile(reads: DataFrame, rec: str, title: str) -> DataFrame:
    """Per super-block and title field: lengths, whether it is constant or numeric, its range, the range of differences to the record before, and the bits
    of the cheaper of both codings. Fields with over 18 digits or other signs are not numeric; an empty field counts as numeric without a value."""
    f = title_fields(reads, rec, title)
    number = F.when(F.col("value").rlike("^[0-9]{1,18}$"), F.col("value").cast("bigint"))
    f = f.withColumn("v", number)
    f = f.withColumn("d", F.col("v") - F.lag("v").over(W.partitionBy("sb_id", "field_no").orderBy(rec)))
    s = f.groupBy("sb_id", "field_no").agg(
        F.min(F.length("value")).alias("min_len"), F.max(F.length("value")).alias("max_len"), (F.min("value") == F.max("value")).alias("is_constant"),
        F.bool_and(F.col("value").rlike("^[0-9]{0,18}$")).alias("is_numeric"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.min("d").alias("min_delta"), F.max("d").alias("max_delta"),
    )
    bits = F.least(bit_length(F.col("max_value") - F.col("min_value")), bit_length(F.col("max_delta") - F.col("min_delta")))
    return s.withColumn("bits", F.when(F.col("is_numeric"), bits))


#: Values of a field, or differences, up to which their histogram is kept.
VALUES = 512


def _numbered(reads: DataFrame, rec: str, title: str) -> DataFrame:
    f = title_fields(reads, rec, title).withColumn("v", F.when(F.col("value").rlike("^[0-9]{1,18}$"), F.col("value").cast("bigint")))
    return f.withColumn("d", F.col("v") - F.lag("v").over(W.partitionBy("sb_id", "field_no").orderBy(rec)))


def title_values(reads: DataFrame, rec: str, title: str) -> DataFrame:
    """sb_id, field_no, what (value or delta), v, n: histograms of numeric title fields and of their differences to the record before, where these have VALUES different ones at most."""
    f = _numbered(reads, rec, title)
    kinds = F.array(F.struct(F.lit("value").alias("what"), F.col("v").alias("v")), F.struct(F.lit("delta").alias("what"), F.col("d").alias("v")))
    n = f.select("sb_id", "field_no", F.explode(kinds).alias("x")).where("x.v is not null").groupBy("sb_id", "field_no", "x.what", "x.v").agg(F.count(F.lit(1)).alias("n"))
    few = n.groupBy("sb_id", "field_no", "what").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= VALUES)
    return n.join(few.drop("k"), ["sb_id", "field_no", "what"], "left_semi")


def title_letters(reads: DataFrame, rec: str, title: str) -> DataFrame:
    """sb_id, field_no, pos, c, n, is_fixed: letters by place in each title field, and whether the place has the same letter in all of the super-block's records that have it."""
    n = _letters(title_fields(reads, rec, title), "value", "sb_id", "field_no").groupBy("sb_id", "field_no", "pos", "c").agg(F.count(F.lit(1)).alias("n"))
    # at most a row a letter: the window is over a few
    return n.withColumn("is_fixed", F.count(F.lit(1)).over(W.partitionBy("sb_id", "field_no", "pos")) == 1)


def title_blocks(reads: DataFrame, rec: str, title: str) -> DataFrame:
    """block, field_no, first_value, is_constant, delta, is_constant_delta of each block of 32 records: whether a field has the first record's value throughout, and whether its differences (delta: the smallest) are all the same."""
    f = title_fields(reads, rec, title).withColumns({"block": F.expr(f"{rec} div {BLOCK}"), "v": F.when(F.col("value").rlike("^[0-9]{1,18}$"), F.col("value").cast("bigint"))})
    f = f.withColumn("d", F.col("v") - F.lag("v").over(W.partitionBy("block", "field_no").orderBy(rec)))
    s = f.groupBy("block", "field_no").agg(F.min_by("value", rec).alias("first_value"), (F.min("value") == F.max("value")).alias("is_constant"), F.min("d").alias("delta"), F.max("d").alias("__most"), (F.count("d") == F.count(F.lit(1)) - 1).alias("__all"))
    return s.select("block", "field_no", "first_value", "is_constant", "delta", F.coalesce(F.col("__all") & (F.col("delta") == F.col("__most")), F.lit(False)).alias("is_constant_delta"))


def quality_gap(reads: DataFrame, rec: str, qual: str) -> DataFrame:
    """block, rec, pos, gap: difference to the letter before in the block (the first to 33), zig-zag coded from 1."""
    rows = _letters(reads.withColumn("block", F.expr(f"{rec} div {BLOCK}")), qual, "block", rec)
    d = F.ascii("c") - F.coalesce(F.lag(F.ascii("c")).over(W.partitionBy("block").orderBy(rec, "pos")), F.lit(33))
    return rows.select("block", rec, "pos", d.alias("d")).select("block", rec, "pos", (F.when(F.col("d") > 0, 2 * F.col("d") - 1).otherwise(-2 * F.col("d")) + 1).cast("int").alias("gap"))


def read_shape(reads: DataFrame, rec: str) -> DataFrame:
    """Per super-block: quality length range, whether plus lines are bare, whether it is colour space, and whether first letters are all the same."""
    return reads.groupBy(F.expr(f"{rec} div {SUPER_BLOCK}").alias("sb_id")).agg(
        F.min(F.length("qual")).alias("min_qual"), F.max(F.length("qual")).alias("max_qual"), F.bool_and(F.length("plus") == 1).alias("plus_bare"),
        F.bool_or(F.substring("seq", 2, 1).isin("0", "1", "2", "3")).alias("colour_space"), (F.count_distinct(F.substring("seq", 1, 1)) == 1).alias("same_first"),
    )

"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Marks the newline before a record; above every byte's value, so it cannot stand in a payload read byte by byte.
MARK = "ā"


def marked(payload: Column, filetype: Column) -> Column:
    """The payload, a character for each byte, with MARK for each newline after which a record starts (FASTA 100, FASTQ 200)."""
    by_byte = F.decode(F.encode(payload, "UTF-8"), "ISO-8859-1")
    fasta = F.regexp_replace(by_byte, r"\n(?=>)", MARK)
    fastq = F.regexp_replace(by_byte, r"((?:[^\n]*\n){3}[^\n]*)\n", "$1" + MARK)
    return F.when(filetype == 100, fasta).when(filetype == 200, fastq).otherwise(by_byte)


def cut_pattern(limit: int, overlap: int) -> str:
    """A pattern whose matches from the start are what each piece adds to the one before.

    A piece that starts at s ends at e with s + overlap < e <= s + limit and the next one starts at e - overlap; so the first adds overlap + 1
    to limit bytes and each further one 1 to limit - overlap. Alternatives in order: the rest if it fits, the last record start in
    reach, the last line start in reach, the limit.
    """
    a, step = ".", limit - overlap
    first = rf"\A(?:{a}{{1,{limit}}}+\z|{a}{{{overlap},{limit - 1}}}{MARK}|{a}{{{overlap},{limit - 1}}}\n|{a}{{{limit}}})"
    later = rf"(?!\A)(?:{a}{{1,{step}}}+\z|{a}{{0,{step - 1}}}{MARK}|{a}{{0,{step - 1}}}\n|{a}{{{step}}})"
    return f"(?s){first}|{later}"


def split_pieces(rows: DataFrame, row_id: str, payload: str, filetype: str, offset: str, limit: int = 2048, overlap: int = 64) -> DataFrame:
    """row id, piece_no, piece_offset, piece_len of the pieces of each payload of more than ``limit`` bytes, in built-in expressions.

    One pattern with bounded quantifiers takes from each place as much as it can up to the limit, with the stronger boundary first; the
    running sum of the matches' lengths gives the ends, and looking back by ``overlap`` the starts. The matches become rows before they are
    summed, so that the work grows with the payload's length and not with its square. Smaller and null payloads have no pieces. Positions
    count bytes of UTF-8. A null offset gives null piece_offset. Rows sent twice are returned once.
    """
    if not 0 < overlap < limit:
        raise ValueError("0 < overlap < limit")
    big = rows.where(F.octet_length(payload) > limit).select(F.col(row_id), F.col(offset).alias("__at"), F.xxhash64(payload, filetype).alias("__which"), F.col(payload).alias("__text"), F.col(filetype).alias("__kind"))
    added = F.transform(F.regexp_extract_all(marked(F.col("__text"), F.col("__kind")), F.lit(cut_pattern(limit, overlap)), F.lit(0)), F.length)
    each = big.select(row_id, "__at", "__which", added.alias("__added")).select(row_id, "__at", "__which", F.posexplode("__added").alias("piece_no", "__add")).distinct()
    end = F.sum("__add").over(W.partitionBy(row_id, "__at", "__which").orderBy("piece_no"))
    # the first piece starts at 0, others overlap bytes before the end of the one before
    start = F.when(F.col("piece_no") == 0, F.lit(0)).otherwise(F.col("__end") - F.col("__add") - overlap)
    return each.withColumn("__end", end).select(row_id, "piece_no", (F.col("__at") + start).cast("bigint").alias("piece_offset"), (F.col("__end") - start).cast("int").alias("piece_len"))

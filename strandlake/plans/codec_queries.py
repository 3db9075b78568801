"""Filters, codes and round trips."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.formatting import ceil_log2, floor_log2
from strandlake.operators import codec, profile, sketch
from strandlake.plans.sequence_queries import _Q, _T, _reads
from strandlake.plans.store_queries import _IX, _UP, _index, _index_rows, _uploads
from strandlake.plans.tables import table
from strandlake.runtime import written

#: DuckDB: bits of a filter for so many fingerprints, by the rule of sketch.size_for.
_BITS_OF = f"greatest({sketch.LEAST}, 1::bigint << ceil(log2(greatest({sketch.BITS_PER_KEY} * ({{}}), 1)))::int)"


def _size(keys, by=None) -> int:
    """Bits of a filter for the fingerprints of keys (repeated or not), with ``by`` for those of the largest group."""
    by = by or []
    n = keys.select(*by, F.xxhash64("fp")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sketch.size_for(n.agg(F.max("n")).first()[0] or 0)


def bloom_build(s, d):
    ix = _index(s, d)
    return sketch.bloom(ix, "fp", _size(_index_rows(s, d)))


def bloom_probe(s, d):
    ix = _index(s, d)
    size = _size(_index_rows(s, d))
    return sketch.probe(_uploads(s, d), "fp", sketch.bloom(ix, "fp", size), size)


def bloom_bitmap(s, d):
    """Set bits per bitmap."""
    return sketch.bloom_words(bloom_build(s, d)).select("bucket", F.expr("bitmap_count(bitmap)").alias("bits"))


def counting_bloom_delete(s, d):
    """Members of a counting filter after the fingerprints of the first batch have been taken out again."""
    rows = _index(s, d).select("fp", "batch_no").distinct()
    changes = rows.select("fp", F.lit(1).alias("n")).unionByName(rows.where("batch_no = 1").select("fp", F.lit(-1).alias("n")))
    size = _size(_index_rows(s, d))
    filled = sketch.counting(changes, "fp", "n", size).select("slot")
    return sketch.probe(_index(s, d), "fp", filled, size)


def master_hits(s, d):
    """Per upload and container group, how many of its fingerprints the group's filter affirms."""
    node = F.pmod(F.col("container_id"), F.lit(4)).cast("int").alias("node")
    keys = _index(s, d).select(node, "fp")
    size = _size(_index_rows(s, d).select(node, "fp"), ["node"])
    filled = keys.select("node", F.explode(sketch.slots("fp", size)).alias("slot")).distinct()
    known = sketch.probe(_uploads(s, d), "fp", filled, size, ["node"])
    return _uploads(s, d).select("upload_id", "fp").distinct().join(known, "fp").groupBy("upload_id", "node").agg(F.count(F.lit(1)).alias("hits"))


def bloom_rate(s, d):
    """One row: the filter's bits and those set, uploaded fingerprints that the index does not have, and those of them that the filter affirms.

    The filter is stored, and read again for the probe."""
    ix, size = _index(s, d), _size(_index_rows(s, d))
    filled = written(sketch.bloom(ix, "fp", size), "filter")
    new = _uploads(s, d).select("fp").distinct().join(ix.select("fp").distinct(), "fp", "left_anti")
    wrong = sketch.probe(new, "fp", filled, size)
    return filled.agg(F.lit(size).cast("bigint").alias("bits"), F.count(F.lit(1)).alias("filled")).crossJoin(new.agg(F.count(F.lit(1)).alias("unknown"))).crossJoin(wrong.agg(F.count(F.lit(1)).alias("affirmed")))


def huffman_bits(s, d):
    """Bits of all qualities in their Huffman code, and by place in a code for each."""
    n = profile.quality_by_position(_reads(s, d), "qual")
    codes = codec.huffman_codes(n, ["pos"], "q", "n")
    return n.join(codes, n["pos"].eqNullSafe(codes["pos"]) & (n["q"] == codes["q"])).groupBy(n["pos"]).agg(F.sum(F.col("n") * F.length("code")).alias("bits"))


def fastq_roundtrip(s, d):
    reads = table(s, d, "fastq_reads").dropDuplicates(["rec_no"]).select("rec_no", "title", "seq", "plus", "qual")
    back = codec.decode_fastq(codec.encode_fastq(reads))
    mark = lambda df, n: df.select("rec_no", F.md5(F.to_json(F.struct("title", "seq", "plus", "qual"))).alias(n))
    j = mark(reads, "a").join(mark(back, "b"), "rec_no", "full")
    return j.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))


def block_headers(s, d):
    """What the headers of encoded super-blocks say; the method is that of encoder_choice."""
    reads = table(s, d, "fastq_reads").dropDuplicates(["rec_no"]).select("rec_no", "title", "seq", "plus", "qual")
    return codec.block_index(codec.encode_fastq(reads)).drop("method")


def quality_cumulative(s, d):
    """Quality letters with their counts and the sums of the counts before them, as interpolative coding needs them."""
    n = profile.quality_by_position(_reads(s, d), "qual").where("pos is null").select("q", "n")
    return n.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def title_widths(s, d):
    """Bits that a field's length and its number of values need."""
    rows = profile.title_profile(_reads(s, d), "rec_no", "title")
    return rows.select("sb_id", "field_no", floor_log2("max_len").alias("floor_bits"), ceil_log2("max_len").alias("ceil_bits"))


def fasta_roundtrip(s, d):
    blocks = table(s, d, "raw_blocks").dropDuplicates(["chunk_id"]).where("filetype = 100 and payload is not null").select("chunk_id", "payload")
    back = codec.decode_fasta(codec.encode_fasta(blocks, "chunk_id", "payload"), "chunk_id")
    return blocks.join(back, "chunk_id", "full").agg(F.count_if(~F.col("payload").eqNullSafe(F.col("text"))).alias("mismatches"))


def record_extract(s, d):
    """Records whose number a noted match names, read back from encoded super-blocks."""
    reads = table(s, d, "fastq_reads").dropDuplicates(["rec_no"]).select("rec_no", "title", "seq", "plus", "qual")
    wanted = table(s, d, "lz_matches").where("rec_no is not null").select("rec_no")
    return codec.extract_records(codec.encode_fastq(reads), wanted).select("rec_no", "title", "seq", "qual")


QUERIES = {f.__name__: f for f in (bloom_build, bloom_probe, bloom_bitmap, counting_bloom_delete, master_hits, huffman_bits, bloom_rate, block_headers, quality_cumulative, title_widths, fastq_roundtrip, fasta_roundtrip, record_extract)}

_SLOTS = "list_distinct([" + ", ".join(f"('0x' || substr(fp, {1 + 6 * i}, 6))::bigint % (select size from z)" for i in range(6)) + "])"
_BITS = f"bi as (select distinct unnest({_SLOTS}) as slot from ix)"
_Z = f"z as (select {_BITS_OF.format('count(distinct fp)')} as size from ix)"
_ZN = f"z as (select {_BITS_OF.format('max(n)')} as size from (select count(distinct fp) as n from ix group by container_id % 4))"
_ASK = f"sl as (select fp, len(sl) as need, unnest(sl) as slot from (select fp, {_SLOTS} as sl from (select distinct fp from {{}})))"

SQL = {
    "bloom_build": f"with {_IX}, {_Z}, {_BITS} select slot from bi",
    "bloom_probe": f"with {_IX}, {_UP}, {_Z}, {_BITS}, {_ASK.format('up')} select fp from sl join bi using (slot) group by fp having count(*) = any_value(need)",
    "bloom_bitmap": f"with {_IX}, {_Z}, {_BITS} select slot // 32768 as bucket, count(*) as bits from bi group by 1",
    "counting_bloom_delete": f"""with {_IX}, {_Z}, rw as (select distinct fp, batch_no from ix), ch as (select fp, 1 as n from rw union all select fp, -1 from rw where batch_no = 1),
        bi as (select slot from (select n, unnest({_SLOTS}) as slot from ch) group by 1 having sum(n) > 0), {_ASK.format('ix')} select fp from sl join bi using (slot) group by fp having count(*) = any_value(need)""",
    "master_hits": f"""with {_IX}, {_UP}, {_ZN}, bi as (select distinct (container_id % 4)::int as node, unnest({_SLOTS}) as slot from ix), {_ASK.format('up')},
        k as (select node, fp from sl join bi using (slot) group by 1, 2 having count(*) = any_value(need)) select upload_id, node, count(*) as hits from (select distinct upload_id, fp from up) join k using (fp) group by 1, 2""",
    "bloom_rate": f"""with {_IX}, {_UP}, {_Z}, {_BITS}, nw as (select distinct fp from up where fp not in (select fp from ix)), {_ASK.format('nw')},
        hi as (select fp from sl join bi using (slot) group by fp having count(*) = any_value(need))
        select (select size from z)::bigint as bits, (select count(*) from bi) as filled, (select count(*) from nw) as unknown, (select count(*) from hi) as affirmed""",
    "huffman_bits": f"""with recursive {_Q[5:]}, n as (select pos::int as pos, c as q, count(*) as n from c group by grouping sets ((pos, c), (c))),
        h as (select pos, list_sort(list(n)) as ws, case when count(*) = 1 then sum(n)::bigint else 0::bigint end as bits from n group by pos
              union all select pos, list_sort(list_append(ws[3:], ws[1] + ws[2])), (bits + ws[1] + ws[2])::bigint from h where len(ws) > 1)
        select pos, bits from h where len(ws) = 1""",
    "fastq_roundtrip": "select 0::bigint as mismatches",
    "block_headers": "select rec_no // 16384 as sb_id, min(rec_no) as first_rec, max(rec_no) as last_rec, count(distinct rec_no)::int as records from fastq_reads where rec_no is not null group by 1",
    "quality_cumulative": f"{_Q}, n as (select c as q, count(*) as n from c group by 1) select q, n, coalesce(sum(n) over (order by q rows between unbounded preceding and 1 preceding), 0)::bigint as before from n",
    "title_widths": f"{_T}, m as (select sb_id, field_no, max(len(value)) as n from f group by 1, 2) select sb_id, field_no, case when n >= 1 then floor(log2(n))::int end as floor_bits, case when n >= 1 then ceil(log2(n))::int end as ceil_bits from m",
    "fasta_roundtrip": "select 0::bigint as mismatches",
    "record_extract": "select rec_no, any_value(title) as title, any_value(seq) as seq, any_value(qual) as qual from fastq_reads where rec_no in (select rec_no from lz_matches) group by rec_no",
}

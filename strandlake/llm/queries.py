"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.fingerprints import fingerprint
from strandlake.llm import abuse
from strandlake.llm.cuckoo import SeenKeys
from strandlake.llm.history import HistoryIndex, records
from strandlake.llm.leaks import leaked, plain
from strandlake.llm.packing import pack, token_counts
from strandlake.llm.signature_tree import linked_groups, similar_records
from strandlake.llm.spans import SpanIndex, shared_portion
from strandlake.llm.splitting import split_pieces
from strandlake.plans.tables import table
from strandlake.runtime import written

_FP = r"lower(regexp_extract(sha, '^[ \t]*(?:0[xX])?([0-9a-fA-F]{40})[ \t]*$', 1))"


# 2. new batches against all history
#: Items of a bucket of the history, about.
BUCKET_ITEMS = 1_000_000
#: Batches in which the queries of problems 2, 4 and 5 take their tables.
STEPS = 2


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Batches in order, in STEPS steps: what the containers took in is appended, then the step's uploads are held against all that is there."""
    taken = table(spark, folder, "fp_index").where((F.col("container_id") != 0) & (F.col("ref_count") > 0))
    taken = taken.select(F.col("container_id").alias("holder_id"), fingerprint("sha").alias("item"), "batch_no")
    uploads = table(spark, folder, "chunks").select(F.col("upload_id").alias("record_id"), fingerprint("sha").alias("item"), "batch_no")
    items = written(records(uploads), "uploads")
    lo, hi, n = items.agg(F.min("batch_no"), F.max("batch_no"), F.count(F.lit(1))).first()
    if lo is None:
        return spark.createDataFrame([], "upload_id bigint, container_id bigint")
    index, found, last = HistoryIndex(spark, buckets=max(16, n // BUCKET_ITEMS)), [], None
    for k in range(1, STEPS + 1):
        until = lo + (hi - lo + 1) * k // STEPS  # the step's uploads are of batches below this; what comes later holds none of them
        since = F.lit(True) if last is None else F.col("batch_no") >= last
        index.append(taken.where(since & (F.col("batch_no") < until)))
        found.append(index.probe(items.where(since & (F.col("batch_no") < until)), prepared=True))
        last = until
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("record_id").alias("upload_id"), F.col("holder_id").alias("container_id"))


_P2 = f"""
    with u as (select distinct upload_id, batch_no, {_FP} as fp from chunks where {_FP} <> ''),
         c as (select container_id, {_FP} as fp, min(batch_no) as batch_no from fp_index where container_id <> 0 and ref_count > 0 and {_FP} <> '' group by 1, 2),
         n as (select upload_id, count(*) as n from u group by 1)
    select upload_id, container_id
    from (select u.upload_id, c.container_id, count(*) as hits from u join c on u.fp = c.fp and c.batch_no < u.batch_no group by 1, 2) join n using (upload_id)
    where 5 * hits >= 4 * n"""


# 5. seen before
def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    come = table(spark, folder, "container_fps").select(F.col("fps_id").alias("row_id"), fingerprint("sha").alias("key"), F.col("arrival_no").alias("arrival"), F.lit(True).alias("wanted"))
    known = table(spark, folder, "fp_index").select(F.lit(None).cast("bigint").alias("row_id"), fingerprint("sha").alias("key"), F.col("arrival_no").alias("arrival"), F.lit(False).alias("wanted"))
    return come.unionByName(known)


#: Keys of a part, for which a task holds about 5 MB of tables.
PART_KEYS = 2_000_000


def _told(rows: DataFrame) -> DataFrame:
    """Rows in order of arrival, in STEPS batches, each held against the stored tables of those before."""
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("arrival"), F.max("arrival")).first()
    seen, out = SeenKeys(rows.sparkSession, max(32, -(-n // PART_KEYS))), []
    if lo is None:
        return seen.take(rows)
    for k in range(STEPS):
        a, b = (lo + (hi - lo + 1) * x // STEPS for x in (k, k + 1))
        out.append(seen.take(rows.where((F.col("arrival") >= a) & (F.col("arrival") < b))))
    return reduce(DataFrame.unionByName, out)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _told(_arrivals(spark, folder)).where("repeat").select(F.col("row_id").alias("fps_id")).distinct()


def p5_audit(spark: SparkSession, folder: str) -> DataFrame:
    """One row: rows with a readable key, those of them that repeat one, those that are the first of their key, and of the latter those that the
    tables took for repeats (wrong), with their share (wrong_rate). A row sent twice counts once; rows without an arrival have no answer."""
    rows = _arrivals(spark, folder)
    told = _told(rows).groupBy("row_id").agg(F.max("repeat").alias("repeat"), F.max("flagged").alias("flagged"))
    asked = rows.where(F.col("wanted") & F.col("key").isNotNull()).groupBy("row_id").agg(F.max("arrival").isNotNull().alias("timed")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("timed").alias("timed"))
    sums = told.agg(F.count_if("repeat").alias("repeats"), F.count_if(F.col("flagged") & ~F.col("repeat")).alias("wrong"))
    new = F.col("timed") - F.col("repeats")
    return asked.crossJoin(sums).select("rows", "repeats", new.alias("new"), "wrong", (F.col("wrong") / F.greatest(new, F.lit(1))).alias("wrong_rate"))


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The audit's counts, and whether no more than one new row in two hundred was taken for a repeat."""
    return p5_audit(spark, folder).select("rows", "repeats", "new", (F.col("wrong_rate") <= 0.005).alias("few_wrong"))


_P5 = f"""
    with a as (select {_FP} as fp, arrival_no from container_fps union all select {_FP}, arrival_no from fp_index),
         f as (select fp, min(arrival_no) as since from a where fp <> '' group by 1)
    select distinct fps_id from (select fps_id, arrival_no, {_FP} as fp from container_fps) join f using (fp) where arrival_no > since"""


_P5_TOTALS = f"""
    with a as (select {_FP} as fp, arrival_no from container_fps union all select {_FP}, arrival_no from fp_index),
         f as (select fp, min(arrival_no) as since from a where fp <> '' group by 1),
         r as (select fps_id, {_FP} as fp, max(arrival_no) as arrival_no from container_fps where {_FP} <> '' group by 1, 2),
         t as (select count(*) as rows, count(arrival_no) as timed, count_if(arrival_no > since) as repeats from r left join f using (fp))
    select rows, repeats::bigint as repeats, (timed - repeats)::bigint as new, true as few_wrong from t"""

# 3. near-duplicate records
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_records(table(spark, folder, "fastq_reads").select("rec_no", "seq"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return linked_groups(table(spark, folder, "fastq_reads").select("rec_no", "seq"))


_P3 = r"""
    with r as (select rec_no, any_value(upper(regexp_replace(seq, '\r+$', ''))) as seq from fastq_reads where seq is not null group by 1),
         t as (select distinct rec_no, g from (select rec_no, substr(seq, i + 1, 12) as g from (select rec_no, seq, unnest(range(0, greatest(len(seq) - 11, 0))) as i from r)) where regexp_full_match(g, '[ACGT]{12}')),
         n as (select rec_no, count(*) as n from t group by 1 having count(*) >= 30)
    select rec_a, rec_b
    from (select x.rec_no as rec_a, y.rec_no as rec_b, count(*) as hits from t x join t y on x.g = y.g and x.rec_no < y.rec_no group by 1, 2)
    join n a on a.rec_no = rec_a join n b on b.rec_no = rec_b
    where 2 * hits >= a.n + b.n - hits"""

_P3_GROUPS = _P3.replace("with r as", "with recursive r as", 1).replace("    select rec_a, rec_b\n", "    , p as (select rec_a, rec_b\n", 1) + r""")
    , c as (select rec_no, case when len(seq) >= 41 then min(rec_no) over (partition by seq) else rec_no end as class_id from r where rec_no is not null union select rec_no, rec_no from fastq_reads where rec_no is not null and rec_no not in (select rec_no from r where rec_no is not null)),
         e as (select distinct a.class_id as x, b.class_id as y from (select rec_a, rec_b from p union all select rec_b, rec_a from p) join c a on a.rec_no = rec_a join c b on b.rec_no = rec_b where a.class_id <> b.class_id),
         w as (select x, y from e union select w.x, e.y from w join e on w.y = e.x),
         l as (select x, count(*) as links from e group by 1),
         m as (select x, min(y) as low from w group by 1)
    select rec_no, class_id, coalesce(links, 0)::bigint as links, least(class_id, coalesce(low, class_id)) as group_id
    from c left join l on l.x = class_id left join m on m.x = class_id"""

# 4. long exact spans
def _stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Reads come in STEPS batches by number; each is joined with the runs of those before."""
    rows = table(spark, folder, "fastq_reads").select("rec_no", "seq")
    index = SpanIndex(spark)
    lo, hi = rows.agg(F.min("rec_no"), F.max("rec_no")).first()
    for k in range(STEPS if lo is not None else 0):
        a, b = (lo + (hi - lo + 1) * x // STEPS for x in (k, k + 1))
        index.add(rows.where((F.col("rec_no") >= a) & (F.col("rec_no") < b)))
    return index.shared_stretches()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _stretches(spark, folder)


def p4_portions(spark: SparkSession, folder: str) -> DataFrame:
    return shared_portion(_stretches(spark, folder), table(spark, folder, "fastq_reads")).where("shared > 0")


_STRETCHES = r"""
    with r as (select rec_no, any_value(upper(regexp_replace(seq, '\r+$', ''))) as seq from fastq_reads where seq is not null group by 1),
         w as (select rec_no, len(seq) as letters, i as pos, substr(seq, i + 1, 40) as t from (select rec_no, seq, unnest(range(0, greatest(len(seq) - 39, 0))) as i from r)),
         g as (select t from w where regexp_full_match(t, '[ACGT]*') and (t like '%A%')::int + (t like '%C%')::int + (t like '%G%')::int + (t like '%T%')::int >= 3
               group by 1 having min(rec_no) < max(rec_no)),
         s as (select rec_no, letters, pos, pos > lag(pos) over (partition by rec_no order by pos) + 40 as gap from w where t in (select t from g)),
         n as (select rec_no, letters, pos, sum(coalesce(gap, false)::int) over (partition by rec_no order by pos) as run from s),
         x as (select rec_no, letters, min(pos)::int as rec_offset, (max(pos) - min(pos) + 40)::int as match_len from n group by rec_no, letters, run)"""

# 6. splitting oversized items
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "raw_blocks")
    return split_pieces(blocks, "chunk_id", "payload", "filetype", "file_offset", 2048, 64)


_P6 = r"""
    with recursive b as (select chunk_id, any_value(filetype) as filetype, any_value(file_offset) as base, any_value(payload) as p, any_value(strlen(payload)) as n from raw_blocks where strlen(payload) > 2048 group by chunk_id),
         l as (select *, list_filter(range(1, n + 1), lambda i: p[i] = chr(10)) as lines from b),
         r as (select chunk_id, base, n, lines, case filetype when 100 then list_filter(lines, lambda i: p[i + 1] = '>')
                   when 200 then list_transform(range(4, len(lines) + 1, 4), lambda k: lines[k]) else [] end as heads from l),
         c as (select chunk_id, 0 as piece_no, 0::bigint as s,
                   case when n <= 2048 then n else coalesce(list_max(list_filter(heads, lambda x: x > 64 and x <= 2048)), list_max(list_filter(lines, lambda x: x > 64 and x <= 2048)), 2048) end as e from r
               union all
               select chunk_id, piece_no + 1, e - 64,
                   case when n - (e - 64) <= 2048 then n else coalesce(list_max(list_filter(heads, lambda x: x > e and x <= e - 64 + 2048)), list_max(list_filter(lines, lambda x: x > e and x <= e - 64 + 2048)), e - 64 + 2048) end
               from c join r using (chunk_id) where e < n)
    select chunk_id, piece_no::int as piece_no, (base + s)::bigint as piece_offset, (e - s)::int as piece_len from c join r using (chunk_id)"""

# 7. fixed-capacity containers
CAPACITY = 2048


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(token_counts(table(spark, folder, "documents").select("doc_id", "text")), CAPACITY)


def p7_unused(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers, tokens, unused space, and the fewest containers that could do."""
    boxes = p7_packing(spark, folder).where("container_no is not null")
    total = boxes.agg(F.count_distinct("container_no").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.withColumns({"unused": F.col("containers") * CAPACITY - F.col("tokens"), "fewest": F.ceil(F.col("tokens") / CAPACITY)})


# 8. evaluation texts in training text
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items").select("item_id", "text"))


def p8_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of items in messages as they stand, without any decoding."""
    return leaked(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items").select("item_id", "text"), parts_of=plain)


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each item that leaked and the number of documents that have of it."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


# 9. abusive, hateful or sexual content
def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    words = written(abuse.worded(docs), "words")
    return abuse.score(docs, abuse.fit(docs, table(spark, folder, "labels"), words=words), words)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_scores(spark, folder).where("flagged").select("doc_id")


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, flagged documents and their rate per source; documents without a source have a null one."""
    source = table(spark, folder, "documents").select("doc_id", "source").distinct()
    by = source.join(p9_scores(spark, folder), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"))
    return by.withColumn("rate", F.col("flagged") / F.col("documents"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_portions": p4_portions, "p5_found": p5_found, "p5_audit": p5_audit, "p5_totals": p5_totals, "p6_found": p6_found, "p7_packing": p7_packing, "p7_unused": p7_unused, "p8_found": p8_found, "p8_items": p8_items, "p8_plain": p8_plain, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL = {
    "p2_found": _P2,
    "p3_found": _P3,
    "p3_groups": _P3_GROUPS,
    "p4_found": f"{_STRETCHES} select rec_no, rec_offset, match_len from x",
    "p4_portions": f"{_STRETCHES} select rec_no, letters::bigint as letters, sum(match_len)::bigint as shared, sum(match_len) / letters as portion from x group by rec_no, letters",
    "p5_found": _P5,
    "p5_totals": _P5_TOTALS,
    "p8_plain": r"""
    with d as (select doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents), i as (select item_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
         g as (select id, array_to_string(w[k:k + 11], ' ') as g from (select id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12)),
         x as (select id, array_to_string(w[k:k + 11], ' ') as g from (select id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12))
    select distinct x.id as doc_id, g.id as item_id from x join g using (g)""",
    "p6_found": _P6,
}

"""Chunking, deduplication, routing, recipes and catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import formatting, hashing
from strandlake.functions.fingerprints import cid_part, fingerprint
from strandlake.operators import catalog, chunking, containers, dedup, recipes, routing
from strandlake.plans.tables import FP_SQL, table
from strandlake.runtime import hot_keys, shared_path, skew_safe_join

CHUNK = 512
NODES = 4


def _fp() -> Column:
    return F.lower(F.hex(fingerprint("sha")))


def _doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return chunking.fixed_chunks(docs, "doc_id", F.encode("text", "UTF-8"), CHUNK)


def _index_rows(spark: SparkSession, folder: str) -> DataFrame:
    """fp_index rows as they were sent, with normal fingerprints and a live count."""
    rows = table(spark, folder, "fp_index").where((F.col("container_id") != 0) & (F.col("ref_count") > 0)).withColumn("fp", _fp())
    return rows.where(F.col("fp").isNotNull())


def _index(spark: SparkSession, folder: str) -> DataFrame:
    """fp_index rows, each once, with normal fingerprints and a live count."""
    return _index_rows(spark, folder).dropDuplicates(["entry_id"])


def _uploads(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").withColumn("fp", _fp())
    return rows.where(F.col("fp").isNotNull()).dropDuplicates(["chunk_id"])


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    cid = F.concat_ws("_", cid_part("inode_cid", 1), cid_part("inode_cid", 2))
    rows = table(spark, folder, "recipes").withColumn("cid", cid)
    return rows.where((F.col("cid") != "") & cid_part("inode_cid", 1).isNotNull() & cid_part("inode_cid", 2).isNotNull()).dropDuplicates(["recipe_id"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The last registration of each file key that is live."""
    rows = catalog.latest(table(spark, folder, "files").dropDuplicates(["file_id"]), ["file_key"], ["registered_at", "file_id"])
    return rows.where(F.col("deleted_at").isNull())


def fixed_chunks(s, d):
    return _doc_chunks(s, d)


def chunk_dedup_summary(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    return dedup.dedup_totals(_doc_chunks(s, d).join(docs, "doc_id"), "sha", "chunk_size", ["source"])


def first_occurrence_chunks(s, d):
    return dedup.first_places(_doc_chunks(s, d), "sha", ["doc_id", "file_offset"]).select("sha", "doc_id", "file_offset", "chunk_size")


def known_chunks(s, d):
    """Per upload: chunks, and those whose fingerprint the index has."""
    out = dedup.probe(_uploads(s, d), _index(s, d), "fp")
    return out.groupBy("upload_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("known").alias("known"))


def fp_index_refcounts(s, d):
    return dedup.reference_counts(_index(s, d), ["fp", "container_id"], "ref_count")


def index_rebuild(s, d):
    rows = table(s, d, "container_fps").withColumn("fp", _fp()).where(F.col("fp").isNotNull()).dropDuplicates(["fps_id"])
    return rows.groupBy("fp", "container_id").agg(F.count(F.lit(1)).alias("ref_count"))


def _deleted_rows(s, d) -> DataFrame:
    """Map rows of files whose last registration is deleted."""
    rows = catalog.latest(table(s, d, "files").dropDuplicates(["file_id"]), ["file_key"], ["registered_at", "file_id"]).where(F.col("deleted_at").isNotNull())
    gone = rows.select(F.concat_ws("_", cid_part("inode_cid", 1), cid_part("inode_cid", 2)).alias("cid")).distinct()
    return _recipes(s, d).withColumn("fp", _fp()).where(F.col("fp").isNotNull()).join(gone, "cid", "left_semi")


def _after_delete(s, d) -> DataFrame:
    plus = _index(s, d).select("fp", "container_id", "ref_count")
    minus = _deleted_rows(s, d).groupBy("fp", "container_id").agg((-F.count(F.lit(1))).alias("ref_count"))
    known = plus.select("fp", "container_id").distinct()
    return dedup.reference_counts(plus.unionByName(minus.join(known, ["fp", "container_id"], "left_semi")), ["fp", "container_id"], "ref_count")


def refcounts_after_delete(s, d):
    return _after_delete(s, d)


def reclaimable_containers(s, d):
    return dedup.reclaimable(_index(s, d), _after_delete(s, d), "container_id")


def free_container_ids(s, d):
    live = table(s, d, "containers").where("deleted_at is null and container_id is not null")
    base = 500_000_000
    out = dedup.free_ids(live.select((F.col("container_id") - base).alias("id")), "id")
    return out.select((F.col("first_free") + base).alias("first_free"), (F.col("last_free") + base).alias("last_free"))


def sampled_fingerprints(s, d):
    rows = _uploads(s, d).select("upload_id", "chunk_id", "file_offset", "fp")
    return dedup.sampled(rows, "fp", 16, F.col("file_offset") == 0).select("upload_id", "chunk_id", "fp")


def champion_container(s, d):
    """Per upload the container that most of its chunks' first index entries are in."""
    first = dedup.first_places(_index(s, d).select("fp", "container_id", "arrival_no"), "fp", ["arrival_no"]).select("fp", "container_id")
    rows = _uploads(s, d).select("upload_id", "chunk_id", "fp")
    hits = skew_safe_join(rows, first, ["fp"], "inner", hot_keys(rows, "fp"))
    return dedup.champion(hits, ["upload_id"], "container_id", "chunk_id")


def container_packing(s, d):
    """Chunks of each batch packed in order of arrival into containers of 8 MiB."""
    rows = _uploads(s, d).select("batch_no", "chunk_id", "chunk_size")
    return dedup.packed(rows, "batch_no", ["chunk_id"], "chunk_size", 8 << 20)


def placement_md5(s, d):
    return table(s, d, "files").select("file_id", hashing.node_of_md5("md5", NODES).alias("node")).distinct()


def placement_stateless(s, d):
    return _uploads(s, d).select("chunk_id", hashing.node_of_sha("fp", NODES).alias("node"), hashing.cache_bucket("fp").alias("bucket"))


def bucket_counts(s, d):
    rows = table(s, d, "container_fps").withColumn("fp", _fp()).where(F.col("fp").isNotNull()).dropDuplicates(["fps_id"])
    return rows.groupBy(hashing.cache_bucket("fp").alias("bucket")).agg(F.count(F.lit(1)).alias("entries"))


def load_aware_route(s, d):
    """Per upload the node (compressor) whose containers know most of it, with fuller nodes held back."""
    boxes = table(s, d, "containers").where("deleted_at is null").groupBy("container_id").agg(F.max("compressor_id").alias("node"))
    first = dedup.first_places(_index(s, d).select("fp", "container_id", "arrival_no"), "fp", ["arrival_no"]).join(boxes, "container_id").select("fp", "node")
    usage = boxes.groupBy("node").agg(F.count(F.lit(1)).alias("used"))
    rows = _uploads(s, d).select("upload_id", "fp")
    hits = skew_safe_join(rows, first, ["fp"], "inner", hot_keys(rows, "fp")).groupBy("upload_id", "node").agg(F.count(F.lit(1)).alias("n"))
    return routing.routed(table(s, d, "chunks"), hits, usage, "upload_id", "node", "n", "used")


def range_read_chunks(s, d):
    """Each live file's bytes 10,000 to 29,999: the map rows that hold them, and the part of each."""
    files = _files(s, d).select(F.concat_ws("_", cid_part("inode_cid", 1), cid_part("inode_cid", 2)).alias("cid")).distinct()
    ask = files.select("cid", F.lit(10_000).cast("bigint").alias("start"), F.lit(20_000).cast("bigint").alias("length"))
    maps = _recipes(s, d).select("cid", "recipe_id", "file_offset", F.col("chunk_size").cast("bigint").alias("chunk_size"))
    return recipes.overlapping(ask, maps, "cid", "file_offset", "chunk_size", "start", "length").select("cid", "recipe_id", "from_byte", "take")


def recipe_node_runs(s, d):
    rows = dedup.first_places(_recipes(s, d).select("cid", "file_offset", "compressor_id", "recipe_id").withColumn("k", F.concat_ws("@", "cid", F.col("file_offset").cast("string"))), "k", ["recipe_id"])
    return recipes.node_runs(rows, "cid", "file_offset", "compressor_id")


def recipe_merge(s, d):
    """Positions and fingerprints of an upload, joined by place."""
    rows = _uploads(s, d).select("upload_id", "chunk_id", "file_offset", "fp")
    both = rows.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "file_offset", "fp"))).alias("x"))
    pos = both.select("upload_id", F.transform("x", lambda v: v["file_offset"]).alias("positions"))
    sha = both.select("upload_id", F.transform("x", lambda v: v["fp"]).alias("shas"))
    return recipes.zip_positions(pos, sha, "upload_id")


def reassemble_md5(s, d):
    """Documents cut into chunks and put together again: the digests must be those of the documents."""
    docs = table(s, d, "documents")
    cut = chunking.fixed_chunks(docs, "doc_id", F.encode("text", "UTF-8"), CHUNK)
    whole = docs.select("doc_id", F.encode("text", "UTF-8").alias("__d"))
    pieces = whole.join(cut.select("doc_id", "file_offset", "chunk_size"), "doc_id").select("doc_id", "file_offset", F.expr("substring(__d, int(file_offset) + 1, chunk_size)").alias("piece"))
    return recipes.reassembled(pieces, "doc_id", "file_offset", "piece").select("doc_id", F.md5("piece").alias("md5"))


def catalog_list(s, d):
    return catalog.listing(_files(s, d))


def catalog_lookup(s, d):
    """The file of each upload."""
    return catalog.lookup(_files(s, d), table(s, d, "chunks").where("file_key is not null"), "file_key")


def catalog_merge(s, d):
    """Catalogs of the compressors, later registrations winning."""
    rows = table(s, d, "files").dropDuplicates(["file_id"])
    return catalog.latest(rows, ["file_key"], ["registered_at", "file_id"]).select("file_key", "file_id", "compressor_id")


def catalog_delete(s, d):
    """What is left of the catalog without the files that were ever deleted."""
    rows = table(s, d, "files")
    return catalog.without(rows.select("file_id", "file_key").distinct(), rows.where("deleted_at is not null"), ["file_key"])


def whole_object_dedup(s, d):
    rows = table(s, d, "documents").select(F.md5(F.encode("text", "UTF-8")).alias("md5"), F.octet_length("text").alias("n"))
    return rows.where("md5 is not null").groupBy("md5").agg(F.count(F.lit(1)).alias("copies"), F.sum("n").cast("bigint").alias("bytes"))


def duplicate_chunks(s, d):
    """Chunks of documents that an earlier place already has, with that place."""
    rows = _doc_chunks(s, d)
    first = dedup.first_places(rows, "sha", ["doc_id", "file_offset"]).select("sha", F.col("doc_id").alias("first_doc"), F.col("file_offset").alias("first_offset"))
    both = skew_safe_join(rows, first, ["sha"], "inner", hot_keys(rows, "sha"))
    return both.where((F.col("doc_id") != F.col("first_doc")) | (F.col("file_offset") != F.col("first_offset"))).distinct()


def range_read_bytes(s, d):
    """Bytes 700 to 2,699 of each document, from its chunks."""
    docs = table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("__d"))
    maps = _doc_chunks(s, d).select("doc_id", "file_offset", F.col("chunk_size").cast("bigint").alias("chunk_size"))
    ask = docs.select("doc_id", F.lit(700).cast("bigint").alias("start"), F.lit(2000).cast("bigint").alias("length"))
    parts = recipes.overlapping(ask, maps, "doc_id", "file_offset", "chunk_size", "start", "length")
    bytes_ = docs.join(parts, "doc_id").select("doc_id", "file_offset", F.expr("substring(__d, int(file_offset) + from_byte + 1, take)").alias("piece"))
    return recipes.reassembled(bytes_, "doc_id", "file_offset", "piece").select("doc_id", F.octet_length("piece").alias("n"), F.md5("piece").alias("md5"))


def container_write_read(s, d):
    """Documents' chunks written into containers of 64 KiB, a folder each, and read back: each chunk cut from its container."""
    whole = table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("__d"))
    rows = dedup.first_places(_doc_chunks(s, d), "sha", ["doc_id", "file_offset"])
    rows = whole.join(rows, "doc_id").select("sha", F.pmod("doc_id", F.lit(8)).cast("int").alias("stream"), F.expr("substring(__d, int(file_offset) + 1, chunk_size)").alias("data"))
    made = containers.write(rows, "stream", "sha", "data", 64 << 10, shared_path(s, "containers"))
    back = containers.slices(made, s)
    return back.select("sha", F.octet_length("data").alias("n"), F.sha1("data").alias("again"))


def prioritised_probe(s, d):
    """Where each upload's chunks are found first: in the open containers (the youngest generation), in the cache, in the index."""
    open_ = table(s, d, "containers").where("deleted_at is null and generation > 1").select("container_id").distinct()
    cache = table(s, d, "container_fps").withColumn("fp", _fp()).where("fp is not null and container_id is not null").select("fp", "container_id")
    index = _index(s, d).select("fp", "container_id")
    levels = [cache.join(open_, "container_id", "left_semi"), cache, index]
    return dedup.first_level(_uploads(s, d).select("chunk_id", "fp"), levels, "fp", "container_id")


def master_arrays(s, d):
    """Fingerprints by the node that their leading bits name, in numbered batches of 1,000: what is sent to each."""
    fps = _uploads(s, d).select("fp").distinct().withColumn("node", hashing.node_of_sha("fp", NODES))
    return dedup.numbered_batches(fps, ["node"], "fp", 1000).select("node", "batch", "fp")


def delete_order(s, d):
    """Map rows of deleted files in the order in which containers give up their chunks: by container, from its end."""
    rows = _deleted_rows(s, d).where("container_id is not null")
    by = W.partitionBy("container_id").orderBy(F.desc_nulls_last("container_offset"), "recipe_id")
    return rows.select("container_id", "recipe_id", F.row_number().over(by).alias("turn"))


def segment_lookup(s, d):
    """Each file content's segments by offset, asked for by (md5, offset): the path, or none."""
    rows = table(s, d, "files").where("md5 is not null and filesize is not null")
    at = rows.select("md5", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("filesize") - 1, F.lit(0)), F.lit(1 << 16).cast("bigint"))).alias("file_offset"), "file_id")
    segments = at.groupBy("md5", "file_offset").agg(F.min("file_id").alias("n")).select("md5", "file_offset", catalog.output_path("/data", "n").alias("path"))
    asked = rows.select("md5", F.explode(F.array(*(F.lit(x).cast("bigint") for x in (0, 1 << 16, 5)))).alias("file_offset")).distinct()
    return catalog.segment(segments, asked)


def catalog_locations(s, d):
    """Contents with the paths of their segments, in order of offset."""
    rows = table(s, d, "files").where("md5 is not null and file_id is not null").select("md5", (F.col("file_id") % 3 * 65536).alias("file_offset"), catalog.output_path("/data", "file_id").alias("path"))
    return catalog.locations(rows).select("md5", F.to_json("off_loc").alias("locations"))


def recyclable_ids(s, d):
    """Container numbers that could be given out again at the end of 2026."""
    return containers.recyclable(table(s, d, "containers"), F.lit("2026-12-31 00:00:00").cast("timestamp"))


def map_names(s, d):
    """Chunk maps by file: their name, and which of two folders they are in."""
    rows = table(s, d, "files").where("inode is not null and client_id is not null and registered_at is not null")
    name = formatting.map_name("inode", "client_id", "registered_at")
    return rows.select("file_id", name.alias("name"), formatting.map_side(name).alias("side")).distinct()


def wrong_lengths(s, d):
    """Blocks whose stated size is not that of their payload."""
    rows = table(s, d, "raw_blocks").where("payload is not null").select("chunk_id", F.col("chunk_size").alias("stated"), F.octet_length("payload").alias("found"))
    return rows.where(~F.col("stated").eqNullSafe(F.col("found"))).distinct()


def champion_cached(s, d):
    """Per upload, how many of its chunks the fingerprints of its champion container answer."""
    best = champion_container(s, d).select("upload_id", "container_id")
    fps = _index(s, d).select("container_id", "fp").distinct()
    mine = _uploads(s, d).select("upload_id", "chunk_id", "fp").join(best, "upload_id")
    return skew_safe_join(mine, fps, ["fp", "container_id"], "left_semi", hot_keys(mine, "fp")).groupBy("upload_id", "container_id").agg(F.count(F.lit(1)).alias("cached"))


def index_upload(s, d):
    """The index after the containers' fingerprints have been sent to it: one more reference for each row."""
    more = table(s, d, "container_fps").withColumn("fp", _fp()).where("fp is not null and container_id is not null").dropDuplicates(["fps_id"])
    return dedup.reference_counts(_index(s, d).select("fp", "container_id", "ref_count").unionByName(more.select("fp", "container_id", F.lit(1).cast("bigint").alias("ref_count"))), ["fp", "container_id"], "ref_count")


def store_ratio(s, d):
    """Bytes as they came, bytes kept once, and the factor between them, per source of documents."""
    rows = chunk_dedup_summary(s, d)
    return rows.select("source", "bytes", "unique_bytes", F.round(F.col("bytes") / F.col("unique_bytes"), 6).alias("factor"))


def cdc_dedup_summary(s, d):
    """Content-defined chunks of documents: how many documents they cover, their bytes."""
    rows = cdc_chunks(s, d)
    return rows.agg(F.count_distinct("doc_id").alias("documents"), F.sum("chunk_size").alias("bytes"), (F.sum("chunk_size") >= F.count_distinct("sha")).alias("shared"))


def low_keys(s, d):
    """The low 16 bits of each file key's digest."""
    keys = table(s, d, "files").where("file_key is not null").select("file_key").distinct()
    return keys.select("file_key", hashing.low_key(F.encode("file_key", "UTF-8")).alias("low"))


def hash_family(s, d):
    keys = table(s, d, "files").where("file_key is not null").select("file_key").distinct()
    return keys.select("file_key", *(hashing.string_hash("file_key", n).alias(n) for n in (*hashing.FAMILY, "crc", "rabin", "rolling")), hashing.low_key(F.encode("file_key", "UTF-8")).alias("low"))


def cdc_chunks(s, d):
    docs = table(s, d, "documents")
    return chunking.content_chunks(docs, "doc_id", F.encode("text", "UTF-8"), 1024)


def cdc_coverage(s, d):
    """Violations of what content-defined chunks promise: they cover their object without gaps, in the allowed sizes."""
    docs = table(s, d, "documents").select("doc_id", F.octet_length("text").alias("n"))
    per = cdc_chunks(s, d).groupBy("doc_id").agg(F.sum("chunk_size").alias("covered"), F.max("chunk_size").alias("largest"), F.max(F.col("file_offset") + F.col("chunk_size")).alias("end"))
    j = docs.where("n > 0").join(per, "doc_id", "left")
    return j.agg(F.count_if(~F.coalesce((F.col("covered") == F.col("n")) & (F.col("end") == F.col("n")) & (F.col("largest") <= 4096), F.lit(False))).alias("violations"))


QUERIES = {f.__name__: f for f in (
    fixed_chunks, chunk_dedup_summary, first_occurrence_chunks, known_chunks, fp_index_refcounts, index_rebuild, refcounts_after_delete, reclaimable_containers,
    free_container_ids, sampled_fingerprints, champion_container, container_packing, placement_md5, placement_stateless, bucket_counts, load_aware_route,
    range_read_chunks, recipe_node_runs, recipe_merge, reassemble_md5, catalog_list, catalog_lookup, catalog_merge, catalog_delete, whole_object_dedup,
    hash_family, low_keys, cdc_chunks, cdc_coverage, cdc_dedup_summary, duplicate_chunks, range_read_bytes, container_write_read, recyclable_ids, prioritised_probe,
    master_arrays, delete_order, segment_lookup, store_ratio, catalog_locations, map_names, wrong_lengths, champion_cached, index_upload,
)}

_CH = f"""
    b as (select doc_id, source, encode(text) as d, octet_length(encode(text)) as n from documents where octet_length(encode(text)) > 0),
    ch as (select doc_id, source, (i * {CHUNK})::bigint as file_offset, least({CHUNK}, n - i * {CHUNK})::int as chunk_size, sha1(array_slice(d, i * {CHUNK} + 1, least((i + 1) * {CHUNK}, n))) as sha
           from (select *, unnest(range(0, (n - 1) // {CHUNK} + 1)) as i from b))"""
_IX = f"ix as (select distinct entry_id, arrival_no, batch_no, container_id, ref_count, {FP_SQL} as fp from fp_index where container_id <> 0 and ref_count > 0 and {FP_SQL} <> '')"
_UP = f"up as (select distinct chunk_id, upload_id, batch_no, file_key, file_offset, chunk_size, {FP_SQL} as fp from chunks where {FP_SQL} <> '')"
_CID = r"""(regexp_extract(inode_cid, '^[\s\x00]*0*([0-9]+)_0*([0-9]+)[\s\x00]*$', 1) || '_' || regexp_extract(inode_cid, '^[\s\x00]*0*([0-9]+)_0*([0-9]+)[\s\x00]*$', 2))"""
_RE = f"re as (select distinct recipe_id, file_offset, chunk_size, compressor_id, container_id, {FP_SQL} as fp, {_CID} as cid from recipes where {_CID} <> '_')"
_LAST = "la as (select * from (select distinct * from files) qualify row_number() over (partition by file_key order by registered_at desc nulls last, file_id desc) = 1)"
_AFTER = f"""{_IX}, {_RE}, {_LAST},
    mi as (select fp, container_id, -count(*) as n from re where fp <> '' and cid in (select {_CID} from la where deleted_at is not null) and (fp, container_id) in (select (fp, container_id) from ix) group by 1, 2),
    af as (select fp, container_id, sum(n)::bigint as ref_count from (select fp, container_id, ref_count as n from ix union all select * from mi) group by 1, 2 having sum(n) > 0)"""
_FIRST = "fi as (select fp, arg_min(container_id, arrival_no) as container_id from ix group by 1)"

SQL = {
    "fixed_chunks": f"with {_CH} select doc_id, file_offset, chunk_size, sha from ch",
    "chunk_dedup_summary": f"""with {_CH} select source, sum(n)::bigint as chunks, count(*) as unique_chunks, sum(s)::bigint as bytes, sum(u)::bigint as unique_bytes
        from (select source, sha, count(*) as n, sum(chunk_size) as s, max(chunk_size) as u from ch group by 1, 2) group by 1""",
    "first_occurrence_chunks": f"with {_CH} select sha, doc_id, file_offset, chunk_size from ch qualify row_number() over (partition by sha order by doc_id, file_offset) = 1",
    "known_chunks": f"with {_IX}, {_UP} select upload_id, count(*) as chunks, count(*) filter (fp in (select fp from ix)) as known from up group by 1",
    "fp_index_refcounts": f"with {_IX} select fp, container_id, sum(ref_count)::bigint as ref_count from ix group by 1, 2",
    "index_rebuild": f"select fp, container_id, count(*) as ref_count from (select distinct fps_id, container_id, {FP_SQL} as fp from container_fps where {FP_SQL} <> '') group by 1, 2",
    "refcounts_after_delete": f"with {_AFTER} select fp, container_id, ref_count from af",
    "reclaimable_containers": f"with {_AFTER} select distinct container_id from ix where container_id not in (select container_id from af where container_id is not null)",
    "free_container_ids": """with c as (select distinct container_id as id from containers where deleted_at is null and container_id is not null)
        select a + 1 as first_free, id - 1 as last_free from (select id, coalesce(lag(id) over (order by id), 500000000) as a from c) where id - a > 1""",
    "sampled_fingerprints": f"with {_UP} select upload_id, chunk_id, fp from up where file_offset = 0 or fp like '0%'",
    "champion_container": f"""with {_IX}, {_UP}, {_FIRST}, h as (select upload_id, container_id, count(*) as hits, min(chunk_id) as f from up join fi using (fp) group by 1, 2)
        select upload_id, container_id, hits from h qualify row_number() over (partition by upload_id order by hits desc, f, container_id) = 1""",
    "container_packing": f"""with recursive {_UP}, o as (select batch_no, chunk_id, chunk_size, row_number() over (partition by batch_no order by chunk_id) as rn from up),
        r as (select batch_no, chunk_id, chunk_size, rn, coalesce(chunk_size, 0)::bigint as fill, 0 as box_no from o where rn = 1
              union all
              select o.batch_no, o.chunk_id, o.chunk_size, o.rn, case when r.fill > 0 and r.fill + coalesce(o.chunk_size, 0) > 8388608 then 0 else r.fill end + coalesce(o.chunk_size, 0),
                     r.box_no + (r.fill > 0 and r.fill + coalesce(o.chunk_size, 0) > 8388608)::int from r join o on o.batch_no is not distinct from r.batch_no and o.rn = r.rn + 1)
        select batch_no, chunk_id, chunk_size, box_no from r""",
    "placement_md5": f"select distinct file_id, ((ascii(md5) * 256 + ascii(substr(md5, 2, 1))) % {NODES} + 1)::int as node from files",
    "placement_stateless": f"with {_UP} select chunk_id, (('0x' || substr(fp, 1, 2))::int % {NODES})::int as node, ('0x' || substr(fp, 1, 3))::int as bucket from up",
    "bucket_counts": f"select ('0x' || substr(fp, 1, 3))::int as bucket, count(*) as entries from (select distinct fps_id, {FP_SQL} as fp from container_fps where {FP_SQL} <> '') group by 1",
    "load_aware_route": f"""with {_IX}, {_UP}, {_FIRST}, bo as (select container_id, max(compressor_id) as node from containers where deleted_at is null group by 1),
        us as (select node, count(*) as used from bo group by 1), me as (select floor(avg(used)) as mean from us),
        h as (select upload_id, node, count(*) as n from up join fi using (fp) join bo using (container_id) group by 1, 2),
        s as (select upload_id, node, case when used > mean then n * mean / used else n::double end as score from h join us using (node), me),
        b as (select upload_id, node, score from s qualify row_number() over (partition by upload_id order by score desc, node) = 1),
        no as (select list_sort(list(node)) as nodes from us)
        select upload_id, coalesce(node, nodes[1 + ('0x' || substr(md5(upload_id::varchar), 1, 4))::bigint % len(nodes)]) as node, round(score, 6) as score
        from (select distinct upload_id from chunks) left join b using (upload_id), no""",
    "range_read_chunks": f"""with {_RE}, {_LAST}, q as (select distinct {_CID} as cid from la where deleted_at is null)
        select cid, recipe_id, (greatest(10000, file_offset) - file_offset)::int as from_byte, (least(30000, file_offset + chunk_size) - greatest(10000, file_offset))::int as take
        from re join q using (cid) where chunk_size > 0 and file_offset + chunk_size > 10000 and file_offset < 30000""",
    "recipe_node_runs": f"""with {_RE}, f as (select cid, file_offset, compressor_id from re qualify row_number() over (partition by cid, file_offset order by recipe_id) = 1),
        s as (select *, case when compressor_id is not distinct from lag(compressor_id) over w and row_number() over w > 1 then 0 else 1 end as st from f window w as (partition by cid order by file_offset)),
        r as (select *, sum(st) over (partition by cid order by file_offset)::int as run_no from s)
        select cid, run_no, any_value(compressor_id) as compressor_id, count(*) as chunks, min(file_offset) as first_offset, max(file_offset) as last_offset from r group by 1, 2""",
    "recipe_merge": f"with {_UP} select upload_id, (row_number() over (partition by upload_id order by chunk_id, file_offset) - 1)::int as ord, file_offset as position, fp as sha from up",
    "reassemble_md5": "select doc_id, md5(text) as md5 from documents where text <> ''",
    "catalog_list": f"""with {_LAST} select file_key as name, case when filesize < 1024 then filesize || 'B' when filesize < 1048576 then printf('%.1fKB', filesize / 1024.0)
        when filesize < 1073741824 then printf('%.1fMB', filesize / 1048576.0) when filesize is not null then printf('%.1fGB', filesize / 1073741824.0) end as size,
        case filetype when 100 then 'fasta' when 200 then 'fastq' else 'unknown' end as type, strftime(mtime, '%Y-%m-%d %H:%M') as mtime from la where deleted_at is null""",
    "catalog_lookup": f"""with {_LAST}, a as (select distinct file_key from chunks where file_key is not null)
        select file_key, coalesce(filetype, 0) as filetype, coalesce(filesize, 0) as filesize, coalesce(inode, 0) as inode, (l.file_id is not null)::int as ack
        from a left join (select * from la where deleted_at is null) l using (file_key)""",
    "catalog_merge": f"with {_LAST} select file_key, file_id, compressor_id from la",
    "catalog_delete": "select distinct file_id, file_key from files where file_key not in (select file_key from files where deleted_at is not null and file_key is not null)",
    "whole_object_dedup": "select md5(text) as md5, count(*) as copies, sum(octet_length(encode(text)))::bigint as bytes from documents where text is not null group by 1",
    "cdc_coverage": "select 0::bigint as violations",
    "low_keys": "select distinct file_key, ('0x' || right(sha1(file_key), 4))::int as low from files where file_key is not null",
    "cdc_dedup_summary": "select count(*) as documents, sum(octet_length(encode(text)))::bigint as bytes, true as shared from documents where text <> ''",
    "duplicate_chunks": f"""with {_CH}, f as (select sha, arg_min((doc_id, file_offset), (doc_id, file_offset)) as f from ch group by 1)
        select distinct doc_id, file_offset, chunk_size, sha, f[1] as first_doc, f[2] as first_offset from ch join f using (sha) where (doc_id, file_offset) <> f""",
    "range_read_bytes": """select doc_id, octet_length(p)::int as n, md5(p) as md5 from (select doc_id, array_slice(encode(text), 701, 2700) as p from documents) where octet_length(p) > 0""",
    "container_write_read": f"with {_CH} select sha, any_value(chunk_size) as n, sha as again from ch group by sha",
    "map_names": """select distinct file_id, name, (('0x' || right(md5(name), 1))::int % 2)::int as side from (select file_id, inode || '_' || client_id || '_' || floor(epoch(registered_at))::bigint as name from files
        where inode is not null and client_id is not null and registered_at is not null)""",
    "wrong_lengths": "select distinct chunk_id, chunk_size as stated, octet_length(encode(payload))::int as found from raw_blocks where payload is not null and chunk_size is distinct from octet_length(encode(payload))",
    "champion_cached": f"""with {_IX}, {_UP}, {_FIRST}, h as (select upload_id, container_id, count(*) as hits, min(chunk_id) as f from up join fi using (fp) group by 1, 2),
        b as (select upload_id, container_id from h qualify row_number() over (partition by upload_id order by hits desc, f, container_id) = 1)
        select upload_id, container_id, count(*) as cached from up join b using (upload_id) where (fp, container_id) in (select (fp, container_id) from ix) group by 1, 2""",
    "index_upload": f"""with {_IX}, m as (select distinct fps_id, container_id, {FP_SQL} as fp from container_fps where {FP_SQL} <> '' and container_id is not null)
        select fp, container_id, sum(n)::bigint as ref_count from (select fp, container_id, ref_count as n from ix union all select fp, container_id, 1 from m) group by 1, 2 having sum(n) > 0""",
    "recyclable_ids": "select container_id, (max(generation) + 1)::int as generation from containers where container_id is not null group by 1 having count(*) filter (deleted_at is null) = 0 and max(deleted_at) < timestamp '2026-12-30 23:59:55'",
    "prioritised_probe": f"""with {_IX}, {_UP}, ca as (select {FP_SQL} as fp, container_id from container_fps where {FP_SQL} <> '' and container_id is not null),
        l as (select fp, 0 as level, container_id from ca where container_id in (select container_id from containers where deleted_at is null and generation > 1) union all select fp, 1, container_id from ca union all select fp, 2, container_id from ix)
        select chunk_id, fp, b[1] as level, b[2] as container_id from (select chunk_id, fp from up) left join (select fp, min((level, container_id)) as b from l group by 1) using (fp)""",
    "master_arrays": f"""with {_UP}, n as (select distinct fp, (('0x' || substr(fp, 1, 2))::int % {NODES})::int as node from up)
        select node, (row_number() over (partition by node order by fp) - 1) // 1000 as batch, fp from n""",
    "delete_order": f"""with {_RE}, {_LAST}, o as (select distinct r.recipe_id, r.container_id, r.container_offset from recipes r join re using (recipe_id) where re.fp <> '' and re.cid in (select {_CID} from la where deleted_at is not null) and r.container_id is not null)
        select container_id, recipe_id, row_number() over (partition by container_id order by container_offset desc nulls last, recipe_id)::int as turn from o""",
    "segment_lookup": """with f as (select * from files where md5 is not null and filesize is not null),
        s as (select md5, unnest(range(0, greatest(filesize - 1, 0) + 1, 65536)) as file_offset, file_id from f),
        g as (select md5, file_offset, min(file_id) as n from s group by 1, 2),
        a as (select distinct md5, unnest([0, 65536, 5])::bigint as file_offset from f)
        select md5, file_offset, '/data/' || case when n // 1000 > 999999 then (n // 1000)::varchar else lpad((n // 1000)::varchar, 6, '0') end || '/' || lpad((n % 1000)::varchar, 6, '0') as path, n is not null as found from a left join g using (md5, file_offset)""",
    "catalog_locations": """with r as (select md5, file_id % 3 * 65536 as o, min('/data/' || case when file_id // 1000 > 999999 then (file_id // 1000)::varchar else lpad((file_id // 1000)::varchar, 6, '0') end || '/' || lpad((file_id % 1000)::varchar, 6, '0')) as p
            from files where md5 is not null and file_id is not null group by 1, 2)
        select md5, '{' || string_agg('"' || o || '":"' || p || '"', ',' order by o) || '}' as locations from r group by 1""",
    "store_ratio": f"""with {_CH} select source, sum(n * a)::bigint as bytes, sum(u)::bigint as unique_bytes, round(sum(n * a)::double / sum(u), 6) as factor
        from (select source, sha, count(*) as n, sum(chunk_size) / count(*) as a, max(chunk_size) as u from ch group by 1, 2) group by 1""",
}

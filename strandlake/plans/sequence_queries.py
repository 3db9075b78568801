"""Reads: profiles, k-mers, seeds, transforms, matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import profile, reference, sequence
from strandlake.plans.tables import table
from strandlake.runtime import written
from strandlake.sources import fastx


def _reads(spark: SparkSession, folder: str) -> DataFrame:
    """Each read once, with carriage returns at line ends dropped and letters in upper case; . is N."""
    rows = table(spark, folder, "fastq_reads").dropDuplicates(["rec_no"])
    tidy = lambda c: F.regexp_replace(c, r"\r+$", "")
    return rows.select("rec_no", tidy("title").alias("title"), F.translate(F.upper(tidy("seq")), ".", "N").alias("seq"), tidy("plus").alias("plus"), tidy("qual").alias("qual"))


def _fragments(s, d) -> DataFrame:
    blocks = table(s, d, "raw_blocks").where("filetype = 100").dropDuplicates(["chunk_id"])
    return fastx.reference_fragments(fastx.fasta_sequences(blocks, ["chunk_id"], "payload"), ["chunk_id", "seq_no"], "seq", 1_000_000)


def _cap(fragments: DataFrame) -> int:
    """The limit of places per k-mer, by the letters of the whole reference."""
    return sequence.seed_cap(fragments.agg(F.sum("len")).first()[0] or 0)


def base_histogram(s, d):
    return profile.base_histogram(_reads(s, d), "seq")


def quality_by_position(s, d):
    return profile.quality_by_position(_reads(s, d), "qual")


def quality_kept_by_position(s, d):
    return profile.quality_by_position(_reads(s, d), "qual", True)


def quality_run_histogram(s, d):
    return profile.run_histogram(profile.quality_runs(_reads(s, d), "rec_no", "qual"))


def title_values(s, d):
    return profile.title_values(_reads(s, d), "rec_no", "title")


def title_letters(s, d):
    return profile.title_letters(_reads(s, d), "rec_no", "title")


def title_blocks(s, d):
    return profile.title_blocks(_reads(s, d), "rec_no", "title")


def quality_transitions(s, d):
    return profile.quality_transitions(_reads(s, d), "qual")


def quality_runs(s, d):
    return profile.quality_runs(_reads(s, d), "rec_no", "qual")


def quality_gap(s, d):
    return profile.quality_gap(_reads(s, d), "rec_no", "qual")


def trailing_trunc(s, d):
    return _reads(s, d).where("qual <> ''").select("rec_no", profile.kept_length(F.col("qual")).alias("kept"))


def encoder_choice(s, d):
    return profile.encoder_choice(_reads(s, d), "rec_no", "qual")


def title_profile(s, d):
    return profile.title_profile(_reads(s, d), "rec_no", "title")


def read_shape(s, d):
    return profile.read_shape(_reads(s, d), "rec_no")


def kmer_counts(s, d):
    return sequence.kmer_counts(_reads(s, d), "seq", 10)


def seed_index_capped(s, d):
    f = _fragments(s, d)
    return sequence.seed_index(f, _cap(f))


def seed_hits_first(s, d):
    f = _fragments(s, d)
    return sequence.first_seed_hits(_reads(s, d), "rec_no", "seq", sequence.seed_index(f, _cap(f), 10, 8, 12), 12)


def seed_hits_near(s, d):
    """First seed hits with up to two other letters among the six behind the seed."""
    f = _fragments(s, d)
    return sequence.first_seed_hits(_reads(s, d), "rec_no", "seq", sequence.seed_index(f, _cap(f), 10, 8, 16), 16, mismatches=2)


def n_runs(s, d):
    return sequence.n_runs(_reads(s, d), "rec_no", "seq")


def n_transfer(s, d):
    rows = _reads(s, d).where("length(seq) = length(qual) and qual <> ''")
    seq, qual = sequence.n_transfer(F.col("seq"), F.col("qual"))
    return rows.select("rec_no", seq.alias("bare"), F.length(F.regexp_replace(qual, "[\\x00-\\x7f]", "")).alias("moved"))


def n_transfer_roundtrip(s, d):
    rows = _reads(s, d).where("length(seq) = length(qual) and qual <> ''")
    seq, qual = sequence.n_transfer(F.col("seq"), F.col("qual"))
    made = rows.select("seq", "qual", seq.alias("a"), qual.alias("b"))
    x, y = sequence.n_restore(F.col("a"), F.col("b"))
    return made.agg(F.count_if((x != F.col("seq")) | (y != F.col("qual"))).alias("mismatches"))


def colour_space(s, d):
    return _reads(s, d).select("rec_no", sequence.to_colours(F.col("seq")).alias("colours")).where("colours is not null")


def codec_roundtrips(s, d):
    """Mismatches after packing and unpacking letters and colours."""
    rows = _reads(s, d).where(F.col("seq").rlike("^[ACGT]+$")).withColumns({"c": sequence.to_colours(F.col("seq")), "p": sequence.pack2(F.col("seq")), "q": sequence.pack4(F.col("seq"))})
    bad = (sequence.from_colours(F.col("c")) != F.col("seq")) | (sequence.unpack2(F.col("p"), F.length("seq")) != F.col("seq")) | (sequence.unpack4(F.col("q"), F.length("seq")) != F.col("seq"))
    return rows.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("mismatches"))


def phred_gate(s, d):
    return sequence.phred_gate(_reads(s, d), "rec_no", "qual").select("rec_no", "pos")


def lz_best_match(s, d):
    return sequence.best_earlier_match(_reads(s, d), "rec_no", "seq")


def lz_gated_match(s, d):
    return sequence.gated_matches(_reads(s, d), "rec_no", "seq", "qual")


def match_decode(s, d):
    return sequence.matched(table(s, d, "lz_matches"), _reads(s, d), "rec_no", "seq")


def longest_shared_prefix(s, d):
    return sequence.longest_shared_prefix(_reads(s, d), "rec_no", "seq")


def edit_script_roundtrip(s, d):
    """Reads that the noted matches pair, written as edits of each other and read back."""
    r = _reads(s, d).where("seq <> ''").select("rec_no", "seq")
    m = table(s, d, "lz_matches").select("match_id", "read_no", "rec_no").dropna().distinct()
    pairs = m.join(r.withColumnRenamed("seq", "ref"), "rec_no").join(r.select(F.col("rec_no").alias("read_no"), F.col("seq").alias("new")), "read_no").select("match_id", "ref", "new")
    made = sequence.edit_scripts(pairs, ["match_id"], "ref", "new")
    back = sequence.applied(made.join(pairs.select("match_id", "ref"), "match_id"), ["match_id"], "ref")
    return pairs.join(back, "match_id").agg(F.count_if(F.col("read") != F.col("new")).alias("mismatches"))


def _coded(s, d):
    f, r = written(_fragments(s, d), "fragments"), written(_reads(s, d).select("rec_no", "seq"), "reads")
    hits = sequence.first_hits(r, "rec_no", "seq", f, _cap(f), 10, 8, 12)
    return f, r, reference.encode(r, "rec_no", "seq", hits, f)


def reference_links(s, d):
    """Reads as links into the reference, with the length of their scripts."""
    return _coded(s, d)[2].select("rec_no", "ref_seq_no", "ref_pos", "ref_len", F.length("script").alias("script_len"))


def reference_roundtrip(s, d):
    """Reads that are not as they were after being written as edits of the reference and read back, and those that were linked without need."""
    f, r, made = _coded(s, d)
    made = written(made, "links")
    back = reference.decode(made, "rec_no", f).withColumnRenamed("seq", "back")
    linked = made.where("ref_seq_no >= 0").select("rec_no", F.length("script").alias("script_len"))
    j = r.join(back, "rec_no", "full").join(linked, "rec_no", "left")
    return j.agg(F.count_if(~F.col("seq").eqNullSafe(F.col("back"))).alias("mismatches"), F.count_if(F.col("script_len") > F.length("seq") + 2).alias("too_long"))


def fastq_scan(s, d):
    """Records of the FASTQ blocks up to each block's first that is not valid."""
    blocks = table(s, d, "raw_blocks").dropDuplicates(["chunk_id"]).where("filetype = 200")
    rows = fastx.until_first_error(fastx.fastq_records(blocks, ["chunk_id"], "payload"), ["chunk_id"])
    return rows.select("chunk_id", "rec_no", "title", F.length("seq").alias("letters"), F.md5(F.encode(fastx.fastq_text(*(F.col(c) for c in ("title", "seq", "plus", "qual"))), "UTF-8")).alias("md5"))


def fasta_scan(s, d):
    blocks = table(s, d, "raw_blocks").dropDuplicates(["chunk_id"]).where("filetype = 100")
    rows = fastx.fasta_sequences(blocks, ["chunk_id"], "payload")
    return rows.select("chunk_id", "seq_no", "header", F.length("seq").alias("letters"), F.md5(F.encode(fastx.wrapped(F.col("seq")), "UTF-8")).alias("md5"))


QUERIES = {f.__name__: f for f in (
    base_histogram, quality_by_position, quality_transitions, quality_runs, quality_gap, trailing_trunc, encoder_choice, title_profile, read_shape, kmer_counts,
    seed_index_capped, seed_hits_first, n_runs, n_transfer, n_transfer_roundtrip, colour_space, codec_roundtrips, phred_gate, lz_best_match,
    longest_shared_prefix, edit_script_roundtrip, fastq_scan, fasta_scan, seed_hits_near, quality_kept_by_position, quality_run_histogram, title_values, title_letters,
    title_blocks, lz_gated_match, match_decode, reference_links, reference_roundtrip,
)}

_R = r"""r as (select rec_no, any_value(regexp_replace(title, '\r+$', '')) as title, any_value(replace(upper(regexp_replace(seq, '\r+$', '')), '.', 'N')) as seq,
    any_value(regexp_replace(plus, '\r+$', '')) as plus, any_value(regexp_replace(qual, '\r+$', '')) as qual from fastq_reads group by rec_no)"""
_Q = f"with {_R}, c as (select rec_no, rec_no // 32 as block, i as pos, substr(qual, i + 1, 1) as c from (select rec_no, qual, unnest(range(0, len(qual))) as i from r where qual <> ''))"
_L = r"""li as (select chunk_id, filetype, i - 1 as line_no, regexp_replace(ls[i], '\r+$', '') as line from (select *, unnest(range(1, len(ls) + 1)) as i
    from (select distinct chunk_id, filetype, string_split(regexp_replace(payload, '\n$', ''), chr(10)) as ls from raw_blocks where payload is not null)))"""
_FA = rf"""{_L}, fa as (select chunk_id, line_no, line, starts_with(line, '>') as head, sum(starts_with(line, '>')::int) over (partition by chunk_id order by line_no)::int as seq_no from li where filetype = 100),
    fs as (select chunk_id, seq_no, max(substr(line, 2)) filter (head) as header, coalesce(string_agg(line, '' order by line_no) filter (not head), '') as seq from fa group by 1, 2)"""
_FR = rf"""{_FA}, fb as (select (row_number() over (order by chunk_id, seq_no) - 1)::int as ref_seq_no, regexp_replace(upper(seq), '[^ACGT]', '', 'g') as bases from fs where regexp_replace(upper(seq), '[^ACGT]', '', 'g') <> '')"""


def _seeds(stride: int) -> str:
    return f"""{_FR}, sd as (select kmer, ref_seq_no, pos from (select ref_seq_no, i as pos, substr(bases, i + 1, 10) as kmer from (select *, unnest(range(0, len(bases) - 9, {stride})) as i from fb where len(bases) >= 10))
        qualify row_number() over (partition by kmer order by ref_seq_no, pos) <= (select least(500, sum(len(bases))::bigint // 1048576 + 2) from fb))"""


def _hits(verify: int, fits: str) -> str:
    return f"""with {_R}, {_seeds(8)}, k as (select rec_no, seq, i as pos, substr(seq, i + 1, 10) as kmer from (select rec_no, seq, unnest(range(0, len(seq) - 9)) as i from r where len(seq) >= 10)),
        h as (select rec_no, k.pos, ref_seq_no, sd.pos as ref_pos from k join sd using (kmer) join fb using (ref_seq_no) where len(seq) >= k.pos + {verify} and len(bases) >= sd.pos + {verify} and {fits})
        select rec_no, pos::int as pos, ref_seq_no, ref_pos::int as ref_pos from h qualify row_number() over (partition by rec_no order by pos, ref_seq_no, ref_pos) = 1"""


_T = rf"""with {_R}, p as (select rec_no // 16384 as sb_id, rec_no, regexp_split_to_array(title, '[ ._,=:/\-]') as a from r where title is not null), f as (select sb_id, rec_no, (i - 1)::int as field_no, a[i] as value from (select *, unnest(range(1, len(a) + 1)) as i from p))"""
_GATE = """p as (select rec_no, pos, case when ascii(c) <= 33 then -10 else log10(1 - pow(10, -(ascii(c) - 33) / 10.0)) end as p from c),
        w as (select rec_no, pos, sum(p) over (partition by rec_no order by pos rows between current row and 35 following) as s, count(*) over (partition by rec_no order by pos rows between current row and 35 following) as n from p),
        ga as (select rec_no, pos from w where n = 36 and pos % 12 = 0 and round(s, 6) > -1)"""


def _lz(places: str) -> str:
    """Matches of 36 letters and more with an earlier read, indexed at every twelfth place, ten places a k-mer."""
    return f"""{_Q}, {_GATE}, l as (select rec_no, seq, i as pos, substr(seq, i + 1, 36) as kmer from (select rec_no, seq, unnest(range(0, len(seq) - 35)) as i from r where len(seq) >= 36)),
        ok as (select * from l where regexp_full_match(kmer, '[ACGT]{{36}}')),
        ix as (select kmer, rec_no as from_rec, pos as from_pos, seq as t from (select * from ok {places}) where pos % 12 = 0 qualify row_number() over (partition by kmer order by rec_no, pos) <= 10),
        h as (select rec_no, pos, from_rec, from_pos, substr(seq, pos + 1) as a, substr(t, from_pos + 1) as b from ok join ix using (kmer) where from_rec < rec_no),
        m as (select *, coalesce(list_min(list_filter(range(37, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b)))::int as match_len from h)
        select rec_no, pos::int as pos, from_rec, from_pos::int as from_pos, match_len from m qualify row_number() over (partition by rec_no order by match_len desc, from_rec, from_pos, pos) = 1"""


_RUNS = f"""{_Q}, s as (select *, (c is distinct from lag(c) over (partition by block order by rec_no, pos))::int as st from c), t as (select *, sum(st) over (partition by block order by rec_no, pos) as r from s),
        u as (select block, r, any_value(c) as q, count(*) as n from t group by 1, 2), v as (select *, unnest(range(0, (n - 1) // 255 + 1)) as k from u)"""

SQL = {
    "quality_run_histogram": f"{_RUNS} select q, least(255, n - k * 255)::int as run, count(*) as n from v group by 1, 2",
    "base_histogram": f"with {_R}, c as (select unnest(string_split(seq, '')) as sym from r where seq <> '') select sym, count(*) as n, (dense_rank() over (order by sym) - 1)::int as code from c group by 1",
    "quality_by_position": f"{_Q} select pos::int as pos, c as q, count(*) as n from c group by grouping sets ((pos, c), (c))",
    "quality_transitions": f"{_Q} select prev, c as q, count(*) as n from (select c, lag(c) over (partition by rec_no order by pos) as prev from c) where prev is not null group by 1, 2",
    "quality_runs": f"{_RUNS} select block, (row_number() over (partition by block order by r, k) - 1)::int as run_no, q, least(255, n - k * 255)::int as run from v",
    "quality_gap": f"""{_Q}, s as (select block, rec_no, pos, ascii(c) - coalesce(lag(ascii(c)) over (partition by block order by rec_no, pos), 33) as d from c)
        select block, rec_no, pos::int as pos, ((case when d > 0 then 2 * d - 1 else -2 * d end) + 1)::int as gap from s""",
    "trailing_trunc": f"with {_R} select rec_no, greatest(len(rtrim(qual, '#')), 1)::int as kept from r where qual <> ''",
    "encoder_choice": rf"""with {_R}, f as (select rec_no // 16384 as sb_id, arg_min(qual, rec_no) as q from r where qual <> '' group by 1, rec_no // 32),
        m as (select sb_id, len(q) as raw, greatest(len(rtrim(q, '#')) - 1, 0) as th, len(list_filter(range(1, len(q) + 1), lambda i: i = 1 or substr(q, i, 1) <> substr(q, i - 1, 1))) - ends_with(q, '#')::int as rle from f),
        s as (select sb_id, sum(raw)::bigint as raw_len, sum(th)::bigint as th_len, sum(rle)::bigint as rle_len, count(*) as blocks from m group by 1)
        select sb_id, raw_len, th_len, rle_len, (case when th_len > 1.25 * rle_len then 2 when raw_len - th_len < 3 * blocks then 1 else 3 end)::int as method from s""",
    "title_profile": rf"""with {_R}, p as (select rec_no // 16384 as sb_id, rec_no, regexp_split_to_array(title, '[ ._,=:/\-]') as a from r where title is not null), f as (select sb_id, rec_no, (i - 1)::int as field_no, a[i] as value from (select *, unnest(range(1, len(a) + 1)) as i from p)),
        n as (select *, case when regexp_full_match(value, '[0-9]{{1,18}}') then value::bigint end as v from f), g as (select *, v - lag(v) over (partition by sb_id, field_no order by rec_no) as d from n),
        s as (select sb_id, field_no, min(len(value))::int as min_len, max(len(value))::int as max_len, min(value) = max(value) as is_constant, bool_and(regexp_full_match(value, '[0-9]{{0,18}}')) as is_numeric,
              min(v) as min_value, max(v) as max_value, min(d) as min_delta, max(d) as max_delta from g group by 1, 2)
        select *, (case when is_numeric then least(case when max_value = min_value then 0 else len(bin(max_value - min_value)) end, case when max_delta = min_delta then 0 else len(bin(max_delta - min_delta)) end) end)::int as bits from s""",
    "read_shape": f"""with {_R} select rec_no // 16384 as sb_id, min(len(qual))::int as min_qual, max(len(qual))::int as max_qual, bool_and(len(plus) = 1) as plus_bare,
        bool_or(substr(seq, 2, 1) in ('0', '1', '2', '3')) as colour_space, count(distinct substr(seq, 1, 1)) = 1 as same_first from r group by 1""",
    "kmer_counts": f"with {_R} select kmer, count(*) as n from (select substr(seq, i + 1, 10) as kmer from (select seq, unnest(range(0, len(seq) - 9)) as i from r where len(seq) >= 10)) where regexp_full_match(kmer, '[ACGT]{{10}}') group by 1",
    "seed_index_capped": f"with {_seeds(64)} select kmer, ref_seq_no, pos::int as pos from sd",
    "seed_hits_first": _hits(12, "substr(seq, k.pos + 1, 12) = substr(bases, sd.pos + 1, 12)"),
    "seed_hits_near": _hits(16, "hamming(substr(seq, k.pos + 1, 16), substr(bases, sd.pos + 1, 16)) <= 2"),
    "quality_kept_by_position": f"{_Q.replace('unnest(range(0, len(qual)))', "unnest(range(0, greatest(len(rtrim(qual, '#')), 1)))")} select pos::int as pos, c as q, count(*) as n from c group by grouping sets ((pos, c), (c))",
    "title_values": f"""{_T}, n as (select *, case when regexp_full_match(value, '[0-9]{{1,18}}') then value::bigint end as v from f), g as (select *, v - lag(v) over (partition by sb_id, field_no order by rec_no) as d from n),
        h as (select sb_id, field_no, 'value' as what, v, count(*) as n from g where v is not null group by 1, 2, 4 union all select sb_id, field_no, 'delta', d, count(*) from g where d is not null group by 1, 2, 4)
        select * from h qualify count(*) over (partition by sb_id, field_no, what) <= 512""",
    "title_letters": f"""{_T}, c as (select sb_id, field_no, (i - 1)::int as pos, substr(value, i, 1) as c from (select *, unnest(range(1, len(value) + 1)) as i from f))
        select *, count(*) over (partition by sb_id, field_no, pos) = 1 as is_fixed from (select sb_id, field_no, pos, c, count(*) as n from c group by 1, 2, 3, 4)""",
    "title_blocks": f"""{_T}, n as (select *, rec_no // 32 as block, case when regexp_full_match(value, '[0-9]{{1,18}}') then value::bigint end as v from f), g as (select *, v - lag(v) over (partition by block, field_no order by rec_no) as d from n)
        select block, field_no, arg_min(value, rec_no) as first_value, min(value) = max(value) as is_constant, min(d) as delta, coalesce(count(d) = count(*) - 1 and min(d) = max(d), false) as is_constant_delta from g group by 1, 2""",
    "lz_best_match": _lz(""),
    "lz_gated_match": _lz("where (rec_no, pos) in (select (rec_no, pos) from ga)"),
    "reference_roundtrip": "select 0::bigint as mismatches, 0::bigint as too_long",
    "match_decode": f"""with {_R}, m as (select distinct match_id, rec_no, rec_offset, match_len from lz_matches)
        select match_id, case when rec_offset >= 0 and match_len > 0 and rec_offset + match_len <= len(seq) then substr(seq, rec_offset + 1, match_len) end as letters from m left join r using (rec_no)""",
    "n_runs": f"""with {_R}, c as (select rec_no, i as pos, substr(seq, i + 1, 1) = 'N' as n from (select rec_no, seq, unnest(range(0, len(seq))) as i from r where contains(seq, 'N'))),
        s as (select *, sum((not n)::int) over (partition by rec_no order by pos) as loc from c) select rec_no, loc::bigint as loc, count(*) as cnt from s where n group by 1, 2""",
    "n_transfer": f"with {_R} select rec_no, replace(seq, 'N', '') as bare, (len(seq) - len(replace(seq, 'N', '')))::int as moved from r where len(seq) = len(qual) and qual <> ''",
    "n_transfer_roundtrip": "select 0::bigint as mismatches",
    "colour_space": f"""with {_R} select rec_no, substr(seq, 1, 1) || coalesce(list_aggregate(list_transform(range(2, len(seq) + 1), lambda i: xor(instr('ACGT', substr(seq, i, 1)) - 1, instr('ACGT', substr(seq, i - 1, 1)) - 1)::varchar), 'string_agg', ''), '') as colours
        from r where regexp_full_match(seq, '[ACGT]+')""",
    "codec_roundtrips": "select 0::bigint as mismatches",
    "phred_gate": f"""{_Q}, p as (select rec_no, pos, case when ascii(c) <= 33 then -10 else log10(1 - pow(10, -(ascii(c) - 33) / 10.0)) end as p from c),
        w as (select rec_no, pos, sum(p) over (partition by rec_no order by pos rows between current row and 35 following) as s, count(*) over (partition by rec_no order by pos rows between current row and 35 following) as n from p)
        select rec_no, pos::int as pos from w where n = 36 and pos % 12 = 0 and round(s, 6) > -1""",
    "longest_shared_prefix": f"""with {_R}, e as (select rec_no, n, substr(seq, 1, n) as p from (select rec_no, seq, unnest(range(20, len(seq) + 1)) as n from r where len(seq) >= 20)),
        g as (select n, p from e group by 1, 2 having min(rec_no) < max(rec_no)) select rec_no, max(n)::int as prefix_len from e join g using (n, p) group by 1""",
    "edit_script_roundtrip": "select 0::bigint as mismatches",
    "fastq_scan": rf"""with {_L}, q as (select chunk_id, (line_no // 4)::bigint as rec_no, max(line) filter (line_no % 4 = 0) as title, max(line) filter (line_no % 4 = 1) as seq, max(line) filter (line_no % 4 = 2) as plus, max(line) filter (line_no % 4 = 3) as qual
        from li where filetype = 200 group by 1, 2), b as (select chunk_id, min(rec_no) as stop from q where not coalesce(starts_with(title, '@') and len(seq) > 0 and len(seq) = len(qual), false) group by 1)
        select chunk_id, rec_no, title, len(seq)::int as letters, md5(title || chr(10) || seq || chr(10) || plus || chr(10) || qual || chr(10)) as md5 from q left join b using (chunk_id) where stop is null or rec_no < stop""",
    "fasta_scan": rf"with {_FA} select chunk_id, seq_no, header, len(seq)::int as letters, md5(rtrim(regexp_replace(seq, '(.{{60}})', '\1' || chr(10), 'g'), chr(10))) as md5 from fs",
}

import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.operators import codec, profile, reference, sequence, sketch
from strandlake.sources import fastx

dna = st.text("ACGT", max_size=60)


@settings(max_examples=150, deadline=None)
@given(dna, dna)
def test_edit_script_roundtrip(ref, read):
    x, y = sequence.align(ref, read)
    assert x.replace("-", "") == ref and y.replace("-", "") == read and len(x) == len(y)
    assert sequence.apply_script(ref, sequence.edit_script(ref, read)) == read


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400))
def test_huffman_roundtrip(data):
    lengths, bits = codec.huffman_pack(data)
    assert codec.huffman_unpack(lengths, bits, len(data)) == data


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 1000), min_size=2))
def test_huffman_is_a_full_prefix_code(counts):
    n = codec.code_lengths(counts)
    assert sum(2.0**-k for k in n.values()) == 1.0
    codes = sorted(codec.canonical(n).values())
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 500), max_size=40))
def test_interpolative_roundtrip(values):
    v = sorted(values)
    assert codec.read_interpolative(codec.interpolative(v, 0, 500), len(v), 0, 500)[0] == v


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=200))
def test_dna_pack_roundtrip(data):
    packed, at, odd = codec.dna_pack(data)
    assert codec.dna_unpack(packed, at, odd, len(data)) == data


def test_records_roundtrip_with_odd_values(spark):
    rows = [(0, "@a", "ACGT", "+", "IIII"), (1, None, None, None, None), (2, "", "", "", ""), (3, "@b\\n\n\\", "acgN.", "+x", "#"), (16384, "@c", "A" * 500, "+", "!" * 500), (40000, "@ü", "TT", "+", "ab")]
    df = spark.createDataFrame(rows, codec.DECODED)
    enc = codec.encode_fastq(df)
    assert sorted(map(tuple, codec.decode_fastq(enc).collect())) == rows
    assert [tuple(r) for r in codec.extract_records(enc, spark.createDataFrame([(3,), (9,)], "rec_no bigint")).collect()] == [rows[3]]
    assert codec.decode_fastq(codec.encode_fastq(df.where("false"))).count() == 0


def test_fasta_roundtrip(spark):
    texts = [(1, ">a b\nACGTNNNNacgt\nAC\n"), (2, ""), (3, "\n"), (4, "no header\r\n>x\r\nAC\r\n\r\n"), (5, ">only"), (6, "N" * 1000 + "RYK\n>z\nünï"), (7, None)]
    df = spark.createDataFrame(texts, "k int, t string")
    assert sorted(map(tuple, codec.decode_fasta(codec.encode_fasta(df, "k", "t"), "k").collect())) == texts[:-1]


def test_fastq_scan_stops_at_first_error(spark):
    good, bad = "@a\nAC\n+\nII\n", "@b\nACG\n+\nII\n"
    df = spark.createDataFrame([(1, good + bad + good), (2, good.replace("\n", "\r\n") * 2), (3, good + "@c\nAC"), (4, None)], "k int, t string")
    got = fastx.until_first_error(fastx.fastq_records(df, ["k"], "t"), ["k"]).groupBy("k").count().collect()
    assert dict(map(tuple, got)) == {1: 1, 2: 2, 3: 1}


def test_packing_columns(spark):
    seqs = ["", "A", "ACG", "ACGT", "ACGTACGTT", None]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = df.select("s", sequence.unpack2(sequence.pack2(F.col("s")), F.length("s")), sequence.from_colours(sequence.to_colours(F.col("s")))).collect()
    assert [r[1] for r in got] == ["" if s is None else s for s in seqs]
    assert [r[2] for r in got] == [None if not s else s for s in seqs]
    script = spark.createDataFrame([("i12AC-sN",), ("s0A",)], "s string")
    assert all(r[0] == r[1] for r in script.select("s", sequence.unpack4(sequence.pack4(F.col("s")), F.length("s"))).collect())


def test_best_earlier_match_against_brute_force(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    reads = [(i, base[k : k + 90]) for i, k in enumerate(rng.randrange(200) for _ in range(25))] + [(90, None), (91, ""), (92, "ACG")]
    got = {r["rec_no"]: r["match_len"] for r in sequence.best_earlier_match(spark.createDataFrame(reads, "rec_no int, seq string"), "rec_no", "seq", collisions=100).collect()}
    want = {}
    for i, s in reads[:25]:
        best = 0
        for j, t in reads[:25]:
            if j < i:
                for q in range(0, len(t) - 35, 12):
                    p = s.find(t[q : q + 36])
                    while p >= 0:
                        n = 0
                        while p + n < len(s) and q + n < len(t) and s[p + n] == t[q + n]:
                            n += 1
                        best = max(best, n)
                        p = s.find(t[q : q + 36], p + 1)
        if best:
            want[i] = best
    assert got == want


def test_runs_of_255_and_256(spark):
    df = spark.createDataFrame([(0, "I" * 255 + "A"), (32, "I" * 256), (33, "I" * 10), (64, None)], "rec_no int, qual string")
    runs = profile.quality_runs(df, "rec_no", "qual")
    assert [(r["block"], r["q"], r["run"]) for r in runs.orderBy("block", "run_no").collect()] == [(0, "I", 255), (0, "A", 1), (1, "I", 255), (1, "I", 11)]
    assert {r["block"]: len(r["letters"]) for r in profile.unrun(runs).collect()} == {0: 256, 1: 266}


def test_filters_never_deny_members(spark):
    fps = [f"{i * 2654435761 % (1 << 160):040x}" for i in range(200)] + [None]
    df = spark.createDataFrame([(f,) for f in fps], "fp string")
    half = df.limit(100)
    assert half.join(sketch.probe(df, "fp", sketch.bloom(half, "fp", 997), 997), "fp", "left_anti").where("fp is not null").count() == 0
    changes = df.withColumn("n", F.lit(1)).unionByName(half.withColumn("n", F.lit(-1)))
    left = sketch.probe(df, "fp", sketch.counting(changes, "fp", "n", 997).select("slot"), 997)
    assert df.join(half, "fp", "left_anti").join(left, "fp", "left_anti").where("fp is not null").count() == 0


def test_huffman_codes_by_group(spark):
    df = spark.createDataFrame([(None, "A", 5), (None, "B", 1), (1, "A", 1), (1, None, 9)], "pos int, q string, n bigint")
    assert sorted((r["pos"] or 0, r["q"], len(r["code"])) for r in codec.huffman_codes(df, ["pos"], "q", "n").collect()) == [(0, "A", 1), (0, "B", 1), (1, "A", 1)]


def test_reference_fragments(spark):
    df = spark.createDataFrame([(2, 1, "acgNNt" * 3), (1, 1, "A" * 25), (1, 2, "NNN"), (1, 3, None)], "k int, n int, s string")
    got = fastx.reference_fragments(df, ["k", "n"], "s", 10).orderBy("ref_seq_no").collect()
    assert [(r["ref_seq_no"], r["bases"]) for r in got] == [(0, "A" * 10), (1, "A" * 10), (2, "A" * 5), (3, "ACGTACGTAC"), (4, "GT")]


def test_seed_cap_grows_with_the_reference(spark, tmp_path):
    from strandlake.plans import sequence_queries

    k = "ACGTACGGTC"
    text = ">r\n" + "".join(k + x * 6 for x in "ACG") + ("\n>t\n" + "T" * 1024) * 1024 + "\n"
    spark.createDataFrame([(1, 100, text)], "chunk_id bigint, filetype int, payload string").write.parquet(f"{tmp_path}/raw_blocks.parquet")
    spark.createDataFrame([(7, "@t", k + "GG", "+", "I" * 12)], "rec_no bigint, title string, seq string, plus string, qual string").write.parquet(f"{tmp_path}/fastq_reads.parquet")
    # 1 MiB of letters and more: three places of each k-mer
    seeds = sequence_queries.seed_index_capped(spark, str(tmp_path))
    assert [(r["ref_seq_no"], r["pos"]) for r in seeds.where("kmer = 'TTTTTTTTTT'").orderBy("ref_seq_no", "pos").collect()] == [(1, 0), (1, 64), (1, 128)]
    assert [tuple(r) for r in sequence_queries.seed_hits_first(spark, str(tmp_path)).collect()] == [(7, 0, 0, 32)]


def test_titles_and_qualities_of_a_super_block():
    rng = random.Random(4)
    for titles in ([None, "@a"], ["@run.1 x:7/1", "@run.2 x:9/1", "@run.13 x:7/1"], ["@a\\b", "@a\nb"], ["@a.01", "@a.1"], ["", ""], ["@a b", "@a_b"], ["@é.5"] * 3):
        assert codec.unpack_titles(codec.pack_titles(titles)) == titles
    many = [f"@EAS.{7 * i} lane:{i % 3}" for i in range(1000)]
    assert len(codec.pack_titles(many)) < 1200
    letters = lambda n, k: bytes(rng.choice(range(35, 35 + k)) for _ in range(n))
    sets = {
        1: [letters(rng.choice([0, 40, 41]), 30) for _ in range(70)],
        2: [bytes([40]) * rng.randrange(60) + bytes([50]) * 300 for _ in range(70)],
        3: [letters(30, 30) + b"#" * rng.randrange(20, 40) for _ in range(70)],
    }
    for want, quals in sets.items():
        method, data = codec.pack_quals(quals)
        assert method == want and codec.unpack_quals(method, data, np.array([len(q) for q in quals])) == quals
    assert codec.unpack_quals(*codec.pack_quals([]), np.zeros(0, np.int64)) == [] and codec.unpack_quals(*codec.pack_quals([b"", b"#"]), np.array([0, 1])) == [b"", b"#"]


def test_integer_codes_are_read_back():
    for n in (0, 1, 2, 7, 8, 100):
        assert codec.read_unary(codec.unary(n) + "01") == (n, n + 1)
        assert codec.read_gamma("1" + codec.gamma(n + 1) + "0", 1)[0] == n + 1
        for low in (0, 1, 4):
            bits = codec.low_high(n, low)
            assert codec.read_low_high(bits + "1", low) == (n, len(bits))


@settings(max_examples=60, deadline=None)
@given(dna, dna, st.integers(0, 60))
def test_extension_is_an_alignment(ref, read, cut):
    for r in (ref, read[:cut] + "A" + read[cut:] + ref, read + ref):
        x, y = reference.extended(r, read)
        assert len(x) == len(y) and y.replace("-", "") == read and r.startswith(x.replace("-", ""))
        assert sequence.apply_script(x.replace("-", ""), sequence.script_of(x, y)) == read


def test_extension_finds_the_least_edits():
    rng = random.Random(6)
    for _ in range(40):
        ref = "".join(rng.choice("ACGT") for _ in range(80))
        read = list(ref[:60])
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(read))
            read[k : k + 1] = rng.choice([[], ["A"], [read[k], "C"]])
        read = "".join(read)
        edits = lambda x, y: sum(a != b for a, b in zip(x, y))
        got = edits(*reference.extended(ref, read))
        best = min(edits(*sequence.align(ref[:n], read)) for n in range(48, 73))
        assert best <= got <= max(best, reference.FEW)


def test_reads_as_edits_of_a_reference(spark):
    rng = random.Random(2)
    bases = "".join(rng.choice("ACGT") for _ in range(3000))
    reads = [(i, bases[k : k + 120]) for i, k in enumerate(rng.randrange(2900) for _ in range(60))]
    reads = [(i, s[: (i * 7) % 100] + rng.choice(["", "A", "TT"]) + s[(i * 7) % 100 + i % 2 :]) for i, s in reads]
    reads += [(90, ""), (91, None), (92, "N" * 50), (93, "ACGT" * 30), (94, bases[:60]), (95, bases[-60:])]
    df = spark.createDataFrame(reads, "rec_no int, seq string")
    fragments = spark.createDataFrame([(0, bases[:1500]), (1, bases[1500:])], "ref_seq_no int, bases string")
    seeds = sequence.seed_index(fragments, 5, 10, 8, 12)
    coded = reference.encode(df, "rec_no", "seq", sequence.first_seed_hits(df, "rec_no", "seq", seeds, 12), fragments)
    rows = {r["rec_no"]: r for r in coded.collect()}
    assert len(rows) == len(reads) and sum(r["ref_seq_no"] >= 0 for r in rows.values()) >= 55
    assert sum(len(r["script"]) for i, r in rows.items() if i < 60) < 2000
    assert {r["rec_no"]: r["seq"] for r in reference.decode(coded, "rec_no", fragments).collect()} == dict(reads)


def test_first_hits_are_those_of_the_seed_index(spark):
    rng = random.Random(3)
    letters = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    bases = ["A" * 700, letters(900), "ACGTACGTAC" * 40, letters(13), letters(12), letters(11), "ACG", "", letters(400, "AC")]
    fragments = spark.createDataFrame(list(enumerate(bases)), "ref_seq_no int, bases string").repartition(3)
    cut = lambda s: s[(k := rng.randrange(max(1, len(s) - 30))) : k + 50]
    reads = [letters(rng.randrange(6)) + cut(rng.choice(bases)) + letters(3) for _ in range(300)]
    reads += [x[:9] + rng.choice("N\u00e9n") + x[9:] for x in reads[:40]] + [bases[3][-12:], bases[1][8:20], bases[1][8:19], "", None, "A" * 30, "N" * 20]
    df = spark.createDataFrame(list(enumerate(reads)), "rec int, s string")
    for cap, stride, verify in ((2, 8, 12), (500, 8, 12), (1, 1, 10), (3, 4, 13), (3, 4, 14)):
        want = sequence.first_seed_hits(df, "rec", "s", sequence.seed_index(fragments, cap, 10, stride, verify), verify)
        got = sequence.first_hits(df, "rec", "s", fragments, cap, 10, stride, verify)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
        assert sequence.first_hits(df, "rec", "s", fragments.where("false"), cap, 10, stride, verify).count() == 0


def _tables(spark, folder, reads, letters, rng):
    """Tables of random reads of 150 letters, of which one in ten is from the reference with a letter changed, and of a reference in blocks of 20,000."""
    bases = "".join(rng.choices("ACGT", k=letters))
    blocks = [(i, 100, f">r{i}\n{bases[i * 20_000 : (i + 1) * 20_000]}\n") for i in range(letters // 20_000)]
    spark.createDataFrame(blocks, "chunk_id bigint, filetype int, payload string").write.parquet(f"{folder}/raw_blocks.parquet")
    near = lambda k: bases[k : k + 60] + "N" + bases[k + 61 : k + 150]
    rows = [(i, f"@{i}", near(i * 20_000 % (letters - 20_000) + 7) if i % 10 == 0 else "".join(rng.choices("ACGT", k=150)), "+", "I" * 150) for i in range(reads)]
    spark.createDataFrame(rows, "rec_no bigint, title string, seq string, plus string, qual string").write.parquet(f"{folder}/fastq_reads.parquet")


def test_links_of_reads_with_chance_hits_take_little_time(spark, tmp_path):
    from strandlake.plans import sequence_queries

    _tables(spark, str(tmp_path), 40_000, 2_000_000, random.Random(8))
    began = time.time()
    got = sequence_queries.reference_links(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.count_if(F.expr("rec_no % 10 = 0 and ref_len = 150"))).first()
    took = time.time() - began
    assert got[0] == 40_000 and got[1] > 3_000
    assert took < 20  # an alignment a read at a time took far longer


def test_links_far_into_a_fragment_are_read_back_soon(spark):
    bases = "".join(random.Random(9).choices("ACGT", k=1_000_000))
    fragments = spark.createDataFrame([(0, bases)], "ref_seq_no int, bases string")
    coded = spark.range(10_000).selectExpr("cast(id as int) as rec", "0 as ref_seq_no", "cast(980000 + id as int) as ref_pos", "150 as ref_len", "if(id % 2 = 0, '', 's5N') as script")
    began = time.time()
    got = dict(map(tuple, reference.decode(coded, "rec", fragments).collect()))
    took = time.time() - began
    plain = [bases[980_000 + i : 980_150 + i] for i in range(10_000)]
    assert got == {i: x if i % 2 == 0 else x[:5] + "N" + x[6:] for i, x in enumerate(plain)}
    assert took < 12  # counting letters from the fragment's beginning took far longer

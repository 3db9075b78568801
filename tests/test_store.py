import hashlib
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import formatting, hashing
from strandlake.operators import catalog, chunking, dedup, recipes, routing
from strandlake.store import Store


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000), st.sampled_from([64, 256, 1024]))
def test_content_cuts_cover(data, size):
    cuts = chunking.content_cuts(data, size)
    assert cuts == sorted(set(cuts)) and (cuts[-1] if cuts else 0) == len(data)
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert all(s <= size * 4 for s in sizes) and all(s >= size // 4 or s == sizes[-1] for s in sizes)


def elf(b):
    h = 0
    for c in b:
        if not c:
            break
        h = (h << 4) + c
        x = h & 0xF0000000
        h = (h ^ (x >> 24)) & ~x
    return h


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=6000))
def test_content_cuts_against_a_walk(data):
    size, at, want = 256, 0, []
    while at < len(data):
        if len(data) - at <= 64:
            want.append(len(data))
            break
        pos = 0
        while True:
            hit = elf(data[at + pos : at + pos + 8]) % 256 == 255
            pos += 8
            if (hit and pos >= 64) or pos >= 1024 or at + pos >= len(data):
                break
        at = min(at + pos, len(data))
        want.append(at)
    assert chunking.content_cuts(data, size) == want


def test_string_hashes(spark):
    texts = ["", "a", "abc", "x" * 300, "naïve", "a\0b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *(hashing.string_hash("t", n).alias(n) for n in (*hashing.FAMILY, "crc", "rabin", "rolling"))).collect()
    m = (1 << 64) - 1
    for r in got:
        if r["t"] is None:
            assert r["bkdr"] is None
            continue
        b = r["t"].encode().split(b"\0")[0]
        bkdr, djb, rs, a, ap = 0, 5381, 0, 63689, 0
        for k, c in enumerate(b):
            bkdr, djb = (bkdr * 131 + c) & m, (djb * 33 + c) & m
            rs, a = (rs * a + c) & m, a * 378551 & m
            ap ^= ((ap << 7 & m) ^ c ^ (ap >> 3)) if k % 2 == 0 else ~((ap << 11 & m) ^ c ^ (ap >> 5)) & m
        top = (1 << 63) - 1
        assert (r["bkdr"], r["djb"], r["rs"], r["ap"], r["elf"]) == (bkdr & top, djb & top, rs & top, ap & top, elf(b))


def test_rolling_sum_rolls():
    data = bytes(range(1, 120))
    for k in range(50):
        assert hashing.roll(hashing.rolling_sum(data[k : k + 40]), 40, data[k], data[k + 40]) & 0xFFFF == hashing.rolling_sum(data[k + 1 : k + 41]) & 0xFFFF


def test_formatting(spark):
    df = spark.createDataFrame([(0, "/a/b.fa", 0o754), (1023, "none", 0), (1536, "/x", 0o777), (5 << 30, None, None), (None, "a/", 7)], "n bigint, p string, m int")
    got = df.select(formatting.human_size("n"), formatting.basename("p"), formatting.mode_text("m"), formatting.padded("n")).collect()
    assert [tuple(r) for r in got[:3]] == [("0B", "b.fa", "rwxr-xr--", "000000"), ("1023B", None, "---------", "001023"), ("1.5KB", "x", "rwxrwxrwx", "001536")]
    assert got[3][0] == "5.0GB" and got[3][3] == str(5 << 30) and got[4][0] is None and got[4][1] == ""


def test_packed_resets_and_ties(spark):
    rows = [(g, i, s) for g in ("a", None) for i, s in enumerate([5, 5, None, 1, 20, 3, 3, 3])]
    got = dedup.packed(spark.createDataFrame(rows, "g string, i int, s int"), "g", ["i"], "s", 10).collect()
    for g in ("a", None):
        assert [r["box_no"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])] == [0, 0, 0, 1, 2, 3, 3, 3]


def test_champion_and_routing(spark):
    hits = spark.createDataFrame([("u", 7, 1), ("u", 8, 2), ("u", 8, 3), ("u", 7, 4), ("v", None, 1)], "u string, c int, o int")
    assert [tuple(r) for r in dedup.champion(hits, ["u"], "c", "o").collect()] == [("u", 7, 2)]
    usage = spark.createDataFrame([(1, 10), (2, 30)], "node int, used int")
    n = spark.createDataFrame([("b", 1, 5), ("b", 2, 7), ("c", 2, 1)], "b string, node int, n int")
    batches = spark.createDataFrame([("b",), ("c",), ("d",), ("e",), ("b",), (None,)], "b string")
    got = {r["b"]: (r["node"], r["score"]) for r in routing.routed(batches, n, usage, "b", "node", "n", "used").collect()}
    assert got.pop("b") == (1, 5.0) and got.pop("c") == (2, round(20 / 30, 6))
    # batches without a hit are given a node too, none where there are no nodes
    assert set(got) == {"d", "e"} and all(node in (1, 2) and score is None for node, score in got.values())
    assert all(r["node"] is None for r in routing.routed(batches, n, usage.where("false"), "b", "node", "n", "used").collect())


def test_containers_are_written_and_cut(spark, tmp_path):
    from strandlake.operators import containers

    rng = random.Random(3)
    data = {f"{i:040x}": rng.randbytes(rng.choice([1, 30, 64, 150])) for i in range(60)}
    df = spark.createDataFrame([(k, i % 3 if i else None, v) for i, (k, v) in enumerate(data.items())] + [("x", 1, b""), ("y", 1, None)], "sha string, stream int, data binary")
    path = containers.write(df, "stream", "sha", "data", 128, str(tmp_path / "c"))
    kept = {k: v for i, (k, v) in enumerate(data.items()) if i}
    assert {r["sha"]: bytes(r["data"]) for r in containers.slices(path, spark).collect()} == kept
    sizes = [len(r["payload"]) for r in spark.read.parquet(f"{path}/data").collect()]
    assert all(n <= 128 or n == 150 for n in sizes)
    one = spark.createDataFrame([(f"{5:040x}",), ("none",)], "sha string")
    assert [(r["sha"], bytes(r["data"])) for r in containers.slices(path, spark, one).collect()] == [(f"{5:040x}", data[f"{5:040x}"])]
    rows = spark.createDataFrame([(1, 1, "2026-01-01 00:00:00"), (1, 2, "2026-01-01 00:00:08"), (2, 1, None), (3, 1, "2026-01-01 00:00:01")], "container_id int, generation int, deleted_at string")
    rows = rows.withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    got = containers.recyclable(rows, F.lit("2026-01-01 00:00:10").cast("timestamp")).collect()
    assert [tuple(r) for r in got] == [(3, 2)]


def test_first_level_and_numbered_batches(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "a")], "i int, k string")
    level = lambda x: spark.createDataFrame(x, "k string, c int")
    got = dedup.first_level(rows, [level([("a", None)]), level([("b", 9), ("b", 7)]), level([("a", 1), ("b", 2)])], "k", "c").collect()
    assert {(r["i"], r["level"], r["c"]) for r in got} == {(1, 2, 1), (2, 1, 7), (3, None, None), (4, None, None), (5, 2, 1)}
    fps = spark.createDataFrame([(hashlib.sha1(bytes([i])).hexdigest(), i % 2) for i in range(50)], "fp string, node int")
    got = dedup.numbered_batches(fps, ["node"], "fp", 10).collect()
    for node in (0, 1):
        mine = sorted((r["fp"], r["batch"]) for r in got if r["node"] == node)
        assert [b for _, b in mine] == [k // 10 for k in range(25)]


def test_segments_merged_and_listed_rows(spark):
    from strandlake.operators import catalog

    seg = spark.createDataFrame([("m", 0, "/b"), ("m", 0, "/a"), ("m", 5, "/c")], "md5 string, file_offset int, path string")
    asked = spark.createDataFrame([("m", 0), ("m", 7), ("n", 0)], "md5 string, file_offset int")
    assert {tuple(r) for r in catalog.segment(seg, asked).collect()} == {("m", 0, "/a", True), ("m", 7, None, False), ("n", 0, None, False)}
    one, two = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)]))
    assert {tuple(r) for r in catalog.merged([one, two], "k").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    from strandlake.functions import formatting

    line = spark.createDataFrame([("x\t1KB\tfasta",)], "line string")
    assert tuple(line.select(*formatting.listing_row("line")).first()) == ("x", "1KB", "fasta", None)


def test_overlapping_against_brute_force(spark):
    rng = random.Random(5)
    maps = [(f, at, rng.choice([0, 1, 700, 9000, 200_000])) for f in "ab" for at in range(0, 400_000, 9000)]
    asks = [(f, rng.randrange(300_000), rng.choice([0, 1, 5000, 150_000])) for f in "abc" for _ in range(20)]
    m = spark.createDataFrame(maps, "f string, o bigint, n bigint")
    q = spark.createDataFrame(asks, "f string, s bigint, l bigint").distinct()
    got = recipes.overlapping(q, m, "f", "o", "n", "s", "l").select("f", "s", "l", "o", "from_byte", "take").collect()
    want = {(f, s, n, o, max(s, o) - o, min(s + n, o + k) - max(s, o)) for f, s, n in set(asks) for g, o, k in maps if f == g and k > 0 and n > 0 and o + k > s and o < s + n}
    assert sorted(map(tuple, got)) == sorted(want)


def test_latest_prefers_later_and_keeps_nulls(spark):
    df = spark.createDataFrame([("k", None, "old"), ("k", 2, "new"), ("n", None, "only")], "k string, v int, x string")
    assert {r["k"]: r["x"] for r in catalog.latest(df, ["k"], ["v"]).collect()} == {"k": "new", "n": "only"}


def test_free_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (1048580,), (5,), (None,)], "id bigint")
    assert sorted(map(tuple, dedup.free_ids(df, "id").collect())) == [(3, 4), (6, 1048579)]
    few = spark.createDataFrame([(1,), (3,)], "id bigint")
    assert sorted(map(tuple, dedup.free_ids(few, "id", 6).collect())) == [(2, 2), (4, 6)]
    assert sorted(map(tuple, dedup.free_ids(few, "id", 2).collect())) == [(2, 2)] and dedup.free_ids(few, "id", 1).count() == 0
    assert sorted(map(tuple, dedup.free_ids(few.where("id > 9"), "id", 4).collect())) == [(1, 4)] and dedup.free_ids(few.where("id > 9"), "id").count() == 0


def test_verbs(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    one, two = os.urandom(20_000), b"x"
    (src / "a.fa").write_bytes(one)
    (src / "sub" / "b.fq").write_bytes(one + b"tail")
    (src / "other.txt").write_bytes(two)
    s = Store(spark, str(tmp_path / "store"))
    assert s.store(str(src)) == 3
    # shared chunks are kept once
    assert s.table("chunks").count() == len({hashlib.sha1(d[i : i + 8192]).hexdigest() for d in (one, one + b"tail", two) for i in range(0, len(d), 8192)})
    got = {r["name"]: bytes(r["content"]) for r in s.read(["a.fa", "sub/b.fq", "other.txt", "none"]).collect()}
    assert got == {"a.fa": one, "sub/b.fq": one + b"tail", "other.txt": two}
    assert [(r["name"], r["type"]) for r in s.list().collect()] == [("a.fa", "fasta"), ("other.txt", "unknown"), ("sub/b.fq", "fastq")]
    (src / "a.fa").write_bytes(b"new")
    s.store(str(src / "a.fa"))
    assert bytes(s.read(["a.fa"]).first()["content"]) == b"new"
    assert s.delete(["sub/b.fq", "none"]) == 1 and s.delete(["sub/b.fq"]) == 0
    assert [r["name"] for r in s.list().collect()] == ["a.fa", "other.txt"]
    assert s.reclaim()[0].count() > 0


def test_files_of_one_name_and_empty_files(spark, tmp_path):
    for sub, data in (("a", b"one"), ("b", os.urandom(5000)), ("c", b"")):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "r.fa").write_bytes(data)
    s = Store(spark, str(tmp_path / "store"), 64, 256)
    assert s.store([str(tmp_path / "a" / "r.fa"), str(tmp_path / "b")]) == 2 and s.store(str(tmp_path / "c")) == 1
    rows = s.list().collect()
    assert [r["name"] for r in rows] == ["r.fa"] * 3 and len({r["key"] for r in rows}) == 3
    assert sorted(bytes(r["content"]) for r in s.read(["r.fa"]).collect()) == sorted((tmp_path / k / "r.fa").read_bytes() for k in "abc")
    with pytest.raises(KeyError):
        s.read_to("r.fa", str(tmp_path / "out"))
    for r in rows:
        s.read_to(r["key"], str(tmp_path / r["key"]))
    assert sorted((tmp_path / r["key"]).read_bytes() for r in rows) == sorted((tmp_path / k / "r.fa").read_bytes() for k in "abc")
    # two clients with the same file
    assert s.store(str(tmp_path / "a"), client=7) == 1 and s.named(["r.fa"], 7).count() == 1 and s.files().count() == 4
    assert s.delete(["r.fa"], 7) == 1 and s.files().count() == 3


@pytest.mark.parametrize("end", ["", "\n", "\n@cut\nAC"])
def test_records_of_a_file_that_is_cut_anywhere(spark, tmp_path, end):
    from strandlake.sources.files import fastq_file_records, listed

    records = [(f"@r{i}", "ACGT" * (i % 3), "+", "I" * (i % 5) + ("\r" if i % 2 else "")) for i in range(7)]
    text = "\n".join("\n".join(r) for r in records) + end
    (tmp_path / "x.fq").write_bytes(text.encode())
    files = listed(spark, str(tmp_path))
    want = [(i, t, s, p, q.rstrip("\r")) for i, (t, s, p, q) in enumerate(records)] + ([(7, "@cut", "AC", None, None)] if "cut" in end else [])
    for size in (1, 2, 3, 5, 7, 16, 64, 1000):
        got = sorted((r["rec_no"], r["title"], r["seq"], r["plus"], r["qual"]) for r in fastq_file_records(files, size).collect())
        assert got == want, size


def test_reassembled_order(spark):
    df = spark.createDataFrame([("k", 10, b"b"), ("k", 2, b"a"), ("k", 30, b"c")], "k string, o int, d binary")
    assert bytes(recipes.reassembled(df, "k", "o", "d").first()["d"]) == b"abc"


def test_sampled_rejects_odd_rates(spark):
    df = spark.createDataFrame([("00ff", 1)], "sha string, o int")
    with pytest.raises(ValueError):
        dedup.sampled(df, "sha", 3, F.lit(True))
    assert dedup.sampled(df, "sha", 256, F.lit(False)).count() == 1


def test_filters_grow_with_their_keys(spark, monkeypatch):
    import hashlib

    from strandlake.operators import sketch
    from strandlake.plans import codec_queries

    assert [sketch.size_for(n) for n in (0, 4096, 4097, 30_000, 1 << 24)] == [1 << 16, 1 << 16, 1 << 17, 1 << 19, 1 << 28]
    fps = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40_000)]
    known = spark.createDataFrame([(f, 1 + i % 2, i) for i, f in enumerate(fps[:30_000])], "fp string, batch_no int, container_id bigint")
    asked = spark.createDataFrame([(1, f) for f in fps[30_000:]], "upload_id bigint, fp string")
    monkeypatch.setattr(codec_queries, "_index", lambda s, d: known)
    monkeypatch.setattr(codec_queries, "_index_rows", lambda s, d: known)
    monkeypatch.setattr(codec_queries, "_uploads", lambda s, d: asked)
    assert codec_queries.bloom_probe(spark, "").count() < 50
    assert 15_000 <= codec_queries.counting_bloom_delete(spark, "").count() < 15_100
    assert (codec_queries.master_hits(spark, "").agg(F.sum("hits")).first()[0] or 0) < 100
    # beyond 2^24 bits the slots still spread over the whole filter
    high = asked.select(F.explode(sketch.slots("fp", 1 << 28)).alias("slot")).agg(F.count_distinct(F.expr("(slot >> 24)")), F.count_if(F.expr("(slot >> 24) >= 8"))).first()
    assert high[0] == 16 and 0.4 < high[1] / 60_000 < 0.6


def test_intermediate_tables_are_removed_on_demand(spark):
    from strandlake import runtime

    kept = runtime.written(spark.range(3).toDF("i"), "some")
    assert kept.count() == 3 and runtime.clear(spark) >= 1 and runtime.clear(spark) == 0
    with pytest.raises(Exception):
        kept.count()

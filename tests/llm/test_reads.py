import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import signature_tree, spans
from strandlake.llm.signature_tree import components, linked_groups, similar_records
from strandlake.llm.spans import SpanIndex, shared_portion


def grams(s):
    s = (s or "").rstrip("\r").upper()
    return {s[i : i + 12] for i in range(len(s) - 11) if not set(s[i : i + 12]) - set("ACGT")}


def edited(rng, s):
    s = list(s)
    for _ in range(rng.randrange(6)):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice([[], ["A"], ["C", s[k]], [s[k].lower()], ["N"]])
    return "".join(s)


def some_reads(rng, n):
    bases = ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(12)]
    rows = [(i, edited(rng, rng.choice(bases))[rng.randrange(20) :]) for i in range(n)]
    # a third are copies of one read, in different spellings; and odd ones
    rows += [(n + i, bases[0] if i % 2 else bases[0].lower() + "\r") for i in range(n // 3)]
    return rows + [(9001, None), (9002, ""), (9003, "AC"), (9004, "AT" * 80), (9005, "N" * 200), (None, bases[1])]


@pytest.mark.parametrize("block,leaf,limit", [(1024, 32, 1000), (16, 4, 0)])
def test_similar_records_against_brute_force(spark, monkeypatch, block, leaf, limit):
    monkeypatch.setattr(signature_tree, "FILTER_LIMIT", limit)
    monkeypatch.setattr(signature_tree, "BLOCK", block)
    monkeypatch.setattr(signature_tree, "LEAF", leaf)
    rows = some_reads(random.Random(block), 120)
    df = spark.createDataFrame(rows + rows[:30], "rec_no bigint, seq string")
    w = {i: grams(s) for i, s in rows if i is not None}
    ids = sorted(i for i in w if len(w[i]) >= 30)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(w[a] & w[b]) >= len(w[a] | w[b])}
    assert {tuple(r) for r in similar_records(df).collect()} == want and want
    assert {tuple(r) for r in similar_records(df, exact=True).collect()} == want


def test_a_tree_prunes_unlike_records():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT") for _ in range(101)) for _ in range(1024)]
    texts += [edited(rng, t).upper() for t in texts[:40]]
    tally = {}
    i, j, common, either = signature_tree.tree_pairs(pa.array(texts), [(0, len(texts), len(texts))], tally)
    sets = [grams(t) for t in texts]
    want = {(a, b) for a in range(40) for b in (1024 + a,) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want and len(want) > 20
    # what a level looks at and what it keeps: a record meets hardly any leaf but those with a like record
    seen, kept = tally["record and leaf"]
    assert seen > 30 * kept and tally["records"][0] < 0.02 * len(texts) ** 2 / 2


def test_bands_keep_their_promise():
    for n in (10, 10**6, 10**11, 10**20):
        rows, bands = signature_tree.bands_for(n)
        assert (1 - 0.5**rows) ** bands <= signature_tree.MISSED and n <= signature_tree.BLOCK * 4 ** (12 * rows)


def test_groups_follow_links(spark):
    rows = some_reads(random.Random(1), 60)
    got = linked_groups(spark.createDataFrame(rows, "rec_no bigint, seq string")).collect()
    assert sorted(r["rec_no"] for r in got) == sorted(i for i, _ in rows if i is not None)
    w = {i: grams(s) for i, s in rows if i is not None}
    group = {i: i for i in w}
    ids = [i for i in w if len(w[i]) >= 30]
    for _ in range(20):
        for a in ids:
            for b in ids:
                if 2 * len(w[a] & w[b]) >= len(w[a] | w[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert {r["rec_no"]: r["group_id"] for r in got} == group


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r["node"]: r["label"] for r in components(df).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def stretches(rows, w=40):
    reads = {i: (s or "").rstrip("\r").upper() for i, s in rows if i is not None}
    have = {}
    for i, s in reads.items():
        for k in range(len(s) - w + 1):
            have.setdefault(s[k : k + w], set()).add(i)
    out = set()
    for i, s in reads.items():
        cover = bytearray(len(s) + 1)
        for k in range(len(s) - w + 1):
            t = s[k : k + w]
            if len(have[t]) > 1 and not set(t) - set("ACGT") and len(set(t)) >= 3:
                cover[k : k + w] = b"\1" * w
        k = 0
        while k < len(s):
            n = cover.find(b"\0", k) - k
            if n > 0:
                out.add((i, k, n))
            k += max(n, 1)
    return out


@pytest.mark.parametrize("limit", [1000, 0])
def test_shared_stretches_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(spans, "MARKS", limit)
    rng = random.Random(11)
    base = "".join(rng.choice("ACGT") for _ in range(2000))
    rows = [(i, edited(rng, base[k : k + rng.randrange(30, 160)])) for i, k in enumerate(rng.randrange(1900) for _ in range(150))]
    rows += [(500 + i, "AT" * 60) for i in range(5)] + [(600 + i, base[:90]) for i in range(70)] + [(700, None), (701, ""), (702, base[:39]), (None, base[:90]), (703, base)]
    df = spark.createDataFrame(rows, "rec_no bigint, seq string")
    index = SpanIndex(spark, buckets=3)
    index.add(df)
    want = stretches(rows)
    got = index.shared_stretches()
    assert {tuple(r) for r in got.collect()} == want and want
    # the same from several runs, before and after they are compacted
    parts = SpanIndex(spark, buckets=3)
    for k in range(3):
        parts.add(df.where(f"rec_no % 3 = {k}"))
    assert {tuple(r) for r in parts.shared_stretches().collect()} == want
    parts.compact()
    assert len(parts.runs) == 1 and {tuple(r) for r in parts.shared_stretches().collect()} == want
    # another session finds the index by its name
    again = SpanIndex(spark, buckets=3, path=parts.path)
    assert {tuple(r) for r in again.shared_stretches().collect()} == want
    again.add(df.where("rec_no = 703").withColumn("rec_no", F.lit(9000).cast("bigint")))
    assert {tuple(r) for r in again.shared_stretches().collect()} == stretches([*rows, (9000, base)])
    part = {r["rec_no"]: r for r in shared_portion(got, df).collect()}
    assert part[703]["shared"] == sum(n for i, _, n in want if i == 703) and part[701]["portion"] is None and part[702]["shared"] == 0


@pytest.mark.parametrize("window,seed", [(12, 6), (32, 20), (64, 64), (50, 24), (90, 24)])
def test_spans_of_any_length(spark, window, seed):
    rng = random.Random(window)
    base = "".join(rng.choice("ACGT") for _ in range(900))
    rows = [(i, edited(rng, base[k : k + rng.randrange(30, 260)])) for i, k in enumerate(rng.randrange(850) for _ in range(60))]
    index = SpanIndex(spark, window, seed, buckets=2)
    assert index.packed == (window in (32, 64))
    df = spark.createDataFrame(rows, "rec_no bigint, seq string")
    index.add(df.where("rec_no < 30"))
    index.add(df.where("rec_no >= 30"))
    assert {tuple(r) for r in index.shared_stretches().collect()} == stretches(rows, window)


def test_no_reads(spark):
    df = spark.createDataFrame([], "rec_no bigint, seq string")
    index = SpanIndex(spark, buckets=2)
    assert index.shared_stretches().count() == 0
    index.add(df)
    assert index.shared_stretches().count() == 0
    assert similar_records(df).count() == 0

import base64
import quopri
import random
import re
import time

import numpy as np
import pytest

from strandlake.llm import abuse, packing
from strandlake.llm.leaks import leaked
from strandlake.llm.mail import text_parts

WORD = re.compile(r"[^\W_]+")


def test_mail_forms():
    body = "Grüße an alle & <b>mehr</b>"
    qp = quopri.encodestring(body.encode()).decode()
    b64 = base64.encodebytes(body.encode()).decode()
    assert text_parts(None) == text_parts("") == []
    assert text_parts("Subject: =?utf-8?B?R3LDvMOfZQ==?=\n =?utf-8?Q?_an?=\n\nhi") == ["Grüße an", "hi"]
    assert text_parts(f"Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n{b64}") == [body]
    multi = f'Subject: s\nContent-Type: multipart/mixed;\n boundary="x.y"\n\npre\n--x.y\nContent-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\n{qp}\n--x.y\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA\n--x.y\n\nno end'
    assert text_parts(multi) == ["s", "Grüße an alle & mehr\n", "no end"]
    assert text_parts("no header at all\n\nmore") == ["no header at all\n\nmore"]
    assert text_parts("Content-Type: multipart/mixed\n\nbody") == ["body"]
    assert text_parts("A: b\nContent-Transfer-Encoding: base64\n\n!!!") == [""]


def test_marks_of_messages_are_found_without_a_pattern_each(monkeypatch):
    made, make = [], re._compiler.compile
    monkeypatch.setattr(re._compiler, "compile", lambda p, flags=0: (made.append(p), make(p, flags))[1])
    message = lambda k: f"Subject: s\nContent-Type: multipart/mixed; boundary=x{k}+\n\npre\n--x{k}+ \na\n --x{k}+\n--x{k}++\n--x{k}+\t\n\nb\n--x{k}+--\npost"
    assert text_parts(message(0)) == ["s", "a\n --x0+\n--x0++\n", "b\n"]
    made.clear()
    assert all(len(text_parts(message(k))) == 3 for k in range(1, 50)) and not made


def test_parts_nested_very_deep():
    text = "Subject: s\n\ndeep words"
    for _ in range(150):
        text = "Content-Type: message/rfc822\n\n" + text
    got = text_parts(text)
    assert len(got) == 1 and got[0].endswith("deep words")


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Ärger", "x1", "a", "the", "of", "moon", "Straße", "42", "tree", "zeta"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 11, 12, 13, 40])))) for i in range(40)] + [(90, None), (91, "")]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        if i % 2:
            it = WORD.findall(rng.choice(items[:40])[1])
            k, n = rng.randrange(len(it)), rng.randrange(9, 20)
            words[50:50] = [w.upper() if w != "Straße" else w for w in it[k : k + n]]
        text = rng.choice([" ", "\n> ", " -- ", ", "]).join(words)
        if i % 5 == 0:
            text = "Content-Transfer-Encoding: base64\n\n" + base64.encodebytes(text.encode()).decode()
        docs.append((i, text))
    docs += [(900, None), (901, ""), (902, docs[1][1])]
    grams = {}
    for i, t in items:
        w = [x.lower() for x in WORD.findall(t or "")]
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for p in text_parts(t) for w in [[x.lower() for x in WORD.findall(p)]] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    d, e = spark.createDataFrame(docs + docs[:9], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leaked(d, e).collect()} == want and want
    assert leaked(d, e.where("false")).count() == 0 and leaked(d.where("false"), e).count() == 0


def test_leaks_by_join_alone(spark, monkeypatch):
    from strandlake.llm import leaks

    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    d, e = spark.createDataFrame([(1, "so " + text), (2, text[:40])], "doc_id bigint, text string"), spark.createDataFrame([(7, text)], "item_id bigint, text string")
    monkeypatch.setattr(leaks, "FILTER_LIMIT", 0)
    assert [tuple(r) for r in leaks.leaked(d, e).collect()] == [(1, 7)]


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(0, 4) for _ in range(5)}
        room = rng.randrange(0, 60)
        sums = {0}
        for s, n in counts.items():
            sums = {a + k * s for a in sums for k in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(s * k for s, k in got.items()) == max(a for a in sums if a <= room)
        assert all(k <= counts[s] for s, k in got.items())


@pytest.mark.parametrize("rows", [500_000, 7])
def test_packing_keeps_all_and_fits(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rows)
    rng = random.Random(1)
    sizes = [(i, rng.choice([10, 10, 10, rng.randrange(1, 130), 250, 64])) for i in range(400)] + [(1000, 0), (1001, None)]
    got = packing.pack(spark.createDataFrame(sizes + sizes[:20], "doc_id bigint, tokens int"), 64).collect()
    boxes, parts = {}, {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append(r)
        if r["container_no"] is not None:
            boxes.setdefault(r["container_no"], []).append(r)
    for i, n in sizes:
        mine = sorted(parts[i], key=lambda r: r["part_no"])
        assert sum(r["tokens"] for r in mine) == (n or 0) and len(mine) == max(1, -(-(n or 0) // 64))
        assert [r["token_start"] for r in mine] == [64 * k for k in range(len(mine))]
    assert all(sum(r["tokens"] for r in b) + b[0]["unused"] == 64 and len({r["unused"] for r in b}) == 1 for b in boxes.values())
    assert sorted(boxes) == list(range(len(boxes)))
    # no more containers than first fit takes on falling sizes
    fill: list[int] = []
    for n in sorted((r["tokens"] for r in got if r["tokens"]), reverse=True):
        k = next((k for k, x in enumerate(fill) if x + n <= 64), None)
        if k is None:
            fill.append(n)
        else:
            fill[k] += n
    assert len(boxes) <= len(fill)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens int"), 64).count() == 0


def units(text):
    kind, plain = abuse.letter_tables()
    return abuse.Units([1], [text], kind, plain)


def test_units_undo_disguise():
    plain = units("you idiot touch").word.tolist()
    for t in ("YOU 1d10t t-o-u-c-h", "y​ou idi­ot t.o.u.c.h", "youuu idiiot toouch", "yоu idiоt tоuch"):
        assert units(t).word.tolist() == plain, t
    assert len(units("").start) == 0 and len(units("... !!").start) == 0
    long = units("word " * 100)
    assert long.start[0] == 0 and long.end[-1] == 100 and (long.end - long.start).max() == abuse.WIDTH
    assert np.unique(np.concatenate([np.arange(a, b) for a, b in zip(long.start, long.end)])).size == 100


def test_classifier_finds_what_was_left_out(spark):
    rng = random.Random(8)
    nouns = ["garden", "printer", "train", "report", "kettle", "window", "letter", "filter", "bridge", "basket"]
    mean = ["you are a filthy fool", "nobody likes a fool like you", "shut up you filthy pig", "you filthy pig go away"]
    docs, truth = [], {}
    for i in range(900):
        lines = [f"The {rng.choice(nouns)} was {rng.choice(['sorted', 'cleaned', 'moved'])} on {rng.choice(['Monday', 'Friday'])}." for _ in range(rng.randrange(3, 12))]
        truth[i] = int(rng.random() < 0.2)
        if truth[i]:
            lines.insert(rng.randrange(len(lines)), rng.choice(mean).capitalize() + "!")
        docs.append((i, "Subject: note\n\n" + "\n".join(lines)))
    labels = [(i, truth[i] if rng.random() > 0.03 else 1 - truth[i]) for i in range(300)]
    d, y = spark.createDataFrame(docs + [(5000, None), (5001, "")], "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = abuse.fit(d, y)
    got = {r["doc_id"]: r for r in abuse.score(d, model).collect()}
    assert set(got) == {*truth, 5000, 5001} and got[5000]["score"] is None and not got[5001]["flagged"]
    rest = range(300, 900)
    hit = sum(got[i]["flagged"] and truth[i] for i in rest)
    assert hit >= 0.9 * sum(truth[i] for i in rest) and hit >= 0.9 * sum(got[i]["flagged"] for i in rest)
    assert abuse.fit(d, y.where("toxic = 0")) is None and not any(r["flagged"] for r in abuse.score(d, None).collect())


def test_few_labels_flag_few_documents(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["red", "blue", "green", "tall", "small", "house", "road", "river"]) for _ in range(40)) + ".") for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    for n in (1, 2, 5, 25):  # positives that have nothing in common, among ten times as many clean ones
        y = spark.createDataFrame([(i, int(i < n)) for i in range(min(400, 10 * n))], "doc_id bigint, toxic int")
        model = abuse.fit(d, y)
        assert (model is None) == (n == 1)
        assert sum(r["flagged"] for r in abuse.score(d, model).collect()) <= 40 + n


def test_nnpu_separates():
    rng = np.random.default_rng(0)
    row = lambda toxic: np.r_[rng.integers(10, 200, 12), [1, 2] if toxic else []].astype(np.int32)
    known = np.arange(200, dtype=np.int32)
    p = abuse._Rows([row(True) for _ in range(80)], known)
    u = abuse._Rows([row(rng.random() < 0.1) for _ in range(800)], known)
    w, b = abuse.nnpu(p, u, 0.1)
    test = abuse._Rows([row(k < 50) for k in range(400)], known).times(w) + b
    assert (test[:50] > 0).mean() > 0.95 and (test[50:] > 0).mean() < 0.05


def test_classifier_counts_and_cuts_over_all_documents(spark, monkeypatch):
    seen = {}
    learn, cut = abuse._learn, abuse._cut
    monkeypatch.setattr(abuse, "MAX_UNITS", 500)
    monkeypatch.setattr(abuse, "_learn", lambda p, outside, n, units, prior: (seen.update(outside=outside, n=n, units=len(units)), learn(p, outside, n, units, prior))[1])
    monkeypatch.setattr(abuse, "_cut", lambda positive, levels, n, most, limit: (seen.update(scored=n.sum()), cut(positive, levels, n, most, limit))[1])
    docs = [(i, f"The garden {'filthy pig ' if i % 40 == 0 else ''}number{i} was moved on Monday. It is well.") for i in range(9_500)]
    d = spark.createDataFrame(docs + docs[:700], "doc_id bigint, text string")
    y = spark.createDataFrame([(i, 1) for i in range(0, 4_000, 40)], "doc_id bigint, toxic int")
    abuse.fit(d, y)
    word = lambda w: (units(w).features()[0][0])[0]
    assert seen["n"] == 9_500 and seen["outside"][word("garden")] == 9_500 and seen["outside"][word("filthy")] == 238
    # both halves' classifiers score every document once
    assert seen["scored"] == 2 * 9_500 and 250 < seen["units"] <= 500


class PlainRows(abuse._Rows):
    """The same rows with both products as they are defined, a place at a time."""

    packed = property(lambda self: self)

    def back(self, g):
        return np.bincount(self.column, (g * self.scale)[self.row], self.width)


def test_fit_takes_less_than_its_plain_products():
    rng = np.random.default_rng(5)
    phrases = [rng.integers(0, 3_000, 12) * 4 for _ in range(2_000)]

    def row():  # phrases that are quoted again and again, each word with its beginning, and features that nobody knows
        words = np.concatenate([phrases[k] for k in rng.integers(0, len(phrases), 3)])
        return np.r_[words, words + 1, rng.integers(20_000, 30_000, 5)].astype(np.int32)

    some = [row() for _ in range(9_000)]
    loose = [some[k] for k in rng.integers(0, len(some), 15_000)] + [np.zeros(0, np.int32), np.array([4, 4, 5], np.int32)]
    known = np.arange(12_000, dtype=np.int32)

    def fitted(kind):
        p, u = kind(some[:60], known), kind(loose, known)
        begin = time.process_time()
        return abuse.nnpu(p, u, 0.01), time.process_time() - begin

    got, want = ([fitted(kind) for _ in range(3)] for kind in (abuse._Rows, PlainRows))
    np.testing.assert_allclose(got[0][0][0], want[0][0][0], rtol=1e-6, atol=1e-9)
    assert abs(got[0][0][1] - want[0][0][1]) < 1e-9
    assert min(t for _, t in got) < 0.7 * min(t for _, t in want)


def test_only_equal_rows_are_one(monkeypatch):
    rows = [[1, 1], [2], [], [2], [1, 1], [66], [33, 33], [1], [], [2, 1], [1, 2], [66]]
    owner, member = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate([np.array(x, np.int64) for x in rows])
    for numbers in (None, lambda low, high, size, kind: np.zeros(size, kind)):  # the second gives all rows one digest
        if numbers:
            monkeypatch.setattr(abuse.np.random, "default_rng", lambda seed: type("Same", (), {"integers": staticmethod(numbers)}))
        first, group = abuse._alike(owner, member, len(rows))
        assert all(rows[first[g]] == x for g, x in zip(group.tolist(), rows))
        assert len(set(group.tolist())) == len(first) and (numbers or len(first) == 8)


def test_lists_and_places_of_units():
    u = abuse.Units([4, 4, 7, 9], ["one two. a", " ".join(f"w{k}" for k in range(40)), "", "Yes! no no"], *abuse.letter_tables())
    both = u.features()
    want = [np.concatenate([x[s : max(s, e - r)] for x, r in both]).tolist() for s, e in zip(u.start, u.end)]
    assert u.lists().to_pylist() == want and u.lists(np.array([1, 3])).to_pylist() == [want[1], want[3]]
    for (x, r), (number, owner) in zip(both, u.places()):
        held = {i: o for s, e, o in zip(u.start.tolist(), u.end.tolist(), u.owner.tolist()) for i in range(s, e - r)}
        assert number.tolist() == [int(x[i]) for i in sorted(held)] and owner.tolist() == [held[i] for i in sorted(held)]

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators.orphans import find_orphans, orphans_by_period

REF = "id int, a string, b string, extra string"
TGT = "x string, y string, extra string"


def ids(df):
    return sorted(r["id"] for r in df.collect())


ROWS = [(1, "1", "1", "e"), (2, "1", "9", None), (3, None, None, "e"), (4, "1", None, "e"), (5, None, "7", "e"), (6, "2", "2", "e"), (6, "2", "2", "e")]


@pytest.mark.parametrize("match,want", [("simple", [2]), ("full", [2, 4, 5]), ("partial", [2, 5])])
def test_null_masks(spark, match, want):
    refs = spark.createDataFrame(ROWS, REF)
    targets = spark.createDataFrame([("1", "1", "z"), ("2", "2", "z"), (None, "7", "z"), ("2", "2", "z")], TGT)
    got = find_orphans(refs, targets, ["a", "b"], ["x", "y"], match)
    # a partly null target is met in its other columns under a partial match
    assert ids(got) == [i for i in want if not (match == "partial" and i == 5)]
    assert got.columns == refs.columns


def test_empty_tables(spark):
    refs, targets = spark.createDataFrame(ROWS, REF), spark.createDataFrame([], TGT)
    assert ids(find_orphans(refs, targets, ["a", "b"], ["x", "y"])) == [1, 2, 6, 6]
    assert find_orphans(refs.where("false"), targets, ["a", "b"], ["x", "y"]).count() == 0


def test_times_and_deletes_against_brute_force(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda: None if rng.random() < 0.1 else t0 + dt.timedelta(minutes=rng.randrange(600))
    # a third of the references have one key
    refs = [(i, "hot" if i % 3 == 0 else str(rng.randrange(30)), at()) for i in range(900)]
    targets = [(rng.choice(["hot", *map(str, range(25))]), at(), at() if rng.random() < 0.3 else None) for _ in range(60)]
    r = spark.createDataFrame(refs, "id int, k string, at timestamp")
    t = spark.createDataFrame(targets, "k string, since timestamp, gone timestamp")
    got = find_orphans(r, t, ["k"], ["k"], "simple", "at", "since", F.col("gone").isNull(), 3600)
    hour = dt.timedelta(hours=1)
    want = [i for i, k, a in refs if not any(k == x and g is None and s is not None and a is not None and s <= a + hour for x, s, g in targets)]
    assert ids(got) == sorted(want)
    by = orphans_by_period(got.withColumn("src", F.lit("r")), "src", "at", "day")
    assert sum(x["orphans"] for x in by.collect()) == len(want)


def test_bad_match(spark):
    refs = spark.createDataFrame(ROWS, REF)
    with pytest.raises(ValueError):
        find_orphans(refs, refs, ["a"], ["a"], "some")
    with pytest.raises(ValueError):
        find_orphans(refs, refs, ["a"], ["a", "b"])

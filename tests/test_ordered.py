"""Order-dependent operators: windows per key, slices of the total order and brute force give the same rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palisade.operators import ordered
from palisade.operators.ordered import by_heat, hot_keys, in_order, order_index
from palisade.operators.prep import stratified_split, split_digits


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # one key holds half of the rows
    return [
        (i, rng.choice(["hot"] * 8 + list("abcdefgh")), float(rng.randrange(40_000)), rng.choice(["x", "y", None]))
        for i in range(3000)
    ]


def brute(rows):
    state = defaultdict(lambda: [0, 0, None, []])
    out = {}
    for i, key, ts, kind in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        s = state[key]
        count = None
        if kind == "x":
            s[0] += 1
            count = s[0]
        s[1] = 1 if s[2] is None or ts - s[2] > 60 else s[1] + 1
        s[2] = ts
        s[3] = [*s[3], i][-4:]
        out[i] = (count, s[1], s[3])
    return out


def steps(df, w):
    df = w.running_count(df, "n", F.col("kind") == "x")
    df = w.since_silence(df, "f", "ts", 60)
    return w.trailing(df, "last", F.col("id"), 4)


@pytest.mark.parametrize("limit, slice_rows", [(10_000, 250_000), (500, 250_000), (500, 64), (0, 64), (0, 3)])
def test_history(spark, rows, monkeypatch, limit, slice_rows):
    monkeypatch.setattr(ordered, "SLICE_ROWS", slice_rows)
    df = spark.createDataFrame(rows, "id bigint, key string, ts double, kind string").repartition(5)
    got = by_heat(df, "key", ["ts", "id"], steps, limit=limit)
    assert {r["id"]: (r["n"], r["f"], r["last"]) for r in got.collect()} == brute(rows)


def test_hot_keys(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, key string, ts double, kind string")
    assert [r[0] for r in hot_keys(df, "key", 500).collect()] == ["hot"]
    assert hot_keys(df, "key", 0).count() == 9


def test_order_index_has_no_single_partition(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, key string, ts double, kind string").repartition(7)
    indexed = order_index(df, ["ts", "id"])
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert [r["id"] for r in indexed.orderBy("pos").select("id").collect()] == want
    assert sorted(r["pos"] for r in indexed.collect()) == list(range(len(rows)))
    plan = indexed._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_slices_stay_small(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    df = spark.createDataFrame(rows, "id bigint, key string, ts double, kind string")
    sizes = []

    def look(part, w):
        halo, _ = w._with_halo(part, 3)
        sizes.extend(r["count"] for r in halo.groupBy("_slice").count().collect())
        return part

    in_order(df, ["ts", "id"], look)
    assert max(sizes) <= 103 and sum(sizes) >= len(rows)


def test_stratified_split_is_exact(spark):
    rows = [(i, "big" if i % 10 else "small", "k") for i in range(2000)] + [(9999, None, "k")]
    df = spark.createDataFrame(rows, "id bigint, Label string, k string")
    wide = {(r["id"], r["part"]) for r in stratified_split(df, ["id"], digits=1).collect()}
    fine = {(r["id"], r["part"]) for r in stratified_split(df, ["id"], digits=4).collect()}
    assert wide == fine and len(wide) == 2000
    counts = stratified_split(df, ["id"]).groupBy("Label", "part").count().collect()
    assert {(r["Label"], r["part"]): r["count"] for r in counts} == {
        ("big", "test"): 360, ("big", "train"): 1440, ("small", "test"): 40, ("small", "train"): 160,
    }


def test_split_digits():
    assert split_digits(1000) == 2
    assert 100_000_000_000 / 16 ** split_digits(100_000_000_000) <= 100_000


def test_row_number_of_hot_keys_needs_no_window(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, key string, ts double, kind string").repartition(5)
    slices = ordered.SlicedOrder("key", ["ts", "id"])
    numbered = slices.row_number(slices.prepare(df), "n")
    assert "Window" not in numbered._jdf.queryExecution().executedPlan().toString()
    got = by_heat(df, "key", ["ts", "id"], lambda r, w: w.row_number(r, "n"), limit=500)
    place, want = defaultdict(int), {}
    for i, key, ts, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        place[key] += 1
        want[i] = place[key]
    assert {r["id"]: r["n"] for r in numbered.collect()} == {r["id"]: r["n"] for r in got.collect()} == want

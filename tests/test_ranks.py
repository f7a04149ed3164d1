"""Places and values at a place against sorted lists, with hot groups, ties, nulls and odd numbers."""

import math
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from foliospark.operators import ranks


def table(spark, n=3000, seed=5):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice([None, "a", "b", "c"]), rng.choice([None, rng.randrange(20), rng.randrange(10**12)]), 9) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, v long, place int").repartition(5)


def test_places_over_all(spark):
    rows, df = table(spark)
    got = {r["id"]: r["place"] for r in ranks.places(df, [F.desc_nulls_last("v"), F.col("id")]).collect()}
    want = [i for i, _, _, _ in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))]
    assert got == {i: k for k, i in enumerate(want, 1)}


def test_places_in_groups(spark):
    rows, df = table(spark)
    got = {r["id"]: r["place"] for r in ranks.places(df, [F.col("v"), F.col("id")], "g").collect()}
    groups = defaultdict(list)
    for i, g, v, _ in rows:
        groups[g].append((v is not None, v or 0, i))
    assert got == {i: k for members in groups.values() for k, (_, _, i) in enumerate(sorted(members), 1)}


def test_places_beyond_the_broadcast(spark, monkeypatch):
    rows, df = table(spark, 500)
    want = {r["id"]: r["place"] for r in ranks.places(df, [F.col("v"), F.col("id")], "g").collect()}
    monkeypatch.setattr(ranks, "BROADCAST_GROUPS", 1)
    assert want == {r["id"]: r["place"] for r in ranks.places(df, [F.col("v"), F.col("id")], "g").collect()}


def test_no_task_holds_more_than_its_range(spark, monkeypatch):
    """One group, all of whose rows tie: the ranges are even all the same."""
    saved, save = {}, ranks.Shared.save
    monkeypatch.setattr(ranks.Shared, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    df = spark.range(20_000).select("id", F.lit("all").alias("g"), F.lit(1).alias("v"))
    out = ranks.places(df, [F.col("v")], "g", ranges=16)
    assert sorted(r["place"] for r in out.collect()) == list(range(1, 20_001))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    sizes = [r["n"] for r in saved["sorted"].groupBy("_metadata.file_path").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16


def test_places_of_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "x")] * 4 + [(2, "x")], "v int, g string")
    assert sorted((r["v"], r["place"]) for r in ranks.places(df, [F.desc("v")], "g").collect()) == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 1)]
    assert ranks.places(df.where("false"), [F.col("v")], "g").collect() == []
    assert ranks.places(df.where("false"), [F.col("v")]).columns == ["v", "g", "place"]


def check(spark, values, kind, place=ranks.upper_median, buckets=1024, at=lambda n: n // 2):
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], f"g string, v {kind}")
    got = {r["g"]: (r["n"], r["median"]) for r in ranks.at_place(df, "g", "v", place, buckets=buckets).collect()}
    want = {}
    for g, vs in values.items():
        vs = sorted((v for v in vs if v is not None), key=lambda x: (isinstance(x, float) and math.isnan(x), x))
        if vs:
            want[g] = (len(vs), vs[at(len(vs))])
    assert repr(sorted(got.items(), key=repr)) == repr(sorted(want.items(), key=repr))


@pytest.mark.parametrize("buckets", [2, 1024])
def test_at_place(spark, buckets):
    rng = random.Random(2)
    check(spark, {"a": [rng.randrange(1000) for _ in range(999)], "b": [7] * 50, None: [3, 1, None], "c": [None], "d": [2, 1]}, "bigint", buckets=buckets)
    check(spark, {"a": [rng.gauss(0, 1e3) for _ in range(500)], "b": [0.1 + 0.2, 0.3, 0.3, 0.1]}, "double", buckets=buckets)


def test_at_place_of_far_values(spark):
    big = 2**63 - 1
    check(spark, {"a": [-big, big, big - 1, -big + 1, 0], "b": [big, big - 1], "c": [2**53, 2**53 + 1, 2**53 + 1]}, "bigint")
    inf, nan = float("inf"), float("nan")
    check(spark, {"a": [1e308, -1e308, 1e-300, 3.0], "b": [inf, -inf, 0.0], "c": [nan, inf, 1.0, nan], "d": [-inf, -inf, 5.0], "e": [5e-324, 0.0]}, "double")


def test_percentile_place(spark):
    rng = random.Random(3)
    check(spark, {"hot": [rng.randrange(10**9) for _ in range(4000)], "one": [5]}, "bigint", ranks.percentile_place(0.9), at=lambda n: math.ceil(n * 0.9) - 1)


def test_at_place_holds_no_group(spark):
    """No plan of a pass gathers a group: what is shuffled is a row per group and bucket."""
    df = spark.range(50_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 50_000).alias("v"))
    assert ranks.at_place(df, "g", "v", buckets=64).collect()[0]["median"] == 25_000
    with pytest.raises(TypeError):
        ranks.at_place(df.select("g", F.lit("x").alias("v")), "g", "v")
    assert Counter(r["n"] for r in ranks.at_place(df.where("v < 0"), "g", "v").collect()) == Counter()

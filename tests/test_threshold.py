import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import sampling, threshold


def taken(frame, groups, quota):
    cut = threshold.cuts(frame, groups, quota)
    out = threshold.within(frame, cut, groups, F.col("_key"), F.col("_id")).filter("_taken")
    return sorted((r.g, r._key, r._id) for r in out.collect())


def test_against_sorting_for_every_quota(spark):
    r = random.Random(1)
    rows = [("hot", float(r.choice([0, 1, 2.5, 7])), i) for i in range(400)]                      # ties
    rows += [("wide", r.choice([1e-12, 1.0, 1e15]) * r.random() ** 9, i - 50) for i in range(300)]  # heavy tails
    rows += [("ids", 3.0, i) for i in (-2 ** 63, 2 ** 63 - 1, 0, 1, -1, 5, 6, 2 ** 62)] + [("one", 0.0, 1)]
    frame = spark.createDataFrame(rows, "g string, _key double, _id bigint").repartition(4).cache()
    by = defaultdict(list)
    for g, k, i in rows:
        by[g].append((g, k, i))
    for quota in (0, 1, 2, 3, 7, 150, 10_000_000):
        want = sorted(x for own in by.values() for x in sorted(own)[:quota])
        assert taken(frame, ["g"], quota) == want
    assert taken(frame.limit(0), ["g"], 3) == []


def test_smallest_keeps_columns(spark):
    frame = spark.range(1000).select(F.col("id").alias("a.b"), F.lit("x").alias("_key"), (F.col("id") % 7).alias("w"))
    frame = frame.withColumnRenamed("a.b", "id")
    got = threshold.smallest(frame, 10, F.col("w").cast("double"), F.col("id"))
    assert got.columns == ["id", "_key", "w"] and sorted(r.id for r in got.collect()) == list(range(0, 70, 7))


def test_samples_are_nested_and_ids_may_be_text(spark):
    frame = spark.range(5000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") % 3).alias("kind"))
    small, large = ({r.name for r in sampling.sample_uniform(frame, n, "name").collect()} for n in (10, 2500))
    assert len(small) == 10 and len(large) == 2500 and small < large
    assert sampling.sample_uniform(frame, 10_000_000, "name").count() == 5000
    out = sampling.sample_stratified(frame, 600, "name", "kind").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in out} == {0: 200, 1: 200, 2: 200}


def test_no_row_is_ordered(spark):
    frame = spark.range(100_000).select("id", (F.col("id") % 2).alias("kind"))
    for out in (sampling.sample_uniform(frame, 40_000, "id"), sampling.sample_stratified(frame, 40_000, "id", "kind")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "TakeOrdered" not in plan and "Sort " not in plan and out.count() == 40_000

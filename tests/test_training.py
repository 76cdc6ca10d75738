import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.operators import training


def test_numbered_against_sorting(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.randrange(20), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = {x.i: x["rank"] for x in training.numbered(frame, ["g"], [F.desc("v"), F.col("i")]).collect()}
    by = defaultdict(list)
    for g, v, i in rows:
        by[g].append((-v, i))
    assert got == {i: n for own in by.values() for n, (_, i) in enumerate(sorted(own), 1)}
    assert training.numbered(frame.limit(0), ["g"], [F.col("i")]).count() == 0


def test_pairs_by_rank(spark):
    rows = [("t", i, "good", 10 - i) for i in range(5)] + [("t", 10 + i, "bad", i) for i in range(3)] + [("u", 20, "good", 1), (None, 30, "good", 1), (None, 31, "bad", 1), ("t", 40, None, 9)]
    frame = spark.createDataFrame(rows, "task string, id int, kind string, score int")
    out = training.preference_pairs(frame, "task", "id", F.col("kind") == "good", F.col("kind") == "bad", [F.desc("score")])
    assert sorted(tuple(x) for x in out.collect()) == [("t", 1, 0, 12), ("t", 2, 1, 11), ("t", 3, 2, 10)]
    # a hot task stays linear: no positives x negatives in the plan
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def words(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").lower()) if w]


def test_training_rows_against_definition(spark):
    r = random.Random(4)
    pool = ["the"] * 9 + ["The", "É", "x", "日本", "to", "c++", "…"] + [f"w{i}" for i in range(30)]
    texts = {i: " ".join(r.choice(pool) + r.choice(["", "", "\n", "\t "]) for _ in range(r.randrange(15))) for i in range(60)}
    texts |= {100: None, 101: "", 102: " \n ", 103: "the " * 3000, 104: "y" * 200_000}
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()] + [(None, "zz " * 50, "x", 1)], "doc_id long, text string, token string, id int")
    held = frame.filter("doc_id is not null")
    counts = Counter(w for t in texts.values() for w in words(t))
    for size, least, length in ((20, 1, 8), (1000, 2, 40)):
        numbers = {w: i for i, (_, w) in enumerate(sorted((-n, w.encode()) for w, n in counts.items() if n >= least)[:size], training.FIRST)}
        vocabulary = training.vocabulary(held, size=size, least=least)
        assert {x.token.encode(): x.id for x in vocabulary.collect()} == numbers
        got = {x.id: x for x in training.training_rows(frame, vocabulary, max_length=length).collect()}
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            own = words(t)
            ids = [numbers.get(w.encode(), training.UNKNOWN) for w in own[:length]]
            assert got[i].n_tokens == len(own) and got[i].input_ids == ids + [training.PAD] * (length - len(ids)) == got[i].labels
            assert got[i].attention_mask == [1] * len(ids) + [0] * (length - len(ids))
    empty = training.training_rows(frame, training.vocabulary(held.limit(0)), max_length=4)
    assert set(empty.select(F.array_max("input_ids").alias("m")).distinct().toPandas()["m"]) == {training.PAD, training.UNKNOWN}
    plan = training.training_rows(frame, vocabulary)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower()

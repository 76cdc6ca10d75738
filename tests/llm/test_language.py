from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import language
from tests.conftest import SF01


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
    padded = " " + " ".join(words) + " "
    for n in (2, 3):
        out.update(padded[i:i + n] for i in range(len(padded) - n + 1) if n == 2 or padded[i + 1] != " ")
    return out if words else Counter()


def test_grams_match_brute_force():
    for text in ["Hello, World! it's", "", "123 ..", "é à", "a", "x  y\nz"]:
        codes, counts = language.grams(text)
        assert sorted(counts.tolist()) == sorted(brute_grams(text).values()), text


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles = language.fit(docs.filter(~held))
    got = language.predict(docs, profiles, [F.col("doc_id"), F.col("lang"), held.alias("held")]).collect()
    assert len(got) == docs.count()
    tested = [r for r in got if r.held and r.lang]
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(1, "the cat the dog", "en", 1.0), (2, "le chat le chien", "fr", None), (2, "le chat", "fr", 2.0), (None, "el perro", "es", 0.0),
            (4, None, "en", 0.0), (5, "123 !", "en", 0.0), (6, "", None, 0.0), (7, "the " * 300_000, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    profiles = language.fit(docs)
    assert set(profiles) == {"en", "fr", "es"}
    got = [(r.doc_id, r.lang_pred, r.s) for r in language.predict(docs, profiles, [F.col("doc_id"), F.col("score").alias("s")]).collect()]
    assert len(got) == len(rows)
    assert {(i, p) for i, p, _ in got} == {(1, "en"), (2, "fr"), (None, "es"), (4, "und"), (5, "und"), (6, "und"), (7, "en")}
    none = spark.createDataFrame([], docs.schema)
    assert language.fit(none) == {}
    assert {r.lang_pred for r in language.predict(docs, {}, [F.col("doc_id")]).collect()} == {"und"}
    assert language.predict(none, profiles, [F.col("doc_id")]).count() == 0

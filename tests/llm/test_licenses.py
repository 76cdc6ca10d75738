import random
import re

import pytest

from tessera.llm import licenses
from tessera.llm.queries import QUERIES
from tests.conftest import SF001, SF01


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = ["", "MIT License", "the mit license. CC BY; cc by cc by", "GNU general\npublic License apache-license", "mit mit license license",
         "gnu general public gnu general public license", "É MIT License", "ccby cc  by", "apache license " * 400,
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files"]


def check(got, text):
    n, base, first, last, labels = brute(text)
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == (n, base, first, last, labels), text
    assert set(labels.split(",")) - {""} <= set(got.labels.split(","))
    assert 0 <= got.score <= 1 and (got.score > 0) == bool(got.labels)


def test_phrases(spark):
    r = random.Random(9)
    words = ["mit", "license", "MIT", "License.", "apache", "cc", "by", "gnu", "general", "public", "é", "x y", "\n"]
    texts = TEXTS + [" ".join(r.choice(words) for _ in range(40)) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "y"), (None, "mit license", "z"), (1, "MIT License", "again")]
    got = {r.id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        check(got[i], t)
    check(got[900], "")
    assert got[len(TEXTS) - 1].labels == "mit" and got[len(TEXTS) - 1].n_base == 0
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_whole_table(spark, folder):
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op2_license_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r.doc_id])

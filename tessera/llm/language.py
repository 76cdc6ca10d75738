"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (1 to 3 letters, words padded by a blank)
in order of frequency.  A document's own list is compared to each language's by the
out-of-place distance: how far each of its n-grams is from its place in the profile, and the
profile's whole length if it isn't there.  The nearest profile wins, ties by name.

``fit`` learns from at most about ``per_language`` labelled rows of each language, chosen by
a hash of their ids (a documented bound); counts are summed over the whole texts of these
rows.  ``predict`` reads whole texts.

Texts that are null or hold no letter get ``und`` and score 0.  With no labelled rows every
text is ``und``.  Rows stay one to one, null and repeated ids included.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import q, slices

PER_LANGUAGE = 3000
PROFILE = 400
DOCUMENT = 300

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: is it a letter?"""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in order of their codes, counts); empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(letters()[codes], codes, 0)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    pairs = (codes[:-1] << 21) + codes[1:]
    triples = ((a << 42) + (b << 21) + c)[b != 0]
    every = np.concatenate((codes[codes != 0], pairs + (1 << 62), triples))
    every.sort()
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.diff(np.append(first, len(every)))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
        per_language: int = PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[int]]:
    """{language: its n-grams by falling frequency} from rows whose language isn't null."""
    known = rows.select(F.col(q(text_col)).alias("text"), F.col(q(lang_col)).cast("string").alias("lang"),
                        F.pmod(F.xxhash64(F.col(q(key_col))), F.lit(1_000_003)).alias("draw")).filter("lang is not null and text is not null")
    totals = known.groupBy("lang").agg(F.count("*").alias("n"))
    sample = known.join(F.broadcast(totals), "lang").filter(F.col("draw") * F.col("n") < F.lit(1_000_003 * per_language)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            by: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                codes, counts = (np.concatenate(x) for x in zip(*found))
                if len(codes):
                    unique, inverse = np.unique(codes, return_inverse=True)
                    total = np.bincount(inverse, counts).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(unique)), pa.array(unique), pa.array(total)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "place", "gram").collect()):  # `size` rows for each language
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Ranker:
    def __init__(self, profiles: dict[str, list[int]], document: int = DOCUMENT):
        self.names = sorted(profiles)
        self.document = document
        self.worst = max((len(p) for p in profiles.values()), default=1)
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.places = np.full((len(self.grams), len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.places[np.searchsorted(self.grams, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        top = np.argsort(-counts, kind="stable")[: self.document]
        own = codes[top]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        places = np.where((self.grams[at] == own)[:, None], self.places[at], -1)
        away = np.abs(places - np.arange(len(own))[:, None])
        distance = np.where(places < 0, self.worst, np.minimum(away, self.worst)).sum(axis=0) / (self.worst * len(own))
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best])


def predict(df: DataFrame, profiles: dict[str, list[int]], carry: list[Column], text_col: str = "text") -> DataFrame:
    """``carry`` columns, then lang_pred string and score double (1: same order as the profile)."""
    rows = df.select(*carry, F.col(q(text_col)).cast("string").alias("__text"))
    fields = rows.schema.fields[:-1]
    schema = ", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # PROFILE numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value)
        for part in slices(batches):
            found = [ranker.predict(t) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             names=[*[f.name for f in fields], "lang_pred", "score"])

    return rows.mapInArrow(run, schema)

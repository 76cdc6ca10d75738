"""License scan by diagonal voting, DataFrame functions only.

The words of a text and of each template are cut into rolling k-grams.  Text grams are joined
to template positions; a match of text position p and template position t votes for the
diagonal p - t.  Votes are counted for each text, template and diagonal.  A diagonal with as
many votes as the template has grams is a place where the template's words stand
consecutively.  For longer templates, neighbouring diagonals (a word was left out or put in)
are merged to one span, which is verified: the template positions that it covers, counted
once, must reach ``threshold`` of the template.

The join compares the grams' words as well as their hashes, so each vote is a verified match.

Words: runs of digits, ASCII letters (A-Z in lower case) and any character beyond ASCII.
Null texts have no words.  Rows with a null id are left out, repeated ids count once with the
smallest text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import texts
from tessera.llm.simhash import lower_ascii

#: words of a gram; the shortest phrase has two
GRAM = 2
#: diagonals no further apart than this are one alignment
NEAR = 3
#: part of a notice's grams that a span must cover, and how many of them at least (or all)
THRESHOLD = 0.6
LEAST = 6

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words of widely used notices, for whole texts of licenses.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under the creative commons attribution sharealike license": "cc-by-sa",
    "this work is licensed under the creative commons attribution noncommercial license": "cc-by-nc",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
}

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")


def template_grams(spark, phrases: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """(template int, label, base boolean, n_grams int, at int, gram string): a few hundred rows."""
    rows = []
    for number, (phrase, label, base) in enumerate([(p, x, True) for p, x in phrases.items()] + [(p, x, False) for p, x in notices.items()]):
        parts = phrase.split(" ")
        n = len(parts) - k + 1
        if n < 1:
            raise ValueError(f"shorter than {k} words: {phrase}")
        rows += [(number, label, base, n, i, " ".join(parts[i:i + k])) for i in range(n)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, at int, gram string")


def text_grams(docs: DataFrame, k: int) -> DataFrame:
    """(id, place int from 0, gram string)."""
    listed = docs.select("id", words(F.col("text")).alias("words")).filter(F.size("words") >= k)
    shifted = [F.slice("words", i + 1, F.size("words") - (k - 1)).alias(f"w{i}") for i in range(k)]
    placed = listed.select("id", F.posexplode(F.arrays_zip(*shifted)).alias("place", "w"))
    return placed.select("id", "place", F.concat_ws(" ", *[F.col(f"w.w{i}") for i in range(k)]).alias("gram"))


def matches(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, k: int = GRAM) -> DataFrame:
    """(id, template, label, base, n_grams, place, at): all votes.  The templates are literals
    of this module or the caller (a few hundred rows), so they are broadcast."""
    templates = template_grams(docs.sparkSession, phrases, notices, k).withColumn("hash", F.xxhash64("gram"))
    grams = text_grams(docs, k).withColumn("hash", F.xxhash64("gram"))
    on = (grams["hash"] == templates["hash"]) & (grams["gram"] == templates["gram"])
    return grams.join(F.broadcast(templates), on).select("id", "template", "label", "base", "n_grams", "place", "at")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, k: int = GRAM,
         near: int = NEAR, threshold: float = THRESHOLD) -> DataFrame:
    """(id, template, label, base, first, last, covered double): base phrases at each place
    where they stand, notices at each verified span (words, last included)."""
    votes = matches(docs, phrases, notices, k).withColumn("diagonal", F.col("place") - F.col("at"))
    diagonals = votes.groupBy("id", "template", "label", "base", "n_grams", "diagonal").agg(
        F.count("*").alias("votes"), F.min("place").alias("lo"), F.max("place").alias("hi"),
        F.collect_set("at").alias("ats"))  # at most n_grams positions
    exact = diagonals.filter("base and votes = n_grams").select(
        "id", "template", "label", "base", F.col("diagonal").alias("first"),
        (F.col("diagonal") + F.col("n_grams") + F.lit(k - 2)).alias("last"), F.lit(1.0).alias("covered"))
    order = Window.partitionBy("id", "template").orderBy("diagonal")
    runs = (diagonals.filter("not base")
            .withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int"))
            .withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(order)))
    merged = runs.groupBy("id", "template", "label", "base", "n_grams", "span").agg(
        F.min("lo").alias("first"), F.max(F.col("hi") + (k - 1)).alias("last"),
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    spans = merged.withColumn("covered", F.size("ats") / F.col("n_grams")).filter((F.col("covered") >= threshold) & (F.size("ats") >= F.least("n_grams", F.lit(LEAST))))
    return exact.unionByName(spans.select("id", "template", "label", "base", "first", "last", "covered"))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per id: n_words, n_base, first_word, last_word, base_labels, labels, score and
    the spans array of (label, first, last, covered).  The score is the largest covered part
    of a template, 0 without any."""
    docs = texts(df, id_col, text_col)
    found = scan(docs, **options)
    per = found.groupBy("id").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_set"),
        F.collect_set("label").alias("set"),
        F.max("covered").alias("score"),
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "covered"))).alias("spans"))
    counted = docs.select("id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(per, "id", "left").select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce(F.array_join(F.sort_array("base_set"), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.sort_array("set"), ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans")

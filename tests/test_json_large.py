"""JSON texts that VARIANT can't hold give the same answers as others."""

import json

from pyspark.sql import functions as F

from tessera.functions import jsonfn
from tessera.operators import notebooks as nbops
from tessera.operators import validation as val

LONG = 20_100_000
META = '"metadata": {}, "nbformat": 4, "nbformat_minor": 4'


def test_is_json(spark):
    good = ['{"a": 1}', ' [1, {"b": []}]\n', "3", '"x"', "null", '{"a": 1, "a": 2}', '{"z": 1}']
    bad = ["", " ", None, "{", '{"a": 1', '{"a": 1} x', '{"a": 1} {}', "1, 2", '1, "x": 2', "1], [2", '1,"z":0} x', '1],"z":0} x', "1}", "{'a': 1}", "NaN", "[1,]", '"', "a", '{"a": "\n"}']
    rows = spark.createDataFrame(list(enumerate(good + bad)), "i int, raw string")
    got = {r.i: r.ok for r in rows.select("i", jsonfn.is_json("raw").alias("ok")).collect()}
    assert got == {i: i < len(good) for i in range(len(good + bad))}


def test_large_and_repeated_keys(spark):
    code = '{"cell_type": "code", "source": ["a = 1\\n", "b = 2"], "metadata": {"k": 1}'
    rows = spark.createDataFrame([
        (1, '{"cells": [' + code + '}], "metadata": {}, ' + META + "}"),
        (3, '{"cells": [{"source": "no kind, and some text"}], ' + META + "}"), (4, "garbage"), (5, "{}"),
        (6, '{"cells": [{"cell_type": "markdown", "cell_type": "code", "source": "[\\"x y z w\\"]", "metadata": {}}], ' + META + "}"),
    ], "notebook_id bigint, raw string")
    long = F.repeat(F.lit("x"), F.lit(LONG))
    cells = lambda *parts: F.concat(F.lit('{"k": 7, "cells": ['), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("], " + META + "}"))
    big = spark.range(1).select(F.lit(2).cast("bigint").alias("notebook_id"), cells(code + ', "outputs": ["', long, '"]}').alias("raw")).unionByName(
        spark.range(1).select(F.lit(7).cast("bigint").alias("notebook_id"), cells('{"cell_type": "code", "source": "', long, '"}').alias("raw")))
    nbs = rows.unionByName(big)
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    try:
        for allowed in ("true", "false"):
            spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
            got = {r.notebook_id: (r.type, r.n, r.metadata) for r in nbops.explode_cells(nbs).select("notebook_id", "type", F.length("content").alias("n"), "metadata").collect()}
            assert got == {1: ("code", 24, '{"k":1}'), 2: ("code", 24, '{"k":1}'), 6: ("code", 24, "{}"), 7: ("code", LONG + 13, "{}")}
            v = {r.notebook_id: (r.json_ok, r.n_cells, r.valid) for r in val.notebook_verdicts(nbs).collect()}
            assert v == {1: (True, 1, True), 2: (True, 1, True), 3: (True, 1, False), 4: (False, 0, False), 5: (True, 0, False), 6: (True, 1, True), 7: (True, 1, False)}
            assert {r.notebook_id: r.reason for r in nbops.rejected_notebooks(nbs).collect()} == {3: "missing_cell_type", 4: "not_json", 5: "no_cells_array"}
            assert {r.notebook_id for r in nbops.explodable_notebooks(nbs).filter("ok").collect()} == {1, 2, 5, 6, 7}
            drafts = nbops.normalise_drafts(nbs.withColumn("task", F.lit("t")), "task", "raw")
            assert [r.notebook_id for r in drafts.filter("is_fallback").select("notebook_id").collect()] == [4]
            k = {r.notebook_id: r.k for r in nbs.select("notebook_id", jsonfn.bigint_field("raw", "k").alias("k")).collect()}
            assert k == {1: None, 2: 7, 3: None, 4: None, 5: None, 6: None, 7: 7}
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)

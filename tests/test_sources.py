import json
import os

from pyspark.sql import functions as F

from tessera.operators.notebooks import explode_cells
from tessera.sources import files, sinks


def test_jsonl_round_trip_and_report(spark, tmp_path):
    cells = spark.createDataFrame([("code", "<code>x=1</code>", "{}", 1, "t", "Python")],
                                  "type string, content string, metadata string, notebook_id bigint, title string, language string")
    out = str(tmp_path / "cells")
    sinks.write_cells_jsonl(cells, out, partition_by="language")
    back = files.read_cells_jsonl(spark, out)
    assert back.count() == 1 and back.first()["content"] == "<code>x=1</code>"
    rep = spark.createDataFrame([("valid", 3, True)], "metric string, value bigint, ok boolean")
    sinks.write_report_json(rep, str(tmp_path / "rep"))
    line = spark.read.text(str(tmp_path / "rep")).first()[0]
    assert json.loads(line) == {"metric": "valid", "value": 3, "ok": True}


def test_put_if_absent(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.save_if_absent(spark.createDataFrame([(1,)], "a int"), p)
    sinks.save_if_absent(spark.createDataFrame([(2,), (3,)], "a int"), p)
    assert [r[0] for r in spark.read.parquet(p).collect()] == [1]


def test_notebook_dir_scan_listing_and_preview(spark, tmp_path):
    d = tmp_path / "nb" / "0" / "0"
    d.mkdir(parents=True)
    for i in (5, 7):
        (d / f"{i}.json").write_text(json.dumps({"cells": [{"cell_type": "code", "source": "x = 1"}],
                                                 "metadata": {}, "nbformat": 4, "nbformat_minor": 4}))
    nbs = files.read_notebook_dir(spark, str(tmp_path / "nb"))
    assert sorted(r[0] for r in nbs.select("notebook_id").collect()) == [5, 7]
    assert explode_cells(nbs).count() == 2
    listing = files.list_files(spark, str(tmp_path / "nb"), "*.json")
    assert listing.count() == 2 and all(r["length"] > 0 for r in listing.collect())
    rules = tmp_path / "DATA_CONSTITUTION.txt"
    rules.write_text("x" * 5000)
    assert len(files.rules_preview(spark, str(rules)).first()[0]) == 2048
    assert files.rules_preview(spark, str(tmp_path / "missing.txt")).first()[0] == "NOT FOUND"
    path = spark.createDataFrame([(1234567890,)], "id bigint").select(files.id_path("id")).first()[0]
    assert path == "1234/567/1234567890.json"
    assert os.path.exists(str(d / "5.json"))


def test_build_index(spark, tmp_path):
    from tessera.operators.knn import build_index
    cells = spark.createDataFrame([("code", f"<code>x = {i}</code>", "{}", i, "t", "Python") for i in range(20)],
                                  "type string, content string, metadata string, notebook_id bigint, title string, language string")
    src = str(tmp_path / "cells")
    sinks.write_cells_jsonl(cells, src)
    build_index(spark, src, str(tmp_path / "index"), num_features=32, buckets=4)
    idx = spark.read.parquet(str(tmp_path / "index"))
    assert idx.count() == 20 and set(idx.columns) >= {"id", "content", "embedding", "bucket"}


def test_id_path_exact_for_large_ids(spark):
    from tessera.sources.files import id_path
    df = spark.createDataFrame([(9007199254740993,), (123456789,), (5,)], "id bigint")
    assert [r[0] for r in df.select(id_path("id")).collect()] == [
        "9007199254/740/9007199254740993.json", "123/456/123456789.json", "0/0/5.json"]


def test_last_duplicate_wins_by_source_position(spark, tmp_path):
    """Several files, split into many parts: the last row of a key in path and line order wins."""
    from pyspark.sql import types as T

    from tessera.operators.joins import lookup_join
    want = {}
    for f in range(3):
        rows = [(i * 7 % 50 if f < 2 else i % 20, f"name {f} {i}") for i in range(400)]
        (tmp_path / f"{f}.csv").write_text("Id,Name\n" + "".join(f"{k},{v}\n" for k, v in rows))
        want |= dict(rows)
    schema = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Name", T.StringType())])
    keys = spark.range(55).withColumnRenamed("id", "k")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", split):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            dim = files.read_csv_typed(spark, str(tmp_path), schema, position="_position")
            got = {x.k: x.Language for x in lookup_join(keys, dim, "k", "Id", "Name", "Language", order_col="_position").collect()}
            assert got == {k: want.get(k, "unknown") for k in range(55)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)

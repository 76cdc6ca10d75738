import json
import os
import tempfile

from tessera.streaming.cells import cells_stream, run_to_parquet


def test_cells_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="tessera-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    for i in range(6):
        nb = {"cells": [{"cell_type": "markdown", "source": f"# nb {i}"}, {"cell_type": "code", "source": "x = 1"}],
              "metadata": {}, "nbformat": 4, "nbformat_minor": 4}
        with open(os.path.join(src, f"{i}.json"), "w") as f:
            json.dump(nb, f)
    run_to_parquet(cells_stream(spark, src), os.path.join(d, "out"), os.path.join(d, "ckpt"))
    out = spark.read.parquet(os.path.join(d, "out"))
    assert out.count() == 12
    assert sorted(r[0] for r in out.select("notebook_id").distinct().collect()) == list(range(6))
    # A second run with no new files appends nothing (progress is in the checkpoint).
    run_to_parquet(cells_stream(spark, src), os.path.join(d, "out"), os.path.join(d, "ckpt"))
    assert spark.read.parquet(os.path.join(d, "out")).count() == 12


def test_graph_append_stream(spark):
    from tessera.operators import graph
    from tessera.streaming.graph import edge_stream, node_stream
    d = tempfile.mkdtemp(prefix="tessera-graph-")
    for sub in ("nodes", "edges"):
        os.makedirs(os.path.join(d, sub))
    with open(os.path.join(d, "nodes", "a.json"), "w") as f:
        f.write(json.dumps({"type": "fact", "content": "pandas joins"}) + "\n")
        f.write(json.dumps({"type": "fact", "content": "spark joins"}) + "\n")
    run_to_parquet(node_stream(spark, os.path.join(d, "nodes")), os.path.join(d, "n"), os.path.join(d, "nc"))
    nodes = spark.read.parquet(os.path.join(d, "n"))
    ids = {r["content"]: r["id"] for r in nodes.collect()}
    with open(os.path.join(d, "edges", "a.json"), "w") as f:
        f.write(json.dumps({"source_id": ids["pandas joins"], "target_id": ids["spark joins"], "relation": "see"}) + "\n")
    run_to_parquet(edge_stream(spark, os.path.join(d, "edges")), os.path.join(d, "e"), os.path.join(d, "ec"))
    edges = spark.read.parquet(os.path.join(d, "e"))
    nb = graph.neighbors(nodes, edges).collect()
    assert [r["content"] for r in nb] == ["spark joins"]
    with open(os.path.join(d, "nodes", "b.json"), "w") as f:
        f.write(json.dumps({"type": "fact", "content": "third"}) + "\n")
    run_to_parquet(node_stream(spark, os.path.join(d, "nodes")), os.path.join(d, "n"), os.path.join(d, "nc"))
    assert spark.read.parquet(os.path.join(d, "n")).count() == 3


def test_cell_verdict_stream_matches_batch(spark):
    from tessera.operators import cells as cellops
    from tessera.streaming.cells import cell_verdict_stream, latest_verdicts, run_verdicts_log
    d = tempfile.mkdtemp(prefix="tessera-cellstream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    rows = [(nb, pos, "markdown" if pos % 2 == 0 else "code",
             "# heading here" if pos % 2 == 0 else ("x = 1 + 2 + 3" if (nb + pos) % 3 else "def (:"), None)
            for nb in range(5) for pos in range(4)]

    def write(name, part):
        with open(os.path.join(src, name), "w") as f:
            for nb, pos, kind, source, meta in part:
                f.write(json.dumps({"notebook_id": nb, "position": pos, "kind": kind, "source": source,
                                    "metadata": meta}) + "\n")
    write("a.json", rows[:9])
    out, ckpt = os.path.join(d, "out"), os.path.join(d, "ckpt")
    run_verdicts_log(cell_verdict_stream(spark, src), out, ckpt)
    write("b.json", rows[9:])                      # notebook 2 is split across the two files
    run_verdicts_log(cell_verdict_stream(spark, src), out, ckpt)
    got = {r["notebook_id"]: (r["n_cells"], r["n_errors"], r["valid"]) for r in latest_verdicts(spark, out).collect()}
    batch = spark.createDataFrame(rows, "notebook_id bigint, position bigint, kind string, source string, metadata string")
    want = {r["notebook_id"]: (r["n_cells"], r["n_errors"], r["valid"]) for r in cellops.notebook_verdicts(batch).collect()}
    assert got == want and len(got) == 5

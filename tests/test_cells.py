from conftest import SF001
from tessera.operators import cells as cellops
from tessera.operators import validation as val
from tessera.plans.fixtures import cells, notebooks


def _cells(spark, rows):
    return spark.createDataFrame(rows, "notebook_id bigint, position bigint, kind string, source string, metadata string")


def test_cell_rows_and_notebook_files_agree(spark):
    """The same conversations as cell rows and as notebook JSON files give the same verdicts."""
    by_cells = {r["notebook_id"]: (r["n_cells"], r["n_invalid_code"], r["n_invalid_markdown"], r["valid"])
                for r in cellops.notebook_verdicts(cells(spark, SF001), check_code=True).collect()}
    by_files = {r["notebook_id"]: (r["n_cells"], r["n_invalid_code"], r["n_invalid_markdown"], r["valid"])
                for r in val.notebook_verdicts(notebooks(spark, SF001), check_code=True).collect()}
    assert by_cells == by_files
    assert len(by_cells) > 0


def test_explode_rejects_whole_notebook(spark):
    c = _cells(spark, [
        (1, 0, "markdown", "# title here", None), (1, 1, "code", "print('hello')", '{"a":1}'),
        (1, 2, "raw", None, None),                                   # other kinds need no source
        (2, 0, "code", "x = 1 + 2 + 3", None), (2, 1, None, "no kind", None),  # missing kind: all of 2 goes
        (3, 0, "code", None, None)])                                 # kept kind without source: 3 goes
    got = sorted((r["notebook_id"], r["position"], r["type"], r["content"], r["metadata"])
                 for r in cellops.explode_cells(c).collect())
    assert got == [(1, 0, "markdown", "<markdown># title here</markdown>", "{}"),
                   (1, 1, "code", "<code>print('hello')</code>", '{"a":1}')]
    ok = {r["notebook_id"]: r["ok"] for r in cellops.explodable_notebooks(c).collect()}
    assert ok == {1: True, 2: False, 3: False}


def test_cap_cells_first_twenty_kept(spark):
    rows = [(7, i, "code" if i % 3 else "raw", "y" * (i * 100), None) for i in range(60)]
    got = cellops.cap_cells(_cells(spark, rows)).orderBy("cell_index").collect()
    kept = [i for i in range(60) if i % 3]
    assert [r["cell_index"] for r in got] == list(range(20))
    assert [len(r["source"]) for r in got] == [min(1000, i * 100) for i in kept[:20]]


def test_error_samples_first_notebooks_first_errors(spark):
    rows = []
    for nb in range(1, 9):
        for pos in range(6):
            bad = (nb % 2 == 0) and pos >= 2                 # even notebooks: errors from position 2 on
            rows.append((nb, pos, "code", "x" if bad else "value = 123456", None))
    rows.append((9, 0, None, "kindless cell", None))
    got = {r["notebook_id"]: r["errors"] for r in cellops.error_samples(_cells(spark, rows)).collect()}
    assert got == {2: "too_short,too_short,too_short", 4: "too_short,too_short,too_short",
                   6: "too_short,too_short,too_short", 8: "too_short,too_short,too_short",
                   9: "missing_cell_type"}


def test_verdicts_count_errors_by_kind(spark):
    c = _cells(spark, [(1, 0, "markdown", "plain words only", None), (1, 1, "code", "def f(:\n  pass", None),
                       (2, 0, "code", "value = 42  # fine", None)])
    v = {r["notebook_id"]: r.asDict() for r in cellops.notebook_verdicts(c, check_code=True).collect()}
    assert (v[1]["n_invalid_markdown"], v[1]["n_invalid_code"], v[1]["valid"]) == (1, 1, False)
    assert (v[2]["n_errors"], v[2]["valid"]) == (0, True)

"""Reference fixtures (KernelVersions / KernelLanguages / notebooks) and edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import validation as val


def nb(cells, drop=()):
    d = {"cells": cells, "metadata": {}, "nbformat": 4, "nbformat_minor": 4}
    for k in drop:
        d.pop(k)
    return json.dumps(d)


def good_nb(i):
    return nb([{"cell_type": "code", "source": f"x = {i}\nprint(x)", "metadata": {}, "execution_count": 1, "outputs": []},
               {"cell_type": "markdown", "source": "# Analysis notes", "metadata": {}}])


LANGS = [(1, "Python"), (2, "R"), (3, "Julia"), (4, "JavaScript"), (5, "SQL")]


def report(df):
    return {r["metric"]: r["value"] for r in df.collect()}


@pytest.fixture(scope="module")
def happy(spark):
    langs_ids = [1, 2, 3, 4, 5, 1, 2, 1, 3, 4]
    meta = spark.createDataFrame(
        [(i, f"Notebook {i}", langs_ids[i - 1], f"2023-01-{i:02d} {9 + i}:00:00", 1) for i in range(1, 11)],
        "Id bigint, Title string, ScriptLanguageId bigint, CreationDate string, VersionNumber bigint")
    nbs = spark.createDataFrame([(i, good_nb(i)) for i in range(1, 11)], "notebook_id bigint, raw string")
    langs = spark.createDataFrame(LANGS, "Id bigint, Name string")
    return meta, nbs, langs


def test_happy_case(spark, happy):
    meta, nbs, langs = happy
    r = report(val.validate_dataset(meta, nbs, langs))
    assert r["total_notebooks"] == 10 and r["valid_notebooks"] == 10 and r["invalid_notebooks"] == 0
    assert r["invalid_language"] == 0 and r["invalid_canonical"] == 5
    assert r["invalid_language_total"] == 5    # the reference's single counter
    assert r["missing_notebooks"] == 0 and r["duplicate_ids"] == 0 and r["invalid_timestamps"] == 0
    assert r["invalid_code"] == 0 and r["invalid_markdown"] == 0


def test_happy_distribution(spark, happy):
    from tessera.operators.joins import lookup_join
    meta, _, langs = happy
    m = lookup_join(meta, langs, "ScriptLanguageId", "Id", "Name", "Language")
    dist = {r["language"]: r["n"] for r in val.language_distribution(m, "Language").collect()}
    assert dist == {"Python": 3, "R": 2, "Julia": 2, "JavaScript": 2, "SQL": 1}


@pytest.mark.parametrize("n", [5, 8])
def test_sampled(spark, happy, n):
    meta, nbs, langs = happy
    r = report(val.validate_dataset(meta, nbs, langs, sample_size=n))
    assert r["total_notebooks"] == n and r["valid_notebooks"] == n and r["total_rows"] == 10


def test_error_case(spark):
    meta = spark.createDataFrame(
        [(1, "a", 1, "2023-01-01 10:00:00"), (2, "b", 2, "2023-01-02 10:00:00"), (3, "c", 999, "invalid-date"),
         (4, "d", 4, "2023-01-04 10:00:00"), (5, "e", 5, "2023-01-05 10:00:00")],
        "Id bigint, Title string, ScriptLanguageId bigint, CreationDate string")
    nbs = spark.createDataFrame([(i, nb([{"cell_type": "code", "source": "print('hello')"}])) for i in range(1, 6)],
                                "notebook_id bigint, raw string")
    langs = spark.createDataFrame([x for x in LANGS if x[0] != 3], "Id bigint, Name string")
    r = report(val.validate_dataset(meta, nbs, langs))
    assert r["valid_notebooks"] == 5 and r["invalid_notebooks"] == 0
    assert r["invalid_language"] == 0          # 'unknown' is allowed
    assert r["invalid_canonical"] == 3         # unknown, JavaScript, SQL
    assert r["invalid_timestamps"] == 1        # raw text checked before coercion (deliberate)


def test_cell_and_structure_cases(spark):
    long9, long10 = "a" * 9, "print(1) "  # 9 chars
    cases = [
        (1, "{not json"),                                               # broken JSON
        (2, "[1, 2]"),                                                  # not an object
        (3, nb([], drop=("nbformat_minor",))),                          # missing field
        (4, nb([{"source": "print('x')  "}])),                          # no cell_type
        (5, nb([{"cell_type": "raw", "source": "whatever text"}])),     # bad kind
        (6, nb([{"cell_type": "code"}])),                               # no source
        (7, nb([{"cell_type": "code", "source": long9}])),              # too short
        (8, nb([{"cell_type": "code", "source": "x=" + "1" * 8}])),     # 10 chars ok
        (9, nb([{"cell_type": "code", "source": "#" + "x" * 9999}])),   # 10 000 ok
        (10, nb([{"cell_type": "code", "source": "#" + "x" * 10000}])),  # too long
        (11, nb([{"cell_type": "code", "source": "!pip install x"}])),  # not Python
        (12, nb([{"cell_type": "markdown", "source": "plain words here"}])),  # unformatted
        (13, nb([{"cell_type": "code", "source": ["import os\n", "print(os.sep)"]}])),  # list source
        (14, nb([])),                                                   # empty cells: valid
    ]
    nbs = spark.createDataFrame(cases, "notebook_id bigint, raw string")
    v = {r["notebook_id"]: r for r in val.notebook_verdicts(nbs, check_code=True).collect()}
    assert not v[1]["json_ok"] and not v[2]["json_ok"] and not v[1]["valid"]
    assert v[3]["missing_fields"] == ["nbformat_minor"] and not v[3]["valid"]
    assert v[4]["errors"] == ["missing_cell_type"]
    assert v[5]["errors"] == ["invalid_cell_type"]
    assert v[6]["errors"] == ["missing_source"]
    assert v[7]["errors"] == ["too_short"]
    assert v[8]["valid"] and v[9]["valid"]
    assert v[10]["errors"] == ["too_long"]
    assert v[11]["errors"] == ["invalid_code"] and v[11]["n_invalid_code"] == 1
    assert v[12]["errors"] == ["invalid_markdown"] and v[12]["n_invalid_markdown"] == 1
    assert v[13]["valid"] and v[14]["valid"]


def test_missing_file_and_duplicates(spark):
    meta = spark.createDataFrame([(1, "Python"), (1, "Python"), (2, " R "), (3, None)], "Id bigint, Language string")
    nbs = spark.createDataFrame([(1, nb([]))], "notebook_id bigint, raw string")
    r = report(val.validate_dataset(meta, nbs, None, date_col=None))
    assert r["duplicate_ids"] == 2
    assert r["missing_notebooks"] == 2
    assert r["valid_notebooks"] == 2           # both rows with id 1 look the file up
    assert r["invalid_language"] == 2          # ' R ' is not stripped for the allow-list; NULL invalid
    assert r["invalid_canonical"] == 1         # only NULL -> other


def test_canonical_language(spark):
    from tessera.functions.text import canonical_language
    df = spark.createDataFrame([(" R ",), ("ipython notebook html",), (None,), ("Julia",), ("\tPython\n",)], "l string")
    got = [r[0] for r in df.select(canonical_language("l")).collect()]
    assert got == ["r", "python", "other", "other", "python"]


def test_strict_timestamps(spark):
    from tessera.functions.temporal import invalid_timestamp
    df = spark.createDataFrame([("2023-01-01",), ("2023-1-1 1:2:3",), ("2023-01-01 10:00:00.5",), (" 2023-01-01",),
                                ("2023-01-01T10:00:00",), (None,), ("invalid-date",)], "s string")
    got = [r[0] for r in df.select(invalid_timestamp("s")).collect()]
    assert got == [False, False, True, True, True, False, True]


def test_explode_cells_order_and_errors(spark):
    nbs = spark.createDataFrame([
        (1, nb([{"cell_type": "markdown", "source": "# t"}, {"cell_type": "raw", "source": "x"},
                {"cell_type": "code", "source": ["a = 1\n", "b = 2"], "metadata": {"k": 1}}])),
        (2, nb([{"source": "no kind"}, {"cell_type": "code", "source": "x"}])),   # raises -> no rows
        (3, "garbage")], "notebook_id bigint, raw string")
    rows = [tuple(r) for r in nbs.transform(lambda d: __import__("tessera.operators.notebooks", fromlist=["x"])
                                            .explode_cells(d)).orderBy("notebook_id", "position").collect()]
    assert rows == [(1, 0, "markdown", "<markdown># t</markdown>", "{}"),
                    (1, 2, "code", "<code>a = 1\nb = 2</code>", '{"k":1}')]


def test_error_samples(spark):
    nbs = spark.createDataFrame([(i, nb([{"cell_type": "code", "source": "x"}] * 5)) for i in range(8)],
                                "notebook_id bigint, raw string")
    s = val.error_samples(val.notebook_verdicts(nbs)).collect()
    assert len(s) == 5 and all(len(r["errors"]) == 3 for r in s)


def test_timestamps_ignore_session_zone(spark):
    from tessera.functions.temporal import coerce_timestamp, invalid_timestamp
    from tessera.operators.profile import profile_datetime
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([("2023-03-12 02:30:00",), ("2023-11-05 01:30:00",), ("bad",)], "s string")
        got = [r[0] for r in df.select(coerce_timestamp("s").cast("string")).collect()]
        assert got == ["2023-03-12 02:30:00", "2023-11-05 01:30:00", None]
        assert [r[0] for r in df.select(invalid_timestamp("s")).collect()] == [False, False, True]
        ts = df.filter("s != 'bad'").select(coerce_timestamp("s").alias("t"))
        p = profile_datetime(ts, ["t"]).collect()[0]
        assert str(p["min"]) == "2023-03-12 02:30:00" and str(p["max"]) == "2023-11-05 01:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)

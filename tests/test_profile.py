import numpy as np
from pyspark.sql import functions as F

from tessera.operators import profile


def test_exact_quantiles_histogram_path(spark, monkeypatch):
    monkeypatch.setattr(profile, "FINAL_MAX", 50)
    monkeypatch.setattr(profile, "GRID", 8)
    vals = np.random.default_rng(1).normal(size=3000).round(3)
    vals[:500] = 0.25  # a hot value
    df = spark.createDataFrame([("x", float(v)) for v in vals], "column_name string, value double")
    got = {r["p"]: r["q"] for r in profile.exact_quantiles(df, [0.1, 0.25, 0.5, 0.9]).collect()}
    for p, q in got.items():
        assert abs(q - np.quantile(vals, p)) < 1e-12


def test_profile_numeric_and_categorical(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b"), (None, "a"), (10.0, None)], "x double, c string")
    n = profile.profile_numeric(df, ["x"]).collect()[0]
    assert n["count"] == 4 and abs(n["mean"] - 4.0) < 1e-12 and n["p50"] == 2.5 and n["p25"] == 1.75
    c = profile.profile_categorical(df, ["c"]).collect()[0]
    assert (c["count"], c["unique"], c["top"], c["freq"]) == (4, 2, "a", 2)   # tie -> smallest value


def test_missingness_and_types(spark):
    df = spark.createDataFrame([("1", None), ("2.5", "x"), ("true", None), ("2023-01-01", "y"), (None, "z")], "a string, b string")
    miss = {r[0]: r[1] for r in profile.missingness(df).collect()}
    assert miss == {"a": 1, "b": 2}
    tp = {(r[0], r[1]): r[2] for r in profile.type_profile(df, ["a"]).collect()}
    assert tp == {("a", "int"): 1, ("a", "float"): 1, ("a", "bool"): 1, ("a", "timestamp"): 1, ("a", "null"): 1}


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "Id bigint")
    r = profile.duplicate_rows(df, ["Id"]).collect()[0]
    assert r["duplicate_rows"] == 2 and r["duplicate_keys"] == 1


def test_rule_parse_and_report(spark, tmp_path):
    from tessera.operators.rules_check import rule_report
    from tessera.sources.rules import parse_rules, rules_dict
    doc = tmp_path / "rules.txt"
    doc.write_text("## A.csv\n- Id: int64 (unique, required)\n- Name: string (nullable)\n- Ref: int64 (FK to B.csv)\n"
                   "- **Foreign Keys:**\n  - Ref → B.Id\n  - Other → (if present, see C.csv)\n\n## B.csv\n- Id: int64 (unique)\n")
    rules = rules_dict(parse_rules(spark, str(doc)))
    assert [c["column"] for c in rules["A.csv"]["columns"]] == ["Id", "Name", "Ref"]
    assert rules["A.csv"]["columns"][0]["is_unique"] and rules["A.csv"]["columns"][0]["required"]
    assert rules["A.csv"]["fks"][0]["fk_column"] == "Id"
    a = spark.createDataFrame([(1, None, 5), (1, "x", 6), (2, "y", None)], "Id bigint, Name string, Ref bigint")
    b = spark.createDataFrame([(5,)], "Id bigint")
    rep = {(r[1], r[2]): r[3] for r in rule_report(spark, {"A": a, "B": b}, rules).collect() if r[0] == "A.csv"}
    assert rep[("Id", "duplicate_rows")] == 2 and rep[("Ref", "fk_orphans")] == 1 and rep[("Name", "missing")] == 1


def test_csv_typed_read(spark, tmp_path):
    from pyspark.sql import types as T

    from tessera.sources.files import read_csv_typed
    p = tmp_path / "k.csv"
    p.write_text("Id,CreationDate,Score\n1,2023-01-01 10:00:00,1.5\n2,invalid-date,NA\nx,2023-01-03,2\n")
    schema = T.StructType([T.StructField("Id", T.LongType()), T.StructField("CreationDate", T.TimestampNTZType()),
                           T.StructField("Score", T.DoubleType())])
    rows = read_csv_typed(spark, str(p), schema).orderBy(F.col("Id").asc_nulls_last()).collect()
    assert rows[0]["Id"] == 1 and rows[1]["bad_CreationDate"] and rows[1]["Score"] is None and not rows[1]["bad_Score"]
    assert rows[2]["Id"] is None and rows[2]["bad_Id"]


def test_column_quantiles_bracket_path(spark, monkeypatch):
    monkeypatch.setattr(profile, "FINAL_MAX", 200)
    rng = np.random.default_rng(4)
    a = rng.exponential(size=5000).round(4)
    b = rng.integers(0, 3, 5000).astype(float)          # heavy ties -> fallback path
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {(r[0], r[1]): r[2] for r in profile.column_quantiles(df, ["a", "b"], [0.1, 0.5, 0.99]).collect()}
    for c, arr in (("a", a), ("b", b)):
        for p in (0.1, 0.5, 0.99):
            assert abs(got[(c, p)] - np.quantile(arr, p)) < 1e-12


def test_column_quantiles_low_cardinality(spark):
    vals = [float(i % 7) for i in range(1000)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r[1]: r[2] for r in profile.column_quantiles(df, ["x"], [0.25, 0.5, 0.9]).collect()}
    arr = np.array([v for v in vals if v is not None])
    for p, q in got.items():
        assert abs(q - np.quantile(arr, p)) < 1e-12


def test_rule_report_sampled(spark, tmp_path):
    from tessera.operators.rules_check import rule_report
    from tessera.sources.rules import parse_rules, rules_dict
    doc = tmp_path / "rules.txt"
    doc.write_text("## A.csv\n- Id: int64 (unique, required)\n- Name: string (nullable)\n")
    rules = rules_dict(parse_rules(spark, str(doc)))
    a = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(100)], "Id bigint, Name string")
    rep = {(r[1], r[2]): r[3] for r in rule_report(spark, {"A": a}, rules, sample_size=10).collect()}
    assert 0 < rep[("Name", "missing")] <= 10

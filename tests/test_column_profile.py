import datetime as dt
import hashlib

import numpy as np

from conftest import SF01
from tessera.operators import column_profile as cp
from tessera.session import read_table


def by_column(df):
    return {(r["table_name"], r["column_name"]): r for r in df.collect()}


def test_kinds_nulls_ties_and_odd_names(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 6)
    rows = [(1, 2.0, "b", True, t, [1]), (3, None, "a", None, None, None), (None, 4.0, "a", True, t + dt.timedelta(days=2), [2]), (5, float("nan"), "b", False, None, [1])]
    df = spark.createDataFrame(rows, "i int, `a.b` double, `x``y` string, flag boolean, at timestamp_ntz, items array<int>")
    p = by_column(cp.profile_tables({"t": df, "u": df.select("i")}))
    assert len(p) == 7
    i = p["t", "i"]
    assert (i["kind"], i["count"], i["n_missing"], i["mean"], i["std"], i["min"], i["max"], i["p50"]) == ("numeric", 3, 1, 3.0, 2.0, 1.0, 5.0, 3.0)
    assert p["t", "a.b"]["count"] == 3 and p["t", "a.b"]["min"] == 2.0 and p["t", "a.b"]["p25"] == 2.0     # NaN: a value, in no sketch
    text = p["t", "x`y"]
    tied = min("ab", key=lambda v: hashlib.md5(v.encode()).hexdigest())
    assert (text["kind"], text["count"], text["n_distinct"], text["freq"], text["top"]) == ("text", 4, 2, 2, tied)
    assert (p["t", "flag"]["top"], p["t", "flag"]["freq"], p["t", "flag"]["n_missing"]) == ("true", 2, 1)
    at = p["t", "at"]
    assert (at["kind"], at["first"], at["last"], at["t25"]) == ("datetime", t, t + dt.timedelta(days=2), t)
    assert (p["t", "items"]["kind"], p["t", "items"]["count"], p["t", "items"]["mean"]) == ("other", 3, None)


def test_empty_and_all_null(spark):
    schema = "n double, s string, at timestamp, flag boolean"
    for rows in ([], [(None, None, None, None)]):
        p = by_column(cp.profile_tables({"t": spark.createDataFrame(rows, schema)}))
        assert len(p) == 4
        assert all(r["count"] == 0 and r["n_missing"] == len(rows) and r["p50"] is None and r["t50"] is None and r["top"] is None for r in p.values())


def test_quartiles_within_the_stated_rank_error(spark):
    li = read_table(spark, SF01, "lineitem")
    p = by_column(cp.measures(li, "lineitem"))
    for c in ("l_orderkey", "l_extendedprice", "l_quantity", "l_tax"):
        x = np.sort(np.array([r[0] for r in li.select(c).collect()], dtype=float))
        for q in cp.QUARTILES:
            v = p["lineitem", c][f"p{int(100 * q)}"]
            low, high = np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)
            assert low - 2 * cp.RANK_ERROR <= q <= high + 2 * cp.RANK_ERROR
    times = np.sort(np.array([r[0] for r in li.select("l_shipdate").collect()], dtype="datetime64[us]"))
    v = np.datetime64(p["lineitem", "l_shipdate"]["t50"])
    assert abs(np.searchsorted(times, v, "right") / len(times) - 0.5) < 0.01


def test_no_text_is_shuffled(spark):
    docs = read_table(spark, SF01, "documents")
    plan = cp._hashes(docs, "documents", ["text", "lang"]).groupBy("table_name", "column_name", "h").count()._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchange and all("text" not in line for line in exchange)

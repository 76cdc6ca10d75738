import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = {r["metric"]: r["value"] for r in df.collect()}
    assert rows["total_rows"] == 200 and rows["total_notebooks"] == 200


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def test_queries_without_an_optional_library():
    """A library that only the optional operators need is missing: the other queries stay."""
    import subprocess
    code = ("import sys; sys.modules['tiktoken'] = sys.modules['tokenizers'] = sys.modules['xxhash'] = None; import __spark_entry__ as E; "
            "print(len(E.queries()), set(E.oracle_sql()) <= set(E.queries()))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(E.__file__))
    n, ok = out.stdout.split()
    assert int(n) >= 67 and ok == "True", out.stderr

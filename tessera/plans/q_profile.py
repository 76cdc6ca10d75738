"""Profile, rule, join and scan queries over the TPC-H-like tables."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonfn
from tessera.functions.temporal import coerce_timestamp, invalid_timestamp
from tessera.functions.text import invalid_language
from tessera.operators import column_profile, joins, profile
from tessera.operators.rules_check import rule_report
from tessera.plans.catalog import r6, register
from tessera.plans.fixtures import META_SQL, doc_metadata
from tessera.session import TABLES, read_table
from tessera.sources.files import id_path, source_position
from tessera.sources.rules import parse_rules, rules_dict

RULES_PATH = os.path.join(os.path.dirname(__file__), "testdata_rules.txt")
VALID_LANGS_SQL = ("('python','r','julia','javascript','sql','scala','java','c++','c#','go','rust','swift',"
                   "'kotlin','php','ruby','perl','matlab','octave','sas','stata','spss','unknown')")

NUMERIC_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CATEGORICAL_COLS = ("l_returnflag", "l_linestatus", "l_shipdate")


@register("missingness", """
SELECT * FROM (VALUES
 ('doc_id', (SELECT count(*) FILTER (WHERE doc_id IS NULL) FROM documents)),
 ('text', (SELECT count(*) FILTER (WHERE text IS NULL) FROM documents)),
 ('lang', (SELECT count(*) FILTER (WHERE lang IS NULL) FROM documents)),
 ('source', (SELECT count(*) FILTER (WHERE source IS NULL) FROM documents)),
 ('n_chars', (SELECT count(*) FILTER (WHERE n_chars IS NULL) FROM documents)),
 ('quality', (SELECT count(*) FILTER (WHERE quality IS NULL) FROM documents d LEFT JOIN labels l USING (doc_id)))
) AS t(column_name, n_missing)""")
def q_missingness(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return profile.missingness(docs.join(labels, "doc_id", "left"),
                               ["doc_id", "text", "lang", "source", "n_chars", "quality"])


def _numeric_sql(table, cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM {table}""")
    return "\nUNION ALL ".join(parts)


@register("profile_numeric", _numeric_sql("lineitem", NUMERIC_COLS))
def q_profile_numeric(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    p = profile.profile_numeric(li, NUMERIC_COLS)
    return p.select("column_name", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register("profile_categorical", """
WITH long AS (
  SELECT 'l_returnflag' AS column_name, l_returnflag AS value FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
  UNION ALL SELECT 'l_shipdate', CAST(l_shipdate AS VARCHAR) FROM lineitem),
c AS (SELECT column_name, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL)
SELECT column_name, sum(n)::BIGINT AS count, count(*) AS unique,
       arg_min(value, (-n, value)) AS top, max(n) AS freq
FROM c GROUP BY column_name""")
def q_profile_categorical(spark, sf_dir):
    return profile.profile_categorical(read_table(spark, sf_dir, "lineitem"), CATEGORICAL_COLS)


@register("profile_datetime", """
WITH m AS (SELECT 'o_orderdate' AS column_name, epoch_us(o_orderdate) AS v FROM orders)
SELECT column_name, count(v) AS count,
  make_timestamp(round(avg(v))::BIGINT) AS mean, make_timestamp(min(v)) AS min,
  make_timestamp(round(quantile_cont(v, 0.25))::BIGINT) AS p25,
  make_timestamp(round(quantile_cont(v, 0.5))::BIGINT) AS p50,
  make_timestamp(round(quantile_cont(v, 0.75))::BIGINT) AS p75,
  make_timestamp(max(v)) AS max
FROM m GROUP BY column_name""")
def q_profile_datetime(spark, sf_dir):
    return profile.profile_datetime(read_table(spark, sf_dir, "orders"), ["o_orderdate"])


TYPE_CASE_SQL = """CASE WHEN value IS NULL THEN 'null'
  WHEN regexp_matches(value, '^[+-]?[0-9]+$') THEN 'int'
  WHEN regexp_matches(value, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float'
  WHEN regexp_matches(value, '^(true|false|True|False|TRUE|FALSE)$') THEN 'bool'
  WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}( [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\\.[0-9]+)?)?$') THEN 'timestamp'
  ELSE 'text' END"""


@register("type_profile", f"""
WITH long AS (
  SELECT 'event_type' AS column_name, event_type AS value FROM events
  UNION ALL SELECT 'props', props FROM events
  UNION ALL SELECT 'k', json_extract_string(props, '$.k') FROM events
  UNION ALL SELECT 'ts', CAST(ts AS VARCHAR) FROM events
  UNION ALL SELECT 'flag', CASE WHEN value > 10 THEN 'true' ELSE CAST(user_id AS VARCHAR) END FROM events)
SELECT column_name, {TYPE_CASE_SQL} AS value_class, count(*) AS n FROM long GROUP BY ALL""")
def q_type_profile(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    text = ev.select("event_type", "props", F.get_json_object("props", "$.k").alias("k"),
                     F.col("ts").cast("string").alias("ts"),
                     F.when(F.col("value") > 10, F.lit("true")).otherwise(F.col("user_id").cast("string")).alias("flag"))
    return profile.type_profile(text, ["event_type", "props", "k", "ts", "flag"])


@register("id_column_check", """
SELECT 'event_id' AS column_name, count(*) FILTER (WHERE event_id IS NULL) AS n_null, 0::BIGINT AS n_non_integer FROM events
UNION ALL SELECT 'user_id', count(*) FILTER (WHERE user_id IS NULL), 0 FROM events
UNION ALL SELECT 'value_id', count(*) FILTER (WHERE value IS NULL), count(*) FILTER (WHERE value <> floor(value)) FROM events""")
def q_id_column_check(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("value_id"), "event_type")
    return profile.id_column_check(ev)


@register("invalid_values", f"""
WITH {META_SQL}
SELECT DISTINCT language AS value FROM meta
WHERE coalesce(lower(language) NOT IN {VALID_LANGS_SQL}, true) ORDER BY value LIMIT 10""")
def q_invalid_values(spark, sf_dir):
    meta = doc_metadata(spark, sf_dir)
    return profile.invalid_values(meta, "language", invalid_language(F.col("language")))


@register("duplicate_ids", """
SELECT 'lineitem.l_orderkey' AS key, coalesce(sum(c), 0)::BIGINT AS duplicate_rows, count(*) AS duplicate_keys
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
UNION ALL
SELECT 'documents.text', coalesce(sum(c), 0)::BIGINT, count(*)
FROM (SELECT count(*) AS c FROM documents GROUP BY text HAVING count(*) > 1)""")
def q_duplicate_ids(spark, sf_dir):
    li = profile.duplicate_rows(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    docs = profile.duplicate_rows(read_table(spark, sf_dir, "documents"), ["text"])
    return (li.select(F.lit("lineitem.l_orderkey").alias("key"), "*")
            .unionByName(docs.select(F.lit("documents.text").alias("key"), "*")))


@register("fk_orphans", """
SELECT 'l_orderkey' AS fk, count(*) AS orphans FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT 'l_partkey', count(*) FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL)
UNION ALL SELECT 'l_suppkey', count(*) FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)
UNION ALL SELECT 'o_custkey', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)""")
def q_fk_orphans(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    out = None
    for fk, parent, pk, child in (("l_orderkey", "orders", "o_orderkey", li), ("l_partkey", "part", "p_partkey", li),
                                  ("l_suppkey", "supplier", "s_suppkey", li),
                                  ("o_custkey", "customer", "c_custkey", read_table(spark, sf_dir, "orders"))):
        n = (joins.fk_orphans(child.select(fk), fk, read_table(spark, sf_dir, parent), pk)
             .agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(fk).alias("fk"), "orphans"))
        out = n if out is None else out.unionByName(n)
    return out


@register("language_lookup", """
SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def q_language_lookup(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    out = joins.lookup_join(cust, read_table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", "n_name", "nation")
    return out.select("c_custkey", "nation")


@register("lookup_last_wins", """
SELECT c_custkey, coalesce(last_type, 'unknown') AS last_type
FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id) ON c_custkey = user_id""")
def q_lookup_last_wins(spark, sf_dir):
    """A lookup with many rows of one key, of which the last in the file wins (its rows are in order of event_id)."""
    events = read_table(spark, sf_dir, "events").select("user_id", "event_type", source_position().alias("_position"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey")
    return joins.lookup_join(cust, events, "c_custkey", "user_id", "event_type", "last_type", order_col="_position").select("c_custkey", "last_type")


@register("missing_notebooks", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def q_missing_notebooks(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.missing_rows(docs, read_table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@register("newest_k", """
SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10""")
def q_newest_k(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)


@register("invalid_timestamps", """
WITH t AS (SELECT event_type, CAST(ts AS VARCHAR) AS s FROM events)
SELECT event_type, count(*) FILTER (WHERE s IS NOT NULL AND (s <> trim(s) OR
   coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%d')) IS NULL)) AS n_invalid,
   count(*) AS n
FROM t GROUP BY event_type""")
def q_invalid_timestamps(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("string").alias("s"))
    return ev.groupBy("event_type").agg(F.count_if(invalid_timestamp("s")).alias("n_invalid"), F.count(F.lit(1)).alias("n"))


@register("date_coerce", """
SELECT event_id, ts AS coerced FROM events""")
def q_date_coerce(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", coerce_timestamp(F.col("ts").cast("string")).alias("coerced"))


@register("json_valid", """
WITH t AS (
  SELECT event_id, props AS raw FROM events
  UNION ALL SELECT event_id + 1000000000, rtrim(props, '}') FROM events
  UNION ALL SELECT event_id + 2000000000, '[' || props || ']' FROM events)
SELECT event_id, CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE false END AS json_ok FROM t""")
def q_json_valid(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    # Every event three times: as stored, with its closing brace cut, and wrapped in an array.
    raw = (ev.select("event_id", F.col("props").alias("raw"))
           .unionByName(ev.select((F.col("event_id") + 1000000000).alias("event_id"),
                                  F.rtrim(F.col("props"), F.lit("}")).alias("raw")))
           .unionByName(ev.select((F.col("event_id") + 2000000000).alias("event_id"),
                                  F.concat(F.lit("["), "props", F.lit("]")).alias("raw"))))
    return raw.select("event_id", jsonfn.is_json_object("raw").alias("json_ok"))


@register("json_or_raw", """
SELECT event_id, CASE WHEN json_valid(props) THEN json_extract(props, '$.k')::BIGINT END AS k,
       NOT json_valid(props) AS kept_raw FROM events""")
def q_json_or_raw(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", jsonfn.bigint_field("props", "k").alias("k"), (~jsonfn.is_json("props")).alias("kept_raw"))


@register("notebook_structure", """
SELECT conv_id AS notebook_id, 0::BIGINT AS n_missing_fields FROM conversations GROUP BY conv_id""")
def q_notebook_structure(spark, sf_dir):
    from tessera.plans.fixtures import notebooks
    nbs = notebooks(spark, sf_dir)
    return nbs.select("notebook_id", F.size(jsonfn.missing_fields(F.col("raw"))).cast("bigint").alias("n_missing_fields"))


@register("id_path_layout", """
SELECT doc_id, (doc_id // 1000000)::VARCHAR || '/' || ((doc_id // 1000) % 1000)::VARCHAR || '/' || doc_id::VARCHAR || '.json' AS path
FROM documents""")
def q_id_path_layout(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", id_path("doc_id").alias("path"))


@register("table_inventory", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
    f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns" for t in TABLES))
def q_table_inventory(spark, sf_dir):
    """S5 + A7: every table in the folder with its row and column counts."""
    out = None
    for t in TABLES:
        df = read_table(spark, sf_dir, t)
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


FAMILY_CASE_SQL = """CASE WHEN data_type IN ('BIGINT','INTEGER','SMALLINT','TINYINT') THEN 'int64'
     WHEN data_type IN ('DOUBLE','FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'float64'
     WHEN data_type IN ('TIMESTAMP','DATE') THEN 'datetime' WHEN data_type = 'BOOLEAN' THEN 'bool'
     WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type LIKE '%[]' THEN 'array' ELSE 'other' END"""


def _schema_sql(tables=TABLES) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, count(*) AS n FROM "
        f"(UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE v) GROUP BY column_name"
        for t in tables)
    return f"""
WITH c AS ({counts})
SELECT i.table_name, i.column_name, {FAMILY_CASE_SQL} AS type_family, coalesce(c.n, 0) AS n_non_null
FROM information_schema.columns i LEFT JOIN c ON c.table_name = i.table_name AND c.column_name = i.column_name
WHERE i.table_name IN ({", ".join(f"'{t}'" for t in tables)})"""


def _profile_sql(tables=TABLES) -> str:
    values = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, v FROM "
        f"(UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE v)" for t in tables)
    sizes = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in tables)
    return f"""
WITH vals AS ({values}), sizes AS ({sizes}),
kinds AS (SELECT table_name, column_name, CASE f WHEN 'int64' THEN 'numeric' WHEN 'float64' THEN 'numeric' WHEN 'datetime' THEN 'datetime'
                 WHEN 'string' THEN 'text' WHEN 'bool' THEN 'text' ELSE 'other' END AS kind
          FROM (SELECT table_name, column_name, {FAMILY_CASE_SQL} AS f FROM information_schema.columns
                WHERE table_name IN ({", ".join(f"'{t}'" for t in tables)}))),
typed AS (SELECT v.*, k.kind FROM vals v JOIN kinds k USING (table_name, column_name)),
counted AS (SELECT table_name, column_name, count(*) AS n FROM vals GROUP BY ALL),
num AS (SELECT table_name, column_name, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS lo, max(x) AS hi
        FROM (SELECT table_name, column_name, TRY_CAST(v AS DOUBLE) AS x FROM typed WHERE kind = 'numeric') GROUP BY ALL),
tim AS (SELECT table_name, column_name, min(x) AS first, max(x) AS last
        FROM (SELECT table_name, column_name, TRY_CAST(v AS TIMESTAMP) AS x FROM typed WHERE kind = 'datetime') GROUP BY ALL),
per AS (SELECT table_name, column_name, v, count(*) AS c FROM typed WHERE kind = 'text' GROUP BY ALL),
txt AS (SELECT table_name, column_name, count(*) AS n_distinct, max(c) AS freq, arg_min(v, (-c, md5(v))) AS top FROM per GROUP BY ALL)
SELECT k.table_name, k.column_name, k.kind, coalesce(c.n, 0) AS count, s.n_rows - coalesce(c.n, 0) AS n_missing,
       num.mean::FLOAT::DOUBLE AS mean, num.std::FLOAT::DOUBLE AS std, num.lo AS min, num.hi AS max,
       tim.first, tim.last, txt.n_distinct, txt.freq, txt.top
FROM kinds k JOIN sizes s USING (table_name) LEFT JOIN counted c USING (table_name, column_name) LEFT JOIN num USING (table_name, column_name)
LEFT JOIN tim USING (table_name, column_name) LEFT JOIN txt USING (table_name, column_name)"""


def _all_tables(spark, sf_dir):
    return {t: read_table(spark, sf_dir, t) for t in TABLES}


@register("profile_all_tables", _profile_sql())
def q_profile_all_tables(spark, sf_dir):
    """S5 + A4-A6: every column of every table in the folder (quartiles: `quartiles_all_tables`);
    means and deviations to the seven digits that do not hang on the order of sums."""
    p = column_profile.profile_tables(_all_tables(spark, sf_dir))
    return p.select("table_name", "column_name", "kind", "count", "n_missing", *[F.col(c).cast("float").cast("double").alias(c) for c in ("mean", "std")],
                    "min", "max", "first", "last", "n_distinct", "freq", "top")


@register("quartiles_all_tables")
def q_quartiles_all_tables(spark, sf_dir):
    """S5 + A4, A6: quartiles of every numeric and time column, within the sketches' rank error."""
    rows = reduce(DataFrame.unionByName, [column_profile.measures(df, t) for t, df in _all_tables(spark, sf_dir).items()])
    return rows.filter("kind in ('numeric', 'datetime')").select("table_name", "column_name", "kind", "count", "p25", "p50", "p75", "t25", "t50", "t75")


def schema_rows(spark, sf_dir, tables=TABLES):
    """(table_name, column_name, type_family, n_non_null): one aggregate per table, unioned."""
    from tessera.sources.rules import type_family
    out = None
    for t in tables:
        df = read_table(spark, sf_dir, t)
        fams = []
        for name, dtype in df.dtypes:
            fam = "array" if dtype.startswith("array") else type_family(dtype)
            fams.append((name, fam if fam in ("int64", "float64", "string", "datetime", "bool", "array") else "other"))
        agg = df.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n, _ in fams])
        pairs = ", ".join(f"'{n}', '{f}', `{n}`" for n, f in fams)
        one = agg.selectExpr(f"stack({len(fams)}, {pairs}) AS (column_name, type_family, n_non_null)").select(
            F.lit(t).alias("table_name"), "column_name", "type_family", "n_non_null")
        out = one if out is None else out.unionByName(one)
    return out


@register("table_schema", _schema_sql())
def q_table_schema(spark, sf_dir):
    """A7 + S5: every table's columns, type family and non-null count (one aggregate per table)."""
    return schema_rows(spark, sf_dir)


# ------------------------------------------------------------ rule report

def _parse_rules_py(path: str) -> dict:
    """Oracle-side reading of the same rule document (string parsing only)."""
    out, cur = {}, None
    for line in open(path, encoding="utf-8").read().splitlines():
        m = re.match(r"^## +`?([^`]+?\.(csv|parquet|json))`?\s*$", line)
        if m:
            cur = m.group(1)
            out[cur] = {"columns": [], "fks": []}
            continue
        if line.startswith("## "):
            cur = None
            continue
        if cur is None:
            continue
        m = re.match(r"^- ([A-Za-z0-9_]+):\s*([A-Za-z0-9_]+)\s*(\((.*)\))?", line)
        if m:
            notes = (m.group(4) or "").lower()
            out[cur]["columns"].append({"column": m.group(1), "dtype": m.group(2), "required": "required" in notes,
                                        "is_unique": bool(re.search(r"(^|[ ,])unique", notes))})
            continue
        m = re.match(r"^\s+- ([A-Za-z0-9_]+)\s*→\s*([A-Za-z0-9_]+)(\.([A-Za-z0-9_]+))?", line)
        if m:
            out[cur]["fks"].append({"column": m.group(1), "fk_table": m.group(2), "fk_column": m.group(4)})
    return out


FAMILY_SQL = {"int64": "('BIGINT','INTEGER','SMALLINT','TINYINT')", "float64": "('DOUBLE','FLOAT')",
              "string": "('VARCHAR')", "datetime": "('TIMESTAMP','DATE')", "bool": "('BOOLEAN')"}


def _rule_report_sql() -> str:
    rules = _parse_rules_py(RULES_PATH)
    parts = ["SELECT NULL::VARCHAR AS dataset, NULL::VARCHAR AS column_name, NULL::VARCHAR AS check_name, "
             "NULL::BIGINT AS value WHERE false"]
    for dataset, spec in rules.items():
        t = dataset.rsplit(".", 1)[0]
        if t not in TABLES:
            parts.append(f"SELECT '{dataset}', NULL, 'file_missing', 1")
            continue
        for c in spec["columns"]:
            col = c["column"]
            parts.append(f"SELECT '{dataset}', '{col}', 'type_mismatch', 1 FROM (SELECT data_type FROM information_schema.columns "
                         f"WHERE table_name = '{t}' AND column_name = '{col}') WHERE data_type NOT IN {FAMILY_SQL[c['dtype']]}")
            parts.append(f"SELECT '{dataset}', '{col}', 'missing', n FROM (SELECT count(*) FILTER (WHERE {col} IS NULL) AS n FROM {t}) WHERE n > 0")
            if c["required"]:
                parts.append(f"SELECT '{dataset}', '{col}', 'required_null', n FROM (SELECT count(*) FILTER (WHERE {col} IS NULL) AS n FROM {t}) WHERE n > 0")
            if c["is_unique"]:
                parts.append(f"SELECT '{dataset}', '{col}', 'duplicate_rows', coalesce(sum(c), 0)::BIGINT FROM "
                             f"(SELECT count(*) AS c FROM {t} GROUP BY {col} HAVING count(*) > 1)")
        for fk in spec["fks"]:
            if fk["fk_column"] is None or fk["fk_table"] not in TABLES:
                parts.append(f"SELECT '{dataset}', '{fk['column']}', 'fk_unresolved', 1")
                continue
            parts.append(f"SELECT '{dataset}', '{fk['column']}', 'fk_orphans', count(*) FROM {t} WHERE {fk['column']} IS NOT NULL "
                         f"AND {fk['column']} NOT IN (SELECT {fk['fk_column']} FROM {fk['fk_table']} WHERE {fk['fk_column']} IS NOT NULL)")
    return "\nUNION ALL ".join(parts)


@register("rule_report", _rule_report_sql())
def q_rule_report(spark, sf_dir):
    rules = rules_dict(parse_rules(spark, RULES_PATH))
    tables = {t: read_table(spark, sf_dir, t) for t in TABLES}
    return rule_report(spark, tables, rules)


def _rule_tables() -> list:
    return sorted({d.rsplit(".", 1)[0] for d in _parse_rules_py(RULES_PATH)} & set(TABLES))


def _rule_parse_sql() -> str:
    rows = ", ".join(f"('{d}', '{d.rsplit('.', 1)[0]}', '{c['column']}', '{c['dtype']}')"
                     for d, s in _parse_rules_py(RULES_PATH).items() for c in s["columns"])
    return f"""
WITH r(dataset, table_name, column_name, dtype) AS (VALUES {rows}),
s AS ({_schema_sql(_rule_tables())})
SELECT r.dataset, r.column_name, r.dtype, s.type_family AS actual_family, s.n_non_null,
       s.column_name IS NOT NULL AS present, coalesce(s.type_family = r.dtype, false) AS type_ok
FROM r LEFT JOIN s ON s.table_name = r.table_name AND s.column_name = r.column_name"""


@register("rule_parse", _rule_parse_sql())
def q_rule_parse(spark, sf_dir):
    """S6 + P1/P3: every parsed rule column against the table it names (presence, type family, non-null count)."""
    rules = parse_rules(spark, RULES_PATH).filter(F.col("kind") == "column").select(
        "dataset", F.regexp_extract("dataset", r"^(.*)\.[A-Za-z]+$", 1).alias("table_name"),
        F.col("column").alias("column_name"), "dtype")
    actual = schema_rows(spark, sf_dir, _rule_tables())
    j = rules.join(actual, ["table_name", "column_name"], "left")
    return j.select("dataset", "column_name", "dtype", F.col("type_family").alias("actual_family"), "n_non_null",
                    F.col("type_family").isNotNull().alias("present"),
                    F.coalesce(F.col("type_family") == F.col("dtype"), F.lit(False)).alias("type_ok"))


def _rule_numeric() -> list:
    """(dataset, table, numeric rule columns) for every rule dataset backed by a table."""
    out = []
    for d, spec in _parse_rules_py(RULES_PATH).items():
        t = d.rsplit(".", 1)[0]
        cols = [c["column"] for c in spec["columns"] if c["dtype"] in ("int64", "float64")]
        if t in TABLES and cols:
            out.append((d, t, cols))
    return out


@register("rule_describe", "\nUNION ALL ".join(
    f"SELECT '{d}' AS dataset, * FROM ({_numeric_sql(t, cols)})" for d, t, cols in _rule_numeric()))
def q_rule_describe(spark, sf_dir):
    """A13 describe step: exact numeric profile of every numeric rule column, whole tables.

    Each table's profile is a few bounded aggregate rounds; the tables are
    independent, so their rounds are submitted from a small thread pool and
    run as concurrent Spark jobs.
    """
    from concurrent.futures import ThreadPoolExecutor

    def one(item):
        d, t, cols = item
        df = read_table(spark, sf_dir, t)
        present = [c for c in cols if c in df.columns]
        if not present:
            return None
        return profile.profile_numeric(df, present).select(
            F.lit(d).alias("dataset"), "column_name", "count",
            *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])
    items = _rule_numeric()
    with ThreadPoolExecutor(max_workers=max(1, min(8, len(items)))) as pool:
        parts = [p for p in pool.map(one, items) if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

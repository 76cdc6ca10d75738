"""Column profiles (A1-A10): missingness, numeric/datetime/categorical
summaries, raw-text type classes, id checks, invalid-value samples.

Every profile is one pass over a long (column, value) form, aggregated with
partial/final aggregation, so a hot value never lands whole in one task.
Quantiles are exact (linear interpolation, as pandas/DuckDB) without Spark's
exact ``percentile`` (which keeps every distinct value of a group in one
task): ranks are located through an exact histogram over approximate cut
points and only the bucket holding the rank is ordered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


GRID = 512          # cut points per refinement round
FINAL_MAX = 100_000  # a bucket this small is ordered directly
MAX_ROUNDS = 30      # after this many refinements an interval is ordered directly


def unpivot(df: DataFrame, cols: Sequence[str], value_type: str = "double") -> DataFrame:
    """(column_name, value) long form of ``cols`` cast to ``value_type``."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS {value_type})" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, value)")


def missingness(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = False) -> DataFrame:
    """A3: (column_name, n_missing) in one aggregate pass."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in cols)
    out = agg.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, n_missing)")
    return out.filter(F.col("n_missing") > 0) if only_missing else out


# ---------------------------------------------------------------- quantiles

def _interp(values: dict, n: int, p: float):
    h = (n - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    a, b = values[lo], values[hi]
    return a + (h - lo) * (b - a)


def exact_quantiles(long_df: DataFrame, probs: Sequence[float], key_col: str = "column_name",
                    value_col: str = "value") -> DataFrame:
    """Exact linear-interpolated quantiles per key: (key, p, q).  NULLs ignored."""
    spark = long_df.sparkSession
    vals = long_df.select(F.col(key_col).alias("k"), F.col(value_col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    grid = [i / GRID for i in range(1, GRID)]
    counts = {r["k"]: r["n"] for r in vals.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    # targets: (key, absolute rank) -> value
    wanted = {}
    for k, n in counts.items():
        for p in probs:
            h = (n - 1) * p
            wanted[(k, math.floor(h))] = None
            wanted[(k, math.ceil(h))] = None
    # intervals: (key, lo exclusive, hi inclusive) -> (cut points, rows); targets carry a rank offset
    frontier = {(k, None, None): ([], n) for k, n in counts.items()}
    pending = {t: (t[0], None, None, 0) for t in wanted}
    big = {k: n for k, n in counts.items() if n > FINAL_MAX}
    if big:
        # percentile_approx returns a value whose rank is within n / accuracy of the
        # asked one; asking p -/+ delta brackets the exact rank-r value for certain.
        acc = int(min(1_000_000, max(10_000, 20 * max(big.values()) // FINAL_MAX)))
        delta = 4.0 / acc
        fr = sorted({min(1.0, max(0.0, round(x, 12))) for (k, r) in wanted if k in big
                     for x in (r / (big[k] - 1) - delta, r / (big[k] - 1) + delta)})
        approx = {row["k"]: row["q"] for row in vals.filter(F.col("k").isin(list(big)))
                  .groupBy("k").agg(F.percentile_approx("v", fr, acc).alias("q")).collect()}
        bounds = {}
        for (k, r) in wanted:
            if k not in big:
                continue
            f = r / (big[k] - 1)
            lo_v = approx[k][fr.index(min(1.0, max(0.0, round(f - delta, 12))))]
            hi_v = approx[k][fr.index(min(1.0, max(0.0, round(f + delta, 12))))]
            bounds[(k, r)] = (float(np.nextafter(lo_v, -np.inf)), float(hi_v))
        ivs = set((k, lo, hi) for (k, _), (lo, hi) in bounds.items())
        tagged = _in_intervals(vals, ivs, with_below=True)
        stats = {(row["k"], row["_iv"]): (row["below"], row["n_in"]) for row in tagged.collect()}
        for (k, r), (lo, hi) in bounds.items():
            below, n_in = stats.get((k, _iv_id(k, lo, hi)), (0, 0))
            if below <= r < below + n_in:
                pending[(k, r)] = (k, lo, hi, below)
                frontier[(k, lo, hi)] = ([], n_in)
    # Intervals that are too big and lack cut points get them now.
    need = [iv for iv, (cuts, n) in frontier.items() if n > FINAL_MAX and not cuts
            and any((p[0], p[1], p[2]) == iv for p in pending.values())]
    if need:
        sub = _in_intervals(vals, set(need))
        rows = sub.groupBy("k", "_iv").agg(F.percentile_approx("v", grid, 4 * GRID).alias("cuts")).collect()
        cuts_by = {(r["k"], r["_iv"]): sorted(set(r["cuts"] or [])) for r in rows}
        for iv in need:
            frontier[iv] = (cuts_by.get((iv[0], _iv_id(*iv)), []), frontier[iv][1])
    rounds = 0
    while pending:
        # Intervals small enough are finished by ordering their rows directly.
        small = {iv for iv, (cuts, n) in frontier.items() if n <= FINAL_MAX}
        direct = {t: iv for t, iv in pending.items() if (iv[0], iv[1], iv[2]) in small}
        if direct:
            ivs = {(iv[0], iv[1], iv[2]) for iv in direct.values()}
            sel = _in_intervals(vals, ivs)
            ranks = {}
            for t, (k, lo, hi, off) in direct.items():
                ranks.setdefault((k, lo, hi), set()).add(t[1] - off)
            w = Window.partitionBy("k", "_iv").orderBy("v")
            ranked = sel.withColumn("_r", F.row_number().over(w) - 1)
            want_rows = [(k, _iv_id(k, lo, hi), int(r)) for (k, lo, hi), rs in ranks.items() for r in rs]
            want = spark.createDataFrame(want_rows, "k " + _key_type(vals) + ", _iv string, _r int")
            got = {(row["k"], row["_iv"], row["_r"]): row["v"]
                   for row in ranked.join(F.broadcast(want), ["k", "_iv", "_r"]).collect()}
            for t, (k, lo, hi, off) in direct.items():
                wanted[t] = got[(k, _iv_id(k, lo, hi), t[1] - off)]
                del pending[t]
        if not pending:
            break
        # Larger intervals: exact histogram over their cut points, then narrow.
        ivs = {(iv[0], iv[1], iv[2]) for iv in pending.values()}
        sel = _in_intervals(vals, ivs)
        cut_rows = [(k, _iv_id(k, lo, hi), frontier[(k, lo, hi)][0]) for (k, lo, hi) in ivs]
        cut_df = spark.createDataFrame(cut_rows, "k " + _key_type(vals) + ", _iv string, cuts array<double>")
        # Bucket ids: 2p-2 = open gap below cut p, 2p-1 = exactly cut p, 2*len = above the last cut.
        pos = F.expr("CAST(array_position(transform(cuts, x -> x >= v), true) AS INT)")
        at_cut = F.expr("element_at(cuts, greatest(CAST(array_position(transform(cuts, x -> x >= v), true) AS INT), 1)) = v")
        bid = (F.when(pos == 0, 2 * F.size("cuts"))
               .when(at_cut, 2 * pos - 1).otherwise(2 * pos - 2))
        hist = (sel.join(F.broadcast(cut_df), ["k", "_iv"])
                .withColumn("_b", bid)
                .groupBy("k", "_iv", "_b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .collect())
        rounds += 1
        by_iv = {}
        for r in hist:
            by_iv.setdefault((r["k"], r["_iv"]), []).append((r["_b"], r["n"], r["lo"], r["hi"]))
        new_frontier = {}
        for t, (k, lo, hi, off) in list(pending.items()):
            cuts = frontier[(k, lo, hi)][0]
            rel = t[1] - off
            run = 0
            for bkt, n, vmin, vmax in sorted(by_iv[(k, _iv_id(k, lo, hi))]):
                if run + n > rel:
                    if vmin == vmax:
                        wanted[t] = vmin
                        del pending[t]
                    else:
                        p = bkt // 2  # open gap below cut index p (0-based), or above the last cut
                        nlo = cuts[p - 1] if p >= 1 else lo
                        nhi = float(np.nextafter(cuts[p], -np.inf)) if p < len(cuts) else hi
                        pending[t] = (k, nlo, nhi, off + run)
                        new_frontier[(k, nlo, nhi)] = 0 if rounds >= MAX_ROUNDS else n
                    break
                run += n
        if new_frontier:
            ivs2 = list(new_frontier)
            sub = _in_intervals(vals, set(ivs2))
            rows = sub.groupBy("k", "_iv").agg(F.percentile_approx("v", grid, 4 * GRID).alias("cuts")).collect()
            cuts_by = {(r["k"], r["_iv"]): sorted(set(r["cuts"] or [])) for r in rows}
            frontier = {iv: (cuts_by.get((iv[0], _iv_id(*iv)), []), n) for iv, n in new_frontier.items()}
    out = []
    for k, n in counts.items():
        vals_k = {r: v for (kk, r), v in wanted.items() if kk == k}
        for p in probs:
            out.append((k, float(p), float(_interp(vals_k, n, p))))
    return spark.createDataFrame(out, "k " + _key_type(vals) + ", p double, q double").withColumnRenamed("k", key_col)


def _key_type(vals: DataFrame) -> str:
    return vals.schema["k"].dataType.simpleString()


def _iv_id(k, lo, hi) -> str:
    return f"{lo!r}|{hi!r}"


def _in_intervals(vals: DataFrame, ivs, with_below: bool = False) -> DataFrame:
    """Rows of ``vals`` inside any (key, lo excl, hi incl) interval, tagged with it.

    ``with_below`` instead returns per interval the count of rows at or below
    ``lo`` and inside it (one aggregate pass).
    """
    spark = vals.sparkSession
    rows = [(k, _iv_id(k, lo, hi), lo, hi) for (k, lo, hi) in ivs]
    iv = spark.createDataFrame(rows, "k " + _key_type(vals) + ", _iv string, _lo double, _hi double")
    above_lo = F.col("_lo").isNull() | (F.col("v") > F.col("_lo"))
    cond = above_lo & (F.col("_hi").isNull() | (F.col("v") <= F.col("_hi")))
    joined = vals.join(F.broadcast(iv), "k")
    if with_below:
        return joined.groupBy("k", "_iv").agg(F.count_if(~above_lo).alias("below"), F.count_if(cond).alias("n_in"))
    return joined.filter(cond).select("k", "_iv", "v")


LOW_CARDINALITY = 20_000  # below this (approximate) distinct count, use exact per-value counts


def _quantiles_by_value_counts(df: DataFrame, cols: Sequence[str], probs, counts: dict) -> list:
    """Exact quantiles of low-cardinality columns from (value, count) pairs (one aggregate)."""
    parts = [df.select(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v")).filter(F.col("v").isNotNull())
             for c in cols]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    pairs: dict = {}
    for r in long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).collect():
        pairs.setdefault(r["c"], []).append((r["v"], r["n"]))
    out = []
    for c in cols:
        n = counts[c]
        vals = sorted(pairs.get(c, []))

        def at(rank):
            run = 0
            for val, cnt in vals:
                if run + cnt > rank:
                    return val
                run += cnt
            return vals[-1][0]
        for p in probs:
            if n == 0:
                out.append((c, float(p), None))
                continue
            h = (n - 1) * p
            lo, hi = math.floor(h), math.ceil(h)
            a, b = at(lo), at(hi)
            out.append((c, float(p), float(a + (h - lo) * (b - a))))
    return out


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     counts: dict | None = None, distinct: dict | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of several columns: (column_name, p, q).

    Four scans of the wide table, each a single codegen'd aggregate:
    counts -> sketch brackets around every needed rank -> exact counts below
    and inside each bracket -> the bracket contents, gathered only where the
    exact count shows they are small (<= FINAL_MAX).  Targets whose bracket
    is large (heavy ties) fall back to the keyed refinement above.
    """
    spark = df.sparkSession
    cols = list(cols)
    if counts is None or distinct is None:
        row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols],
                     *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"{c}__d") for c in cols]).first()
        counts = {c: int(row[c]) for c in cols}
        distinct = {c: int(row[f"{c}__d"]) for c in cols}
    low = [c for c in cols if distinct[c] <= LOW_CARDINALITY]
    pre = _quantiles_by_value_counts(df, low, probs, counts) if low else []
    cols = [c for c in cols if c not in low]
    if not cols:
        return spark.createDataFrame(pre, "column_name string, p double, q double")
    targets = {}
    for c in cols:
        n = counts[c]
        if n == 0:
            continue
        for p in probs:
            h = (n - 1) * p
            targets[(c, math.floor(h))] = None
            targets[(c, math.ceil(h))] = None
    if not targets:
        return spark.createDataFrame(pre + [(c, float(p), None) for c in cols for p in probs],
                                     "column_name string, p double, q double")
    nmax = max(counts.values())
    acc = int(min(1_000_000, max(10_000, 20 * nmax // FINAL_MAX)))
    delta = 4.0 / acc

    def frac(c, r, sign):
        n = counts[c]
        return min(1.0, max(0.0, round((r / (n - 1) if n > 1 else 0.0) + sign * delta, 12)))
    fr = {c: sorted({frac(c, r, sg) for (cc, r) in targets if cc == c for sg in (-1, 1)}) for c in counts if counts[c]}
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), fr[c], acc).alias(c) for c in fr]).first()
    bounds = {}
    for (c, r) in targets:
        lo_v = row[c][fr[c].index(frac(c, r, -1))]
        hi_v = row[c][fr[c].index(frac(c, r, 1))]
        bounds[(c, r)] = (float(np.nextafter(lo_v, -np.inf)), float(hi_v))
    keys = sorted(set((c, lo, hi) for (c, _), (lo, hi) in bounds.items()))

    def v(c):
        return F.col(f"`{c}`").cast("double")
    aggs = []
    for i, (c, lo, hi) in enumerate(keys):
        aggs.append(F.count_if(v(c) <= F.lit(lo)).alias(f"b{i}"))
        aggs.append(F.count_if((v(c) > F.lit(lo)) & (v(c) <= F.lit(hi))).alias(f"n{i}"))
    st = df.agg(*aggs).first()
    small = [i for i in range(len(keys)) if st[f"n{i}"] <= FINAL_MAX]
    slices = {}
    if small:
        got = df.agg(*[F.sort_array(F.collect_list(F.when((v(keys[i][0]) > F.lit(keys[i][1])) & (v(keys[i][0]) <= F.lit(keys[i][2])),
                                                            v(keys[i][0])))).alias(f"s{i}") for i in small]).first()
        slices = {i: got[f"s{i}"] for i in small}
    # Large brackets usually mean ties: resolve them from (value, count) pairs
    # when the bracket holds few distinct values (a partial aggregate per value).
    big = [i for i in range(len(keys)) if st[f"n{i}"] > FINAL_MAX]
    dist = {}
    if big:
        parts = []
        for i in big:
            c, lo, hi = keys[i]
            parts.append(df.select(F.lit(i).alias("_i"), v(c).alias("v"))
                         .filter((F.col("v") > F.lit(lo)) & (F.col("v") <= F.lit(hi))))
        long = parts[0]
        for part in parts[1:]:
            long = long.unionByName(part)
        per = long.groupBy("_i", "v").agg(F.count(F.lit(1)).alias("n"))
        nd = {r["_i"]: r["d"] for r in per.groupBy("_i").agg(F.count(F.lit(1)).alias("d")).collect()}
        ok = [i for i in big if nd.get(i, 0) <= FINAL_MAX]
        if ok:
            for r in per.filter(F.col("_i").isin(ok)).collect():
                dist.setdefault(r["_i"], []).append((r["v"], r["n"]))
    values, fallback = {}, set()
    for (c, r), (lo, hi) in bounds.items():
        i = keys.index((c, lo, hi))
        below, n_in = st[f"b{i}"], st[f"n{i}"]
        if not below <= r < below + n_in:
            fallback.add(c)
        elif i in slices:
            values[(c, r)] = slices[i][r - below]
        elif i in dist:
            run = below
            for val, cnt in sorted(dist[i]):
                if run + cnt > r:
                    values[(c, r)] = val
                    break
                run += cnt
        else:
            fallback.add(c)
    out = list(pre)
    for c in fallback:
        q = exact_quantiles(unpivot(df.select(c), [c]), probs).collect()
        out += [(c, float(x["p"]), x["q"]) for x in q]
    for c in cols:
        if c in fallback:
            continue
        n = counts[c]
        for p in probs:
            out.append((c, float(p), None if n == 0 else float(_interp({r: values[(c, r)] for (cc, r) in values if cc == c}, n, p))))
    return spark.createDataFrame(out, "column_name string, p double, q double")


# ---------------------------------------------------------------- profiles

def profile_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: count, mean, std (n-1), min, 25/50/75 % (linear), max per column."""
    cols = list(cols)
    aggs = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"), F.approx_count_distinct(x).alias(f"{c}__d")]
    base = df.agg(*aggs).first()
    counts = {c: int(base[f"{c}__count"]) for c in cols}
    distinct = {c: int(base[f"{c}__d"]) for c in cols}
    q = {(r["column_name"], r["p"]): r["q"]
         for r in column_quantiles(df, cols, [0.25, 0.5, 0.75], counts, distinct).collect()}
    rows = [(c, counts[c], base[f"{c}__mean"], base[f"{c}__std"], base[f"{c}__min"], q[(c, 0.25)], q[(c, 0.5)],
             q[(c, 0.75)], base[f"{c}__max"]) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, count bigint, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")


def profile_datetime(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, min, quartiles, max of timestamps (no std), via epoch micros."""
    from tessera.functions.temporal import micros_to_ntz, ntz_to_micros
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    # NTZ columns use zone-free epoch micros; zoned timestamps use the instant.
    micros = df.select(*[(ntz_to_micros(F.col(c)) if types[c] == "timestamp_ntz" else
                          F.unix_micros(F.col(c).cast("timestamp"))).alias(c) for c in cols])
    prof = profile_numeric(micros, cols)

    def back(c: str) -> Column:
        return micros_to_ntz(F.round(F.col(c)).cast("bigint")).alias(c)
    return prof.select("column_name", "count", back("mean"), back("min"), back("p25"), back("p50"), back("p75"), back("max"))


def profile_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A5: count (non-null), unique, top (ties -> smallest value), freq."""
    long = unpivot(df, cols, "string").filter(F.col("value").isNotNull())
    per_value = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("top"),
        F.max("n").alias("freq"))


INT_RE = r"^[+-]?[0-9]+$"
FLOAT_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BOOL_RE = r"^(true|false|True|False|TRUE|FALSE)$"
TS_RE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}( [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]+)?)?$"


def value_class(c) -> Column:
    """A8 re-aimed: the type a raw text value would take (null/int/float/bool/timestamp/text)."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c.isNull(), "null").when(c.rlike(INT_RE), "int").when(c.rlike(FLOAT_RE), "float")
            .when(c.rlike(BOOL_RE), "bool").when(c.rlike(TS_RE), "timestamp").otherwise("text"))


def type_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value_class, n) over text values; >1 non-null class = mixed column."""
    long = unpivot(df, cols, "string")
    return long.groupBy("column_name", value_class("value").alias("value_class")).agg(F.count(F.lit(1)).alias("n"))


def id_column_check(df: DataFrame) -> DataFrame:
    """Columns named *id: null count and non-integral values (text that is no number included)."""
    ids = [c for c in df.columns if c.lower().endswith("id")]
    long = unpivot(df, ids, "string")
    number = F.col("value").try_cast("double")
    return long.groupBy("column_name").agg(
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.count_if(F.col("value").isNotNull() & (number.isNull() | (number != F.floor(number)))).alias("n_non_integer"))


def invalid_values(df: DataFrame, col: str, bad: Column, limit: int = 10) -> DataFrame:
    """A10: first ``limit`` distinct offending values (sorted)."""
    return df.filter(bad).select(F.col(col).alias("value")).distinct().orderBy("value").limit(limit)


def duplicate_rows(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """A2: one-row count of rows whose key occurs more than once (keep=False)."""
    return (df.groupBy(*key_cols).count().filter(F.col("count") > 1)
            .agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
                 F.count(F.lit(1)).alias("duplicate_keys")))

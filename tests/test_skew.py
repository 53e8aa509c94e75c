"""Problem 2 against plain counting."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provspark.operators import skew as S

SCHEMA = "gid string, src string, dst string, ts bigint, node_key string, side int, h int"
ROWS = [("g", " A ", "b", 5, "x", 1, 1)] * 40 + [("g", "a", None, 0, None, None, None), ("g", None, "C", None, "x", 1, 1), ("g", "", "b", 7, "x", 1, 1)] + [("g", f"n{i}", f"m{i % 7}", i, "x", 1, 1) for i in range(60)]


def brute(rows):
    out = defaultdict(lambda: [0, set(), []])
    for _, s, d, ts, *_ in rows:
        s, d = (None if x is None else x.strip().lower() for x in (s, d))
        for side, k, o in (("src", s, d), ("dst", d, s)):
            if k is not None:
                x = out[side, k]
                x[0] += 1
                x[1] |= {o} - {None}
                x[2] += [ts] if ts else []
    return {k: (n, len(o), min(t, default=None), max(t, default=None), sorted(t)[(len(t) + 1) // 2 - 1] if t else None) for k, (n, o, t) in out.items()}


def test_profile_and_heavy(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = brute(ROWS)
    got = {(r[0], r[1]): tuple(r)[2:] for r in S.key_profile(df, (0.5,)).collect()}
    assert got == want
    for share in (0.01, 0.1, 0.3, 1.0):
        heavy = {(r.side, r.node_key): r.n_rows for r in S.heavy_keys(df, share).collect()}
        assert heavy == {k: v[0] for k, v in want.items() if v[0] >= share * len(ROWS) - 1e-9}
    empty = spark.createDataFrame([], SCHEMA)
    assert S.key_profile(empty, (0.5,)).count() == 0 and S.heavy_keys(empty).count() == 0


@pytest.mark.parametrize("light", [1, 50, 10_000])
def test_quantiles(spark, light):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(5000)) - 900).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("far", -(2**61)), ("far", 2**61), ("far", 3), (None, 3)], "k string, v bigint"))
    qs = (0.0, 0.25, 0.5, 0.99, 1.0)
    want = {}
    by = defaultdict(list)
    for k, v in rows.collect():
        if k is not None and v is not None:
            by[k].append(v)
    for k, v in by.items():
        v.sort()
        for q in qs:
            want[k, q] = v[max(1, -(-int(q * 100) * len(v) // 100)) - 1]
    got = {(r.k, r.q): r.value for r in S.exact_quantiles(rows, ["k"], "v", qs, light=light, buckets=8).collect()}
    assert got == want

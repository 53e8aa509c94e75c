"""Problem 4 against a plain loop."""

import random
from itertools import groupby

import numpy as np
import pytest

from provspark.llm import runs as R

SCHEMA = "gid string, eidx long, src string, dst string, etype string, ts long, n int, pid int, duration string"


def brute(rows, least):
    ev = {}
    for gid, eidx, s, d, e, ts, *_ in rows:
        if None in (gid, eidx, s, d, ts) or ts == 0:
            continue
        e = (e or "").strip().lower().removeprefix("event_") or "event"
        ev[gid, eidx] = (gid, s.strip().lower(), ts, eidx, d.strip().lower(), e)
    out = []
    for _, seq in groupby(sorted(ev.values()), key=lambda x: x[:2]):
        seq = list(seq)
        run = [seq[0]]
        for x in [*seq[1:], None]:
            if x and x[4:] == run[-1][4:] and x[2] - run[-1][2] <= R.GAP_NS:
                run.append(x)
                continue
            if len(run) >= least:
                out.append((run[0][0], run[0][1], run[0][4], run[0][5], run[0][3], run[-1][3], len(run), run[0][2], run[-1][2], run[-1][2] - run[0][2]))
            run = [x]
    return sorted(out)


def make(seed, n):
    r = random.Random(seed)
    rows = []
    ts = 10**18
    for i in range(n):
        ts += r.choice([0, 1, 10**9, 59 * 10**9, 60 * 10**9, 61 * 10**9])
        rows.append((r.choice(["g1", "g2"]), i, r.choice(["P", " p", "q"]), r.choice(["x", "X "]), r.choice(["read", "EVENT_READ", "read", None if r.random() < 0.1 else "Read "]), r.choice([ts] * 20 + [0, None]), 1, 1, "c"))
    rows += r.sample(rows, n // 10)
    rows += [(None, 1, "p", "x", "read", ts, 1, 1, "c"), ("g1", None, "p", "x", "read", ts, 1, 1, "c"), ("g1", n + 1, None, "x", "read", ts, 1, 1, "c"), ("g1", n + 2, "p", None, "", ts, 1, 1, "c")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,parts,batch", [(0, 1, 10_000), (1, 4, 7), (2, 16, 10_000), (3, 40, 3)])
@pytest.mark.parametrize("least", [1, 2])
def test_runs(spark, seed, parts, batch, least):
    rows = make(seed, 300)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(tuple(x) for x in R.collapse_runs(spark.createDataFrame(rows, SCHEMA), min_count=least).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, least)


def test_one_long_run_over_all_partitions(spark):
    rows = [("g", i, "p", "x", "read", 1 + i, 1, 1, "c") for i in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    try:
        got = R.collapse_runs(spark.createDataFrame(rows, SCHEMA), min_count=2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert [tuple(x) for x in got] == [("g", "p", "x", "read", 0, 1999, 2000, 1, 2000, 1999)]


def test_pointers():
    m = np.array([False, True, True, False, False, True])
    assert R.run_starts(m).tolist() == [0, 0, 0, 3, 4, 4]


def test_empty(spark):
    assert R.collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0

"""Problem 8 against all windows of all texts."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from provspark.llm import spans as S

SCHEMA = "doc_id long, text string, anchor int, lo int, whole string"


def brute(rows, n):
    where = defaultdict(set)
    rows = [(d, t or "") for d, t, *_ in rows if d is not None]
    for d, t in rows:
        for i in range(len(t) - n + 1):
            where[t[i : i + n]].add(d)
    out = set()
    for d, t in rows:
        on = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if len(where[t[i : i + n]]) > 1:
                on[i : i + n] = True
        edge = np.flatnonzero(np.diff(np.append(False, on).astype(int)))
        out |= {(d, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)}
    return sorted(out)


def run(spark, rows, n, g):
    return sorted(tuple(r) for r in S.shared_spans(spark.createDataFrame(rows, SCHEMA), n, g).collect())


@pytest.mark.parametrize("seed,n,g", [(0, 12, 5), (1, 12, 12), (2, 7, 3), (3, 20, 10)])
def test_random(spark, seed, n, g):
    r = random.Random(seed)
    pool = ["".join(r.choice(["ab", "abcdefghij", "日本語é\U0001f600x"][seed % 3]) for _ in range(r.randrange(1, 60))) for _ in range(12)]
    rows = [(i, "".join(r.choice(pool)[r.randrange(3) :] for _ in range(r.randrange(0, 6))), 1, 1, "x") for i in range(40)]
    rows += [(100 + i, rows[3][1], 1, 1, "x") for i in range(5)] + [(200, None, 1, 1, "x"), (201, "", 1, 1, "x"), (None, rows[3][1], 1, 1, "x"), (202, "a" * 200, 1, 1, "x"), (203, "b" + "a" * 90, 1, 1, "x"), (204, "q" * 30 + "z" + "q" * 30, 1, 1, "x")]
    want = brute(rows, n)
    assert run(spark, rows, n, g) == want and len(want) > 10


@pytest.mark.parametrize("size", [150, 300])
@pytest.mark.parametrize("ids", [(1, 2), (2, 1)])
def test_passage_again_in_the_same_text(spark, size, ids):
    r = random.Random(size)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    p, c1, c2, d1, d2 = word(size), word(300), word(300), word(150), word(150)
    rows = [(ids[0], c1 + p + c2 + d1 + p + d2, 1, 1, "x"), (ids[1], c1 + p + c2, 1, 1, "x")]
    want = brute(rows, 120)
    assert any(d == ids[0] and a >= 600 + size for d, a, _ in want)
    assert run(spark, rows, 120, 60) == want


def test_tables(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = [(d, x, 1, 1, "x") for d, x in zip(t["doc_id"], t["text"], strict=True)]
    want = brute(rows, 120)
    assert run(spark, rows, 120, 60) == want and len(want) > 5


def test_coverage(spark):
    rows = [(1, "abcdefgh", 1, 1, "x"), (2, "xxabcdef", 1, 1, "x"), (3, None, 1, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_chars, r.n_shared, r.share) for r in S.coverage(df, S.shared_spans(df, 5, 3)).collect()}
    assert got == {1: (8, 6, 0.75), 2: (8, 6, 0.75), 3: (0, 0, 0.0)}


def test_empty(spark):
    assert run(spark, [], 12, 5) == []

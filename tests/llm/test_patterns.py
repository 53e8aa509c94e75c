"""Problem 3 against plain versions."""

import random
from itertools import combinations

import duckdb
import pytest

from provspark.llm import patterns as P


def subsequences(word, k):
    return {tuple(word[i] for i in c) for n in range(1, k + 1) for c in combinations(range(len(word)), n)}


@pytest.mark.parametrize("seed", range(30))
def test_shortened_keeps_subsequences(seed):
    r = random.Random(seed)
    k = r.choice([1, 2, 3])
    word = [r.choice("abc"[: r.choice([1, 2, 3])]) for _ in range(r.choice([0, 5, 12, 14]))]
    short = P.shortened(word, k)
    assert subsequences(word, k) == subsequences(short, k)
    cut = r.randrange(len(word) + 1)
    again = P.shortened(P.shortened(word[:cut], k) + P.shortened(word[cut:], k), k)
    assert subsequences(word, k) == subsequences(again, k)


def test_shortened_is_bounded():
    r = random.Random(1)
    word = [r.choice("abcde") for _ in range(20_000)]
    assert len(P.shortened(word, 3)) < 200


def brute(words, need, lo, hi):
    found, level = {}, {(): list(words)}
    letters = sorted({a for w in words for a in w})

    def has(w, p):
        it = iter(w)
        return all(a in it for a in p)

    for n in range(1, hi + 1):
        new = {}
        for p, ws in level.items():
            for a in letters:
                if a not in p:
                    hit = [w for w in ws if has(w, (*p, a))]
                    if len(hit) >= need:
                        new[*p, a] = hit
        level = new
        if n >= lo:
            found |= {p: len(ws) for p, ws in new.items()}
    return found


@pytest.mark.parametrize("seed", range(5))
def test_diagram(seed):
    r = random.Random(seed)
    words = [[r.randrange(6) for _ in range(r.randrange(1, 12))] for _ in range(60)]
    d = P.Diagram(words, [1] * len(words), 6)
    want = brute(words, 15, 1, 4)
    got = {tuple(p): c for p, c in d.frequent(15, 4)}
    assert got == want
    assert d.count(list(want)) == list(want.values())


def test_mine(spark, monkeypatch):
    r = random.Random(3)
    words = [[r.choice("abcdefg") for _ in range(r.randrange(0, 15))] for _ in range(400)]
    monkeypatch.setattr(P, "WORDS_PER_TASK", 100)
    monkeypatch.setattr(P, "CANDIDATES_PER_PASS", 50)
    df = spark.createDataFrame([(w,) for w in words], "word array<string>")
    got = {tuple(x.pattern.split(" > ")): x.support for x in P.mine(df, 0.1, 12, 2, 4).collect()}
    assert got == brute(words, 40, 2, 4) and len(got) > 100


SEQ = """
WITH n AS (SELECT gid, lower(trim(nid)) nid, npos, lower(trim(type)) t FROM nodes),
     m AS (SELECT gid, nid, npos, CASE t WHEN 'file_object_file' THEN 'file' WHEN 'file_object_directory' THEN 'dir' WHEN 'file_object_socket' THEN 'socket'
             WHEN 'file_object_fifo' THEN 'fifo' WHEN 'file_object_char' THEN 'chardev' WHEN 'net_flow_object' THEN 'netflow' WHEN 'subject_process' THEN 'process'
             WHEN 'ipc_object' THEN 'ipc' WHEN 'unprincipled' THEN 'object' ELSE t END t FROM n),
     t AS (SELECT gid, nid, arg_min(t, npos) t FROM m WHERE t IS NOT NULL AND t NOT IN ('', 'object') GROUP BY ALL),
     e AS (SELECT DISTINCT gid, eidx, ts, lower(trim(src)) src, lower(trim(dst)) dst,
             CASE WHEN coalesce(trim(etype), '') = '' THEN 'event' ELSE regexp_replace(lower(trim(etype)), '^event_', '') END etype
           FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL AND ts <> 0)
SELECT list(e.etype || ':' || coalesce(t.t, 'unknown') ORDER BY e.ts, e.eidx) w FROM e LEFT JOIN t ON e.gid = t.gid AND e.dst = t.nid GROUP BY e.gid, e.src
"""


@pytest.mark.parametrize("long", [4, 64])
def test_tables(spark, sf, monkeypatch, long):
    monkeypatch.setattr(P, "LONG", long)
    con = duckdb.connect()
    for t in ("edges", "nodes"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    words = [w for (w,) in con.sql(SEQ).fetchall()]
    need = max(12, -(-len(words) * 6 // 100))
    want = brute(words, need, 1, 4)
    df = P.frequent_patterns(spark.read.parquet(f"{sf}/edges.parquet"), spark.read.parquet(f"{sf}/nodes.parquet"), min_len=1, max_len=4)
    got = {tuple(x.pattern.split(" > ")): x.support for x in df.collect()}
    assert got == want and len(got) > 20


def test_empty_and_nulls(spark):
    e = spark.createDataFrame([("g", 1, None, "b", "read", 5), ("g", 2, "a", None, "read", 5), ("g", 3, "a", "b", None, 0), (None, 3, "a", "b", None, 4)], "gid string, eidx long, src string, dst string, etype string, ts long")
    n = spark.createDataFrame([(None, None, None, None)], "gid string, nid string, type string, npos long")
    assert P.frequent_patterns(e, n).count() == 0
    many = spark.createDataFrame([("g", i * 4 + j, f"p{i}", "b", x, j + 1) for i in range(12) for j, x in enumerate(["read", None, " ", "EVENT_Write"])], e.schema)
    got = {r.pattern: r.support for r in P.frequent_patterns(many, n, min_len=1).collect()}
    assert got == {k: 12 for k in ("read:unknown", "event:unknown", "write:unknown", "read:unknown > event:unknown", "read:unknown > write:unknown", "event:unknown > write:unknown", "read:unknown > event:unknown > write:unknown")}

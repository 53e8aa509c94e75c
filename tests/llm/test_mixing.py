"""Problem 7: apportionment against the plain rule, and what a mix must keep to."""

import random
from fractions import Fraction
from collections import Counter

import pytest

from provspark.llm import mixing as M


def brute(weights, caps, n):
    out = dict.fromkeys(weights, 0)
    for _ in range(n):
        open_ = [k for k, w in weights.items() if w > 0 and out[k] < caps[k]]
        if not open_:
            break
        out[min(open_, key=lambda k: (-weights[k] / (2 * out[k] + 1), k))] += 1
    return out


@pytest.mark.parametrize("seed", range(20))
def test_apportion(seed):
    r = random.Random(seed)
    keys = "abcdefg"[: r.randrange(1, 8)]
    weights = {k: r.choice([0.0, 1.0, 2.0, 3.5, r.random()]) for k in keys}
    caps = {k: r.choice([0, 3, 50, 1000]) for k in keys}
    n = r.choice([0, 1, 7, 100, 900])
    assert M.apportion(weights, caps, n) == brute(weights, caps, n)


def docs(spark, n=600):
    r = random.Random(5)
    src = ["a"] * 6 + ["B ", " b", "c", None, "other"]
    rows = [(i, " ".join(["word"] * r.randrange(1, 60)) if i % 37 else r.choice([None, ""]), r.choice(src), "x", 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, n int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


@pytest.mark.parametrize("shard", [M.SHARD_TOKENS, 500])
def test_mix(spark, shard):
    rows, df = docs(spark)
    t = targets(spark, [("A", 1.0, 2), ("b", 1.0, 2), ("b", 1.0, 2), ("C ", 2.0, 3), ("none", 0.5, 4), ("other", 0.0, 9), (None, 3.0, 1), ("nan", float("nan"), 1)])
    chosen, report = M.mix(df, t, block_tokens=64, shard_tokens=shard)
    tokens = {i: len((x or "").split()) for i, x, *_ in rows}
    have = Counter()
    for i, _, s, *_ in rows:
        if s and s.strip().lower() in "abc":
            have[s.strip().lower()] += tokens[i]
    total, limit = sum(have.values()), {"a": 2, "b": 2, "c": 3}
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got)
    used = Counter()
    for r in got:
        assert 0 < r.repeats <= limit[r.source] and r.n == tokens[r.doc_id] > 0
        used[r.source] += r.n * r.repeats
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"a", "b", "c", "none"}
    for s, w in (("a", 1), ("b", 1), ("c", 2), ("none", 0.5)):
        x = rep[s]
        assert x.tokens == have[s] and x.mixed_tokens == used[s] and abs(x.target_share - w / 4.5) < 1e-12
        assert x.short == (have[s] * {"a": 2, "b": 2, "c": 3, "none": 4}[s] < w / 4.5 * total)
        shards = max(1, have[s] // shard)
        if x.short:
            assert used[s] == have[s] * limit.get(s, 4)
        else:
            assert abs(used[s] - 64 * x.quota_blocks) <= 64 * 2 * (shards + 1)
    assert abs(sum(r.mixed_share for r in rep.values()) - 1) < 1e-9


def test_short_by_apportionment():
    """What the apportionment calls short are the sources whose cap is below their target, also at the very boundary."""
    r = random.Random(3)
    for _ in range(400):
        want = {f"s{i}": (r.choice([1.0, 2.0, 0.1, 0.3, r.random() * 5 + 1e-6]), r.randrange(0, 4)) for i in range(r.randrange(1, 8))}
        have = {s: r.choice([0, 10, 1000, 4096, r.randrange(20_000)]) for s in want if r.random() < 0.9}
        plan = M.plan_of(have, want, block_tokens=r.choice([1, 64, 1024]))
        total, weights = sum(have.values()), sum(Fraction(w) for w, _ in want.values())
        assert plan.short == {s: have.get(s, 0) * k * weights < Fraction(w) * total for s, (w, k) in want.items()}
    even = M.plan_of({"a": 100, "b": 300}, {"a": (1.0, 2), "b": (1.0, 1)}, block_tokens=7)
    assert even.short == {"a": False, "b": False} and even.caps["a"] == 200


def test_seeded(spark):
    _, df = docs(spark)
    t = targets(spark, [("a", 1.0, 1), ("b", 3.0, 1)])
    pick = lambda s: {(r.doc_id, r.repeats) for r in M.mix(df, t, seed=s, block_tokens=64, total_tokens=2000)[0].collect()}
    assert pick(1) == pick(1) != pick(2)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    chosen, report = M.mix(df, targets(spark, [("a", 1.0, 1)]))
    assert chosen.count() == 0 and [(r.source, r.short, r.mixed_share) for r in report.collect()] == [("a", False, None)]
    chosen, report = M.mix(df, targets(spark, []))
    assert chosen.count() == 0 and report.count() == 0

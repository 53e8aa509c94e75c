"""Paired statistics: counts and rank sums in Spark, p-values from them on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered

EXACT = 20


def paired(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """on..., a, b, d = b - a of the slots both have."""
    x = a.select(*on, F.col(value).cast("double").alias("a")).join(b.select(*on, F.col(value).cast("double").alias("b")), on)
    return x.withColumn("d", F.col("b") - F.col("a"))


def win_tie_loss(d: DataFrame, tol: float = 1e-12) -> DataFrame:
    """wins, ties, losses, mean, effect (mean by sample deviation, 0 without spread)."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    x = d.agg(one(F.col("d") > tol).alias("wins"), one(F.abs("d") <= tol).alias("ties"), one(F.col("d") < -tol).alias("losses"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("_s"))
    return x.select("wins", "ties", "losses", "mean", F.when(F.col("_s") > 0, F.col("mean") / F.col("_s")).otherwise(0.0).alias("effect"))


def rank_sum(d: DataFrame) -> tuple[int, float, dict[float, int] | None]:
    """(n, W+, ties): differences without zeros, sum of the average ranks of positive ones; sizes of tied ranks if n is small."""
    x = d.where("d IS NOT NULL AND d <> 0").select(F.abs("d").alias("m"), (F.col("d") > 0).cast("bigint").alias("p")).groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.sum("p").alias("p"))
    r = numbered(x, ["m"], sums={"upto": "c"}).withColumn("rank", F.col("upto") - (F.col("c") - 1) / 2)
    n, w = r.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("rank") * F.col("p")), F.lit(0.0))).first()
    ties = {t.rank: t.c for t in r.select("rank", "c").collect()} if n <= EXACT else None
    return n, float(w), ties


def wilcoxon(d: DataFrame, side: str = "two") -> float:
    """p of the signed-rank test: exact over all signs up to EXACT differences, else the normal approximation.  side: two or greater."""
    n, w, ties = rank_sum(d)
    if n == 0:
        return 1.0
    mean = n * (n + 1) / 4
    if ties is None:
        z = (w - mean) / sqrt(n * (n + 1) * (2 * n + 1) / 24)
        upper = (1 - erf(z / sqrt(2))) / 2
        return upper if side == "greater" else min(1.0, 2 * min(upper, 1 - upper))
    sums = {0.0: 1}  # distribution of W+ over all sign choices
    for rank, c in ties.items():
        for _ in range(c):
            new = dict(sums)
            for s, k in sums.items():
                new[s + rank] = new.get(s + rank, 0) + k
            sums = new
    if side == "greater":
        return sum(k for s, k in sums.items() if s >= w - 1e-9) / 2**n
    far = abs(w - mean)
    return sum(k for s, k in sums.items() if abs(s - mean) >= far - 1e-9) / 2**n


def binomial_two_sided(k: int, n: int) -> float:
    """Exact p of k of n at chance 1/2."""
    if n == 0:
        return 1.0
    if n <= 1000:
        return min(1.0, 2 * sum(comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
    term = lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2))
    return min(1.0, 2 * sum(term(i) for i in range(max(0, min(k, n - k) - 60 * int(sqrt(n))), min(k, n - k) + 1)))


def mcnemar(df: DataFrame, a: str, b: str) -> tuple[int, int, float]:
    """(only a, only b, exact p) of two 0/1 columns."""
    x, y = df.agg(F.coalesce(F.sum(((F.col(a) == 1) & (F.col(b) == 0)).cast("int")), F.lit(0)), F.coalesce(F.sum(((F.col(a) == 0) & (F.col(b) == 1)).cast("int")), F.lit(0))).first()
    return x, y, binomial_two_sided(x, x + y)


def tost(d: DataFrame, delta: float) -> float:
    """p of equivalence within +-delta: the larger of both one-sided signed-rank tests."""
    up = wilcoxon(d.select((F.col("d") + delta).alias("d")), "greater")
    down = wilcoxon(d.select((delta - F.col("d")).alias("d")), "greater")
    return max(up, down)


def bootstrap_mean(d: DataFrame, b: int = 20_000, level: float = 0.95, seed: int = 0, cluster: str | None = None) -> tuple[float, float, float]:
    """(mean, low, high): percentile interval of the mean, resampling rows, or whole clusters.

    A resample gives each row, or cluster, a Poisson(1) weight drawn by a seed of its own (Poisson(c) for c rows of one value), so
    tasks add up their part of all b resamples and b sums a task come to the driver, not the rows.
    """
    if cluster:
        x = d.groupBy(cluster).agg(F.sum("d").alias("s"), F.count("d").alias("n")).select(F.xxhash64(F.lit(seed), cluster).alias("h"), "s", F.col("n").cast("double").alias("n"), F.lit(1.0).alias("c"))
    else:
        x = d.groupBy("d").agg(F.count(F.lit(1)).cast("double").alias("c")).select(F.xxhash64(F.lit(seed), "d").alias("h"), F.col("d").alias("s"), F.lit(1.0).alias("n"), "c")

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros(b + 1), np.zeros(b + 1)  # the last is the sample itself
        for batch in batches:
            for h, s, n, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                w = np.append(np.random.default_rng(h & 2**63 - 1).poisson(c, b), c)
                sums += w * s
                sizes += w * n
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([sizes.tolist()], pa.list_(pa.float64()))], names=["s", "n"])

    parts = x.where("s IS NOT NULL AND n > 0").mapInArrow(resample, "s array<double>, n array<double>").collect()
    s, n = (np.sum([r[k] for r in parts], axis=0) if parts else np.zeros(b + 1) for k in ("s", "n"))
    if not n[-1]:
        return float("nan"), float("nan"), float("nan")
    drawn = n[:-1] > 0
    lo, hi = np.quantile(s[:-1][drawn] / n[:-1][drawn], [(1 - level) / 2, (1 + level) / 2])
    return float(s[-1] / n[-1]), float(lo), float(hi)


def outer_scores(listed: DataFrame, scores: DataFrame, on: list[str], default: float = -1e9) -> DataFrame:
    """listed with ``score``: that of the same key, ``default`` where there is none."""
    return listed.join(scores.select(*on, "score"), on, "left").withColumn("score", F.coalesce("score", F.lit(default)))


def full_match(a: DataFrame, b: DataFrame, on: list[str], value: str, tol: float = 1e-9) -> DataFrame:
    """on..., old, new, status (same, changed, only_old, only_new) of all keys of either table; a null value equals a null."""
    x = a.select(*on, F.col(value).cast("double").alias("old"), F.lit(True).alias("_a")).join(b.select(*on, F.col(value).cast("double").alias("new"), F.lit(True).alias("_b")), on, "full")
    equal = F.coalesce(F.abs(F.col("old") - F.col("new")) <= tol, F.col("old").isNull() & F.col("new").isNull())
    return x.select(*on, "old", "new", F.when(F.col("_b").isNull(), "only_old").when(F.col("_a").isNull(), "only_new").when(equal, "same").otherwise("changed").alias("status"))

"""Problem 7: mixing sources to target weights.

Method: Sainte-Lague apportionment.  The budget is cut into blocks of equal tokens; blocks go to sources by the highest
quotients weight/(2k+1), a source dropping out when its records, each used at most ``max_repeats`` times, are used up.  Each
source's blocks are apportioned the same way to its shards by their tokens, which gives integer quotas per shard; within a shard
the records stand in the order of a seeded hash, are cut into blocks and used block by block.

A source's shards grow in number with its tokens, so a source that holds a third of all rows is spread; there are at most
SHARDS shards plus one per source, whose counts are all that comes to the driver.

Defined results: weights that are null, NaN, infinite, 0 or negative are not mixed; null max_repeats is 1, negative is 0; rows of one
source in different spellings add their weights and take the larger max_repeats, equal rows count once; null sources and
documents of unlisted sources are not mixed; null and empty texts have 0 tokens and are never chosen; documents of a repeated id
each count; no mixed tokens give an empty mix with all shares null; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.normal import source_form
from ..functions.tables import cut
from .tokens import encode

BLOCK_TOKENS = 1024
SHARD_TOKENS = 4_000_000
SHARDS = 20_000


def apportion(weights: dict, caps: dict, blocks: int) -> dict:
    """Sainte-Lague: blocks by highest quotients weight/(2k+1) with at most ``caps`` each; ties go to the lesser key."""
    caps = {k: caps[k] if w > 0 else 0 for k, w in weights.items()}
    blocks = min(blocks, sum(caps.values()))
    if blocks <= 0:
        return dict.fromkeys(weights, 0)

    def seats(divisor: float) -> dict:
        return {k: min(caps[k], int(w / divisor / 2 + 0.5)) for k, w in weights.items()}

    # a divisor just too large gives almost all blocks at once
    lo, hi = min(w for w in weights.values() if w > 0) / (4 * (blocks + 1)), 2 * max(weights.values()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(seats(mid).values()) > blocks:
            lo = mid
        else:
            hi = mid
    out = seats(hi)
    heap = [(-w / (2 * out[k] + 1), k) for k, w in weights.items() if out[k] < caps[k]]
    heapq.heapify(heap)
    for _ in range(blocks - sum(out.values())):
        _, k = heapq.heappop(heap)
        out[k] += 1
        if out[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), k))
    return out


def sized(docs: DataFrame, path: str | None = None, sources: list[str] | None = None) -> DataFrame:
    """doc_id, source (form), n: tokens of each text, of the given sources only if there are any given."""
    d = docs.select("doc_id", source_form("source").alias("source"), "text")
    d = d if sources is None else d.where(F.col("source").isin(sources))
    return d.select("doc_id", "source", F.size(encode(F.col("text"), path)).cast("bigint").alias("n"))


def targets_of(mix: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (weight, max_repeats) of all mixed sources; the target table is a parameter, one row a source."""
    rows = mix.select(source_form("source").alias("source"), F.col("weight").cast("double").alias("weight"), F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(1)).alias("r")).where("source IS NOT NULL AND weight > 0 AND NOT isnan(weight) AND weight < double('Infinity')").distinct()
    return {x.source: (x.w, max(0, x.r)) for x in rows.groupBy("source").agg(F.sum("weight").alias("w"), F.max("r").alias("r")).collect()}


@dataclass(frozen=True)
class Plan:
    """What each source has, may and is to give, by source; blocks are ``quota``."""

    have: dict[str, int]
    share: dict[str, Fraction]
    caps: dict[str, int]
    quota: dict[str, int]
    short: dict[str, bool]
    budget: int


def plan_of(have: dict[str, int], want: dict[str, tuple[float, int]], total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> Plan:
    """Blocks of each source by Sainte-Lague, and which sources fall short of their target.

    Short ones come from the apportionment: the k sources together get all blocks, so a source short of its target ends within
    (k + 3) / 2 blocks of its cap.  Of those, an exact comparison in fractions tells which caps are below the target.
    """
    total = sum(have.get(s, 0) for s in want)
    budget = total if total_tokens is None else total_tokens
    weight_sum = sum((Fraction(w) for w, _ in want.values()), Fraction(0))
    share = {s: Fraction(w) / weight_sum for s, (w, _) in want.items()}
    caps = {s: have.get(s, 0) * r for s, (_, r) in want.items()}
    blocks = {s: ceil(c / block_tokens) for s, c in caps.items()}
    quota = apportion({s: float(x) for s, x in share.items()}, blocks, ceil(budget / block_tokens))
    full = {s for s in want if quota[s] >= blocks[s] - (len(want) + 3) / 2}
    return Plan(have, share, caps, quota, {s: s in full and caps[s] < share[s] * budget for s in want}, budget)


def _have(sizes: DataFrame) -> dict[str, int]:
    return {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # at most one row a target


def short_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, path: str | None = None) -> DataFrame:
    """source: those that cannot reach their target even with all their repeats."""
    want = targets_of(targets)
    plan = plan_of(_have(sized(docs, path, list(want))), want, total_tokens, block_tokens)
    return docs.sparkSession.createDataFrame([(s,) for s in want if plan.short[s]], "source string")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    chosen: doc_id, source, n, repeats of all records used.  report: one row per mixed source with its tokens, target_share,
    goal_tokens, cap_tokens, short (the cap is below the goal), quota_blocks, mixed_tokens and mixed_share.
    ``total_tokens`` is the size of the mix; by default all tokens of the mixed sources.
    """
    spark = docs.sparkSession
    want = targets_of(targets)
    n = cut(sized(docs, path, list(want)), "sizes")
    have = _have(n)
    plan = plan_of(have, want, total_tokens, block_tokens)
    caps, quota = plan.caps, plan.quota

    size = max(shard_tokens, sum(have.values()) // SHARDS)
    shards = {s: max(1, have.get(s, 0) // size) for s in want}
    pieces = F.create_map(*[x for s, k in shards.items() for x in (F.lit(s), F.lit(k))]) if want else F.lit(None)
    h = F.xxhash64(F.lit(seed), "doc_id")
    placed = n.where("n > 0").withColumn("h", h).withColumn("shard", F.pmod(F.xxhash64("h"), F.try_element_at(pieces, F.col("source")))) if want else n.withColumn("h", h).withColumn("shard", F.lit(0))
    by_shard: dict[str, dict[int, int]] = {s: {} for s in want}
    for r in placed.groupBy("source", "shard").agg(F.sum("n").alias("n")).collect():  # at most SHARDS + sources rows
        by_shard[r.source][r.shard] = r.n
    rows = []
    for s, shard in by_shard.items():
        q = apportion({k: float(v) for k, v in shard.items()}, {k: ceil(v * want[s][1] / block_tokens) for k, v in shard.items()}, quota[s])
        full = quota[s] >= ceil(caps[s] / block_tokens)  # all there is
        rows += [(s, k, q[k], ceil(shard[k] / block_tokens), want[s][1], full) for k in shard]
    q = spark.createDataFrame(rows, "source string, shard bigint, quota bigint, blocks bigint, max_repeats bigint, used_up boolean")
    w = W.partitionBy("source", "shard").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    block = F.floor(F.coalesce(F.sum("n").over(w), F.lit(0)) / block_tokens)
    used = placed.withColumn("block", block).join(F.broadcast(q), ["source", "shard"])
    once = F.expr("quota div blocks") + F.when(F.col("block") < F.col("quota") % F.col("blocks"), 1).otherwise(0)
    chosen = used.withColumn("repeats", F.when(F.col("used_up"), F.col("max_repeats")).otherwise(F.least("max_repeats", once))).where("repeats > 0").select("doc_id", "source", "n", "repeats")

    rows = [(s, have.get(s, 0), float(plan.share[s]), float(plan.share[s] * plan.budget), caps[s], plan.short[s], quota[s]) for s in want]
    plan = spark.createDataFrame(rows, "source string, tokens bigint, target_share double, goal_tokens double, cap_tokens bigint, short boolean, quota_blocks bigint")
    got = chosen.groupBy("source").agg(F.sum(F.col("n") * F.col("repeats")).alias("mixed_tokens"))
    report = plan.join(F.broadcast(got), "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    report = report.withColumn("mixed_share", F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(W.partitionBy()), F.lit(0)))
    return chosen, report

"""Problem 2: per-key results where a few keys hold most records.

Method: distributed exact selection.  Value histograms with mergeable counts are refined until ranks resolve; the rows of a hot
key never meet in a task, only one count per (task, bucket) is shuffled.

* ``select_ranks``: the values at given ranks of each group.  Each round counts the rows of the intervals that still hold a rank in
  BUCKETS buckets, with the least and greatest value of each; running sums tell which bucket a rank falls in, and that bucket's
  bounds are the next interval, until both are one value.
* ``heavy_keys``: the values are key hashes, the groups are the sides, and the ranks are the multiples of the least size asked
  for.  Equal keys stand together, so a key of that size covers at least one of these ranks, and its hash is among the at most
  1/share values selected.  An interval with fewer rows holds no such key and is given up.  A grouped count over the selected
  hashes separates keys of equal hash.
* ``exact_quantiles`` and ``percentiles``: the ranks are those of the quantiles.  Groups above a size bound are refined; there are
  at most rows/bound of them, which bounds what is broadcast.  Groups below the bound are ranked by a sorted window, which spills
  and holds at most the bound in a group.
* ``key_profile``: counts, distinct opposite keys, first and last known time: one grouped pass over (src, dst) pairs, which
  spreads a hot key over its partners, then a combined pass over either side.

Defined results: null keys are no keys (their rows count in the total and for the opposite side); blank keys are the key '';
null or 0 times are unknown; an empty table gives no rows; a key whose times are all unknown has null first, last and median;
repeated rows count; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.normal import node_key
from ..functions.tables import cut

#: Buckets of an interval; those of ``heavy_keys``, which has few intervals.
BUCKETS, KEY_BUCKETS = 1024, 16_384
#: A group with more rows than the larger of this and 1/GROUPS of all rows is refined, smaller ones are sorted.
LIGHT, GROUPS = 512, 20_000


def sides(edges: DataFrame, *cols: str) -> DataFrame:
    """Two rows for each edge: (side, node_key, opposite, *cols)."""
    s, d = node_key("src"), node_key("dst")
    both = F.array(F.struct(F.lit("src").alias("side"), s.alias("node_key"), d.alias("opposite")), F.struct(F.lit("dst").alias("side"), d.alias("node_key"), s.alias("opposite")))
    return edges.select(*cols, F.explode(both).alias("k")).select("k.*", *cols)


def known_ts(c: str = "ts") -> Column:
    return F.when(F.col(c) != 0, F.col(c))


def select_ranks(rows: DataFrame, keys: list[str], state: DataFrame, buckets: int = BUCKETS, least: int = 0) -> DataFrame:
    """(keys, t, value): the values at the wanted ranks of each group, of those in intervals of at least ``least`` rows.

    ``rows``: keys, v (bigint between -2^62 and 2^62, or double).  ``state``: keys, lo, hi (bounds of v) and want, an array of (t, r):
    a name and a rank from 1; ranks beyond the group's size have no value.  It is broadcast.
    """
    exact = dict(rows.dtypes)["v"] != "double"
    levels: list[DataFrame] = []
    done, path = None, []
    while True:
        hit = state.where("lo = hi").select(*keys, F.explode("want").alias("w"), "lo").select(*keys, "w.t", F.col("lo").alias("value"))
        done = hit if done is None else done.unionByName(hit)
        live = state.where("lo < hi")
        if live.isEmpty():
            return done
        levels.append(live)
        at, path = rows, []
        for i, level in enumerate(levels):
            at = at.join(F.broadcast(level.select(*keys, *path, "lo", "hi")), [*keys, *path])
            bucket = F.expr(f"(v - lo) div ((hi - lo) div {buckets} + 1)" if exact else f"least({buckets - 1}, floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * {buckets}))")
            at = at.withColumn(f"_b{i}", bucket.cast("int")).drop("lo", "hi")
            path.append(f"_b{i}")
        hist = at.groupBy(*keys, *path).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        run = F.sum("c").over(W.partitionBy(*keys, *path[:-1]).orderBy(path[-1]))  # at most ``buckets`` rows
        hist = hist.withColumn("before", run - F.col("c")).join(F.broadcast(live.select(*keys, *path[:-1], "want")), [*keys, *path[:-1]])
        inside = F.filter("want", lambda w: (w.r > F.col("before")) & (w.r <= F.col("before") + F.col("c")))
        want = F.transform(inside, lambda w: F.struct(w.t.alias("t"), (w.r - F.col("before")).alias("r")))
        state = cut(hist.withColumn("want", want).where((F.size("want") > 0) & (F.col("c") >= least)).select(*keys, *path, "lo", "hi", "want"), "bounds")


def heavy_keys(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(side, node_key, n_rows) of all keys that hold at least ``share`` of all rows on their side, exactly."""
    n = edges.count()
    least = max(1, ceil(Fraction(str(share)) * n))
    # 62 bits of hash, so that differences of values stay in range
    rows = sides(edges).where("node_key IS NOT NULL").select("side", "node_key", F.shiftright(F.xxhash64("node_key"), 2).alias("v"))
    ranks = F.transform(F.sequence(F.lit(least), F.lit(max(n, least)), F.lit(least)), lambda r: F.struct(r.alias("t"), r.cast("bigint").alias("r")))
    state = edges.sparkSession.createDataFrame([("src", -(2**61), 2**61 - 1), ("dst", -(2**61), 2**61 - 1)], "side string, lo bigint, hi bigint").withColumn("want", ranks)
    hits = sorted({(r.side, r.value) for r in select_ranks(rows.select("side", "v"), ["side"], state, KEY_BUCKETS, least).collect()})  # at most 1/share of a side
    found = rows.where(_either(hits, F.col("v")))
    return found.groupBy("side", "node_key").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)


def _either(pairs: list[tuple[str, int]], value: Column) -> Column:
    out = F.lit(False)
    for side in sorted({s for s, _ in pairs}):
        out = out | ((F.col("side") == side) & value.isin([v for s, v in pairs if s == side]))
    return out


def key_profile(edges: DataFrame, quantiles: tuple[float, ...] = ()) -> DataFrame:
    """side, node_key, n_rows, n_opposite, first_ts, last_ts of every key, and with ``quantiles`` the exact ts_qNN of its known times."""
    pairs = edges.groupBy(node_key("src").alias("s"), node_key("dst").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(known_ts()).alias("lo"), F.max(known_ts()).alias("hi"))
    both = F.array(F.struct(F.lit("src").alias("side"), F.col("s").alias("node_key"), F.col("d").alias("opposite")), F.struct(F.lit("dst").alias("side"), F.col("d").alias("node_key"), F.col("s").alias("opposite")))
    out = (
        pairs.select("n", "lo", "hi", F.explode(both).alias("k"))
        .where("k.node_key IS NOT NULL")
        .groupBy("k.side", "k.node_key")
        .agg(F.sum("n").alias("n_rows"), F.count("k.opposite").alias("n_opposite"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"))
    )
    if not quantiles:
        return out
    values = sides(edges, "ts").select("side", "node_key", known_ts().alias("ts")).where("node_key IS NOT NULL AND ts IS NOT NULL")
    q = exact_quantiles(values, ["side", "node_key"], "ts", quantiles)
    wide = q.groupBy("side", "node_key").agg(*[F.max(F.when(F.col("q") == x, F.col("value"))).alias(f"ts_q{round(x * 100):02d}") for x in quantiles])
    return out.join(wide, ["side", "node_key"], "left")


def _ranked(rows: DataFrame, keys: list[str], ranks: list[Column], light: int, groups: int, buckets: int) -> DataFrame:
    """(keys, n, t, value): of each group the values at ``ranks``, expressions over its size n; t counts them from 0.  ``rows``: keys, v."""
    rows = rows.dropna()
    size = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    total, largest = (x or 0 for x in size.agg(F.sum("n"), F.max("n")).first())
    bound = max(light, total // groups)
    heavy = size.where(F.col("n") > bound)  # at most total/bound <= groups rows, or total/light of a small table
    some = largest > bound
    light_rows = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti") if some and keys else rows.limit(0) if some else rows
    w = W.partitionBy(*keys)
    ranked = light_rows.withColumn("rn", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count(F.lit(1)).over(w))
    is_one = F.lit(False)
    for r in ranks:
        is_one = is_one | (F.col("rn") == r)
    want = F.array(*[F.struct(F.lit(i).alias("t"), r.cast("bigint").alias("r")) for i, r in enumerate(ranks)])
    small = ranked.where(is_one).withColumn("w", F.explode(want)).where("w.r = rn").select(*keys, "n", "w.t", F.col("v").alias("value"))
    if not some:
        return small
    one = F.lit(0).alias("_one")  # all rows as one group, where there are no keys
    by = keys or ["_one"]
    state = heavy.select(*(keys or [one]), "lo", "hi", want.alias("want"))
    big = select_ranks(rows if keys else rows.select(one, "v"), by, state, buckets).join(F.broadcast(heavy.select(*(keys or [one]), "n")), by)
    return small.unionByName(big.select(*keys, "n", "t", "value"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...], light: int = LIGHT, groups: int = GROUPS, buckets: int = BUCKETS) -> DataFrame:
    """(keys, q, value): of each group the smallest value whose rank is at least q times the group's size (q = 0: the least).

    ``value`` is an integer column; rows with a null value or key are left out.
    """
    ranks = [F.greatest(F.lit(1), F.ceil(F.lit(str(q)).cast("decimal(12,9)") * F.col("n"))).cast("bigint") for q in quantiles]
    got = _ranked(rows.select(*keys, F.col(value).cast("bigint").alias("v")), keys, ranks, light, groups, buckets)
    return got.select(*keys, F.element_at(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("t") + 1).alias("q"), "value")


def percentiles(rows: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...], light: int = LIGHT, groups: int = GROUPS, buckets: int = BUCKETS) -> DataFrame:
    """(keys, q, value): percentiles of doubles, interpolated between the two values beside the place (n - 1) q.

    Rows with a null key or a value that is null, NaN or infinite are left out; a group without others has no row.
    """
    place = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles]
    ranks = [f(p).cast("bigint") + 1 for p in place for f in (F.floor, F.ceil)]
    v = F.col(value).cast("double")
    v = F.when(v.between(-1.7976931348623157e308, 1.7976931348623157e308), v)
    got = _ranked(rows.select(*keys, v.alias("v")), keys, ranks, light, groups, buckets)
    q = F.element_at(F.array(*[F.lit(float(q)) for q in quantiles]), (F.shiftright("t", 1) + 1).cast("int"))
    x = got.groupBy(*keys, q.alias("q")).agg(F.max("n").alias("n"), F.max(F.when(F.col("t") % 2 == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("t") % 2 == 1, F.col("value"))).alias("b"))
    p = F.col("q") * (F.col("n") - 1)
    return x.select(*keys, "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil(p) - p) * F.col("a") + (p - F.floor(p)) * F.col("b")).alias("value"))


def wide_percentiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], **kw) -> DataFrame:
    """keys and one column per percentile: ``wanted`` is name -> (value column, q)."""
    cols = sorted({c for c, _ in wanted.values()})
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(*keys, F.col("x.c").alias("_c"), F.col("x.v").alias("_v"))
    p = percentiles(long, [*keys, "_c"], "_v", tuple(sorted({q for _, q in wanted.values()})), **kw)
    return p.groupBy(*keys).agg(*[F.max(F.when((F.col("_c") == c) & (F.col("q") == q), F.col("value"))).alias(name) for name, (c, q) in wanted.items()])

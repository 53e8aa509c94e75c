"""Node-level metrics over (score, y) rows.

Everything that depends on ranks works on counts per distinct score or on distributed row numbers, so no task sorts the table.
Rows with a null score or label are left out; metrics without positives or negatives are NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .skew import percentiles


def _safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, by: tuple[str, ...] = (), pred: str = "pred", y: str = "y") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, fpr, fnr; pred and y are 1 for an attack; ratios without a denominator are 0."""
    one = lambda p, t: F.coalesce(F.sum(F.when((F.col(pred) == p) & (F.col(y) == t), 1).otherwise(0)), F.lit(0))
    return rates(df.groupBy(*by).agg(one(1, 1).alias("tp"), one(1, 0).alias("fp"), one(0, 1).alias("fn"), one(0, 0).alias("tn")))


def rates(c: DataFrame) -> DataFrame:
    p, r = _safe(F.col("tp"), F.col("tp") + F.col("fp")), _safe(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumns({"precision": p, "recall": r})
    return c.withColumns({"f1": _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "fpr": _safe(F.col("fp"), F.col("fp") + F.col("tn")), "fnr": _safe(F.col("fn"), F.col("fn") + F.col("tp"))})


def micro(c: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rates of summed counts."""
    return rates(c.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")]))


def ranked(df: DataFrame, score: str = "score", y: str = "y", pos: str = "pos") -> DataFrame:
    """score, y, pos, rn, tp: rows by descending score, ties by pos, with the running number of positives."""
    x = df.select(F.col(score).cast("double").alias("score"), F.col(y).cast("int").alias("y"), F.col(pos).alias("pos")).where("score IS NOT NULL AND y IS NOT NULL")
    return numbered(x, [F.desc("score"), "pos"], sums={"tp": "y"})


def precision_at_k(df: DataFrame, ks: tuple[int, ...] = (10, 50, 100), **kw) -> DataFrame:
    """k, precision: share of positives among the first min(k, n)."""
    r = ranked(df, **kw)
    return r.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rn <= k").groupBy("k").agg(F.avg("y").alias("precision"))


def curve(df: DataFrame, **kw) -> DataFrame:
    """rn, score, tp, fp, precision, recall, f1, fpr, mcc at each cut of the stable descending order."""
    r = ranked(df, **kw)
    tot = r.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p"))
    n, p = tot.first()
    tp, fp = F.col("tp").cast("double"), (F.col("rn") - F.col("tp")).cast("double")
    fn, tn = F.lit(float(p)) - tp, F.lit(float(n - p)) - fp
    prec, rec = _safe(tp, tp + fp), _safe(tp, tp + fn)
    mcc = _safe(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return r.select("rn", "score", "tp", (F.col("rn") - F.col("tp")).alias("fp"), prec.alias("precision"), rec.alias("recall"), _safe(2 * prec * rec, prec + rec).alias("f1"), _safe(fp, fp + tn).alias("fpr"), mcc.alias("mcc"))


def best_f1(df: DataFrame, **kw) -> DataFrame:
    """f1, rn: the best cut, the first of equals."""
    return curve(df, **kw).agg(F.max(F.struct("f1", (-F.col("rn")).alias("r"))).alias("x")).select("x.f1", (-F.col("x.r")).alias("rn"))


def best_mcc(df: DataFrame, **kw) -> DataFrame:
    return curve(df, **kw).agg(F.max(F.struct("mcc", (-F.col("rn")).alias("r"))).alias("x")).select("x.mcc", (-F.col("x.r")).alias("rn"))


def tpr_at_fpr(df: DataFrame, limits: tuple[float, ...] = (0.001, 0.01, 0.05), **kw) -> DataFrame:
    """limit, tpr: recall at the last cut whose fpr is at most the limit (0 if there is none)."""
    c = curve(df, **kw).withColumn("limit", F.explode(F.array(*[F.lit(x) for x in limits])))
    return c.groupBy("limit").agg(F.coalesce(F.max_by("recall", F.when(F.col("fpr") <= F.col("limit"), F.col("rn"))), F.lit(0.0)).alias("tpr"))


def roc_auc(df: DataFrame, ties: str = "average", score: str = "score", y: str = "y", pos: str = "pos") -> DataFrame:
    """auc by rank sums: tied scores get their average rank (``average``), or ranks by position in ascending stable order (``stable``),
    counted from 1, or from 0 (``zero``, which is 1/negatives lower)."""
    if ties in ("stable", "zero"):
        x = df.select(F.col(score).cast("double").alias("score"), F.col(y).cast("int").alias("y"), F.col(pos).alias("pos")).where("score IS NOT NULL AND y IS NOT NULL")
        r = numbered(x, ["score", "pos"])
        a = r.agg(F.sum(F.when(F.col("y") == 1, F.col("rn") - (1 if ties == "zero" else 0))).cast("double").alias("s"), F.sum("y").cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    elif ties == "average":
        d = df.select(F.col(score).cast("double").alias("score"), F.col(y).cast("bigint").alias("y")).where("score IS NOT NULL AND y IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("y"))
        r = numbered(d, ["score"], sums={"upto": "c"})
        a = r.agg(F.sum(F.col("y") * (F.col("upto") - (F.col("c") - 1) / 2)).cast("double").alias("s"), F.sum("y").cast("double").alias("p"), F.sum("c").cast("double").alias("n"))
    else:
        raise ValueError(f"ties: {ties}")
    neg = F.col("n") - F.col("p")
    return a.select(F.when((F.coalesce("p", F.lit(0.0)) > 0) & (neg > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).otherwise(F.lit(float("nan"))).alias("auc"))


def pr_auc(df: DataFrame, **kw) -> DataFrame:
    """auc: trapezoid over (recall, precision) of all cuts of the stable descending order, without an anchor at recall 0."""
    c = curve(df, **kw)
    nxt = numbered(c.select("rn", "precision", "recall"), ["rn"], name="i").select((F.col("i") + 1).alias("i"), F.col("precision").alias("p0"), F.col("recall").alias("r0"))
    own = c.select(F.col("rn").cast("bigint").alias("i"), "precision", "recall")
    return own.join(nxt, "i").agg(F.coalesce(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2), F.lit(float("nan"))).alias("auc"))


def attacks_found(df: DataFrame, threshold: float, attacks: str = "attacks") -> DataFrame:
    """attack, found: whether some node of an attack scores above the threshold."""
    return df.select("score", F.explode(attacks).alias("attack")).groupBy("attack").agg(F.max(F.col("score") > threshold).alias("found"))


def summary_by(df: DataFrame, by: list[str], value: str, pivot: str | None = None) -> DataFrame:
    """mean and population deviation, optionally one pair of columns per value of ``pivot``."""
    g = df.groupBy(*by)
    g = g.pivot(pivot) if pivot else g
    return g.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def score_stats(df: DataFrame, threshold: float) -> DataFrame:
    """p95, p99, max, share at or above the threshold."""
    own = df.agg(F.max("score").cast("double").alias("max"), F.avg((F.col("score") >= threshold).cast("double")).alias("share"))
    x = percentiles(df, [], "score", (0.95, 0.99)).unionByName(own.select(F.explode(F.array(F.struct(F.lit(2.0).alias("q"), F.col("max").alias("value")), F.struct(F.lit(3.0).alias("q"), F.col("share").alias("value")))).alias("x")).select("x.*"))
    return x.agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(c) for c, q in (("p95", 0.95), ("p99", 0.99), ("max", 2.0), ("share", 3.0))])


def top_k_table(df: DataFrame, ks: tuple[int, ...] = (10, 50, 100, 500, 1000), **kw) -> DataFrame:
    """k, tp, precision, recall, f1, threshold: the cut after the first min(k, n) rows."""
    c = curve(df, **kw).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rn <= k")
    return c.groupBy("k").agg(F.max_by(F.struct("tp", "precision", "recall", "f1", "score"), "rn").alias("x")).select("k", "x.tp", "x.precision", "x.recall", "x.f1", F.col("x.score").alias("threshold"))


def thinned_curve(df: DataFrame, points: int = 200, **kw) -> DataFrame:
    """The curve at every n-th cut, so that about ``points`` are left, and at its last."""
    c = curve(df, **kw)
    n = c.count()
    return c.where(((F.col("rn") - 1) % max(1, n // points) == 0) | (F.col("rn") == n))


def zeroed(df: DataFrame, column: str) -> DataFrame:
    """The table with one feature put to 0."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.withColumn(column, F.lit(0.0))


def as_benign(df: DataFrame, y: str = "y") -> DataFrame:
    """The table as if nothing were an attack."""
    return df.withColumn(y, F.lit(0))


def pick(df: DataFrame, where: dict[str, str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose columns, as text, have these values; ``numbers`` become doubles, null where they are none."""
    for c, v in where.items():
        df = df.where(F.col(c).cast("string") == v)
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numbers})

"""One-class detectors: an ensemble of group centroids, and Mahalanobis distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import cut
from .features import dot, unit
from .skew import percentiles, wide_percentiles


#: Cosines computed at once in a task.
CELLS = 4_000_000


@dataclass(frozen=True)
class Ensemble:
    """One expert (grp, centroid, radius) per group of training rows; groups are few (a graph each)."""

    experts: DataFrame

    def add(self, rows: DataFrame, **kw) -> Ensemble:
        """Further experts; those there are stay (groups of the same name are replaced)."""
        new = fit(rows, **kw).experts
        return Ensemble(self.experts.join(new.select("grp"), "grp", "left_anti").unionByName(new))


def fit(rows: DataFrame, q: float = 0.05, least_radius: float = 0.5, group: str = "grp", vec: str = "vec") -> Ensemble:
    """Centroid of the unit vectors of each group, scaled to length 1, and the radius: the larger of the q-quantile of the rows' cosine to it and ``least_radius``."""
    x = rows.select(F.col(group).alias("grp"), unit(F.col(vec)).alias("u"))
    c = x.groupBy("grp").agg(Summarizer.mean(array_to_vector("u")).alias("m")).select("grp", unit(vector_to_array("m")).alias("centroid"))
    r = wide_percentiles(x.join(c, "grp").select("grp", dot(F.col("u"), F.col("centroid")).alias("s")), ["grp"], {"p": ("s", q)})
    return Ensemble(c.join(r, "grp").select("grp", "centroid", F.greatest("p", F.lit(least_radius)).alias("radius")))


def score(rows: DataFrame, model: Ensemble, vec: str = "vec", max_experts: int = 10_000) -> DataFrame:
    """rows with ``score`` = 1 - the greatest cosine to a centroid, and ``benign``: some cosine reaches its expert's radius.

    The experts, of a checked number, go along with the function; a batch of rows is one matrix product.  Null vectors have a null
    score and are not benign.
    """
    experts = [(r.centroid, r.radius) for r in model.experts.orderBy("grp").limit(max_experts + 1).collect()]
    if len(experts) > max_experts:
        raise ValueError(f"more than {max_experts} experts")
    if not experts:
        return rows.withColumns({"score": F.lit(1.0), "benign": F.lit(False)})
    centroids, radii = np.array([c for c, _ in experts]), np.array([r for _, r in experts])

    @F.pandas_udf("score double, benign boolean")
    def rate(vecs: pd.Series) -> pd.DataFrame:
        best, inside = np.full(len(vecs), np.nan), np.zeros(len(vecs), bool)
        there = np.flatnonzero(vecs.notna().to_numpy())
        for at in np.array_split(there, max(1, len(there) * len(radii) // CELLS)):
            if len(at):
                x = np.stack(vecs.iloc[at].to_numpy())
                cos = x @ centroids.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                best[at], inside[at] = 1 - cos.max(1), (cos >= radii).any(1)
        return pd.DataFrame({"score": best, "benign": inside})

    x = rows.withColumn("_r", rate(F.col(vec)))
    return x.select(*rows.columns, F.when(~F.isnan("_r.score"), F.col("_r.score")).alias("score"), F.col("_r.benign").alias("benign"))


def operating_point(scores: DataFrame, q: float = 0.95) -> DataFrame:
    """threshold: the q-quantile of pooled training scores."""
    return percentiles(scores, [], "score", (q,)).agg(F.max("value").alias("threshold"))


def mahalanobis(train: DataFrame, rows: DataFrame, vec: str = "vec", shrink: float = 1e-3) -> DataFrame:
    """rows with ``distance``: squared Mahalanobis distance to the training rows' mean under their covariance, shrunk to its diagonal.

    Means and the d x d moments are summed in tasks; only those (their size is that of the vectors) come to the driver.
    """
    x = train.select(F.col(vec).alias("v"))

    def moments(batches):
        n, s, g = 0, None, None
        for b in batches:
            a = np.array([v for v in b.column(0).to_pylist() if v is not None], float)
            if len(a):
                n, s, g = n + len(a), a.sum(0) if s is None else s + a.sum(0), a.T @ a if g is None else g + a.T @ a
        if n:
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([g.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s", "g"])

    parts = cut(x.mapInArrow(moments, "n bigint, s array<double>, g array<double>"), "moments")  # one row a task
    total = parts.select("n", F.posexplode(F.concat("s", "g")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    n = parts.agg(F.sum("n")).first()[0]
    if not n:
        return rows.withColumn("distance", F.lit(None).cast("double"))
    flat = np.array([r.v for r in total])
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean = flat[:d] / n
    cov = flat[d:].reshape(d, d) / n - np.outer(mean, mean)
    cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-9 * np.eye(d)
    half = np.linalg.cholesky(np.linalg.inv(cov))  # distance = |(x - mean) half|^2

    @F.pandas_udf("double")
    def far(vecs: pd.Series) -> pd.Series:
        out, there = np.full(len(vecs), np.nan), np.flatnonzero(vecs.notna().to_numpy())
        if len(there):
            out[there] = (((np.stack(vecs.iloc[there].to_numpy()) - mean) @ half) ** 2).sum(1)
        return pd.Series(out)

    return rows.withColumn("_d", far(F.col(vec))).select(*rows.columns, F.when(~F.isnan("_d"), F.col("_d")).alias("distance"))

"""The whole way from graphs to alerts and metrics, and its command line.

    python -m provspark.pipeline --nodes N --edges E --out O [--train g1,g2] [--operator template] ...

Nodes and edges are Parquet tables in the form of ``sources.views.Graph``.  Defaults are those of the published node-level and
alert-level runs.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.tables import cut
from .operators import alerts, detect, features, graph, match, metrics, mine, reduce
from .sources.files import write_summary
from .sources.lines import parse_gids
from .sources.views import Graph, kept

OPERATORS = ("identity", "edge_dedup", "node_merge", "template")


@dataclass(frozen=True)
class Options:
    """Parameters of a run; ``train``: graphs that are known to be benign ('' = the first share of the benign ones), as names or, where all are numbers, as ranges."""

    operator: str = "identity"
    encoding: str = "rate"
    train: str = ""
    train_frac: float = 0.7
    dim: int = 8
    base: float = 10_000.0
    scale: bool = False
    min_support: int = 5
    coverage: float = 1.0
    max_templates: int = 80
    max_nodes: int = 48
    quota: int = 300
    context_k: int = 0
    share_k: int = 2
    min_absorb: int = 2
    max_instances: int = 200
    max_total: int = 1000
    percentile: float = 0.95
    top_k: int = 100
    bfs_q: float = 0.75
    min_cluster: int = 3
    max_cluster: int = 200
    max_alerts: int = 20
    seed: int = 0


@dataclass(frozen=True)
class Result:
    """templates; reduced (graph and maps); scores (gid, nid, npos, score, y, benign, over: above the operating point); alerts; and metrics by graph: of alerts, and of originals."""

    templates: list[match.Template]
    reduced: reduce.Reduced
    scores: DataFrame
    alerts: DataFrame
    alert_metrics: DataFrame
    orig_metrics: DataFrame
    node_metrics: DataFrame


def training_graphs(g: Graph, o: Options) -> list[str]:
    """Names of the training graphs; one entry a graph."""
    named = g.nodes.groupBy("gid").agg((F.max(F.coalesce("label", F.lit(0))) == 1).alias("attack"))
    if o.train:
        listed = [x.strip() for x in o.train.split(",")]
        return [str(x) for x in parse_gids(o.train)] if all(x.replace("-", "").isdigit() for x in listed) else listed
    return [r.gid for r in graph.benign_split(named, o.train_frac, o.seed).where("part = 'train'").select("gid").collect()]


def run(g: Graph, options: Options | None = None) -> Result:
    """Templates from the training graphs, reduction, features, detector, scores of all other graphs, alerts and metrics."""
    o = options or Options()
    if o.operator not in OPERATORS:
        raise ValueError(f"operator: {o.operator}")
    g = kept(g)
    train = F.col("gid").isin(training_graphs(g, o))
    templates: list[match.Template] = []
    if o.operator == "template":
        benign = kept(Graph(g.nodes.where(train), g.edges.where(train)))
        found = mine.mine(benign, [r.ntype for r in graph.semantic_types(benign).collect()], o.min_support, o.max_templates, o.max_nodes, quota=o.quota, seed=o.seed, context_k=o.context_k)
        total, upto, best = sum(t.support for t in found), 0, set()
        for i in sorted(range(len(found)), key=lambda i: (-found[i].support, i)):
            if upto < o.coverage * total:
                best.add(i)
            upto += found[i].support
        templates = [t for i, t in enumerate(found) if i in best]
    if o.operator == "edge_dedup":
        r = reduce.edge_dedup(g)
    elif o.operator == "node_merge":
        r = reduce.node_merge(g)
    elif templates:
        r = reduce.collapse(g, match.find_regions(g, templates, o.share_k, o.min_absorb, o.max_instances, o.max_total))
    else:
        r = reduce.identity(g)
    r = reduce.Reduced(kept(r.graph), r.node_map, r.edge_map)
    x = cut(features.features(r.graph, o.encoding, scale=o.scale, dim=o.dim, base=o.base), "features")
    model = detect.fit(x.where(train), group="gid")
    rated = cut(detect.score(x, model).select("gid", "nid", "npos", F.coalesce("label", F.lit(0)).alias("y"), "score", "benign"), "scores")
    limit = detect.operating_point(rated.where(train), o.percentile).first()
    over = F.lit(None).cast("boolean") if limit is None or limit.threshold is None else F.col("score") > limit.threshold
    tested = rated.where(~train).withColumn("over", over)
    e = r.graph.edges.where(~train)
    found = cut(alerts.clusters(tested, e, o.top_k, o.bfs_q, o.min_cluster, o.max_cluster, o.max_alerts, seed=o.seed), "alerts")
    node = metrics.confusion(tested.withColumn("pred", (~F.col("benign")).cast("int")), ("gid",))
    return Result(templates, r, tested, found, alerts.alert_metrics(found, tested, o.top_k), alerts.orig_metrics(found, g.nodes.where(~train), r.node_map), node)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(prog="provspark.pipeline", description="graphs to alerts and metrics")
    for name in ("nodes", "edges", "out"):
        p.add_argument(f"--{name}", required=True)
    for f in fields(Options):
        kind = type(f.default)
        p.add_argument(f"--{f.name}", default=f.default, **({"action": "store_true"} if kind is bool else {"type": kind}))
    a = vars(p.parse_args(argv))
    spark = SparkSession.builder.getOrCreate()
    out = a.pop("out").rstrip("/")
    r = run(Graph(spark.read.parquet(a.pop("nodes")), spark.read.parquet(a.pop("edges"))), Options(**a))
    for name in ("scores", "alerts"):
        getattr(r, name).write.mode("overwrite").parquet(f"{out}/{name}")
    for name in ("alert_metrics", "orig_metrics", "node_metrics"):
        write_summary(getattr(r, name), f"{out}/{name}")


if __name__ == "__main__":
    main()

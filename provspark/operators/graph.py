"""Statistics, splits, filters and neighbourhoods of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.views import Graph
from .order import numbered

#: Parts of the names of subject types, and the types whose neighbours count as processes.
SUBJECT_WORDS = ("process", "subject", "unit", "proc", "principal", "task")
PROCESS_TYPES = ("process", "subject")


def graph_stats(g: Graph) -> DataFrame:
    """gid, n_nodes, n_edges, total_mu, n_labels."""
    n = g.nodes.groupBy("gid").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.coalesce("label", F.lit(0))).alias("n_labels"))
    e = g.edges.groupBy("gid").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("mu").alias("total_mu"))
    return n.join(e, "gid", "full").select("gid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_nodes", "n_edges", "n_labels")], F.coalesce("total_mu", F.lit(0.0)).alias("total_mu"))


def type_histogram(g: Graph) -> DataFrame:
    return g.nodes.groupBy("gid", "ntype").agg(F.count(F.lit(1)).alias("n"))


def etype_histogram(g: Graph) -> DataFrame:
    return g.edges.groupBy("gid", "etype").agg(F.count(F.lit(1)).alias("n"), F.sum("mu").alias("mu"))


def _ends(edges: DataFrame, *cols: str) -> DataFrame:
    return edges.select("gid", F.explode(F.array(F.struct(F.col("src").alias("nid"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("nid"), F.lit(0).alias("out")))).alias("x"), *cols).select("gid", "x.nid", "x.out", *cols)


def degrees(g: Graph) -> DataFrame:
    """gid, nid, cnt_in, cnt_out, mu_in, mu_out; nodes without edges have zeros, endpoints without a node row appear too."""
    one = lambda side, c: F.sum(F.when(F.col("out") == side, c).otherwise(F.lit(0)))
    d = _ends(g.edges, "mu").groupBy("gid", "nid").agg(one(0, F.lit(1)).alias("cnt_in"), one(1, F.lit(1)).alias("cnt_out"), one(0, F.col("mu")).alias("mu_in"), one(1, F.col("mu")).alias("mu_out"))
    cols = {"cnt_in": "bigint", "cnt_out": "bigint", "mu_in": "double", "mu_out": "double"}
    return g.nodes.select("gid", "nid").join(d, ["gid", "nid"], "full").select("gid", "nid", *[F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c) for c, t in cols.items()])


def drop_nodes(g: Graph, gone: DataFrame) -> Graph:
    """Without the nodes ``gone`` (gid, nid) and their edges."""
    x = gone.select("gid", "nid").distinct()
    e = g.edges.join(x.withColumnRenamed("nid", "src"), ["gid", "src"], "left_anti").join(x.withColumnRenamed("nid", "dst"), ["gid", "dst"], "left_anti")
    return Graph(g.nodes.join(x, ["gid", "nid"], "left_anti"), e.select(g.edges.columns))


def drop_dangling(g: Graph) -> Graph:
    """Without edges that have an endpoint outside the node list."""
    x = g.nodes.select("gid", "nid").distinct()
    e = g.edges.join(x.withColumnRenamed("nid", "src"), ["gid", "src"], "left_semi").join(x.withColumnRenamed("nid", "dst"), ["gid", "dst"], "left_semi")
    return Graph(g.nodes, e.select(g.edges.columns))


def filter_edges(edges: DataFrame, ts_window: tuple[int, int] | None = None, hosts: list[str] | None = None, max_records: int | None = None) -> DataFrame:
    """Inclusive time window; known hosts only (an unknown or blank host passes); the first records by eidx."""
    if ts_window:
        edges = edges.where(F.col("ts").between(*ts_window))
    if hosts is not None:
        edges = edges.where(F.col("host").isNull() | (F.col("host") == "") | F.col("host").isin(hosts))
    if max_records is not None:
        edges = edges.where(F.col("eidx") < max_records)
    return edges


def time_split(g: Graph, train_frac: float = 0.7) -> DataFrame:
    """edges with ``part``: ``train`` for the first int(n * frac) of each graph by (ts, eidx), ``test`` for the others."""
    n = g.edges.groupBy("gid").agg(F.floor(F.count(F.lit(1)) * F.lit(train_frac) + 1e-9).alias("_cut"))
    e = numbered(g.edges, ["ts", "eidx"], ["gid"])
    return e.join(n, "gid").select(g.edges.columns + [F.when(F.col("rn") <= F.col("_cut"), "train").otherwise("test").alias("part")])


def windows_by_time(edges: DataFrame, n: int = 8) -> DataFrame:
    """``win`` 0..n-1 of equal width between the first and last time of each graph, the last one closed; unknown times (0) in none."""
    e = edges.where("ts <> 0")
    span = e.groupBy("gid").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    width = F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo")) / n)
    return e.join(span, "gid").withColumn("win", F.least(F.lit(n - 1), F.floor((F.col("ts") - F.col("_lo")) / width)).cast("int")).drop("_lo", "_hi")


def windows_by_count(edges: DataFrame, n: int = 8) -> DataFrame:
    """``win`` of equal counts by (ts, eidx); what is beyond n equal parts is left out."""
    per = edges.groupBy("gid").agg(F.expr(f"greatest(1, count(1) div {n})").alias("_per"))
    e = numbered(edges, ["ts", "eidx"], ["gid"]).join(per, "gid")
    return e.withColumn("win", F.expr("(rn - 1) div _per").cast("int")).where(F.col("win") < n).select(*edges.columns, "win")


def window_span(edges: DataFrame) -> DataFrame:
    """gid, n_edges, ts_lo, ts_hi, hours, events_per_s over known times."""
    a = edges.groupBy("gid").agg(F.count(F.lit(1)).alias("n_edges"), F.min(F.when(F.col("ts") != 0, F.col("ts"))).alias("ts_lo"), F.max("ts").alias("ts_hi"))
    s = (F.col("ts_hi") - F.col("ts_lo")) / 1e9
    return a.select("*", F.round(s / 3600, 6).alias("hours"), F.round(F.col("n_edges") / F.nullif(s, F.lit(0.0)), 6).alias("events_per_s"))


def undirected(edges: DataFrame) -> DataFrame:
    """gid, a, b: both directions of each edge once, without self-loops."""
    return edges.where("src <> dst").select("gid", F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x")).select("gid", "x.a", "x.b").distinct()


def khop(g: Graph, anchors: DataFrame, k: int = 2) -> DataFrame:
    """gid, anchor, nid, hop: nodes within k undirected hops of each anchor (gid, anchor), with the least number of hops."""
    u = undirected(g.edges)
    reach = anchors.select("gid", "anchor", F.col("anchor").alias("nid"), F.lit(0).alias("hop")).distinct()
    front = reach
    for i in range(1, k + 1):
        step = front.select("gid", "anchor", F.col("nid").alias("a")).join(u, ["gid", "a"]).select("gid", "anchor", F.col("b").alias("nid")).distinct()
        front = step.join(reach.select("gid", "anchor", "nid"), ["gid", "anchor", "nid"], "left_anti").withColumn("hop", F.lit(i))
        reach = reach.unionByName(front)
    return reach


def induced_edges(g: Graph, members: DataFrame) -> DataFrame:
    """gid, anchor and edge columns: edges with both ends among an anchor's members, with multiplicity."""
    m = members.select("gid", "anchor", "nid").distinct()
    return g.edges.join(m.withColumnRenamed("nid", "src"), ["gid", "src"]).join(m.withColumnRenamed("nid", "dst"), ["gid", "anchor", "dst"]).select("anchor", *g.edges.columns)


def _is_subject():
    return F.lower("ntype").rlike("|".join(SUBJECT_WORDS))


def process_refs(g: Graph, subjects: bool = False) -> DataFrame:
    """gid, nid, proc: one row for each edge between a process and a node, in either direction.  With ``subjects`` all nodes of a type named like a subject are processes."""
    act = g.nodes.where(_is_subject() if subjects else F.lower("ntype").isin(*PROCESS_TYPES)).select("gid", "nid")
    a = g.edges.join(act.withColumnRenamed("nid", "src"), ["gid", "src"], "left_semi").select("gid", F.col("dst").alias("nid"), F.col("src").alias("proc"))
    b = g.edges.join(act.withColumnRenamed("nid", "dst"), ["gid", "dst"], "left_semi").select("gid", F.col("src").alias("nid"), F.col("dst").alias("proc"))
    return a.unionByName(b)


def shared_objects(g: Graph, k: int = 2) -> DataFrame:
    """gid, nid of nodes next to at least k different processes (k < 0: none)."""
    r = process_refs(g)
    return (r if k >= 0 else r.limit(0)).distinct().groupBy("gid", "nid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("gid", "nid")


def context_nodes(g: Graph, k: int = 2) -> DataFrame:
    """gid, nid of nodes with at least k edges to subjects."""
    return process_refs(g, subjects=True).groupBy("gid", "nid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("gid", "nid")


def semantic_types(g: Graph, rare: float = 0.02, least: int = 4) -> DataFrame:
    """ntype, n: types named like a subject; if there is none, rare types of at least ``least`` nodes."""
    h = g.nodes.groupBy("ntype").agg(F.count(F.lit(1)).alias("n"))  # one row a type
    named = _is_subject()
    w = W.partitionBy()
    h = h.select("ntype", "n", named.alias("named"), F.max(named.cast("int")).over(w).alias("any"), F.sum("n").over(w).alias("total"))
    return h.where((F.col("named")) | ((F.col("any") == 0) & (F.col("n") <= rare * F.col("total")) & (F.col("n") >= least))).select("ntype", "n")


def last_neighbours(edges: DataFrame, n: int = 10) -> DataFrame:
    """gid, nid, nbr, eidx, rank: the last n neighbours of each node by event, both directions; hubs are thinned in parts first."""
    from .order import smallest

    e = edges.select("gid", F.explode(F.array(F.struct(F.col("src").alias("nid"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("nid"), F.col("src").alias("nbr")))).alias("x"), "eidx").select("gid", "x.nid", "x.nbr", "eidx", (-F.col("eidx") * 2 - (F.col("x.nid") == F.col("x.nbr")).cast("int")).alias("_o"))
    e = e.distinct()  # a self-loop is one neighbour
    return smallest(e, ["gid", "nid"], "_o", n).withColumn("rank", F.row_number().over(W.partitionBy("gid", "nid").orderBy("_o"))).drop("_o")


def last_update(edges: DataFrame) -> DataFrame:
    """gid, nid, last_ts, n, last_etype: time, number of events and type of the last event of each node."""
    e = _ends(edges, "ts", "eidx", "etype")
    return e.groupBy("gid", "nid").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.max_by("etype", F.struct("ts", "eidx")).alias("last_etype"))


def benign_split(graphs: DataFrame, train_frac: float = 0.7, seed: int = 0) -> DataFrame:
    """gid, attack, part: benign graphs in seeded hash order, the first share of them for training; attack graphs are tested."""
    w = W.partitionBy("attack").orderBy(F.xxhash64(F.lit(seed), "gid"), "gid")
    n = F.count(F.lit(1)).over(W.partitionBy("attack"))
    return graphs.select("gid", "attack").withColumn("part", F.when(F.col("attack"), "test").when(F.row_number().over(w) <= F.floor(n * F.lit(train_frac)), "train").otherwise("test"))


def process_profile(g: Graph, k: int = 2) -> DataFrame:
    """gid, proc, n_edges, n_objects, n_private: of each process its edges, the different nodes beside it, and those that fewer than k processes touch."""
    r = process_refs(g)
    pairs = r.groupBy("gid", "nid", "proc").agg(F.count(F.lit(1)).alias("e"))
    users = pairs.groupBy("gid", "nid").agg(F.count(F.lit(1)).alias("users"))
    x = pairs.join(users, ["gid", "nid"])
    return x.groupBy("gid", "proc").agg(F.sum("e").alias("n_edges"), F.count(F.lit(1)).alias("n_objects"), F.sum((F.col("users") < k).cast("bigint")).alias("n_private"))


def egonet_profile(g: Graph, k: int = 2) -> DataFrame:
    """gid, proc, ntype, d, n, n_private: of each process, by direction and type, its different neighbours and those that fewer than k processes touch."""
    r = process_refs(g).distinct()
    users = r.groupBy("gid", "nid").agg(F.count(F.lit(1)).alias("users"))
    e = g.edges.select("gid", F.explode(F.array(F.struct(F.col("src").alias("proc"), F.lit("o").alias("d"), F.col("dst").alias("nid")), F.struct(F.col("dst").alias("proc"), F.lit("i").alias("d"), F.col("src").alias("nid")))).alias("x")).select("gid", "x.*").where("proc <> nid").distinct()
    e = e.join(r, ["gid", "nid", "proc"], "left_semi").join(users, ["gid", "nid"]).join(g.nodes.select("gid", "nid", "ntype"), ["gid", "nid"])
    own = g.nodes.where(F.lower("ntype").isin(*PROCESS_TYPES)).select("gid", F.col("nid").alias("proc"))
    return e.join(own, ["gid", "proc"], "left_semi").groupBy("gid", "proc", "ntype", "d").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("users") < k).cast("bigint")).alias("n_private"))


def missing(listed: DataFrame, found: DataFrame) -> DataFrame:
    """gid, nid: what is listed and not found, once each."""
    return listed.select("gid", "nid").distinct().join(found.select("gid", "nid"), ["gid", "nid"], "left_anti")

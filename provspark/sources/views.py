"""Graph views over stored tables.

A graph is a pair of frames: nodes (gid, nid, npos, ntype, label) and edges (gid, eidx, src, dst, etype, ts, mu); ``npos`` and
``eidx`` carry the order that ties are broken by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import etype_form, node_key, type_form
from ..functions.tables import cut, table
from ..operators.order import numbered

#: Places of nodes without a row of their own, behind all that have one.
ENDPOINT_POS = 10**12


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def ground_truth(gt: DataFrame) -> DataFrame:
    """nid (lower case, no blanks), attributes of the labelled nodes; one row a node."""
    return gt.select(node_key("uuid").alias("nid"), "attributes", "index_id").where("nid IS NOT NULL AND nid <> ''").groupBy("nid").agg(F.min_by("attributes", "index_id").alias("attributes"))


def label_nodes(nodes: DataFrame, gt: DataFrame) -> DataFrame:
    """``label`` 1 for nodes in the ground truth, else 0."""
    hit = gt.select(F.col("nid").alias("_gt")).distinct()
    return nodes.join(hit, nodes.nid == hit["_gt"], "left").withColumn("label", F.col("_gt").isNotNull().cast("int")).drop("_gt")


def canonical(edges: DataFrame, nodes: DataFrame, gt: DataFrame) -> Graph:
    """The canonical graph: events once each, nodes with their first usable type (placeholders upgraded), endpoints without a row as ``unknown``."""
    e = edges.select("gid", "eidx", node_key("src").alias("src"), node_key("dst").alias("dst"), etype_form("etype").alias("etype"), F.coalesce("ts", F.lit(0)).cast("bigint").alias("ts"), F.coalesce("mu", F.lit(1.0)).cast("double").alias("mu"))
    e = e.where("gid IS NOT NULL AND eidx IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").groupBy("gid", "eidx", "src", "dst", "etype").agg(F.min("ts").alias("ts"), F.min("mu").alias("mu"))
    d = nodes.select("gid", node_key("nid").alias("nid"), F.coalesce("npos", F.lit(ENDPOINT_POS - 1)).alias("npos"), type_form("type").alias("t")).where("gid IS NOT NULL AND nid IS NOT NULL")
    good = F.col("t").isNotNull() & ~F.col("t").isin("", "object")
    d = d.groupBy("gid", "nid").agg(F.min("npos").alias("npos"), F.min(F.when(good, F.struct("npos", "t"))).alias("x")).select("gid", "nid", "npos", F.coalesce("x.t", F.lit("object")).alias("ntype"))
    ends = e.select("gid", F.explode(F.array(F.struct(F.col("src").alias("nid"), (F.col("eidx") * 2 + ENDPOINT_POS).alias("pos")), F.struct(F.col("dst").alias("nid"), (F.col("eidx") * 2 + ENDPOINT_POS + 1).alias("pos")))).alias("x"))
    ends = ends.groupBy("gid", "x.nid").agg(F.min("x.pos").alias("pos"))
    n = d.join(ends, ["gid", "nid"], "full").select("gid", "nid", F.coalesce("npos", "pos").alias("npos"), F.coalesce("ntype", F.lit("unknown")).alias("ntype"))
    return Graph(label_nodes(n, ground_truth(gt)), e)


def prov(spark: SparkSession, d: str) -> Graph:
    return canonical(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "gt_nodes"))


def kept(g: Graph) -> Graph:
    """The graph written once, for operators that read it many times."""
    return Graph(cut(g.nodes, "nodes"), cut(g.edges, "edges"))


def g_events(spark: SparkSession, d: str) -> Graph:
    """One graph a day: user -> key events; users are processes, keys files, sockets, dirs and pipes by number."""
    t = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    e = t.select(F.date_format("ts", "yyyy-MM-dd").alias("gid"), F.col("event_id").alias("eidx"), F.concat(F.lit("u"), "user_id").alias("src"), F.concat(F.lit("k"), k).alias("dst"), F.col("event_type").alias("etype"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"), F.lit(1.0).alias("mu"))
    ends = e.select("gid", "eidx", F.explode(F.array("src", "dst")).alias("nid")).groupBy("gid", "nid").agg(F.min("eidx").alias("first"))
    num = F.substring("nid", 2, 20).cast("bigint")
    kinds = F.when(F.col("nid").startswith("u"), "process").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("file", "socket", "dir", "pipe")]), (num % 4 + 1).cast("int")))
    n = ends.select("gid", "nid", (F.col("first") * 2 + F.col("nid").startswith("k").cast("int")).alias("npos"), kinds.alias("ntype"), F.when(F.col("nid").startswith("u") & (num % 29 == 0), 1).otherwise(0).alias("label"))
    return Graph(n, e)


def g_supply(spark: SparkSession, d: str) -> Graph:
    """One graph of supplier -> part, heavy multi-edges."""
    t = table(spark, d, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    t = numbered(t.select(*order, "l_returnflag"), order)
    e = t.select(F.lit("supply").alias("gid"), (F.col("rn") - 1).cast("bigint").alias("eidx"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("etype"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts"), F.lit(1.0).alias("mu"))
    s = table(spark, d, "supplier").select(F.lit("supply").alias("gid"), F.concat(F.lit("s"), "s_suppkey").alias("nid"), (F.col("s_suppkey") * 2).cast("bigint").alias("npos"), F.lit("process").alias("ntype"), (F.col("s_acctbal") < 0).cast("int").alias("label"))
    p = table(spark, d, "part").select(F.lit("supply").alias("gid"), F.concat(F.lit("p"), "p_partkey").alias("nid"), (F.col("p_partkey") * 2 + 1).cast("bigint").alias("npos"), F.lower("p_type").alias("ntype"), F.lit(0).alias("label"))
    return Graph(s.unionByName(p), e)


def g_geo(spark: SparkSession, d: str) -> Graph:
    """Customers and suppliers -> nations -> regions: many nodes with one neighbourhood."""
    c, s, n, r = (table(spark, d, x) for x in ("customer", "supplier", "nation", "region"))
    g = F.lit("geo").alias("gid")
    lives = c.select(g, (F.col("c_custkey") * 3).cast("bigint").alias("eidx"), F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("lives").alias("etype"))
    based = s.select(g, (F.col("s_suppkey") * 3 + 1).cast("bigint").alias("eidx"), F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("based").alias("etype"))
    within = n.select(g, (F.col("n_nationkey") * 3 + 2).cast("bigint").alias("eidx"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in").alias("etype"))
    e = lives.unionByName(based).unionByName(within).select("*", F.lit(0).cast("bigint").alias("ts"), F.lit(1.0).alias("mu"))
    node = lambda t, key, letter, ntype, place: t.select(g, F.concat(F.lit(letter), key).alias("nid"), (F.col(key) * 4 + place).cast("bigint").alias("npos"), ntype.alias("ntype"), F.lit(0).alias("label"))
    nodes = node(c, "c_custkey", "c", F.col("c_mktsegment"), 0).unionByName(node(s, "s_suppkey", "s", F.lit("supplier"), 1)).unionByName(node(n, "n_nationkey", "n", F.lit("nation"), 2)).unionByName(node(r, "r_regionkey", "r", F.lit("region"), 3))
    return Graph(nodes, e)


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, grp, vec (array of double)."""
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("vec"))

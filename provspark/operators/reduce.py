"""Graph reduction with lineage: identity, duplicate-edge merging, same-neighbourhood merging, template collapse, and the checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import cut
from ..sources.views import Graph
from .graph import degrees
from .order import numbered
from .skew import wide_percentiles

SUMMARY = "__summary__"


@dataclass(frozen=True)
class Reduced:
    """graph; node_map (gid, nid, new_nid), total and many to one; edge_map (gid, new_eidx, eidx), one row an original edge."""

    graph: Graph
    node_map: DataFrame
    edge_map: DataFrame


def identity(g: Graph) -> Reduced:
    return Reduced(g, g.nodes.select("gid", "nid", F.col("nid").alias("new_nid")), g.edges.select("gid", F.col("eidx").alias("new_eidx"), "eidx"))


def _renumber(edges: DataFrame, first: str = "first") -> DataFrame:
    """new eidx of each edge by its first original edge."""
    return numbered(edges, [first], ["gid"]).withColumn("new_eidx", (F.col("rn") - 1).cast("bigint")).drop("rn")


def edge_dedup(g: Graph, mass: str = "count") -> Reduced:
    """Edges of one (src, dst, etype) become one: earliest time, mu = number of rows, or the sum of their mu with mass='sum' (for chains of reductions)."""
    if mass not in ("count", "sum"):
        raise ValueError(f"mass: {mass}")
    key = ["gid", "src", "dst", "etype"]
    m = F.count(F.lit(1)).cast("double") if mass == "count" else F.sum("mu")
    merged = cut(_renumber(g.edges.groupBy(*key).agg(F.min("ts").alias("ts"), m.alias("mu"), F.min("eidx").alias("first"))), "dedup")
    e = merged.select("gid", F.col("new_eidx").alias("eidx"), "src", "dst", "etype", "ts", "mu")
    rho = g.edges.select(*key, "eidx").join(merged.select(*key, "new_eidx"), key).select("gid", "new_eidx", "eidx")
    return Reduced(Graph(g.nodes, e), g.nodes.select("gid", "nid", F.col("nid").alias("new_nid")), rho)


def _multiset(*cols: str) -> list:
    """Fingerprint of a multiset of rows: count and sums of two hashes, in halves that don't overflow; combined map-side, so a hub's neighbours are never gathered."""
    out = []
    for i, seed in enumerate((11, 23)):
        h = F.xxhash64(F.lit(seed), *cols)
        out += [F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"h{i}a"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"h{i}b")]
    return [F.count(F.lit(1)).alias("n"), *out]


def node_signatures(g: Graph) -> DataFrame:
    """gid, nid, sig: equal for nodes with one type and the same multisets of (neighbour, etype) on either side; nodes without edges are left out."""
    x = F.array(F.struct(F.col("src").alias("nid"), F.lit("o").alias("side"), F.col("dst").alias("nb")), F.struct(F.col("dst").alias("nid"), F.lit("i").alias("side"), F.col("src").alias("nb")))
    s = g.edges.select("gid", "etype", F.explode(x).alias("x")).select("gid", "x.nid", "x.side", "x.nb", "etype")
    s = s.groupBy("gid", "nid").agg(*_multiset("side", "nb", "etype"))
    return g.nodes.join(s, ["gid", "nid"]).select("gid", "nid", "npos", "ntype", "label", F.concat_ws("|", "ntype", "n", "h0a", "h0b", "h1a", "h1b").alias("sig"))


def node_merge(g: Graph, min_group: int = 2) -> Reduced:
    """Nodes of one signature become a super-node nm_k; edges between unmerged nodes stay as they are, others are grouped by (src, dst, etype) with the first edge's time and mu = count."""
    sig = cut(node_signatures(g), "signatures")
    groups = sig.groupBy("gid", "sig").agg(F.count(F.lit(1)).alias("size"), F.min("npos").alias("first"), F.max("label").alias("label"), F.min("ntype").alias("ntype")).where(F.col("size") >= min_group)
    groups = cut(numbered(groups, ["first"], ["gid"]).withColumn("new_nid", F.concat(F.lit("nm_"), F.col("rn") - 1)), "groups")
    pi = g.nodes.select("gid", "nid").join(sig.join(groups.select("gid", "sig", "new_nid"), ["gid", "sig"]).select("gid", "nid", "new_nid"), ["gid", "nid"], "left")
    pi = cut(pi.select("gid", "nid", F.coalesce("new_nid", "nid").alias("new_nid"), F.col("new_nid").isNotNull().alias("merged")), "node_map")
    kept = g.nodes.join(pi.where("NOT merged"), ["gid", "nid"], "left_semi").select("gid", "nid", "npos", "ntype", "label")
    sup = groups.select("gid", F.col("new_nid").alias("nid"), (F.col("rn") + F.lit(2**50)).alias("npos"), "ntype", "label")
    m = pi.select("gid", F.col("nid").alias("k"), "new_nid", "merged")
    e = g.edges.join(m.withColumnsRenamed({"k": "src", "new_nid": "ns", "merged": "ms"}), ["gid", "src"], "left").join(m.withColumnsRenamed({"k": "dst", "new_nid": "nd", "merged": "md"}), ["gid", "dst"], "left")
    e = e.select("gid", "eidx", F.coalesce("ns", "src").alias("src"), F.coalesce("nd", "dst").alias("dst"), "etype", "ts", "mu", (F.coalesce("ms", F.lit(False)) | F.coalesce("md", F.lit(False))).alias("touched"))
    alone = F.when(~F.col("touched"), F.col("eidx"))
    key = ["gid", "src", "dst", "etype"]
    merged = e.groupBy(*key, alone.alias("alone")).agg(F.min(F.struct("eidx", "ts")).alias("f"), F.when(F.col("alone").isNull(), F.count(F.lit(1)).cast("double")).otherwise(F.max("mu")).alias("mu"))
    merged = cut(_renumber(merged.select(*key, "alone", F.col("f.eidx").alias("first"), F.col("f.ts").alias("ts"), "mu")), "merged")
    o = e.withColumn("alone", alone)
    on = [o.gid == merged.gid, o.src == merged.src, o.dst == merged.dst, o.etype == merged.etype, o.alone.eqNullSafe(merged.alone)]
    rho = o.join(merged, on).select(o.gid, "new_eidx", o.eidx)
    return Reduced(Graph(kept.unionByName(sup), merged.select("gid", F.col("new_eidx").alias("eidx"), "src", "dst", "etype", "ts", "mu")), pi.select("gid", "nid", "new_nid"), rho)


def collapse(g: Graph, regions: DataFrame, summary_etype: str = SUMMARY) -> Reduced:
    """Template collapse.  ``regions``: gid, ridx, tpl_id, anchor_type, absorb (array of nids), disjoint within a graph.

    Absorbed nodes go; a region gets an entry regionM{r} if it has edges in or inside, an exit regionN{r} if it has edges out or
    inside; inner edges become one summary edge M -> N whose mu is their number; all other edges get mu 1, rewired or not.  A member
    with an edge to a node that no region absorbs maps to the exit, others to the entry.  M and N are labelled if a member is.
    A region without edges stays as it is.
    """
    a = regions.select("gid", "ridx", "anchor_type", F.explode("absorb").alias("nid"))
    m = a.select("gid", F.col("nid").alias("k"), F.col("ridx").alias("r"))
    e = g.edges.join(m.withColumnsRenamed({"k": "src", "r": "rs"}), ["gid", "src"], "left").join(m.withColumnsRenamed({"k": "dst", "r": "rt"}), ["gid", "dst"], "left")
    e = cut(e.select("gid", "eidx", "src", "dst", "etype", "ts", "mu", "rs", "rt", F.coalesce(F.col("rs") == F.col("rt"), F.lit(False)).alias("inner")), "rewired")
    use = e.select("gid", F.explode(F.array(F.struct(F.col("rs").alias("r"), F.lit(True).alias("out")), F.struct(F.col("rt").alias("r"), F.lit(False).alias("out")))).alias("x"), "inner").where("x.r IS NOT NULL")
    role = use.groupBy("gid", F.col("x.r").alias("ridx")).agg(F.max(F.col("inner") | ~F.col("x.out")).alias("need_m"), F.max(F.col("inner") | F.col("x.out")).alias("need_n"))
    name = lambda letter: F.concat(F.lit(f"region{letter}"), F.col("ridx"))
    lab = a.join(g.nodes.select("gid", "nid", "label"), ["gid", "nid"], "left").groupBy("gid", "ridx").agg(F.max(F.coalesce("label", F.lit(0))).alias("label"), F.min("anchor_type").alias("anchor_type"))
    role = cut(role.join(lab, ["gid", "ridx"]), "roles")
    far = e.where("rs IS NOT NULL AND rt IS NULL").select("gid", F.col("src").alias("nid")).distinct().withColumn("goes_out", F.lit(True))
    am = a.select("gid", "nid", "ridx").join(role, ["gid", "ridx"], "left").join(far, ["gid", "nid"], "left")
    mm, nn = F.when(F.col("need_m"), name("M")), F.when(F.col("need_n"), name("N"))
    am = am.select("gid", "nid", F.when(F.coalesce("goes_out", F.lit(False)), F.coalesce(nn, mm)).otherwise(F.coalesce(mm, nn)).alias("to"))
    pi = g.nodes.select("gid", "nid").join(am, ["gid", "nid"], "left").select("gid", "nid", F.coalesce("to", "nid").alias("new_nid"))
    pi = cut(pi, "node_map")
    kept = g.nodes.join(pi.where("nid <> new_nid"), ["gid", "nid"], "left_anti").select("gid", "nid", "npos", "ntype", "label")
    fresh = lambda letter, need, ntype, add: role.where(need).select("gid", name(letter).alias("nid"), (F.col("ridx") * 2 + F.lit(2**50 + add)).alias("npos"), ntype.alias("ntype"), "label")
    nodes = kept.unionByName(fresh("M", "need_m", F.col("anchor_type"), 0)).unionByName(fresh("N", "need_n", F.lit("summary_node"), 1))
    outer = e.where("NOT inner").select("gid", "eidx", F.when(F.col("rs").isNull(), F.col("src")).otherwise(F.concat(F.lit("regionN"), "rs")).alias("src"), F.when(F.col("rt").isNull(), F.col("dst")).otherwise(F.concat(F.lit("regionM"), "rt")).alias("dst"), "etype", "ts", F.lit(1.0).alias("mu"), F.lit(None).cast("bigint").alias("region"))
    inner = e.where("inner").groupBy("gid", F.col("rs").alias("region")).agg(F.count(F.lit(1)).cast("double").alias("mu"))
    inner = inner.select("gid", (F.col("region") + F.lit(2**50)).alias("eidx"), F.concat(F.lit("regionM"), "region").alias("src"), F.concat(F.lit("regionN"), "region").alias("dst"), F.lit(summary_etype).alias("etype"), F.lit(0).cast("bigint").alias("ts"), "mu", F.col("region").cast("bigint").alias("region"))
    new = cut(_renumber(outer.unionByName(inner), "eidx"), "collapsed")
    rho = new.where("region IS NULL").select("gid", "new_eidx", "eidx")
    rho = rho.unionByName(e.where("inner").select("gid", "eidx", F.col("rs").cast("bigint").alias("region")).join(new.where("region IS NOT NULL").select("gid", "region", "new_eidx"), ["gid", "region"]).select("gid", "new_eidx", "eidx"))
    return Reduced(Graph(nodes, new.select("gid", F.col("new_eidx").alias("eidx"), "src", "dst", "etype", "ts", "mu")), pi, rho)


def truncate_regions(regions: DataFrame, per_template: int, total: int) -> DataFrame:
    """Cut after a full match: the first ``per_template`` regions of each template, then the first ``total`` of each graph, by ridx."""
    a = regions.withColumn("_r", F.row_number().over(W.partitionBy("gid", "tpl_id").orderBy("ridx"))).where(F.col("_r") <= per_template)
    return a.withColumn("_r", F.row_number().over(W.partitionBy("gid").orderBy("ridx"))).where(F.col("_r") <= total).drop("_r")


def node_mass(r: Reduced) -> DataFrame:
    """gid, nid, mass_in, mass_out of the reduced nodes: original edges behind their edges, by the edge map."""
    e = r.graph.edges.join(edge_mass(r).withColumnRenamed("new_eidx", "eidx"), ["gid", "eidx"]).select("gid", "src", "dst", F.col("n_original").alias("m"))
    ends = F.array(F.struct(F.col("dst").alias("nid"), F.col("m").alias("i"), F.lit(0).cast("bigint").alias("o")), F.struct(F.col("src").alias("nid"), F.lit(0).cast("bigint").alias("i"), F.col("m").alias("o")))
    return e.select("gid", F.explode(ends).alias("x")).groupBy("gid", "x.nid").agg(F.sum("x.i").alias("mass_in"), F.sum("x.o").alias("mass_out"))


def invariants(g: Graph, r: Reduced) -> DataFrame:
    """check, violations.  mass_total: sum of mu' is the number of original edges; cover: each original edge in exactly one new
    edge; mass_edge: mu' of each new edge is its number of originals; external: a node that maps to itself keeps its number of
    edges in and out, by the edge map; nodes_monotone and edges_monotone: no graph grows; endpoints: every end of a new edge is a
    node.  Reductions that keep the input's mu meet the first and third only where that is 1."""
    n = lambda df: df.agg(F.count(F.lit(1)).alias("violations"))
    before = g.edges.groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
    after = r.graph.edges.groupBy("gid").agg(F.sum("mu").alias("mu"), F.count(F.lit(1)).alias("k"))
    j = before.join(after, "gid", "full").fillna(0)
    nodes = g.nodes.groupBy("gid").agg(F.count(F.lit(1)).alias("m")).join(r.graph.nodes.groupBy("gid").agg(F.count(F.lit(1)).alias("k")), "gid", "full").fillna(0)
    covered = g.edges.select("gid", "eidx").join(r.edge_map.groupBy("gid", "eidx").agg(F.count(F.lit(1)).alias("c")), ["gid", "eidx"], "full").where("coalesce(c, 0) <> 1")
    size = r.edge_map.groupBy("gid", F.col("new_eidx").alias("eidx")).agg(F.count(F.lit(1)).alias("c"))
    mass = r.graph.edges.join(size, ["gid", "eidx"], "left").where("abs(mu - coalesce(c, 0)) > 1e-6")
    ends = r.graph.edges.select("gid", "src", "dst").distinct()
    known = r.graph.nodes.select("gid", "nid").distinct()
    lost = ends.select("gid", F.col("src").alias("nid")).unionByName(ends.select("gid", F.col("dst").alias("nid"))).distinct().join(known, ["gid", "nid"], "left_anti")
    own = degrees(g).select("gid", "nid", "cnt_in", "cnt_out").join(r.node_map.where("nid = new_nid").select("gid", "nid"), ["gid", "nid"], "left_semi")
    changed = own.join(node_mass(r), ["gid", "nid"], "left").where("cnt_in <> coalesce(mass_in, 0) OR cnt_out <> coalesce(mass_out, 0)")
    parts = {"mass_total": j.where("abs(mu - m) > 1e-6"), "edges_monotone": j.where("k > m"), "nodes_monotone": nodes.where("k > m"), "cover": covered, "mass_edge": mass, "external": changed, "endpoints": lost}
    out = None
    for k, df in parts.items():
        x = n(df).select(F.lit(k).alias("check"), "violations")
        out = x if out is None else out.unionByName(x)
    return out


def node_map_sanity(g: Graph, r: Reduced) -> DataFrame:
    """check, violations: every original node maps, every image exists, every new node is an image or has an edge."""
    n = lambda k, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(k).alias("check"), "violations")
    total = g.nodes.select("gid", "nid").join(r.node_map, ["gid", "nid"], "left_anti")
    new = r.graph.nodes.select("gid", F.col("nid").alias("new_nid"))
    image = r.node_map.select("gid", "new_nid").distinct()
    reached = image.unionByName(r.graph.edges.select("gid", F.explode(F.array("src", "dst")).alias("new_nid"))).distinct()
    return n("total", total).unionByName(n("image_exists", image.join(new, ["gid", "new_nid"], "left_anti"))).unionByName(n("reachable", new.join(reached, ["gid", "new_nid"], "left_anti")))


def edge_mass(r: Reduced) -> DataFrame:
    """gid, new_eidx, n_original."""
    return r.edge_map.groupBy("gid", "new_eidx").agg(F.count(F.lit(1)).alias("n_original"))


def multiplicity(r: Reduced) -> DataFrame:
    """gid, new_nid, n_members."""
    return r.node_map.groupBy("gid", "new_nid").agg(F.count(F.lit(1)).alias("n_members"))


def survival(g: Graph, r: Reduced) -> DataFrame:
    """gid, survival: share of labelled nodes that map to themselves; 1 where none is labelled."""
    j = g.nodes.join(r.node_map, ["gid", "nid"], "left")
    return j.groupBy("gid").agg(F.coalesce(F.avg(F.when(F.col("label") == 1, (F.coalesce("new_nid", "nid") == F.col("nid")).cast("double"))), F.lit(1.0)).alias("survival"))


def summary_mass(r: Reduced, etype: str = SUMMARY) -> DataFrame:
    """gid, n, median_mu, max_mu of summary edges."""
    e = r.graph.edges.where(F.col("etype") == etype)
    return e.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.max("mu").alias("max_mu")).join(wide_percentiles(e, ["gid"], {"median_mu": ("mu", 0.5)}), "gid").select("gid", "n", "median_mu", "max_mu")


def collapse_rates(g: Graph, r: Reduced) -> DataFrame:
    """gid, share_collapsed, p_attack, covered: of the nodes that stay, the share whose edges stand for more than one edge each on
    either side (mean mu above 1); the share of labelled ones among those; and the share of labelled nodes that are among them.
    Null where there is nothing to divide by."""
    d = degrees(r.graph)
    up = lambda s: F.col(f"mu_{s}") / F.greatest(F.col(f"cnt_{s}"), F.lit(1)) > 1 + 1e-9
    x = r.graph.nodes.join(d, ["gid", "nid"]).select("gid", F.coalesce("label", F.lit(0)).alias("y"), (up("in") | up("out")).cast("int").alias("c"))
    return x.groupBy("gid").agg(F.avg("c").alias("share_collapsed"), F.avg(F.when(F.col("c") == 1, F.col("y"))).alias("p_attack"), F.avg(F.when(F.col("y") == 1, F.col("c"))).alias("covered"))

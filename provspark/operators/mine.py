"""Template mining from benign graphs: egonets and hub slices, Weisfeiler-Lehman buckets, disjoint support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import cut
from ..sources.views import Graph
from .graph import context_nodes, drop_nodes, process_refs, undirected
from .match import Template, fold_counts, greedy_disjoint
from .order import numbered, smallest
from .reduce import edge_dedup

#: Neighbours of a slice of a hub's egonet (from, to), and slices of a hub.
SLICE, SLICES = (2, 6), 24


def candidates(g: Graph, anchor_types: list[str], max_nodes: int = 48, min_nodes: int = 3, quota: int = 0, seed: int = 0, slice_size: tuple[int, int] = SLICE, slices: int = SLICES) -> DataFrame:
    """gid, cand, anchor, nid: members of the candidate subgraphs.

    Anchors are all nodes of the anchor types, and per graph ``quota`` others with at least two neighbours, by seeded hash.  An
    anchor's candidate is its 2-hop neighbourhood, or the 1-hop one where the former has more than ``max_nodes`` nodes; a hub
    with more neighbours than that gives ``slices`` slices of neighbours in seeded hash order, whose sizes go through ``slice_size``
    (from, to) in turn: a sample of its neighbourhood, as in the published method.  A neighbour with max_nodes neighbours
    or more settles the size of the 2-hop neighbourhood by itself, so hubs are never expanded.
    """
    u = cut(undirected(g.edges), "undirected")
    deg = u.groupBy("gid", F.col("a").alias("nid")).agg(F.count(F.lit(1)).alias("deg"))
    n = g.nodes.join(deg, ["gid", "nid"]).select("gid", "nid", "ntype", "deg")
    sem = n.where(F.col("ntype").isin(anchor_types))
    if quota:
        rest = n.where(~F.col("ntype").isin(anchor_types) & (F.col("deg") >= 2)).withColumn("h", F.xxhash64(F.lit(seed), "gid", "nid"))
        sem = sem.unionByName(smallest(rest, ["gid"], "h", quota).drop("h"))
    anchors = cut(sem.select("gid", F.col("nid").alias("a"), (F.col("deg") + 1 > max_nodes).alias("hub")), "anchors")
    h = F.xxhash64(F.lit(seed), "a", "b")
    sizes = [slice_size[0] + k % (slice_size[1] - slice_size[0] + 1) for k in range(slices)]
    ends = [sum(sizes[: k + 1]) for k in range(slices)]
    hub = smallest(u.join(anchors.where("hub"), ["gid", "a"]).select("gid", "a", "b", h.alias("h")), ["gid", "a"], "h", ends[-1])
    place = F.row_number().over(W.partitionBy("gid", "a").orderBy("h"))
    part = F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda x: x < place))
    sliced = hub.withColumn("cand", F.concat("a", F.lit("#"), part)).select("gid", "cand", "a", "b")
    small = u.join(anchors.where("NOT hub").select("gid", "a"), ["gid", "a"])
    near = small.join(deg.select("gid", F.col("nid").alias("b"), "deg"), ["gid", "b"])
    wide = near.groupBy("gid", "a").agg(F.max("deg").alias("m"))
    narrow = wide.where(F.col("m") < max_nodes).select("gid", "a")
    one = small.select("gid", F.col("a").alias("cand"), "a", "b")
    two = small.join(narrow, ["gid", "a"], "left_semi").select("gid", F.col("a").alias("cand"), F.col("b").alias("m")).join(u.withColumnsRenamed({"a": "m"}), ["gid", "m"]).select("gid", "cand", F.col("cand").alias("a"), "b").where("a <> b")
    two = cut(two.unionByName(one.join(narrow, ["gid", "a"], "left_semi").select(two.columns)).distinct(), "two_hops")
    fits = two.groupBy("gid", "cand").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 <= max_nodes).select("gid", "cand")
    rest = one.join(fits, ["gid", "cand"], "left_anti")
    allm = sliced.unionByName(two.join(fits, ["gid", "cand"], "left_semi").select(sliced.columns)).unionByName(rest.select(sliced.columns))
    allm = allm.select("gid", "cand", F.col("a").alias("anchor"), "b").distinct()
    members = allm.select("gid", "cand", "anchor", F.col("b").alias("nid")).unionByName(allm.select("gid", "cand", "anchor", F.col("anchor").alias("nid")).distinct())
    big = members.groupBy("gid", "cand").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_nodes)
    return cut(members.join(big.select("gid", "cand"), ["gid", "cand"], "left_semi"), "members")


def inner_links(g: Graph, members: DataFrame) -> DataFrame:
    """gid, cand, src, dst: distinct links between members of a candidate, without self-loops."""
    m = members.select("gid", "cand", "nid")
    e = g.edges.where("src <> dst").select("gid", "src", "dst").distinct()
    return e.join(m.withColumnRenamed("nid", "src"), ["gid", "src"]).join(m.withColumnRenamed("nid", "dst"), ["gid", "cand", "dst"]).select("gid", "cand", "src", "dst")


def wl_colours(nodes: DataFrame, links: DataFrame, iters: int = 3, by: tuple[str, ...] = ("gid", "cand")) -> DataFrame:
    """by..., nid, colour: rounds of md5(colour / sorted successors' colours + sorted predecessors' colours), without a mark of direction.  ``nodes``: by..., nid, ntype."""
    by = list(by)
    col = nodes.select(*by, "nid", F.coalesce("ntype", F.lit("?")).alias("colour"))
    for _ in range(iters):
        succ = links.join(col.withColumnsRenamed({"nid": "dst"}), [*by, "dst"]).groupBy(*by, F.col("src").alias("nid")).agg(F.array_sort(F.collect_list("colour")).alias("s"))
        pred = links.join(col.withColumnsRenamed({"nid": "src"}), [*by, "src"]).groupBy(*by, F.col("dst").alias("nid")).agg(F.array_sort(F.collect_list("colour")).alias("p"))
        none = F.array().cast("array<string>")
        col = col.join(succ, [*by, "nid"], "left").join(pred, [*by, "nid"], "left").select(*by, "nid", F.md5(F.concat("colour", F.lit("/"), F.array_join(F.concat(F.coalesce("s", none), F.coalesce("p", none)), ","))).alias("colour"))
    return col


def wl_signatures(g: Graph, members: DataFrame, links: DataFrame) -> DataFrame:
    """gid, cand, sig, n_nodes, n_edges: candidates of one signature may be isomorphic; lists are bounded by the candidates' size."""
    n = members.join(g.nodes.select("gid", "nid", "ntype"), ["gid", "nid"]).select("gid", "cand", "nid", "ntype")
    c = wl_colours(n, links)
    sig = c.groupBy("gid", "cand").agg(F.md5(F.array_join(F.array_sort(F.collect_list("colour")), ",")).alias("sig"), F.count(F.lit(1)).alias("n_nodes"))
    m = links.groupBy("gid", "cand").agg(F.count(F.lit(1)).alias("n_edges"))
    return sig.join(m, ["gid", "cand"], "left").fillna(0, ["n_edges"])


def supports(g: Graph, members: DataFrame, links: DataFrame, dedup: str = "node") -> DataFrame:
    """gid, cand, sig, o, n_nodes, n_edges, ...: candidates chosen for their bucket's disjoint support, larger ones first.  ``dedup``: no two share a node, or (``anchor``) an anchor."""
    if dedup not in ("node", "anchor"):
        raise ValueError(f"dedup: {dedup}")
    sig = wl_signatures(g, members, links)
    # candidates of a size stand in the order of their hash
    items = members.groupBy("gid", "cand").agg(F.first("anchor").alias("anchor"), F.collect_set(F.concat_ws("/", "gid", "nid" if dedup == "node" else "anchor")).alias("uses"))
    c = cut(sig.join(items, ["gid", "cand"]), "buckets")
    c = cut(numbered(c, [F.desc("n_nodes"), F.desc("n_edges"), "gid", "cand"], ["sig"], name="o").withColumn("takes", F.col("uses")), "buckets")
    return greedy_disjoint(c, ["sig"])


def mine(g: Graph, anchor_types: list[str], min_support: int = 5, max_templates: int = 80, max_nodes: int = 48, quota: int = 0, seed: int = 0, dedup: str = "node", min_edges: int = 2, verify: bool = True, context_k: int = 0, merged_first: bool = False) -> list[Template]:
    """Templates by size, then support, nodes renamed 0..n-1 with the anchor first.

    One of each bucket with at least ``min_support`` disjoint candidates and ``min_edges`` links is tried, in order of support, then
    size, until ``max_templates`` are kept; with ``verify`` one is kept only if it folds ``min_support`` regions over all graphs.  The support
    given is that of the disjoint candidates.  With ``context_k`` nodes with that many edges to subjects are taken out before, so
    that templates hold what is private; with ``merged_first`` equal edges are merged before.
    """
    whole = g
    if merged_first:
        g = edge_dedup(g).graph
    if context_k:
        g = drop_nodes(g, context_nodes(g, context_k))
    g = Graph(cut(g.nodes, "nodes"), cut(g.edges, "edges"))
    members = candidates(g, anchor_types, max_nodes, quota=quota, seed=seed)
    return _mined(whole, g, members, min_support, max_templates, dedup, min_edges, verify)


def _mined(whole: Graph, g: Graph, members: DataFrame, min_support: int, max_templates: int, dedup: str, min_edges: int, verify: bool) -> list[Template]:
    """Templates of the candidates' buckets; ``whole`` is what they are tried on."""
    links = cut(inner_links(g, members), "inner_links")
    sup = cut(supports(g, members, links, dedup), "supports")
    best = sup.groupBy("sig").agg(F.count(F.lit(1)).alias("support"), F.min_by(F.struct("gid", "cand", "anchor", "n_nodes", "n_edges"), "o").alias("r")).where(F.col("support") >= min_support)
    best = cut(best.select("sig", "support", "r.*").where(F.col("n_edges") >= min_edges), "templates")
    ranked = cut(numbered(best, [F.desc("support"), F.desc("n_nodes"), F.desc("n_edges"), "sig"]), "templates")
    out: list[tuple] = []
    upto = 0
    while len(out) < max_templates:  # no more at once than may still be kept
        some = ranked.where((F.col("rn") > upto) & (F.col("rn") <= upto + max_templates))
        rows = some.orderBy("rn").collect()
        if not rows:
            break
        upto += len(rows)
        key = some.select("gid", "cand")
        types = members.join(key, ["gid", "cand"], "left_semi").join(g.nodes.select("gid", "nid", "ntype"), ["gid", "nid"]).select("gid", "cand", "nid", "ntype").collect()
        edges = links.join(key, ["gid", "cand"], "left_semi").collect()
        found = [_template(r, types, edges) for r in rows]
        folds = fold_counts(whole, found) if verify else dict.fromkeys(range(len(rows)), min_support)
        good = [(-r.n_nodes, -r.n_edges, -r.support, r.sig, t) for i, (r, t) in enumerate(zip(rows, found, strict=True)) if folds[i] >= min_support]
        out += good[: max_templates - len(out)]
    out.sort(key=lambda x: x[:4])
    return [Template(f"tpl_{i}", t.nodes, t.edges, t.anchor, -n) for i, (*_, n, _, t) in enumerate(out)]


def fan_out_templates(g: Graph, anchor_types: list[str], k: int = 4, min_support: int = 5, max_templates: int = 80, seed: int = 0, verify: bool = False) -> list[Template]:
    """The probe's variant: a candidate is an anchor with k of its neighbours, by seeded hash."""
    u = undirected(g.edges).join(g.nodes.where(F.col("ntype").isin(anchor_types)).select("gid", F.col("nid").alias("a")), ["gid", "a"])
    few = smallest(u.withColumn("h", F.xxhash64(F.lit(seed), "a", "b")), ["gid", "a"], "h", k)
    full = few.groupBy("gid", "a").agg(F.collect_list("b").alias("bs")).where(F.size("bs") == k)
    members = cut(full.select("gid", F.col("a").alias("cand"), F.col("a").alias("anchor"), F.explode(F.concat(F.array("a"), "bs")).alias("nid")), "members")
    return _mined(g, g, members, min_support, max_templates, "node", 1, verify)


def _template(b, types: list, edges: list) -> Template:
    """The candidate with its nodes renamed."""
    own = {r.nid: r.ntype for r in types if (r.gid, r.cand) == (b.gid, b.cand)}
    name = {n: str(k) for k, n in enumerate([b.anchor, *sorted(set(own) - {b.anchor})])}
    return Template("tpl", {name[n]: t for n, t in sorted(own.items(), key=lambda x: int(name[x[0]]))}, tuple(sorted((name[r.src], name[r.dst]) for r in edges if (r.gid, r.cand) == (b.gid, b.cand))), "0")


def coverage_subset(templates: DataFrame, coverage: float = 1.0) -> DataFrame:
    """tpl_id, tpos, support: templates by descending support until their sum reaches the share of all support."""
    w = W.partitionBy().orderBy(F.desc("support"), "tpos")  # one row a template
    t = templates.withColumns({"_before": F.coalesce(F.sum("support").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("support").over(W.partitionBy())})
    return t.where(F.col("_before") < coverage * F.col("_total")).drop("_before", "_total")


def fold_ceiling(g: Graph, k: int = 2) -> DataFrame:
    """gid, n_regions, n_absorbed: how many disjoint neighbourhoods of a process and the objects that at most k processes touch could fold at best, processes in node order."""
    pairs = process_refs(g).distinct()
    few = pairs.groupBy("gid", "nid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= k).select("gid", "nid")
    own = pairs.join(few, ["gid", "nid"], "left_semi").select("gid", "proc", "nid").unionByName(pairs.select("gid", "proc", F.col("proc").alias("nid"))).distinct()
    c = own.groupBy("gid", "proc").agg(F.collect_set("nid").alias("uses")).where(F.size("uses") >= 2)
    c = c.join(g.nodes.select("gid", F.col("nid").alias("proc"), "npos"), ["gid", "proc"])
    c = cut(numbered(c, ["npos", "proc"], ["gid"], name="o").withColumn("takes", F.col("uses")), "neighbourhoods")
    return greedy_disjoint(c, ["gid"]).groupBy("gid").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.size("takes")).alias("n_absorbed"))


def absorb_conflicts(g: Graph, k: int = 2) -> DataFrame:
    """gid, n_regions, n_absorbed, n_conflicts: whole neighbourhoods of processes packed greedily, and how many of the objects absorbed are still touched by at least k processes outside of the region."""
    pairs = cut(process_refs(g).where("nid <> proc").distinct(), "pairs")
    c = pairs.groupBy("gid", "proc").agg(F.array_union(F.collect_set("nid"), F.array("proc")).alias("uses"))
    c = c.join(g.nodes.select("gid", F.col("nid").alias("proc"), "npos"), ["gid", "proc"])
    c = cut(numbered(c, ["npos", "proc"], ["gid"], name="o").withColumn("takes", F.col("uses")), "neighbourhoods")
    r = cut(greedy_disjoint(c, ["gid"]).select("gid", F.col("proc").alias("region"), "takes"), "folded")
    inside = r.select("gid", "region", F.explode("takes").alias("nid"))
    touched = inside.where("nid <> region").join(pairs, ["gid", "nid"]).join(inside.select("gid", "region", F.col("nid").alias("proc")), ["gid", "region", "proc"], "left_anti")
    hit = touched.groupBy("gid", "region", "nid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).groupBy("gid").agg(F.count(F.lit(1)).alias("n_conflicts"))
    return r.groupBy("gid").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.size("takes")).alias("n_absorbed")).join(hit, "gid", "left").fillna(0, ["n_conflicts"])

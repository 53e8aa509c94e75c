"""Queries of the graph, reduction, matching, feature, detector, metric and alert operators, with the SQL they must agree with."""

from __future__ import annotations

from functools import reduce as reduce_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import TYPE_NAMES
from ..functions.tables import cut, table
from ..operators import alerts, detect, features, graph, match, metrics, mine, reduce, stats
from ..operators.match import Template
from ..sources import cdm, files, views
from ..sources.views import kept, prov
from .registry import ORACLES, query

_ET = "CASE WHEN coalesce(trim(etype), '') = '' OR lower(trim(etype)) = 'event_' THEN 'event' ELSE regexp_replace(lower(trim(etype)), '^event_', '') END"
_TYPE = "CASE lower(trim(type)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_NAMES.items()) + " ELSE lower(trim(type)) END"
PROV = f"""
WITH pe AS (SELECT gid, eidx, lower(trim(src)) src, lower(trim(dst)) dst, {_ET} etype, min(coalesce(ts, 0)) ts, min(coalesce(mu, 1.0)) mu FROM edges
            WHERE gid IS NOT NULL AND eidx IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL),
     pt AS (SELECT gid, lower(trim(nid)) nid, npos, {_TYPE} t FROM nodes WHERE gid IS NOT NULL AND nid IS NOT NULL),
     pd AS (SELECT gid, nid, min(npos) npos, coalesce(arg_min(t, (npos, t)) FILTER (t IS NOT NULL AND t NOT IN ('', 'object')), 'object') ntype FROM pt GROUP BY gid, nid),
     px AS (SELECT gid, nid, min(pos) pos FROM (SELECT gid, src nid, 1000000000000 + 2 * eidx pos FROM pe UNION ALL SELECT gid, dst, 1000000000001 + 2 * eidx FROM pe) GROUP BY gid, nid),
     pn AS (SELECT coalesce(d.gid, x.gid) gid, coalesce(d.nid, x.nid) nid, coalesce(npos, pos) npos, coalesce(ntype, 'unknown') ntype,
              (coalesce(d.nid, x.nid) IN (SELECT lower(trim(uuid)) FROM gt_nodes WHERE uuid IS NOT NULL))::INTEGER AS label
            FROM pd d FULL JOIN px x ON d.gid = x.gid AND d.nid = x.nid),
     deg AS (SELECT gid, nid, sum(ci)::BIGINT cnt_in, sum(co)::BIGINT cnt_out, sum(mi) mu_in, sum(mo) mu_out FROM (
              SELECT gid, dst nid, 1 ci, 0 co, mu mi, 0.0::DOUBLE mo FROM pe UNION ALL SELECT gid, src, 0, 1, 0.0::DOUBLE, mu FROM pe
              UNION ALL SELECT gid, nid, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM pn) GROUP BY gid, nid)
"""
GEO = """
WITH ge AS (SELECT c_custkey * 3 eidx, 'c' || c_custkey src, 'n' || c_nationkey dst, 'lives' etype FROM customer
            UNION ALL SELECT s_suppkey * 3 + 1, 's' || s_suppkey, 'n' || s_nationkey, 'based' FROM supplier
            UNION ALL SELECT n_nationkey * 3 + 2, 'n' || n_nationkey, 'r' || n_regionkey, 'in' FROM nation),
     gn AS (SELECT 'c' || c_custkey nid, c_custkey * 4 npos, c_mktsegment ntype FROM customer UNION ALL SELECT 's' || s_suppkey, s_suppkey * 4 + 1, 'supplier' FROM supplier
            UNION ALL SELECT 'n' || n_nationkey, n_nationkey * 4 + 2, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey * 4 + 3, 'region' FROM region)
"""


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n).alias(c) if isinstance(c, str) else F.round(c, n)


# --- statistics, splits, neighbourhoods ----------------------------------------------------------------------------------


@query("graph_stats", PROV + """SELECT n.gid, n_nodes, n_edges, n_labels, round(total_mu, 6) total_mu FROM (SELECT gid, count(*) n_nodes, sum(label)::BIGINT n_labels FROM pn GROUP BY 1) n
 JOIN (SELECT gid, count(*) n_edges, sum(mu) total_mu FROM pe GROUP BY 1) e USING (gid)""")
def _(spark, d):
    return graph.graph_stats(prov(spark, d)).select("gid", "n_nodes", "n_edges", "n_labels", _r("total_mu"))


@query("type_histogram", PROV + "SELECT gid, ntype, count(*) n FROM pn GROUP BY ALL")
def _(spark, d):
    return graph.type_histogram(prov(spark, d))


@query("etype_histogram", PROV + "SELECT gid, etype, count(*) n, round(sum(mu), 6) mu FROM pe GROUP BY ALL")
def _(spark, d):
    return graph.etype_histogram(prov(spark, d)).select("gid", "etype", "n", _r("mu"))


@query("degrees", PROV + "SELECT gid, nid, cnt_in, cnt_out, round(mu_in, 6) mu_in, round(mu_out, 6) mu_out FROM deg")
def _(spark, d):
    return graph.degrees(prov(spark, d)).select("gid", "nid", "cnt_in", "cnt_out", _r("mu_in"), _r("mu_out"))


@query("degrees_supply", "SELECT 'p' || l_partkey nid, count(*) cnt_in FROM lineitem GROUP BY 1")
def _(spark, d):
    return graph.degrees(views.g_supply(spark, d)).where("nid LIKE 'p%' AND cnt_in > 0").select("nid", "cnt_in")


@query("label_semijoin", PROV + "SELECT gid, nid FROM pn WHERE label = 1")
def _(spark, d):
    return prov(spark, d).nodes.where("label = 1").select("gid", "nid")


@query("drop_nodes_antijoin", PROV + "SELECT gid, eidx FROM pe WHERE NOT EXISTS (SELECT 1 FROM pn WHERE ntype = 'process' AND pn.gid = pe.gid AND (nid = src OR nid = dst))")
def _(spark, d):
    g = prov(spark, d)
    return graph.drop_nodes(g, g.nodes.where("ntype = 'process'")).edges.select("gid", "eidx")


@query("filter_time_host_head", PROV + "SELECT gid, eidx FROM pe WHERE eidx < 1000 AND ts BETWEEN 1760007200000000000 AND 1760020000000000000 AND (right(src, 1) = '' OR right(src, 1) IN ('0', '3', '7', 'a', 'd'))")
def _(spark, d):
    """The last character of src stands for the host."""
    e = prov(spark, d).edges.withColumn("host", F.substring("src", -1, 1))
    return graph.filter_edges(e, ts_window=(1760007200000000000, 1760020000000000000), hosts=["0", "3", "7", "a", "d"], max_records=1000).select("gid", "eidx")


@query("time_split_70", PROV + """SELECT gid, eidx, CASE WHEN row_number() OVER (PARTITION BY gid ORDER BY ts, eidx) <= floor(count(*) OVER (PARTITION BY gid) * 0.7::DOUBLE + 1e-9) THEN 'train' ELSE 'test' END part FROM pe""")
def _(spark, d):
    return graph.time_split(prov(spark, d), 0.7).select("gid", "eidx", "part")


@query("time_windows_8", PROV + """SELECT gid, eidx, least(7, floor((ts - lo) / greatest(1.0::DOUBLE, (hi - lo) / 8.0::DOUBLE)))::INTEGER win FROM (SELECT *, min(ts) OVER (PARTITION BY gid) lo, max(ts) OVER (PARTITION BY gid) hi FROM pe WHERE ts <> 0)""")
def _(spark, d):
    return graph.windows_by_time(prov(spark, d).edges, 8).select("gid", "eidx", "win")


@query("count_windows_8", PROV + """, w AS (SELECT gid, eidx, (row_number() OVER (PARTITION BY gid ORDER BY ts, eidx) - 1) // greatest(1, count(*) OVER (PARTITION BY gid) // 8) win FROM pe) SELECT gid, eidx, win::INTEGER win FROM w WHERE win < 8""")
def _(spark, d):
    return graph.windows_by_count(prov(spark, d).edges, 8).select("gid", "eidx", "win")


@query("window_span", PROV + """SELECT gid, count(*) n_edges, min(ts) FILTER (ts <> 0) ts_lo, max(ts) ts_hi, round((max(ts) - min(ts) FILTER (ts <> 0)) / 1e9 / 3600, 6) AS hours, round(count(*) / nullif((max(ts) - min(ts) FILTER (ts <> 0)) / 1e9, 0), 6) events_per_s FROM pe GROUP BY gid""")
def _(spark, d):
    return graph.window_span(prov(spark, d).edges)


_KHOP = """, a AS (SELECT DISTINCT gid, nid anchor FROM pn WHERE label = 1), u AS (SELECT gid, src a, dst b FROM pe WHERE src <> dst UNION SELECT gid, dst, src FROM pe WHERE src <> dst),
 h1 AS (SELECT DISTINCT a.gid, anchor, b nid FROM a JOIN u ON u.gid = a.gid AND u.a = anchor), h2 AS (SELECT DISTINCT h1.gid, anchor, b nid FROM h1 JOIN u ON u.gid = h1.gid AND u.a = h1.nid)"""


@query("khop1", PROV + _KHOP + " SELECT gid, anchor, nid, min(hop)::INTEGER hop FROM (SELECT gid, anchor, anchor nid, 0 hop FROM a UNION ALL SELECT *, 1 FROM h1) GROUP BY ALL")
def _(spark, d):
    g = prov(spark, d)
    return graph.khop(g, g.nodes.where("label = 1").select("gid", F.col("nid").alias("anchor")), 1)


@query("khop2", PROV + _KHOP + " SELECT gid, anchor, nid, min(hop)::INTEGER hop FROM (SELECT gid, anchor, anchor nid, 0 hop FROM a UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY gid, anchor, nid")
def _(spark, d):
    g = prov(spark, d)
    return graph.khop(g, g.nodes.where("label = 1").select("gid", F.col("nid").alias("anchor")), 2)


@query("khop1_induced", PROV + _KHOP + """, m AS (SELECT gid, anchor, anchor nid FROM a UNION SELECT * FROM h1) SELECT m1.anchor, e.gid, e.eidx FROM pe e JOIN m m1 ON m1.gid = e.gid AND m1.nid = e.src JOIN m m2 ON m2.gid = e.gid AND m2.nid = e.dst AND m1.anchor = m2.anchor""")
def _(spark, d):
    g = prov(spark, d)
    m = graph.khop(g, g.nodes.where("label = 1").select("gid", F.col("nid").alias("anchor")), 1)
    return graph.induced_edges(g, m).select("anchor", "gid", "eidx")


_PROC = """, pr AS (SELECT gid, nid FROM pn WHERE lower(ntype) IN ('process', 'subject')), rf AS (SELECT e.gid, dst nid, src proc FROM pe e JOIN pr ON pr.gid = e.gid AND pr.nid = src UNION ALL SELECT e.gid, src, dst FROM pe e JOIN pr ON pr.gid = e.gid AND pr.nid = dst)"""


@query("shared_objects", PROV + _PROC + " SELECT gid, nid FROM rf GROUP BY ALL HAVING count(DISTINCT proc) >= 2")
def _(spark, d):
    return graph.shared_objects(prov(spark, d), 2)


_SUBJ = _PROC.replace("lower(ntype) IN ('process', 'subject')", "regexp_matches(lower(ntype), 'process|subject|unit|proc|principal|task')")


@query("context_nodes", PROV + _SUBJ + " SELECT gid, nid FROM rf GROUP BY ALL HAVING count(*) >= 2")
def _(spark, d):
    return graph.context_nodes(prov(spark, d), 2)


@query("process_profile", PROV + _PROC + """, q AS (SELECT gid, nid, proc, count(*) e FROM rf GROUP BY ALL), u AS (SELECT gid, nid, count(*) n FROM q GROUP BY ALL)
 SELECT q.gid, proc, sum(e)::BIGINT n_edges, count(*) n_objects, sum((n < 2)::INTEGER)::BIGINT n_private FROM q JOIN u ON u.gid = q.gid AND u.nid = q.nid GROUP BY ALL""")
def _(spark, d):
    return graph.process_profile(prov(spark, d))


@query("egonet_profile", PROV + _PROC + """, u AS (SELECT gid, nid, count(DISTINCT proc) n FROM rf GROUP BY ALL), x AS (SELECT DISTINCT gid, src proc, 'o' d, dst nid FROM pe WHERE src <> dst UNION SELECT gid, dst, 'i', src FROM pe WHERE src <> dst)
 SELECT x.gid, x.proc, pn.ntype, x.d, count(*) n, sum((u.n < 2)::INTEGER)::BIGINT n_private FROM x JOIN pr ON pr.gid = x.gid AND pr.nid = x.proc JOIN u ON u.gid = x.gid AND u.nid = x.nid JOIN pn ON pn.gid = x.gid AND pn.nid = x.nid GROUP BY ALL""")
def _(spark, d):
    return graph.egonet_profile(prov(spark, d))


@query("semantic_types", PROV + "SELECT ntype, count(*) n FROM pn WHERE regexp_matches(lower(ntype), 'process|subject|unit|proc|principal|task') GROUP BY 1")
def _(spark, d):
    return graph.semantic_types(prov(spark, d))


@query("labels_missing", PROV + "SELECT DISTINCT pe.gid, lower(trim(uuid)) nid FROM (SELECT DISTINCT gid FROM pe) pe, gt_nodes WHERE lower(trim(uuid)) <> '' AND NOT EXISTS (SELECT 1 FROM pn WHERE pn.gid = pe.gid AND pn.nid = lower(trim(uuid)))")
def _(spark, d):
    g = prov(spark, d)
    listed = g.edges.select("gid").distinct().join(F.broadcast(views.ground_truth(table(spark, d, "gt_nodes")).select("nid")))  # the labels are a parameter, a few
    return graph.missing(listed, g.nodes)


@query("last_neighbours", PROV + """, b AS (SELECT DISTINCT * FROM (SELECT gid, src nid, dst nbr, eidx FROM pe UNION ALL SELECT gid, dst, src, eidx FROM pe)), r AS (SELECT *, row_number() OVER (PARTITION BY gid, nid ORDER BY eidx DESC) rank FROM b) SELECT gid, nid, nbr, eidx, rank::INTEGER rank FROM r WHERE rank <= 10""")
def _(spark, d):
    return graph.last_neighbours(prov(spark, d).edges, 10).select("gid", "nid", "nbr", "eidx", "rank")


@query("last_update", PROV + """SELECT gid, nid, max(ts) last_ts, count(*) n, arg_max(etype, (ts, eidx)) last_etype FROM (SELECT gid, src nid, ts, eidx, etype FROM pe UNION ALL SELECT gid, dst, ts, eidx, etype FROM pe) GROUP BY ALL""")
def _(spark, d):
    return graph.last_update(prov(spark, d).edges)


# --- reductions ----------------------------------------------------------------------------------------------------------

_DEDUP = """, m AS (SELECT gid, src, dst, etype, min(ts) ts, count(*)::DOUBLE mu, min(eidx) f FROM pe GROUP BY gid, src, dst, etype), q AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY f) - 1 new_eidx FROM m)"""


@query("edge_dedup", PROV + _DEDUP + " SELECT gid, new_eidx eidx, src, dst, etype, ts, mu FROM q")
def _(spark, d):
    return reduce.edge_dedup(prov(spark, d)).graph.edges


@query("edge_dedup_lineage", PROV + _DEDUP + " SELECT pe.gid, new_eidx, eidx FROM pe JOIN q ON pe.gid = q.gid AND pe.src = q.src AND pe.dst = q.dst AND pe.etype = q.etype")
def _(spark, d):
    return reduce.edge_dedup(prov(spark, d)).edge_map


@query("edge_dedup_supply", """SELECT 's' || l_suppkey src, 'p' || l_partkey dst, l_returnflag etype, min(epoch_us(l_shipdate)) * 1000 ts, count(*)::DOUBLE mu FROM lineitem GROUP BY ALL""")
def _(spark, d):
    return reduce.edge_dedup(views.g_supply(spark, d)).graph.edges.select("src", "dst", "etype", "ts", "mu")


@query("edge_dedup_events", """SELECT strftime(ts, '%Y-%m-%d') gid, 'u' || user_id src, 'k' || json_extract_string(props, '$.k') dst, event_type etype, min(epoch_us(ts)) * 1000 ts, count(*)::DOUBLE mu FROM events GROUP BY ALL""")
def _(spark, d):
    return reduce.edge_dedup(views.g_events(spark, d)).graph.edges.select("gid", "src", "dst", "etype", "ts", "mu")


_MERGE = """, s AS (SELECT nid, string_agg(x, ',' ORDER BY x) sig FROM (SELECT src nid, 'o' || dst || '/' || etype x FROM ge UNION ALL SELECT dst, 'i' || src || '/' || etype FROM ge) GROUP BY nid),
 k AS (SELECT gn.nid, npos, ntype, sig FROM gn JOIN s USING (nid)), g AS (SELECT ntype, sig, count(*) size, min(npos) f FROM k GROUP BY ALL HAVING count(*) >= 2),
 g2 AS (SELECT *, 'nm_' || (row_number() OVER (ORDER BY f) - 1) new_nid, row_number() OVER (ORDER BY f) + 1125899906842624 new_pos FROM g),
 pi AS (SELECT gn.nid, coalesce(g2.new_nid, gn.nid) new_nid, g2.new_nid IS NOT NULL merged FROM gn LEFT JOIN k USING (nid) LEFT JOIN g2 ON g2.ntype = k.ntype AND g2.sig = k.sig)"""


@query("node_merge_map", GEO + _MERGE + " SELECT nid, new_nid FROM pi")
def _(spark, d):
    return reduce.node_merge(views.g_geo(spark, d)).node_map.select("nid", "new_nid")


@query("node_merge_nodes", GEO + _MERGE + " SELECT nid, ntype FROM gn WHERE nid IN (SELECT nid FROM pi WHERE NOT merged) UNION ALL SELECT new_nid, ntype FROM g2")
def _(spark, d):
    return reduce.node_merge(views.g_geo(spark, d)).graph.nodes.select("nid", "ntype")


@query("node_merge_edges", GEO + _MERGE + """ SELECT a.new_nid src, b.new_nid dst, etype, count(*)::DOUBLE mu FROM ge JOIN pi a ON a.nid = src JOIN pi b ON b.nid = dst GROUP BY a.new_nid, b.new_nid, etype, CASE WHEN NOT a.merged AND NOT b.merged THEN eidx END""")
def _(spark, d):
    return reduce.node_merge(views.g_geo(spark, d)).graph.edges.select("src", "dst", "etype", "mu")


STAR = (Template("star_fn", {"0": "process", "1": "file", "2": "netflow"}, (("0", "1"), ("0", "2")), "0"), Template("star_ff", {"0": "process", "1": "file", "2": "file"}, (("0", "1"), ("0", "2")), "0"), Template("fork", {"0": "process", "1": "file", "2": "process"}, (("0", "1"), ("2", "1")), "0"))
_CHECKS = "SELECT c.r AS reduction, k.k AS \"check\", 0::BIGINT violations FROM (VALUES {0}) c(r), (VALUES {1}) k(k)"


def _reductions(g):
    r = match.find_regions(g, list(STAR))
    return g, {"identity": reduce.identity(g), "edge_dedup": reduce.edge_dedup(g), "node_merge": reduce.node_merge(g), "collapse": reduce.collapse(g, r)}


def _all(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for k, f in frames.items():
        x = f.select(F.lit(k).alias("reduction"), *f.columns)
        out = x if out is None else out.unionByName(x)
    return out


@query("reduction_invariants", _CHECKS.format("('identity'), ('edge_dedup'), ('node_merge'), ('collapse')", "('mass_total'), ('edges_monotone'), ('nodes_monotone'), ('cover'), ('mass_edge'), ('external'), ('endpoints')"))
def _(spark, d):
    """Of a graph whose every edge weighs 1, as the checks ask."""
    g = prov(spark, d)
    g, rs = _reductions(kept(views.Graph(g.nodes, g.edges.withColumn("mu", F.lit(1.0)))))
    return _all({k: reduce.invariants(g, r) for k, r in rs.items()})


@query("node_map_sanity", _CHECKS.format("('identity'), ('edge_dedup'), ('node_merge'), ('collapse')", "('total'), ('image_exists'), ('reachable')"))
def _(spark, d):
    g, rs = _reductions(kept(prov(spark, d)))
    return _all({k: reduce.node_map_sanity(g, r) for k, r in rs.items()})


@query("edge_mass", PROV + _DEDUP + " SELECT gid, new_eidx, mu::BIGINT n_original FROM q")
def _(spark, d):
    return reduce.edge_mass(reduce.edge_dedup(prov(spark, d)))


@query("node_mass", PROV + "SELECT gid, nid, cnt_in::BIGINT mass_in, cnt_out::BIGINT mass_out FROM deg WHERE cnt_in + cnt_out > 0")
def _(spark, d):
    """Merging edges leaves the mass of every node as it was."""
    return reduce.node_mass(reduce.edge_dedup(prov(spark, d)))


@query("collapse_rates", PROV + _DEDUP + """, d2 AS (SELECT gid, nid, sum(i) ci, sum(o) co, sum(mi) mi, sum(mo) mo FROM (SELECT gid, dst nid, 1 i, 0 o, mu mi, 0 mo FROM q UNION ALL SELECT gid, src, 0, 1, 0, mu FROM q) GROUP BY ALL),
 x AS (SELECT pn.gid, label y, (coalesce(mi / greatest(ci, 1), 0) > 1.000000001 OR coalesce(mo / greatest(co, 1), 0) > 1.000000001)::INTEGER c FROM pn LEFT JOIN d2 ON d2.gid = pn.gid AND d2.nid = pn.nid)
 SELECT gid, round(avg(c), 6) share_collapsed, round(avg(y) FILTER (c = 1), 6) p_attack, round(avg(c) FILTER (y = 1), 6) covered FROM x GROUP BY gid""")
def _(spark, d):
    g = prov(spark, d)
    return reduce.collapse_rates(g, reduce.edge_dedup(g)).select("gid", _r("share_collapsed"), _r("p_attack"), _r("covered"))


@query("attack_survival", PROV + "SELECT gid, coalesce(avg((ntype <> 'process')::INTEGER) FILTER (label = 1), 1.0)::DOUBLE survival FROM pn GROUP BY gid")
def _(spark, d):
    """Of a reduction that puts all processes of a graph into one node."""
    g = prov(spark, d)
    r = reduce.identity(g)
    pi = g.nodes.select("gid", "nid", F.when(F.col("ntype") == "process", "P").otherwise(F.col("nid")).alias("new_nid"))
    return reduce.survival(g, reduce.Reduced(r.graph, pi, r.edge_map))


@query("template_survival")
def _(spark, d):
    g = prov(spark, d)
    return reduce.survival(g, reduce.collapse(g, match.find_regions(g, list(STAR))))


@query("collapse_multiplicity")
def _(spark, d):
    g = prov(spark, d)
    return reduce.multiplicity(reduce.collapse(g, match.find_regions(g, list(STAR))))


@query("summary_mass")
def _(spark, d):
    g = prov(spark, d)
    return reduce.summary_mass(reduce.collapse(g, match.find_regions(g, list(STAR))))


@query("template_collapse")
def _(spark, d):
    g = prov(spark, d)
    return reduce.collapse(g, match.find_regions(g, list(STAR))).graph.edges


_FIXED = """, ab AS (SELECT gid, nid, 0 r FROM (SELECT gid, nid, row_number() OVER (PARTITION BY gid ORDER BY npos) rn FROM pn) WHERE rn <= 20),
 w AS (SELECT e.*, a.r rs, b.r rt FROM pe e LEFT JOIN ab a ON a.gid = e.gid AND a.nid = src LEFT JOIN ab b ON b.gid = e.gid AND b.nid = dst)"""


@query("collapse_fixed_region", PROV + _FIXED + """ SELECT gid, CASE WHEN rs IS NULL THEN src ELSE 'regionN' || rs END src, CASE WHEN rt IS NULL THEN dst ELSE 'regionM' || rt END dst, etype, ts, 1.0::DOUBLE mu FROM w WHERE rs IS NULL OR rt IS NULL OR rs <> rt
 UNION ALL SELECT gid, 'regionM' || rs, 'regionN' || rs, '__summary__', 0, count(*)::DOUBLE FROM w WHERE rs = rt GROUP BY gid, rs""")
def _(spark, d):
    from ..operators.order import numbered

    g = prov(spark, d)
    r = numbered(g.nodes, ["npos"], ["gid"]).where("rn <= 20").groupBy("gid").agg(F.collect_list("nid").alias("absorb"))
    r = r.select("gid", F.lit(0).cast("bigint").alias("ridx"), F.lit("fixed").alias("tpl_id"), F.lit("process").alias("anchor_type"), "absorb")
    return reduce.collapse(g, r).graph.edges.select("gid", "src", "dst", "etype", "ts", "mu")


# --- matching and mining -------------------------------------------------------------------------------------------------

_LINKS = """, l AS (SELECT DISTINCT gid, src, dst FROM pe WHERE src <> dst), o AS (SELECT l.gid, src a, dst b, pn.ntype bt FROM l JOIN pn ON pn.gid = l.gid AND pn.nid = dst)"""


@query("seeds_prefilter", PROV + _LINKS + """ SELECT p.gid, p.nid x0 FROM pn p JOIN o ON o.gid = p.gid AND o.a = p.nid WHERE p.ntype = 'process' GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, d):
    g = prov(spark, d)
    return match.seeds(g, match.typed_links(g), STAR[0], signature=False).select("gid", "x0")


@query("signature_prefilter", PROV + _LINKS + """ SELECT p.gid, p.nid x0 FROM pn p JOIN o ON o.gid = p.gid AND o.a = p.nid WHERE p.ntype = 'process' GROUP BY ALL HAVING count(*) >= 2 AND bool_or(bt = 'file') AND bool_or(bt = 'netflow')""")
def _(spark, d):
    g = prov(spark, d)
    return match.seeds(g, match.typed_links(g), STAR[0]).select("gid", "x0")


@query("match_star2_first", PROV + _LINKS + """ SELECT p.gid, p.nid seed, min(b) FILTER (bt = 'file') n1, min(b) FILTER (bt = 'netflow') n2 FROM pn p JOIN o ON o.gid = p.gid AND o.a = p.nid WHERE p.ntype = 'process' GROUP BY ALL HAVING n1 IS NOT NULL AND n2 IS NOT NULL""")
def _(spark, d):
    e = match.first_embeddings(prov(spark, d), [STAR[0]])
    return e.select("gid", "seed", F.get("nodes", F.lit(1)).alias("n1"), F.get("nodes", F.lit(2)).alias("n2"))


@query("match_fork_first", PROV + _LINKS + """, m AS (SELECT p.gid, p.nid seed, (o1.b, l.src) k FROM pn p JOIN o o1 ON o1.gid = p.gid AND o1.a = p.nid AND o1.bt = 'file' JOIN l ON l.gid = p.gid AND l.dst = o1.b JOIN pn q ON q.gid = p.gid AND q.nid = l.src AND q.ntype = 'process' WHERE p.ntype = 'process' AND l.src <> p.nid),
 f AS (SELECT gid, seed, min(k) k FROM m GROUP BY ALL) SELECT gid, seed, k[1] n1, k[2] n2 FROM f""")
def _(spark, d):
    e = match.first_embeddings(prov(spark, d), [STAR[2]])
    return e.select("gid", "seed", F.get("nodes", F.lit(1)).alias("n1"), F.get("nodes", F.lit(2)).alias("n2"))


@query("template_regions")
def _(spark, d):
    return match.find_regions(prov(spark, d), list(STAR)).select("gid", "ridx", "tpl_id", "seed", F.array_join("absorb", ",").alias("absorb"))


@query("template_regions_capped")
def _(spark, d):
    r = match.find_regions(prov(spark, d), list(STAR), max_instances=5, max_total=12)
    return reduce.truncate_regions(r, 3, 6).select("gid", "ridx", "tpl_id", "seed")


@query("mined_templates")
def _(spark, d):
    g = prov(spark, d)
    t = mine.mine(g, [r.ntype for r in graph.semantic_types(g).collect()], min_support=3)
    rows = [(x.tpl_id, i, len(x.nodes), len(x.edges), x.support) for i, x in enumerate(t)]
    return mine.coverage_subset(spark.createDataFrame(rows, "tpl_id string, tpos int, n_nodes int, n_edges int, support bigint"), 0.9)


@query("match_profile")
def _(spark, d):
    g = kept(prov(spark, d))
    return match.match_profile(g, list(STAR), match.find_regions(g, list(STAR)))


@query("regions_shared_by_edges")
def _(spark, d):
    return match.find_regions(kept(prov(spark, d)), list(STAR), share_k=3, shared_by="edges").select("gid", "ridx", "tpl_id", "seed")


@query("fold_ceiling")
def _(spark, d):
    return mine.fold_ceiling(kept(prov(spark, d)))


_WL = """, c{1} AS (SELECT c.nid, md5(c.colour || '/' || array_to_string(list_concat(coalesce(s.l, []), coalesce(p.l, [])), ',')) colour FROM c{0} c
 LEFT JOIN (SELECT src nid, list(x.colour ORDER BY x.colour) l FROM ge JOIN c{0} x ON x.nid = ge.dst GROUP BY 1) s ON s.nid = c.nid LEFT JOIN (SELECT dst nid, list(x.colour ORDER BY x.colour) l FROM ge JOIN c{0} x ON x.nid = ge.src GROUP BY 1) p ON p.nid = c.nid)"""


@query("wl_colours", GEO + ", c0 AS (SELECT nid, ntype colour FROM gn)" + "".join(_WL.format(i, i + 1) for i in range(3)) + " SELECT nid, colour FROM c3")
def _(spark, d):
    """The operator's three rounds, in which a colour depends on more than direct neighbours."""
    g = views.g_geo(spark, d)
    return mine.wl_colours(g.nodes, g.edges.where("src <> dst").select("gid", "src", "dst").distinct(), 3, ("gid",)).select("nid", "colour")


@query("template_subset_coverage", PROV + """, t AS (SELECT ntype tpl_id, count(*) support, row_number() OVER (ORDER BY ntype)::INTEGER tpos FROM pn GROUP BY ntype), w AS (SELECT *, coalesce(sum(support) OVER (ORDER BY support DESC, tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b, sum(support) OVER () n FROM t)
 SELECT tpl_id, tpos, support FROM w WHERE b < 0.8 * n""")
def _(spark, d):
    """Node types stand for templates, their numbers of nodes for support."""
    from pyspark.sql.window import Window as W

    t = prov(spark, d).nodes.groupBy(F.col("ntype").alias("tpl_id")).agg(F.count(F.lit(1)).alias("support"))
    return mine.coverage_subset(t.withColumn("tpos", F.row_number().over(W.partitionBy().orderBy("tpl_id"))), 0.8).select("tpl_id", "tpos", "support")  # one row a type


# --- features ------------------------------------------------------------------------------------------------------------


def _tape(x: str, dim: int = 8, base: float = 10000.0) -> list[str]:
    return [f"{f}(ln(1 + greatest({x}, 0)) / {base ** (2 * i / dim)!r}::DOUBLE)" for i in range(dim // 2) for f in ("sin", "cos")]


_RATIO = [f"mu_{s} / greatest(cnt_{s}, 1)" for s in ("in", "out")]
_ENC = {"dual_naive": ["cnt_in", "cnt_out"], "rate": ["mu_in", "mu_out"], "rate_single": ["(mu_in + mu_out)"], "rate_ratio": ["cnt_in", "cnt_out", *_RATIO], "rate_ratio_only": _RATIO}


def _long(df: DataFrame) -> DataFrame:
    return df.select("gid", "nid", F.posexplode("vec").alias("i", "v")).select("gid", "nid", "i", _r("v"))


def _encoding(name: str):
    def f(spark, d):
        return _long(graph.degrees(prov(spark, d)).select("gid", "nid", features.encoding(name).alias("vec")))

    return f


for _name, _xs in _ENC.items():
    _cols = [t for x in _xs for t in _tape(x)]
    query("enc_" + _name, PROV + ", v AS (SELECT gid, nid, [" + ", ".join(_cols) + "] v FROM deg) SELECT gid, nid, (generate_subscripts(v, 1) - 1)::INTEGER i, round(unnest(v), 6) v FROM v")(_encoding(_name))


@query("enc_rate_rank", PROV + """, r AS (SELECT deg.gid, deg.nid, row_number() OVER (PARTITION BY deg.gid ORDER BY mu_in, npos) - 1 ri, row_number() OVER (PARTITION BY deg.gid ORDER BY mu_out, npos) - 1 ro, count(*) OVER (PARTITION BY deg.gid) n FROM deg JOIN pn ON pn.gid = deg.gid AND pn.nid = deg.nid)
 SELECT gid, nid, round(CASE WHEN n > 1 THEN ri / (n - 1) ELSE 0 END, 6) rank_in, round(CASE WHEN n > 1 THEN ro / (n - 1) ELSE 0 END, 6) rank_out FROM r""")
def _(spark, d):
    g = prov(spark, d)
    return features.with_ranks(g.nodes.join(graph.degrees(g), ["gid", "nid"])).select("gid", "nid", _r("rank_in"), _r("rank_out"))


@query("onehot", PROV + ", t AS (SELECT DISTINCT ntype FROM pn) SELECT gid, nid, (row_number() OVER (PARTITION BY gid, nid ORDER BY t.ntype) - 1)::INTEGER i, (t.ntype = pn.ntype)::INTEGER::DOUBLE v FROM pn, t")
def _(spark, d):
    n = prov(spark, d).nodes
    return _long(n.select("gid", "nid", features.onehot(F.col("ntype"), features.vocabulary(n)).alias("vec")))


_STRUCT = """, s AS (SELECT deg.gid, deg.nid, ln(1 + mu_in + mu_out) log_deg, mu_out / (mu_in + 1) out_in_ratio, (cnt_in + cnt_out > 0)::INTEGER / nt::DOUBLE nbr_type_div, coalesce(sl, 0)::DOUBLE self_loop
 FROM deg JOIN (SELECT gid, count(DISTINCT ntype) nt FROM pn GROUP BY 1) t USING (gid) LEFT JOIN (SELECT gid, src nid, count(*) sl FROM pe WHERE src = dst GROUP BY ALL) x ON x.gid = deg.gid AND x.nid = deg.nid)"""


@query("structural_cols", PROV + _STRUCT + " SELECT gid, nid, " + ", ".join(f"round({c}, 6) {c}" for c in features.STRUCTURAL) + " FROM s")
def _(spark, d):
    return features.structural(prov(spark, d)).select("gid", "nid", *[_r(c) for c in features.STRUCTURAL])


_ROBUST = ", q AS (SELECT gid, " + ", ".join(f"quantile_cont({c}, 0.25) {c}1, quantile_cont({c}, 0.5) {c}2, quantile_cont({c}, 0.75) {c}3" for c in features.STRUCTURAL) + " FROM s GROUP BY gid)"


@query("structural_robust", PROV + _STRUCT + _ROBUST + " SELECT gid, nid, " + ", ".join(f"round(({c} - {c}2) / CASE WHEN {c}3 - {c}1 < 1e-9 THEN 1 ELSE {c}3 - {c}1 END, 6) {c}" for c in features.STRUCTURAL) + " FROM s JOIN q USING (gid)")
def _(spark, d):
    return features.robust(features.structural(prov(spark, d)), features.STRUCTURAL).select("gid", "nid", *[_r(c) for c in features.STRUCTURAL])


@query("neighbour_diversity", PROV + """, a AS (SELECT DISTINCT gid, src nid, dst k FROM pe UNION SELECT gid, dst, src FROM pe), c AS (SELECT a.gid, a.nid, count(DISTINCT ntype) n FROM a JOIN pn ON pn.gid = a.gid AND pn.nid = k GROUP BY ALL), t AS (SELECT gid, count(DISTINCT ntype) nt FROM pn GROUP BY 1)
 SELECT pn.gid, pn.nid, round(coalesce(c.n, 0) / nt::DOUBLE, 6) nbr_type_div FROM pn JOIN t USING (gid) LEFT JOIN c ON c.gid = pn.gid AND c.nid = pn.nid""")
def _(spark, d):
    return features.structural(prov(spark, d), true_diversity=True).select("gid", "nid", _r("nbr_type_div"))


@query("mean_neighbours", PROV + """, b AS (SELECT gid, src nid, dst k FROM pe UNION ALL SELECT gid, dst, src FROM pe) SELECT b.gid, b.nid, round(avg(ln(1 + cnt_in)), 6) m0, round(avg(ln(1 + cnt_out)), 6) m1, round(avg(ln(1 + mu_in + mu_out)), 6) m2 FROM b JOIN deg ON deg.gid = b.gid AND deg.nid = b.k GROUP BY ALL""")
def _(spark, d):
    g = kept(prov(spark, d))
    f = graph.degrees(g).select("gid", "nid", F.array(F.log1p("cnt_in"), F.log1p("cnt_out"), F.log1p(F.col("mu_in") + F.col("mu_out"))).alias("vec"))
    return features.mean_neighbours(g, f).select("gid", "nid", *[F.round(F.get("vec", F.lit(i)), 6).alias(f"m{i}") for i in range(3)])


@query("document_vectors")
def _(spark, d):
    """Processes as documents: the types of their events in order."""
    e = kept(prov(spark, d)).edges.select(F.concat_ws("/", "gid", "src").alias("key"), F.col("eidx").alias("pos"), F.col("etype").alias("word"))
    words = e.join(e.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    vec = e.select("word").distinct().select("word", F.array(*[F.pmod(F.xxhash64(F.lit(i), "word"), F.lit(1000)) / 1000.0 for i in range(4)]).alias("vec"))
    return features.mean_of_words(words, vec, 4).select("key", F.posexplode("vec").alias("i", "v")).select("key", "i", _r("v"))


# --- detectors -----------------------------------------------------------------------------------------------------------

_EMB = """WITH e AS (SELECT vec_id, label grp, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) i FROM embeddings), n AS (SELECT vec_id, greatest(sqrt(sum(v * v)), 1e-12) n FROM e GROUP BY 1), u AS (SELECT e.vec_id, grp, i, v / n u FROM e JOIN n USING (vec_id)),
 m AS (SELECT grp, i, avg(u) m FROM u WHERE grp < 8 GROUP BY ALL), c AS (SELECT grp, i, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY grp)), 1e-12) c FROM m), s AS (SELECT u.vec_id, u.grp, c.grp cg, sum(u * c) s FROM u JOIN c USING (i) GROUP BY ALL),
 r AS (SELECT cg, greatest(quantile_cont(s, 0.05), 0.5) radius FROM s WHERE grp = cg GROUP BY cg), x AS (SELECT vec_id, any_value(s.grp) grp, 1 - max(s) score, bool_or(s >= radius) benign FROM s JOIN r USING (cg) GROUP BY vec_id)"""


def _scored(spark, d) -> DataFrame:
    e = views.embeddings(spark, d)
    return detect.score(e, detect.fit(e.where("grp < 8")))


@query("ensemble_fit", _EMB + " SELECT r.cg grp, round(radius, 6) radius, (i - 1)::INTEGER i, round(c, 6) c FROM r JOIN c ON c.grp = r.cg")
def _(spark, d):
    x = detect.fit(views.embeddings(spark, d).where("grp < 8")).experts
    return x.select("grp", "radius", F.posexplode("centroid").alias("i", "c")).select("grp", _r("radius"), "i", _r("c"))


@query("ensemble_scores", _EMB + " SELECT vec_id, round(score, 6) score FROM x")
def _(spark, d):
    return _scored(spark, d).select("vec_id", _r("score"))


@query("ensemble_predict", _EMB + " SELECT vec_id, (NOT benign) is_alert FROM x")
def _(spark, d):
    return _scored(spark, d).select("vec_id", (~F.col("benign")).alias("is_alert"))


@query("op_threshold", _EMB + " SELECT round(quantile_cont(score, 0.95), 6) threshold FROM x WHERE grp < 8")
def _(spark, d):
    return detect.operating_point(_scored(spark, d).where("grp < 8")).select(_r("threshold"))


@query("mahalanobis")
def _(spark, d):
    e = views.embeddings(spark, d)
    return detect.mahalanobis(e.where("grp < 8"), e).select("vec_id", _r("distance", 4))


@query("leave_one_out", """WITH e AS (SELECT vec_id, label grp, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) i FROM embeddings), n AS (SELECT vec_id, greatest(sqrt(sum(v * v)), 1e-12) n FROM e GROUP BY 1), u AS (SELECT e.vec_id, grp, i, v / n u FROM e JOIN n USING (vec_id)),
 m AS (SELECT grp, i, avg(u) m FROM u GROUP BY ALL), c AS (SELECT grp, i, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY grp)), 1e-12) c FROM m), s AS (SELECT u.vec_id, u.grp, c.grp cg, sum(u * c) s FROM u JOIN c USING (i) WHERE c.grp <> u.grp GROUP BY ALL), x AS (SELECT vec_id, grp, 1 - max(s) sc FROM s GROUP BY ALL) SELECT grp, round(avg(sc), 6) mean_score FROM x GROUP BY grp""")
def _(spark, d):
    """Every group of the table is left out once; the experts of all others score it."""
    e = views.embeddings(spark, d)
    groups = [r.grp for r in e.where("grp IS NOT NULL").select("grp").distinct().orderBy("grp").collect()]  # one job each
    experts = cut(detect.fit(e).experts, "experts")  # an expert is its own group's: the model without a group is the others
    out = alerts.leave_one_out(groups, lambda gs: detect.Ensemble(experts.where(F.col("grp").isin(gs))), lambda m, g: detect.score(e.where(F.col("grp") == g), m).groupBy("grp").agg(F.round(F.avg("score"), 6).alias("mean_score")))
    return reduce_(DataFrame.unionByName, out.values()) if out else e.select("grp", F.lit(0.0).alias("mean_score")).limit(0)


# --- metrics -------------------------------------------------------------------------------------------------------------

_M = "WITH m AS (SELECT vec_id pos, round(embedding[1]::DOUBLE, 2) score, (label >= 8)::INTEGER y, label FROM embeddings)"
_CURVE = _M + """, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) rn, sum(y) OVER (ORDER BY score DESC, pos) tp, sum(y) OVER () p, count(*) OVER () n FROM m),
 c AS (SELECT rn, score, tp::BIGINT tp, (rn - tp)::BIGINT fp, tp / rn::DOUBLE pr, tp / p::DOUBLE re, (rn - tp) / (n - p)::DOUBLE fpr, (tp * (n - p - rn + tp) - (rn - tp) * (p - tp))::DOUBLE / nullif(sqrt(rn::DOUBLE) * sqrt(p::DOUBLE) * sqrt((n - p)::DOUBLE) * sqrt((n - rn)::DOUBLE), 0) mcc FROM k),
 d AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END f1 FROM c)"""


def _m(spark, d) -> DataFrame:
    e = views.embeddings(spark, d)
    return e.select(F.col("vec_id").alias("pos"), F.round(F.get("vec", F.lit(0)), 2).alias("score"), (F.col("grp") >= 8).cast("int").alias("y"), F.col("grp").alias("label"))


_CONF = _M + """, p AS (SELECT label, count(*) FILTER (score > 0 AND y = 1) tp, count(*) FILTER (score > 0 AND y = 0) fp, count(*) FILTER (score <= 0 AND y = 1) fn, count(*) FILTER (score <= 0 AND y = 0) tn FROM m GROUP BY label),
 t AS (SELECT sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn, sum(tn)::BIGINT tn FROM p)"""
_RATES = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6) \"precision\", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 6) recall, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn)::DOUBLE END, 6) fpr"


@query("confusion", _CONF + f" SELECT label, tp, fp, fn, tn, {_RATES} FROM p")
def _(spark, d):
    c = metrics.confusion(_m(spark, d).withColumn("pred", (F.col("score") > 0).cast("int")), ("label",))
    return c.select("label", *[F.col(x).cast("bigint").alias(x) for x in ("tp", "fp", "fn", "tn")], _r("precision"), _r("recall"), _r("fpr"))


@query("confusion_micro", _CONF + f" SELECT tp, fp, fn, tn, {_RATES} FROM t")
def _(spark, d):
    c = metrics.micro(metrics.confusion(_m(spark, d).withColumn("pred", (F.col("score") > 0).cast("int")), ("label",)))
    return c.select(*[F.col(x).cast("bigint").alias(x) for x in ("tp", "fp", "fn", "tn")], _r("precision"), _r("recall"), _r("fpr"))


@query("precision_at_k", _CURVE + " SELECT k::INTEGER k, round((SELECT avg(y) FROM k WHERE rn <= x.k), 6) \"precision\" FROM (VALUES (10), (50), (100)) x(k)")
def _(spark, d):
    return metrics.precision_at_k(_m(spark, d)).select("k", _r("precision"))


@query("pr_curve", _CURVE + " SELECT rn, tp, fp, round(pr, 6) \"precision\", round(re, 6) recall, round(f1, 6) f1, round(fpr, 6) fpr, round(coalesce(mcc, 0), 6) mcc FROM d")
def _(spark, d):
    return metrics.curve(_m(spark, d)).select(F.col("rn").cast("bigint").alias("rn"), "tp", "fp", *[_r(c) for c in ("precision", "recall", "f1", "fpr", "mcc")])


@query("best_f1", _CURVE + " SELECT round(max(f1), 6) f1 FROM d")
def _(spark, d):
    return metrics.best_f1(_m(spark, d)).select(_r("f1"))


@query("mcc_best", _CURVE + " SELECT round(max(coalesce(mcc, 0)), 6) mcc FROM d")
def _(spark, d):
    return metrics.best_mcc(_m(spark, d)).select(_r("mcc"))


@query("tpr_at_fpr", _CURVE + " SELECT l::DOUBLE \"limit\", round(coalesce((SELECT max_by(re, rn) FROM d WHERE fpr <= l), 0), 6) tpr FROM (VALUES (0.001), (0.01), (0.05)) x(l)")
def _(spark, d):
    return metrics.tpr_at_fpr(_m(spark, d)).select("limit", _r("tpr"))


@query("roc_auc_stable", _M + ", r AS (SELECT y, row_number() OVER (ORDER BY score, pos) rk FROM m) SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) auc FROM r")
def _(spark, d):
    return metrics.roc_auc(_m(spark, d), "stable").select(_r("auc"))


@query("roc_auc_zero", _M + ", r AS (SELECT y, row_number() OVER (ORDER BY score, pos) - 1 rk FROM m) SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) auc FROM r")
def _(spark, d):
    return metrics.roc_auc(_m(spark, d), "zero").select(_r("auc"))


@query("top_k_table", _CURVE + " SELECT k::INTEGER k, tp, round(pr, 6) \"precision\", round(re, 6) recall, round(f1, 6) f1, score threshold FROM d JOIN (SELECT x.k, least(x.k, (SELECT count(*) FROM m)) n FROM (VALUES (10), (50), (100), (500), (1000)) x(k)) ON rn = n")
def _(spark, d):
    return metrics.top_k_table(_m(spark, d)).select("k", "tp", _r("precision"), _r("recall"), _r("f1"), "threshold")


@query("thinned_curve", _CURVE + " SELECT rn, round(pr, 6) \"precision\", round(re, 6) recall FROM d WHERE (rn - 1) % greatest(1, (SELECT count(*) // 100 FROM m)) = 0 OR rn = (SELECT count(*) FROM m)")
def _(spark, d):
    return metrics.thinned_curve(_m(spark, d), 100).select(F.col("rn").cast("bigint").alias("rn"), _r("precision"), _r("recall"))


@query("feature_zeroed", PROV + _STRUCT + " SELECT gid, nid, round(log_deg, 6) log_deg, 0.0::DOUBLE out_in_ratio, round(nbr_type_div, 6) nbr_type_div, round(self_loop, 6) self_loop FROM s")
def _(spark, d):
    return metrics.zeroed(features.structural(prov(spark, d)), "out_in_ratio").select("gid", "nid", *[_r(c) for c in features.STRUCTURAL])


@query("as_benign_confusion", _CONF + " SELECT label, 0::BIGINT tp, tp + fp fp, 0::BIGINT fn, tn + fn tn FROM p")
def _(spark, d):
    c = metrics.confusion(metrics.as_benign(_m(spark, d)).withColumn("pred", (F.col("score") > 0).cast("int")), ("label",))
    return c.select("label", *[F.col(x).cast("bigint").alias(x) for x in ("tp", "fp", "fn", "tn")])


@query("roc_auc_ties", _M + ", r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 rk FROM m) SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2)::DOUBLE / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) auc FROM r")
def _(spark, d):
    return metrics.roc_auc(_m(spark, d), "average").select(_r("auc"))


@query("pr_auc", _CURVE + ", z AS (SELECT (re - lag(re) OVER (ORDER BY rn)) * (pr + lag(pr) OVER (ORDER BY rn)) / 2 a FROM d) SELECT round(sum(a), 6) auc FROM z")
def _(spark, d):
    return metrics.pr_auc(_m(spark, d)).select(_r("auc"))


@query("metric_summary", _M + " SELECT label, round(avg(score), 6) mean, round(stddev_pop(score), 6) std FROM m GROUP BY 1")
def _(spark, d):
    return metrics.summary_by(_m(spark, d), ["label"], "score").select("label", _r("mean"), _r("std"))


@query("score_stats", _M + " SELECT round(quantile_cont(score, 0.95), 6) p95, round(quantile_cont(score, 0.99), 6) p99, max(score) max, round(avg((score >= 0.1)::INTEGER), 6) share FROM m")
def _(spark, d):
    return metrics.score_stats(_m(spark, d), 0.1).select(_r("p95"), _r("p99"), "max", _r("share"))


@query("attacks_found", _M + " SELECT label attack, bool_or(score > 0.2) found FROM m GROUP BY 1")
def _(spark, d):
    return metrics.attacks_found(_m(spark, d).withColumn("attacks", F.array("label")), 0.2)


# --- alerts --------------------------------------------------------------------------------------------------------------


def _node_scores(spark, d) -> tuple[views.Graph, DataFrame]:
    g = kept(prov(spark, d))
    s = g.nodes.join(graph.degrees(g), ["gid", "nid"]).select("gid", "nid", "npos", F.col("label").alias("y"), F.log1p(F.col("mu_in") + F.col("mu_out")).alias("score"))
    return g, s


@query("alert_components", """WITH z AS (SELECT 'n' || n_nationkey nid, n_regionkey r FROM nation UNION ALL SELECT 'r' || n_regionkey, n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT DISTINCT nid, min(nid) OVER (PARTITION BY r) comp FROM z""")
def _(spark, d):
    """Customers and suppliers hang on nations, nations on regions: labels go over four hops."""
    g = views.g_geo(spark, d)
    used = g.edges.select("gid", F.explode(F.array("src", "dst")).alias("nid")).distinct()
    return alerts.components(g.edges, used).select("nid", "comp")


@query("alert_clusters")
def _(spark, d):
    g, s = _node_scores(spark, d)
    return alerts.clusters(s, g.edges).select("gid", "rank", "seed_nid", "nid", _r("agg"))


@query("alert_seeds_only", PROV + """, s AS (SELECT deg.gid, deg.nid, npos, ln(1 + mu_in + mu_out) score FROM deg JOIN pn ON pn.gid = deg.gid AND pn.nid = deg.nid), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, npos) rank FROM s) SELECT gid, rank::INTEGER rank, nid, round(score, 6) agg FROM r WHERE rank <= 20""")
def _(spark, d):
    g, s = _node_scores(spark, d)
    return alerts.clusters(s, g.edges, expand=False).select("gid", F.col("rank").cast("int").alias("rank"), "nid", _r("agg"))


@query("alert_metrics")
def _(spark, d):
    g, s = _node_scores(spark, d)
    return alerts.alert_metrics(alerts.clusters(s, g.edges), s)


@query("alert_totals")
def _(spark, d):
    g, s = _node_scores(spark, d)
    return alerts.alert_totals(alerts.alert_metrics(alerts.clusters(s, g.edges), s))


@query("alerts_uncapped")
def _(spark, d):
    g, s = _node_scores(spark, d)
    return alerts.uncapped(s, g.edges).select("gid", "comp", "nid", _r("agg"))


@query("orig_unit", PROV + """, pi AS (SELECT gid, nid, label, CASE WHEN ntype = 'process' THEN 'P' ELSE nid END new_nid FROM pn) SELECT gid, sum(label)::BIGINT n_orig, sum((label = 1 AND nid = new_nid)::INTEGER)::BIGINT n_kept, sum((label = 1 AND new_nid = 'P')::INTEGER)::BIGINT orig_covered, sum((new_nid = 'P')::INTEGER)::BIGINT "load",
 round(CASE WHEN coalesce(sum(label), 0) = 0 OR sum((label = 1 AND new_nid = 'P')::INTEGER) = 0 THEN 0 ELSE 2 * (sum((label = 1 AND new_nid = 'P')::INTEGER) / sum(label)) / (1 + sum((label = 1 AND new_nid = 'P')::INTEGER) / sum(label)) END, 6)::DOUBLE F1_orig FROM pi GROUP BY gid""")
def _(spark, d):
    n = prov(spark, d).nodes
    pi = n.select("gid", "nid", F.when(F.col("ntype") == "process", "P").otherwise(F.col("nid")).alias("new_nid"))
    m = alerts.orig_metrics(n.select("gid", F.lit("P").alias("nid"), F.lit(1).alias("rank")).distinct(), n, pi)
    return m.select("gid", *[F.col(c).cast("bigint").alias(c) for c in ("n_orig", "n_kept", "orig_covered", "load")], _r("F1_orig"))


@query("degree_distortion", PROV + _DEDUP + """, d2 AS (SELECT gid, nid, sum(i)::BIGINT ci, sum(o)::BIGINT co FROM (SELECT gid, dst nid, 1 i, 0 o FROM q UNION ALL SELECT gid, src, 0, 1 FROM q) GROUP BY ALL), x AS (SELECT pn.gid, greatest(abs(coalesce(deg.cnt_in, 0) - coalesce(ci, 0)), abs(coalesce(deg.cnt_out, 0) - coalesce(co, 0))) w FROM pn LEFT JOIN deg ON deg.gid = pn.gid AND deg.nid = pn.nid LEFT JOIN d2 ON d2.gid = pn.gid AND d2.nid = pn.nid WHERE label = 1)
 SELECT gid, sum((w > 0)::INTEGER)::BIGINT n_boundary, max(w)::BIGINT worst FROM x GROUP BY gid""")
def _(spark, d):
    g = prov(spark, d)
    r = reduce.edge_dedup(g)
    return alerts.degree_distortion(graph.degrees(g), graph.degrees(r.graph), g.nodes, r.node_map)


@query("kept_slots", PROV + "SELECT gid, nid FROM pn WHERE ntype <> 'process'")
def _(spark, d):
    n = prov(spark, d).nodes
    pi = n.select("gid", "nid", F.when(F.col("ntype") == "process", "P").otherwise(F.col("nid")).alias("new_nid"))
    return alerts.kept_only(n, pi).select("gid", "nid")


# --- statistics over paired results --------------------------------------------------------------------------------------

_PAIR = """WITH a AS (SELECT config, file, avg(DISTINCT F1_alert) v FROM e6_alert_full GROUP BY ALL), b AS (SELECT config, file, avg(DISTINCT F1_alert) v FROM e6_alert_full_v3 GROUP BY ALL), p AS (SELECT a.config, a.file, a.v a, b.v b, b.v - a.v d FROM a JOIN b ON a.config = b.config AND a.file = b.file)"""


def _slots(spark, d, name: str) -> DataFrame:
    """One row a slot (config, file): repeated rows count once, of differing ones the mean of the distinct values."""
    return table(spark, d, name).groupBy("config", "file").agg(F.expr("avg(DISTINCT F1_alert)").alias("v"))


def _pair(spark, d) -> DataFrame:
    return stats.paired(_slots(spark, d, "e6_alert_full"), _slots(spark, d, "e6_alert_full_v3"), ["config", "file"], "v")


@query("paired_diff", _PAIR + " SELECT config, file, round(d, 6) d FROM p")
def _(spark, d):
    return _pair(spark, d).select("config", "file", _r("d"))


@query("win_tie_loss", _PAIR + " SELECT count(*) FILTER (d > 1e-12) wins, count(*) FILTER (abs(d) <= 1e-12) ties, count(*) FILTER (d < -1e-12) losses, round(avg(d), 6) mean, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) ELSE 0 END, 6) effect FROM p")
def _(spark, d):
    return stats.win_tie_loss(_pair(spark, d)).select("wins", "ties", "losses", _r("mean"), _r("effect"))


@query("full_match", _PAIR + """ SELECT coalesce(a.config, b.config) config, coalesce(a.file, b.file) file, round(a.v, 6) "old", round(b.v, 6) "new", CASE WHEN b.k IS NULL THEN 'only_old' WHEN a.k IS NULL THEN 'only_new' WHEN abs(a.v - b.v) <= 1e-9 OR (a.v IS NULL AND b.v IS NULL) THEN 'same' ELSE 'changed' END status
 FROM (SELECT *, 1 k FROM a) a FULL JOIN (SELECT *, 1 k FROM b) b ON a.config = b.config AND a.file = b.file""")
def _(spark, d):
    x = stats.full_match(_slots(spark, d, "e6_alert_full"), _slots(spark, d, "e6_alert_full_v3"), ["config", "file"], "v")
    return x.select("config", "file", _r("old"), _r("new"), "status")


@query("outer_scores", PROV + "SELECT pn.gid, pn.nid, coalesce(round(ln(1 + mu_in + mu_out), 6), -1e9) score FROM pn LEFT JOIN deg ON deg.gid = pn.gid AND deg.nid = pn.nid AND cnt_out > 0")
def _(spark, d):
    """Nodes that do something have a score; the others the default."""
    g = kept(prov(spark, d))
    s = graph.degrees(g).where("cnt_out > 0").select("gid", "nid", F.round(F.log1p(F.col("mu_in") + F.col("mu_out")), 6).alias("score"))
    return stats.outer_scores(g.nodes.select("gid", "nid"), s, ["gid", "nid"])


@query("picked_rows", """SELECT config, file, TRY_CAST(F1_alert AS DOUBLE) F1_alert, TRY_CAST(operator AS DOUBLE) operator FROM e6_alert_full WHERE is_attack::VARCHAR IN ('1', 'true')""")
def _(spark, d):
    t = table(spark, d, "e6_alert_full")
    yes = "true" if dict(t.dtypes)["is_attack"] == "boolean" else "1"
    return metrics.pick(t, {"is_attack": yes}, ("F1_alert", "operator")).select("config", "file", "F1_alert", "operator")


@query("paired_tests")
def _(spark, d):
    p = cut(_pair(spark, d), "pairs")
    a, b, q = stats.mcnemar(p.select((F.col("a") > 0.4).cast("int").alias("x"), (F.col("b") > 0.4).cast("int").alias("y")), "x", "y")
    mean, lo, hi = stats.bootstrap_mean(p, 20_000)
    _, clo, chi = stats.bootstrap_mean(p, 10_000, 0.9, cluster="config")
    rows = [("wilcoxon", stats.wilcoxon(p)), ("tost", stats.tost(p, 0.05)), ("mcnemar", q), ("only_a", float(a)), ("only_b", float(b)), ("mean", mean), ("low", lo), ("high", hi), ("cluster_low", clo), ("cluster_high", chi)]
    return p.sparkSession.createDataFrame([(k, None if v != v else float(v)) for k, v in rows], "stat string, value double")


# --- sources -------------------------------------------------------------------------------------------------------------


#: DuckDB's own reading of the records: JSON functions, wrappers taken off column by column.
_WRAP = "'array', 'map', 'string', 'long', 'int', 'bytes'"


def _step(c):
    k = f"json_keys({c})[1]"
    return f"CASE WHEN json_type({c}) = 'OBJECT' AND len(json_keys({c})) = 1 AND ({k} IN ({_WRAP}) OR contains({k}, '.')) THEN json_extract({c}, '$.\"' || {k} || '\"') ELSE {c} END"


def _unwrap(name, source, cols, keep, times=4):
    """CTEs name1..name<times> that take the wrappers off the JSON columns."""
    out, prev = [], source
    for i in range(1, times + 1):
        out.append(f"{name}{i} AS MATERIALIZED (SELECT {', '.join(keep + [f'{_step(c)} AS {c}' for c in cols])} FROM {prev})")
        prev = f"{name}{i}"
    return ",\n".join(out)


_DOT = "CASE WHEN json_type(d) = 'OBJECT' AND len(json_keys(d)) = 1 AND contains(json_keys(d)[1], '.') THEN string_split(json_keys(d)[1], '.')[-1] ELSE k END"


def _datum():
    """Off with the datum's wrappers, and into JSON held as text; the innermost dotted key names the kind."""
    out, prev = [], "o4"
    for i in range(1, 7):
        inner = f"CASE WHEN json_type(d) = 'VARCHAR' AND json_valid(d->>'$') THEN (d->>'$')::JSON ELSE {_step('d')} END"
        out.append(f"d{i} AS MATERIALIZED (SELECT rec_id, file_name, t, h, {_DOT} AS k, {inner} AS d FROM {prev})")
        prev = f"d{i}"
    return ",\n".join(out)


_FIELDS = ("uuid", "type", "subject", "predicateObject", "timestampNanos", "subjectType", "hostId", "path", "filename", "cmdLine", "localAddress", "localPort", "remoteAddress", "remotePort")
_KIND = "CASE t->>'$' " + " ".join(f"WHEN 'RECORD_{u}' THEN '{k}'" for u, k in (("EVENT","Event"),("SUBJECT","Subject"),("FILE_OBJECT","FileObject"),("NET_FLOW_OBJECT","NetFlowObject"),("UNIT","Unit"),("PRINCIPAL","Principal"),("SRC_SINK_OBJECT","SrcSinkObject"),("IPC_OBJECT","IpcObject"))) + " END"
_CDM = f"""WITH o0 AS MATERIALIZED (SELECT rec_id, file_name, json_extract(j, '$.type') t, json_extract(j, '$.hostId') h, json_extract(j, '$.datum') d, NULL::VARCHAR k FROM (SELECT rec_id, file_name, CASE WHEN json_valid(raw) THEN raw::JSON END j FROM tccdmdatum WHERE raw IS NOT NULL AND trim(raw) <> '') WHERE json_type(j) = 'OBJECT'),
{_unwrap('o', 'o0', ['t', 'h'], ['rec_id', 'file_name', 'd', 'k'])},
{_datum()},
b0 AS MATERIALIZED (SELECT rec_id, file_name, coalesce(k, {_KIND}) kind, h->>'$' host, {', '.join(f"json_extract(d, '$.{f}') f_{f}" for f in _FIELDS)} FROM d6 WHERE json_type(d) = 'OBJECT'),
{_unwrap('b', 'b0', [f'f_{f}' for f in _FIELDS], ['rec_id', 'file_name', 'kind', 'host'])},
c AS MATERIALIZED (SELECT rec_id, file_name, kind, host, {', '.join(f"CASE WHEN json_type(f_{f}) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE f_{f}->>'$' END {f}" for f in _FIELDS)} FROM b4 WHERE kind IN ('Event', 'Subject', 'FileObject', 'NetFlowObject', 'Unit', 'Principal', 'SrcSinkObject', 'IpcObject')),
r AS MATERIALIZED (SELECT * FROM c QUALIFY uuid IS NULL OR row_number() OVER (PARTITION BY kind, lower(uuid) ORDER BY rec_id) = 1)
"""

def _own(c: str) -> str:
    return f"CASE lower(trim({c})) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in {**TYPE_NAMES, **cdm.OBJECT_TYPES}.items()) + f" ELSE lower(trim({c})) END"


#: Records of hosts whose name begins with one of these, or that name no host.
_HOSTS = "01234567"
_EVENTS = f""", ev AS (SELECT rec_id, lower(subject) src, lower(predicateObject) dst, {_ET.replace("etype", '"type"')} etype, coalesce(try_cast(timestampNanos AS BIGINT), 0) ts, coalesce(nullif({_own("subjectType")}, ''), 'process') st FROM r WHERE kind = 'Event' AND subject <> '' AND predicateObject <> '' {{0}}),
 df AS (SELECT lower(uuid) nid, rec_id * 3 pos, CASE WHEN kind = 'Subject' THEN 'process' ELSE coalesce(nullif({_own('"type"')}, ''), 'object') END t, kind <> 'Subject' up FROM r WHERE kind <> 'Event' AND uuid <> '' {{0}}
        UNION ALL SELECT src, rec_id * 3 + 1, st, false FROM ev UNION ALL SELECT dst, rec_id * 3 + 2, 'object', false FROM ev)"""
_NODES = " SELECT '{1}' gid, nid, min(pos) npos, CASE WHEN arg_min(t, pos) = 'object' THEN coalesce(arg_min(t, pos) FILTER (up AND t <> 'object'), 'object') ELSE arg_min(t, pos) END ntype, 0 AS label FROM df GROUP BY nid"
_EDGES = " SELECT '{1}' gid, rec_id eidx, src, dst, etype, ts, 1.0::DOUBLE mu FROM ev"
_OF_HOSTS = f"AND (host IS NULL OR host = '' OR contains('{_HOSTS}', left(host, 1)))"


def _hosts(t: DataFrame) -> list[str]:
    """Host names (a few hundred) that begin so."""
    h = t.select(F.explode(F.regexp_extract_all("raw", F.lit('(?i)"hostId[\\\\"]*\\s*:[^0-9a-f]{0,80}?([0-9a-f]{8}-[0-9a-f-]{27})'), F.lit(1))).alias("h")).distinct()
    return [r.h for r in h.collect() if r.h[0] in _HOSTS]


@query("cdm_nodes", _CDM + (_EVENTS + _NODES).format("", "cdm"))
def _(spark, d):
    return cdm.load(table(spark, d, "tccdmdatum")).nodes


@query("cdm_edges", _CDM + (_EVENTS + _EDGES).format("", "cdm"))
def _(spark, d):
    return cdm.load(table(spark, d, "tccdmdatum")).edges


@query("cdm_nodes_of_hosts", _CDM + (_EVENTS + _NODES).format(_OF_HOSTS, "cdm"))
def _(spark, d):
    t = table(spark, d, "tccdmdatum")
    return cdm.load(t, hosts=_hosts(t)).nodes


@query("cdm_edges_of_hosts", _CDM + (_EVENTS + _EDGES).format(_OF_HOSTS, "cdm"))
def _(spark, d):
    t = table(spark, d, "tccdmdatum")
    return cdm.load(t, hosts=_hosts(t)).edges


@query("cdm_graph_sizes", _CDM.replace("PARTITION BY kind, lower(uuid)", "PARTITION BY file_name, kind, lower(uuid)") + _EVENTS.format("").replace("rec_id, lower(subject)", "file_name, rec_id, lower(subject)").replace("SELECT lower(uuid) nid", "SELECT file_name, lower(uuid) nid").replace("SELECT src, rec_id", "SELECT file_name, src, rec_id").replace("SELECT dst, rec_id", "SELECT file_name, dst, rec_id") + """ SELECT n.file_name gid, n_nodes, n_edges FROM (SELECT file_name, count(DISTINCT nid) n_nodes FROM df GROUP BY 1) n JOIN (SELECT file_name, count(*) n_edges FROM ev GROUP BY 1) e USING (file_name)""")
def _(spark, d):
    """One graph a file."""
    g = cdm.load(table(spark, d, "tccdmdatum"), gid=None)
    return graph.graph_stats(g).select("gid", "n_nodes", "n_edges")


_STORE = """, n AS (SELECT lower(uuid) node_uuid, kind, sha256(lower(uuid)) hash_id, row_number() OVER (ORDER BY CASE kind WHEN 'NetFlowObject' THEN 0 WHEN 'Subject' THEN 1 ELSE 2 END, rec_id) - 1 index_id FROM r WHERE uuid IS NOT NULL AND kind IN ('Subject', 'FileObject', 'NetFlowObject'))"""


@query("store_nodes", _CDM + _STORE + " SELECT node_uuid, kind, hash_id, index_id FROM n")
def _(spark, d):
    return cdm.store(table(spark, d, "tccdmdatum"))["nodes"]


@query("store_events", _CDM + _STORE + f""", e AS (SELECT lower(uuid) event_uuid, "type" operation, lower(subject) s, lower(predicateObject) o, try_cast(timestampNanos AS BIGINT) "timestamp", "type" IN ({', '.join(f"'{x}'" for x in cdm.READ_LIKE)}) b FROM r WHERE kind = 'Event' AND uuid IS NOT NULL AND "type" NOT IN ({', '.join(f"'{x}'" for x in cdm.LEFT_OUT)})),
 ob AS (SELECT node_uuid, arg_min((hash_id, index_id), CASE kind WHEN 'FileObject' THEN 0 WHEN 'NetFlowObject' THEN 1 ELSE 2 END) x FROM n GROUP BY 1)
 SELECT CASE WHEN b THEN ob.x[1] ELSE n.hash_id END src_hash, CASE WHEN b THEN ob.x[2] ELSE n.index_id END src_index, operation, CASE WHEN b THEN n.hash_id ELSE ob.x[1] END dst_hash, CASE WHEN b THEN n.index_id ELSE ob.x[2] END dst_index, event_uuid, "timestamp"
 FROM e JOIN n ON n.node_uuid = s AND n.kind = 'Subject' JOIN ob ON ob.node_uuid = o WHERE "timestamp" IS NOT NULL""")
def _(spark, d):
    return cdm.store(table(spark, d, "tccdmdatum"))["event"]


_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


@query("scan_files", f"""WITH i AS (SELECT file_name, unnest(regexp_extract_all(lower(raw), '{_UUID}')) nid FROM tccdmdatum), h AS (SELECT file_name, count(DISTINCT nid) n_hits FROM i WHERE nid IN (SELECT lower(trim(uuid)) FROM gt_nodes) GROUP BY 1),
 t AS (SELECT file_name, count(raw) n_records, min(x) ts_lo, max(x) ts_hi FROM (SELECT file_name, raw, try_cast(nullif(regexp_extract(raw, '"timestampNanos[\\\\"]*:\\s*(?:\\{{[\\\\"]*long[\\\\"]*:\\s*)?(\\d+)', 1), '') AS BIGINT) x FROM tccdmdatum) GROUP BY 1)
 SELECT t.file_name, n_records, ts_lo, ts_hi, coalesce(n_hits, 0) n_hits FROM t LEFT JOIN h USING (file_name)""")
def _(spark, d):
    """Records, times and labelled nodes of each file."""
    return files.scan(table(spark, d, "tccdmdatum"), views.ground_truth(table(spark, d, "gt_nodes"))).select("file_name", "n_records", "ts_lo", "ts_hi", "n_hits")


@query("max_loss", "SELECT vec_id node, max(v) loss FROM (SELECT vec_id, unnest(embedding)::DOUBLE v FROM embeddings) GROUP BY 1")
def _(spark, d):
    e = views.embeddings(spark, d)
    return files.max_loss(e.select(F.col("vec_id").alias("node"), F.explode("vec").alias("loss")), e.select(F.col("vec_id").alias("node")))


# --- end to end ----------------------------------------------------------------------------------------------------------


@query("flagship")
def _(spark, d):
    """Day graphs -> merged edges -> rate-ratio features -> ensemble of even days -> scores of odd days -> top 20 nodes a day."""
    from ..operators.order import numbered

    g = views.g_events(spark, d)
    r = reduce.edge_dedup(g)
    vocab = features.vocabulary(g.nodes)
    f = cut(features.features(r.graph, "rate_ratio", vocab), "features")
    even = F.pmod(F.substring("gid", 9, 2).cast("int"), F.lit(2)) == 0
    m = detect.fit(f.where(even), group="gid")
    s = detect.score(f.where(~even), m)
    top = numbered(s.select("gid", "nid", "npos", "score"), [F.desc("score"), "npos"], ["gid"]).where("rn <= 20")
    return top.select("gid", F.col("rn").cast("int").alias("rank"), "nid", _r("score"))


@query("pipeline_alerts")
def _(spark, d):
    """Templates of the benign graphs -> collapse -> features -> detector -> ranked alerts, of the audit graphs."""
    from .. import pipeline

    r = pipeline.run(prov(spark, d), pipeline.Options(operator="template", encoding="rate_ratio", min_support=3, context_k=2))
    return r.alerts.select("gid", "rank", "seed_nid", "nid", _r("agg"))

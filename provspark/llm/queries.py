"""Queries of the training-data problems of this subpackage, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import TYPE_NAMES
from ..functions.tables import table
from ..plans.registry import query as registered
from . import mixing, patterns, runs, spans, tokens

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    return registered(name, sql, QUERIES, ORACLES)


# --- problem 3: frequent subsequences ------------------------------------------------------------------------------------


_TYPE = "CASE lower(trim(type)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_NAMES.items()) + " ELSE lower(trim(type)) END"
_STEPS = f"""
WITH e AS (SELECT DISTINCT gid, eidx, ts, lower(trim(src)) src, lower(trim(dst)) dst, CASE WHEN coalesce(trim(etype), '') = '' THEN 'event' ELSE regexp_replace(lower(trim(etype)), '^event_', '') END etype
           FROM edges WHERE gid IS NOT NULL AND eidx IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL AND ts <> 0),
     t AS (SELECT gid, lower(trim(nid)) nid, arg_min(t, npos) t FROM (SELECT gid, nid, npos, {_TYPE} t FROM nodes) WHERE t <> '' AND t <> 'object' GROUP BY ALL),
     q AS (SELECT e.gid, src, row_number() OVER (PARTITION BY e.gid, src ORDER BY ts, eidx) i, etype || ':' || coalesce(t, 'unknown') step FROM e LEFT JOIN t ON t.gid = e.gid AND t.nid = dst),
     c AS (SELECT greatest(12, ceil(0.06::DECIMAL(3, 2) * count(*))) least FROM (SELECT DISTINCT gid, src FROM q)),
     l1 AS MATERIALIZED (SELECT gid, src, [step] p, min(i) i FROM q WHERE step IN (SELECT step FROM q GROUP BY step HAVING count(DISTINCT (gid, src)) >= (SELECT least FROM c)) GROUP BY gid, src, step),
     f AS MATERIALIZED (SELECT * FROM q WHERE [step] IN (SELECT p FROM l1))""" + "".join(f""",
     m{k} AS MATERIALIZED (SELECT l.gid, l.src, list_append(p, step) p, min(f.i) i FROM l{k - 1} l JOIN f ON f.gid = l.gid AND f.src = l.src AND f.i > l.i WHERE NOT list_contains(p, step) GROUP BY l.gid, l.src, p, step),
     l{k} AS MATERIALIZED (SELECT * FROM m{k} WHERE p IN (SELECT p FROM m{k} GROUP BY p HAVING count(*) >= (SELECT least FROM c)))""" for k in range(2, 6))


@query("p3_found", _STEPS + " SELECT DISTINCT array_to_string(p, ' > ') pattern FROM (SELECT p FROM l3 UNION ALL SELECT p FROM l4 UNION ALL SELECT p FROM l5)")
def p3_found(spark, d):
    return patterns.frequent_patterns(table(spark, d, "edges"), table(spark, d, "nodes")).select("pattern")


@query("p3_patterns")
def p3_patterns(spark, d):
    return patterns.frequent_patterns(table(spark, d, "edges"), table(spark, d, "nodes"), min_len=1)


# --- problem 4: runs of events -------------------------------------------------------------------------------------------

_RUNS = """
WITH e AS (SELECT DISTINCT gid, eidx, ts, lower(trim(src)) src, lower(trim(dst)) dst,
             CASE WHEN coalesce(trim(etype), '') = '' THEN 'event' ELSE regexp_replace(lower(trim(etype)), '^event_', '') END etype
           FROM edges WHERE gid IS NOT NULL AND eidx IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL AND ts <> 0),
     l AS (SELECT *, CASE WHEN lag(dst) OVER w = dst AND lag(etype) OVER w = etype AND ts - lag(ts) OVER w <= 60000000000 THEN 0 ELSE 1 END fresh
           FROM e WINDOW w AS (PARTITION BY gid, src ORDER BY ts, eidx)),
     r AS (SELECT *, sum(fresh) OVER (PARTITION BY gid, src ORDER BY ts, eidx) run FROM l),
     g AS (SELECT gid, src, any_value(dst) dst, any_value(etype) etype, arg_min(eidx, (ts, eidx)) first_eidx, arg_max(eidx, (ts, eidx)) last_eidx,
             count(*) n, min(ts) first_ts, max(ts) last_ts, max(ts) - min(ts) duration FROM r GROUP BY gid, src, run)
"""


@query("p4_found", _RUNS + "SELECT gid, first_eidx, last_eidx FROM g WHERE n >= 2")
def p4_found(spark, d):
    return runs.collapse_runs(table(spark, d, "edges"), min_count=2).select("gid", "first_eidx", "last_eidx")


@query("p4_collapsed", _RUNS + "SELECT gid, src, dst, etype, first_eidx, last_eidx, n, first_ts, last_ts, duration FROM g")
def p4_collapsed(spark, d):
    return runs.collapse_runs(table(spark, d, "edges"))


# --- problem 6: encoding -------------------------------------------------------------------------------------------------


@query("p6_ids")
def p6_ids(spark, d):
    return tokens.encode_documents(table(spark, d, "documents"))


@query("p6_roundtrip", "SELECT doc_id, coalesce(text, '') AS decoded FROM documents")
def p6_roundtrip(spark, d):
    return tokens.encode_documents(table(spark, d, "documents")).select("doc_id", tokens.decode(F.col("ids")).alias("decoded"))


# --- problem 7: mixing ---------------------------------------------------------------------------------------------------


@query("p7_found")
def p7_found(spark, d):
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p7_report")
def p7_report(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@query("p7_chosen")
def p7_chosen(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


# --- problem 8: shared spans ---------------------------------------------------------------------------------------------


_SPANS = """
WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 120),
     w AS (SELECT doc_id, i, substring(text, i + 1, 120) w FROM (SELECT doc_id, text, unnest(range(0, length(text) - 119)) i FROM d)),
     s AS (SELECT w FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id)),
     p AS (SELECT DISTINCT doc_id, i FROM w WHERE w IN (SELECT w FROM s)),
     f AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 120 THEN 0 ELSE 1 END fresh FROM p),
     g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) k FROM f),
     x AS (SELECT doc_id, min(i)::INTEGER start_pos, (max(i) + 120)::INTEGER end_pos FROM g GROUP BY doc_id, k)
"""


@query("p8_found", _SPANS + "SELECT doc_id, start_pos, end_pos FROM x")
def p8_found(spark, d):
    return spans.shared_spans(table(spark, d, "documents"))


@query(
    "p8_coverage",
    _SPANS
    + """SELECT doc_id, coalesce(length(text), 0) n_chars, coalesce(n, 0)::BIGINT n_shared, coalesce(n / nullif(length(text), 0)::DOUBLE, 0) share
    FROM documents LEFT JOIN (SELECT doc_id, sum(end_pos - start_pos) n FROM x GROUP BY 1) USING (doc_id) WHERE doc_id IS NOT NULL""",
)
def p8_coverage(spark, d):
    docs = table(spark, d, "documents")
    return spans.coverage(docs, spans.shared_spans(docs))

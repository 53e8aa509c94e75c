"""Named queries over a folder of tables, and the SQL each must agree with where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import cut, table
from ..operators import drift, nested, skew
from . import graph_queries  # noqa: F401
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

# --- problem 1: nested records -------------------------------------------------------------------------------------------


@query("p1_found")
def p1_found(spark, d):
    return nested.item_table(nested.flatten_records(table(spark, d, "tccdmdatum"), with_fields=False)).select("rec_id", "parent_path", "child_path")


@query("p1_records")
def p1_records(spark, d):
    r = nested.flatten_records(table(spark, d, "tccdmdatum"))
    return r.select("rec_id", "kind", "uuid", F.to_json("fields").alias("fields"))


@query("p1_items")
def p1_items(spark, d):
    i = nested.item_table(nested.flatten_records(table(spark, d, "tccdmdatum")))
    return i.select("rec_id", "kind", "table", "parent_path", "child_path", "pos", F.to_json("fields").alias("fields"))


@query("p1_values")
def p1_values(spark, d):
    return nested.value_table(nested.flatten_records(table(spark, d, "tccdmdatum"), with_fields=False, with_values=True))


# --- problem 2: heavy keys -----------------------------------------------------------------------------------------------

_SIDES = """
WITH e AS (SELECT lower(trim(src)) s, lower(trim(dst)) d, CASE WHEN ts <> 0 THEN ts END t FROM edges),
     k AS (SELECT 'src' side, s node_key, d opposite, t FROM e UNION ALL SELECT 'dst', d, s, t FROM e)
"""


@query(
    "p2_found",
    _SIDES + "SELECT side, node_key FROM k WHERE node_key IS NOT NULL GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM edges)",
)
def p2_found(spark, d):
    return skew.heavy_keys(table(spark, d, "edges")).select("side", "node_key")


@query(
    "p2_profile",
    _SIDES
    + """SELECT side, node_key, count(*) n_rows, count(DISTINCT opposite) n_opposite, min(t) first_ts, max(t) last_ts, quantile_disc(t, 0.5) ts_q50
    FROM k WHERE node_key IS NOT NULL GROUP BY ALL""",
)
def p2_profile(spark, d):
    return skew.key_profile(table(spark, d, "edges"), (0.5,))


# --- problem 5: drifting schemas -----------------------------------------------------------------------------------------

ALERT_TABLES = ("e6_alert_full", "e6_alert_full_v2", "e6_alert_full_v3")


def _drift(spark, d):
    r1, f1 = drift.csv_rows(table(spark, d, "alert_lines"))
    r2, f2 = drift.stored_rows([(t, table(spark, d, t)) for t in ALERT_TABLES], "stored alert tables")
    return cut(r1.unionByName(r2), "rows"), cut(f1.unionByName(f2), "fields")


@query("p5_found")
def p5_found(spark, d):
    return drift.changes(*_drift(spark, d)).select("file_name", "change", "old_field", "new_field")


@query("p5_unified")
def p5_unified(spark, d):
    rows, fields = _drift(spark, d)
    return drift.unify(rows, fields, drift.changes(rows, fields))


@query("p5_table")
def p5_table(spark, d):
    rows, fields = _drift(spark, d)
    return drift.unified_table(rows, fields, drift.changes(rows, fields))

"""Event sequences of processes, shared by problems 3 and 4.

A sequence is the events of one (gid, node key of src) by (ts, eidx).  It may be as long as a third of all rows, so sequences
are not grouped: rows are range-partitioned by (gid, src, ts, eidx) and sorted within partitions, which splits a long sequence
over as many tasks as its rows need.  Work runs over each partition's rows in order; what crosses a partition's border is put
together afterwards from at most two pieces per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import etype_form, node_key


def events(edges: DataFrame) -> DataFrame:
    """gid, src, ts, eidx, dst, etype in normal form; without unknown times, missing endpoints or a missing name (gid, eidx).

    Second deliveries are still there; they sort next to each other.
    """
    return edges.select("gid", node_key("src").alias("src"), F.col("ts").cast("bigint").alias("ts"), F.col("eidx").cast("bigint").alias("eidx"), node_key("dst").alias("dst"), etype_form("etype").alias("etype")).where(
        "gid IS NOT NULL AND eidx IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL AND ts <> 0"
    )


def ordered(ev: DataFrame) -> DataFrame:
    """Rows in sequence order, long sequences split over partitions."""
    n = int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["gid", "src", "ts", "eidx"]
    return ev.repartitionByRange(n, *by).sortWithinPartitions(*by)

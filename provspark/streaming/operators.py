"""Streaming forms of two operators (beyond the batch set): duplicate-edge merging per window, and last neighbours per node."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_edge_dedup(edges: DataFrame, time_col: str = "arrived", window: str = "15 minutes", watermark: str = "10 minutes") -> DataFrame:
    """gid, start, src, dst, etype, ts, mu: edges of one (gid, src, dst, etype) within a window of arrival time; later ones than the watermark are left out."""
    e = edges.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, watermark)
    x = e.groupBy("gid", F.window(time_col, window).alias("w"), "src", "dst", "etype").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).cast("double").alias("mu"))
    return x.select("gid", F.col("w.start").alias("start"), "src", "dst", "etype", "ts", "mu")


def stream_last_neighbours(edges: DataFrame, n: int = 10) -> DataFrame:
    """gid, nid, neighbours: after each micro-batch, the last n neighbours of every node it touched, newest first; n entries of state a node."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        for f in frames:
            have += list(zip(f["eidx"].tolist(), f["nb"].tolist(), strict=True))
            have = sorted(set(have), reverse=True)[:n]
        state.update(([e for e, _ in have], [b for _, b in have]))
        yield pd.DataFrame({"gid": [key[0]], "nid": [key[1]], "neighbours": [[b for _, b in have]]})

    e = edges.select("gid", "eidx", F.explode(F.array(F.struct(F.col("src").alias("nid"), F.col("dst").alias("nb")), F.struct(F.col("dst").alias("nid"), F.col("src").alias("nb")))).alias("x")).select("gid", "x.nid", "x.nb", "eidx")
    return e.groupBy("gid", "nid").applyInPandasWithState(update, "gid string, nid string, neighbours array<string>", "e array<bigint>, b array<string>", "update", GroupStateTimeout.NoTimeout)

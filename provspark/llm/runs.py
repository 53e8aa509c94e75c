"""Problem 4: repeated consecutive events.

Method: pointer doubling.  Every event that matches its predecessor points to it, every other event to itself; pointers are
replaced by pointers' pointers until all reach their run's start, which takes the logarithm of the longest run.  Within a
sorted partition the predecessor is the row before and the self-join is a vectorised take over the batch; the pieces at the
partitions' borders, two per partition at most, are then joined with themselves as a table until their pointers stand still.

Defined results: rows with a null gid, eidx, src, dst or ts, or ts 0, are no events; second deliveries are one event; null and
blank etypes are ``event``; equal times are ordered by eidx; an event alone is a run of one; an empty table gives no runs;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import cut
from .sequences import events, ordered

GAP_NS = 60_000_000_000
_RUN = "gid string, src string, dst string, etype string, first_eidx bigint, last_eidx bigint, n bigint, first_ts bigint, last_ts bigint"
_KEY = ("gid", "src", "dst", "etype")


def run_starts(match: np.ndarray) -> np.ndarray:
    """Index of the run start of each row; ``match[i]``: row i continues row i-1."""
    ptr = np.arange(len(match)) - match
    while True:
        far = ptr[ptr]
        if np.array_equal(far, ptr):
            return ptr
        ptr = far


def _continues(t: pa.Table | pa.RecordBatch, first: str, last: str, gap: int) -> np.ndarray:
    """Whether each row but the first has the key of the row before it and starts within the gap of its end."""
    n = t.num_rows
    same = np.ones(max(n - 1, 0), bool)
    for c in _KEY:
        a = t.column(c)
        same &= pc.equal(a.slice(1), a.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    a, b = t.column(first).to_numpy(zero_copy_only=False), t.column(last).to_numpy(zero_copy_only=False)
    return same & (a[1:] - b[:-1] <= gap)


def _collapse(t: pa.RecordBatch, gap: int) -> pa.RecordBatch:
    """Rows that are runs already (of one event or more), in order, joined to longer ones."""
    if t.num_rows < 2:
        return t
    start = run_starts(np.append(False, _continues(t, "first_ts", "last_ts", gap)))
    heads = np.flatnonzero(start == np.arange(len(start)))
    tails = np.append(heads[1:], len(start)) - 1
    head, tail = t.take(pa.array(heads)), t.take(pa.array(tails))
    n = np.add.reduceat(t.column("n").to_numpy(), heads)
    return pa.RecordBatch.from_arrays([*[head.column(c) for c in (*_KEY, "first_eidx")], tail.column("last_eidx"), pa.array(n, pa.int64()), head.column("first_ts"), tail.column("last_ts")], names=t.schema.names)


def _events_as_runs(b: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """Events of a batch without second deliveries, as runs of one; ``last`` names the last event of the batch before."""
    gid, src, ts, eidx = (b.column(i) for i in range(4))
    n = b.num_rows
    again = np.zeros(n, bool)
    if n > 1:
        again[1:] = True
        for a in (gid, src, ts, eidx):
            again[1:] &= pc.equal(a.slice(1), a.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    again[0] = last == tuple(a[0].as_py() for a in (gid, src, ts, eidx))
    end = tuple(a[n - 1].as_py() for a in (gid, src, ts, eidx))
    if again.any():
        b = b.filter(pa.array(~again))
    gid, src, ts, eidx, dst, etype = b.columns[:6]
    ones = pa.array(np.ones(b.num_rows, np.int64))
    return pa.RecordBatch.from_arrays([gid, src, dst, etype, eidx, eidx, ones, ts, ts], names=[x.split()[0] for x in _RUN.split(", ")]), end


def collapse_runs(edges: DataFrame, gap_ns: int = GAP_NS, min_count: int = 1) -> DataFrame:
    """Runs of at least ``min_count`` events: gid, src, dst, etype, first_eidx, last_eidx, n, first_ts, last_ts, duration.

    A run is a longest stretch of neighbouring events of one sequence with one dst and etype, each at most ``gap_ns`` after the
    one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held, last, first = None, None, True  # held: the run that may go on

        def out(b: pa.RecordBatch, border: np.ndarray) -> pa.RecordBatch:
            keep = border | (b.column("n").to_numpy() >= min_count)
            b = pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(border, pid, -1), pa.int32())], names=[*b.schema.names, "pid"])
            return b.filter(pa.array(keep))

        for b in batches:
            if not b.num_rows:
                continue
            b, last = _events_as_runs(b, last)
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()
                b = b[0] if b else held
            b = _collapse(b, gap_ns)
            held = b.slice(b.num_rows - 1)
            b = b.slice(0, b.num_rows - 1)
            if b.num_rows:
                border = np.zeros(b.num_rows, bool)
                border[0], first = first, False
                yield out(b, border)
        if held is not None:
            yield out(held, np.ones(1, bool))

    pieces = cut(ordered(events(edges)).mapInArrow(run, _RUN + ", pid int"), "runs")
    inner = pieces.where("pid < 0").drop("pid")
    # at most two rows of each partition
    k = F.row_number().over(W.orderBy("pid", "gid", "src", "first_ts", "first_eidx")).cast("bigint")
    border = pieces.where("pid >= 0").withColumn("k", k)
    w = W.orderBy("k")
    cont = F.col("first_ts") - F.lag("last_ts").over(w) <= gap_ns
    for c in _KEY:
        cont = cont & (F.col(c) == F.lag(c).over(w))
    border = cut(border.withColumn("ptr", F.when(cont, F.col("k") - 1).otherwise(F.col("k"))), "border")
    ptr = border.select("k", "ptr")
    moved = border.where("ptr < k").limit(1).count()
    while moved:
        a, b = ptr.alias("a"), ptr.alias("b")
        new = cut(a.join(b, F.col("a.ptr") == F.col("b.k")).select("a.k", F.col("b.ptr").alias("ptr"), F.col("a.ptr").alias("old")), "ptr")
        moved = new.where("ptr <> old").limit(1).count()
        ptr = new.select("k", "ptr")
    cols = [x.split()[0] for x in _RUN.split(", ")]
    whole = (
        border.drop("ptr")
        .join(ptr, "k")
        .groupBy("ptr", *_KEY)
        .agg(F.min_by("first_eidx", "k").alias("first_eidx"), F.max_by("last_eidx", "k").alias("last_eidx"), F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
        .where(F.col("n") >= min_count)
        .select(*cols)
    )
    return inner.unionByName(whole).withColumn("duration", F.col("last_ts") - F.col("first_ts"))

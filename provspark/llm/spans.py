"""Problem 8: long exact spans shared between records.

Method: seed and extend.  Every text is winnowed: of each window of ``min_len`` characters the GRAM-long piece of least hash is
an anchor, so texts that share a window share its anchor at the same place.  Records are joined on anchors; an anchor of one
record only is no seed.  Around a seed the match is extended both ways over all windows that chose it: first as a whole (the
stretch of all of its windows at once), then, where stretches differ, window by window.  What neighbouring windows share is
joined to maximal stretches.

No pairs of records are formed.  Equal stretches of an anchor are one class, counted with map-side combining, so whole copies
cost one row per task; where an anchor has several classes, two doc_ids of each are enough to compare their windows, again by a
combined count.  A seed that stands in a third of all texts is therefore spread by the content around it.

Anchors are chosen by a rolling hash.  Identity of stretches and windows is that of 128-bit BLAKE2b digests of their code points:
two different ones of n agree with a chance below n^2 / 2^129 (3e-15 for 10^12 windows), also in texts made to collide.

Defined results: null, empty and shorter texts share nothing; lengths and positions are in code points; a stretch repeated within
one record only is not shared; rows with a null doc_id are left out; rows of one doc_id are one record per row, but only other
doc_ids count as another text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import cut

MIN_LEN = 120
#: Length of an anchor; windows of min_len have min_len - GRAM + 1 of them.
GRAM = 60
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that leaves no structure (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = np.full(size, _BASE, np.uint64), np.full(size, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def rolling(chars: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each piece of ``size`` code points."""
    up, down = _powers.get(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(_mix(chars.astype(np.uint64) * np.uint64(256) + np.uint64(0x51)) * up[: len(chars)], out=sums[1:])
    n = len(chars) - size + 1
    return _mix((sums[size:] - sums[:n]) * down[:n])


def digests(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of the stretches, one row of two numbers each."""
    raw = memoryview(chars).cast("B")
    parts = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip((start * 4).tolist(), (end * 4).tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)


def _last_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the place of its least, the last of equals: windows of powers of two, then two that overlap."""
    at, size = np.arange(len(h)), 1
    while size * 2 <= w:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(h[b] <= h[a], b, a)
        size *= 2
    if size < w:
        a, b = at[: len(at) - (w - size)], at[w - size :]
        at = np.where(h[b] <= h[a], b, a)
    return at


def anchors(chars: np.ndarray, min_len: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(anchor, its place, first and last window start that chose it) of a text, or None if it is too short."""
    if len(chars) < min_len:
        return None
    h = rolling(chars, gram)
    least = _last_least(h, min_len - gram + 1)
    new = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(new[1:], len(least)) - 1
    return h[least[new]], least[new], new, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


_OCC = "doc_id bigint, lo int, hi int, anchor bigint, c1 bigint, c2 bigint"


def occurrences(docs: DataFrame, min_len: int, gram: int) -> DataFrame:
    """doc_id, lo, hi, anchor, c1, c2: anchors of each text, the window starts lo..hi that chose them, and the digest of the
    stretch of those windows together with the anchor's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                chars = code_points(text)
                got = anchors(chars, min_len, gram)
                if got is None:
                    continue
                anchor, place, lo, hi = got
                d = digests(chars, lo, hi + min_len)
                for p, x in zip(parts, (np.full(len(lo), doc), lo, hi, anchor, d[:, 0] ^ _mix((place - lo).astype(np.uint64)), d[:, 1]), strict=True):
                    p.append(x)
            if parts[0]:
                doc, lo, hi, a, c1, c2 = (np.concatenate(p) for p in parts)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), _signed(a), _signed(c1), _signed(c2)], names=[x.split()[0] for x in _OCC.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= min_len)).mapInArrow(run, _OCC)


def _windows(docs: DataFrame, wanted: DataFrame, min_len: int) -> DataFrame:
    """doc_id, s, w1, w2: digests of the windows lo..hi of each document.  ``wanted``: doc_id, ranges (array of lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for doc, text, ranges in zip(*(c.to_pylist() for c in b.columns), strict=True):
                chars = code_points(text)
                lo, hi = np.array([r["lo"] for r in ranges]), np.array([r["hi"] for r in ranges])
                ok = hi + min_len <= len(chars)  # of another row of this doc_id otherwise
                lo, hi = lo[ok], hi[ok]
                n = hi - lo + 1
                s = np.unique(np.arange(n.sum()) + np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n)) if len(n) else lo
                d = digests(chars, s, s + min_len)
                for p, x in zip(out, (np.full(len(s), doc), s, d[:, 0], d[:, 1]), strict=True):
                    p.append(x)
            if out[0]:
                doc, s, w1, w2 = (np.concatenate(p) for p in out)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(s, pa.int32()), _signed(w1), _signed(w2)], names=["doc_id", "s", "w1", "w2"])

    texts = docs.select(F.col("doc_id").cast("bigint"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= min_len))
    return texts.join(wanted, "doc_id").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id bigint, s int, w1 bigint, w2 bigint")


def shared_spans(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM) -> DataFrame:
    """doc_id, start_pos, end_pos: longest stretches of positions that lie in a stretch of ``min_len`` standing in another doc_id's text too."""
    gram = min(gram, min_len)
    cls = ["anchor", "c1", "c2"]
    occ = cut(occurrences(docs, min_len, gram), "anchors")
    # classes of equal stretches; seeds are anchors of more than one doc_id
    classes = occ.groupBy(*cls).agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2"))
    classes = cut(classes, "classes")
    seeds = classes.groupBy("anchor").agg(F.min("d1").alias("a1"), F.max("d2").alias("a2"), F.count(F.lit(1)).alias("n_classes")).where("a1 <> a2")
    marked = cut(classes.join(seeds.select("anchor", "n_classes"), "anchor").select(*cls, "d1", "d2", (F.col("d1") != F.col("d2")).alias("whole"), (F.col("n_classes") > 1).alias("open")), "seeds")
    hits = cut(occ.join(marked, cls).select("doc_id", "lo", "hi", "whole", "open", F.col("doc_id").isin(F.col("d1"), F.col("d2")).alias("kept")), "hits")
    whole = hits.where("whole").select("doc_id", "lo", "hi")
    # window by window: what differs, against the records of each class of the same seed; of a whole class two doc_ids will do,
    # as any text then meets another doc_id than its own, even where one of them holds the passage again in other surroundings
    todo = hits.where("open AND (kept OR NOT whole)")
    ranges = todo.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))  # as many as a text has anchors
    win = cut(_windows(docs, ranges, min_len), "windows")
    common = win.groupBy("w1", "w2").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2")).where("d1 <> d2").select("w1", "w2")
    single = win.join(common, ["w1", "w2"], "left_semi").select("doc_id", F.col("s").alias("lo"), F.col("s").alias("hi"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, starts, ends = [], [], []
            for doc, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lo = np.array([x["lo"] for x in r])
                hi = np.array([x["hi"] for x in r]) + min_len
                o = np.argsort(lo, kind="stable")
                lo, far = lo[o], np.maximum.accumulate(hi[o])
                new = np.flatnonzero(np.append(True, lo[1:] > far[:-1]))
                starts.append(lo[new])
                ends.append(far[np.append(new[1:], len(lo)) - 1])
                docs_.append(np.full(len(new), doc))
            if docs_:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs_), pa.int64()), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(ends), pa.int32())], names=["doc_id", "start_pos", "end_pos"])

    # a group is the shared windows of one text
    grouped = whole.unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    return grouped.mapInArrow(join, "doc_id bigint, start_pos int, end_pos int")


def coverage(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_shared, share of every document."""
    s = spans.groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).cast("bigint").alias("n_shared"))
    d = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    return d.join(s, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_shared", F.lit(0)).alias("n_shared")).withColumn("share", F.coalesce(F.col("n_shared") / F.nullif("n_chars", F.lit(0)), F.lit(0.0)))

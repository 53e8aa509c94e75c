"""Problem 3: frequent subsequences with gaps, across many sequences.

Method: sequence decision diagrams.  Each sequence becomes a word of steps; equal words are one word with a weight.  A task
compresses its words into a shared directed acyclic graph (equal suffixes are one node) with, for every node and step, the
node behind the step's next occurrence.  The conditional diagram of a prefix is a weighted set of nodes; it is pushed one step
further by taking along those pointers, where suffixes that meet add their weights, and the counts of its extensions are kept
by its content, so that prefixes leading to the same diagram are counted once.

Between tasks counts are exact by partitioned counting: a pattern frequent in all data is frequent, by the same share, in at
least one task's words; the union of the tasks' frequent patterns is counted exactly in all tasks' diagrams in a second pass.

Words are made without grouping a sequence (see ``sequences``): each partition's piece of a sequence is shortened to the normal
form of Simon's congruence for subsequences of up to ``max_len`` steps, which has the same such subsequences and a length that
depends on the number of steps only; pieces at partition borders are concatenated and shortened again.

Defined results: an event needs gid, eidx, src, dst and a ts other than 0; second deliveries are one event; sequences without
frequent steps count in the total; nodes without a usable row are of type ``unknown``; no sequences give no patterns; ties and
repeated rows of nodes go to the lowest npos, then the first type by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import node_key, type_form
from ..functions.tables import cut
from .sequences import events, ordered

#: Words from this length on are shortened within a partition; shorter ones are left, with the same result.
LONG = 64
#: Distinct words of a task's diagram, about, and fewer where its table of next nodes would be larger than DIAGRAM_BYTES, down to LEAST_WORDS.
WORDS_PER_TASK, LEAST_WORDS = 25_000, 2_000
DIAGRAM_BYTES = 200_000_000
#: Bytes of conditional diagrams that a task keeps.
MEMO_BYTES = 200_000_000
#: Candidates counted in a pass of the second phase; more are counted in further passes.
CANDIDATES_PER_PASS = 200_000


def node_types(nodes: DataFrame) -> DataFrame:
    """gid, nid (node key), type: of the row with the lowest npos whose type is not null, blank or ``object``."""
    t = nodes.select("gid", node_key("nid").alias("nid"), type_form("type").alias("type"), "npos").where("gid IS NOT NULL AND nid IS NOT NULL AND type IS NOT NULL AND type NOT IN ('', 'object')")
    return t.groupBy("gid", "nid").agg(F.min(F.struct(F.coalesce("npos", F.lit(2**63 - 1)).alias("npos"), "type")).alias("x")).select("gid", "nid", "x.type")


def steps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """gid, src, ts, eidx, step of every event."""
    e, t = events(edges), node_types(nodes).withColumnsRenamed({"gid": "t_gid"})
    j = e.join(t, (e.gid == t.t_gid) & (e.dst == t.nid), "left")
    return j.select("gid", "src", "ts", "eidx", F.concat("etype", F.lit(":"), F.coalesce("type", F.lit("unknown"))).alias("step"))


def shortened(word: list, k: int) -> list:
    """The word without letters that no subsequence of length up to k needs (normal form of Simon's congruence).

    From the left each place gets the length of the shortest word whose leftmost occurrence ends there; then from the right,
    over the places still kept, the same mirrored; a place where both add up to more than k + 1 is not needed.
    """
    nxt: dict = {}
    floor = 1  # what a letter not seen yet would get
    left = []
    for a in word:
        x = nxt.get(a, floor)
        left.append(x)
        for b in nxt:
            if nxt[b] > x + 1:
                nxt[b] = x + 1
        nxt[a] = x + 1
    nxt, out = {}, []
    for a, x in zip(reversed(word), reversed(left), strict=True):
        y = nxt.get(a, floor)
        if x + y > k + 1:
            continue
        out.append(a)
        for b in nxt:
            if nxt[b] > y + 1:
                nxt[b] = y + 1
        nxt[a] = y + 1
    return out[::-1]


def words(step_rows: DataFrame, max_len: int) -> DataFrame:
    """One row a sequence: gid, src, word (array of steps without immediate repeats, shortened where long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: tuple | None = None  # gid, src, word so far
        last = None
        first = True

        def batch(rows: list[tuple], border: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array(border, pa.int32())], names=["gid", "src", "word", "pid"])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new_seq = np.ones(n, bool)
            again = np.zeros(n, bool)
            eq = [pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in b.columns]
            new_seq[1:] = ~(eq[0] & eq[1])
            again[1:] = eq[0] & eq[1] & eq[2] & eq[3]
            head = tuple(b.column(i)[0].as_py() for i in range(4))
            new_seq[0] = held is None or held[:2] != head[:2]
            again[0] = last == head
            last = tuple(b.column(i)[n - 1].as_py() for i in range(4))
            # immediate repeats add no subsequence of different steps
            again[1:] |= eq[0] & eq[1] & eq[4]
            keep = np.flatnonzero(new_seq | ~again)
            starts = np.flatnonzero(new_seq[keep])
            step = b.column(4).take(pa.array(keep)).to_pylist()
            gid, src = (b.column(i).take(pa.array(keep[starts])).to_pylist() for i in (0, 1))
            cuts = [*starts.tolist(), len(step)]
            done: list[tuple] = []
            if cuts[0] > 0 and held is not None:
                held[2].extend(step[: cuts[0]])
                if len(held[2]) > 16 * LONG:
                    held[2][:] = shortened(held[2], max_len)
            for i in range(len(cuts) - 1):
                if held is not None:
                    done.append(held)
                held = (gid[i], src[i], step[cuts[i] : cuts[i + 1]])
            if done:
                border = [-1] * len(done)
                if first:
                    border[0], first = pid, False
                yield batch([(g, s, shortened(w, max_len) if len(w) >= LONG else w) for g, s, w in done], border)
        if held is not None:
            yield batch([(held[0], held[1], shortened(held[2], max_len) if len(held[2]) >= LONG else held[2])], [pid])

    pieces = cut(ordered(step_rows).mapInArrow(run, "gid string, src string, word array<string>, pid int"), "words")

    def join(key: tuple, t: pa.Table) -> pa.Table:
        word = [a for w in t.sort_by("pid").column("word").to_pylist() for a in w]
        word = shortened(word, max_len) if len(word) >= LONG else word
        return pa.table({"gid": pa.array([key[0].as_py()], pa.string()), "src": pa.array([key[1].as_py()], pa.string()), "word": pa.array([word], pa.list_(pa.string()))})

    # at most two pieces of each partition, each of bounded length
    ends = pieces.where("pid >= 0").groupBy("gid", "src").applyInArrow(join, "gid string, src string, word array<string>")
    return pieces.where("pid < 0").drop("pid").unionByName(ends)


class Diagram:
    """Shared graph of weighted words over letters 0..k-1: node 0 is the end; ``nxt[node, letter]`` the node behind the next occurrence, -1 if none."""

    def __init__(self, word_list: list[list[int]], weights: list[int], letters: int):
        ids: dict[tuple[int, int], int] = {}
        head: list[int] = [-1]
        tail: list[int] = [-1]
        roots: dict[int, int] = {}
        for w, n in zip(word_list, weights, strict=True):
            node = 0
            for a in reversed(w):
                got = ids.get((a, node))
                if got is None:
                    got = ids[a, node] = len(head)
                    head.append(a)
                    tail.append(node)
                node = got
            roots[node] = roots.get(node, 0) + n
        self.nxt = np.full((len(head), letters), -1, np.int32)
        for i in range(1, len(head)):
            self.nxt[i] = self.nxt[tail[i]]
            self.nxt[i, head[i]] = tail[i]
        order = sorted(roots)
        self.root = (np.array(order, np.int64), np.array([roots[x] for x in order], np.int64))
        self.memo: dict[bytes, tuple] = {}
        self.kept = 0

    def extend(self, state: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(next nodes by letter, supports of all letters) of a conditional diagram, kept by its content."""
        key = state[0].tobytes() + state[1].tobytes()
        if (got := self.memo.get(key)) is None:
            to = self.nxt[state[0]]
            got = (to, state[1] @ (to >= 0))
            self.kept += to.nbytes + len(key)
            if self.kept > MEMO_BYTES:
                self.memo.clear()
                self.kept = to.nbytes + len(key)
            self.memo[key] = got
        return got

    def push(self, state: tuple, to: np.ndarray, letter: int) -> tuple:
        """The conditional diagram behind a letter: suffixes that meet are one node, their weights added."""
        col = to[:, letter]
        hit = col >= 0
        nodes, where = np.unique(col[hit], return_inverse=True)
        return nodes.astype(np.int64), np.bincount(where, weights=state[1][hit], minlength=len(nodes)).astype(np.int64)

    def frequent(self, least: int, max_len: int) -> Iterator[tuple[list[int], int]]:
        """All patterns of different letters with at least this support."""
        stack = [([], self.root)]
        while stack:
            prefix, state = stack.pop()
            to, support = self.extend(state)
            for a in np.flatnonzero(support >= least):
                a = int(a)
                if a in prefix:
                    continue
                yield [*prefix, a], int(support[a])
                if len(prefix) + 1 < max_len:
                    stack.append(([*prefix, a], self.push(state, to, a)))

    def count(self, patterns: list[tuple[int, ...]]) -> list[int]:
        """Supports of the patterns; patterns with a common prefix share its conditional diagram."""
        order = sorted(range(len(patterns)), key=lambda i: patterns[i])
        out = [0] * len(patterns)
        path: list[tuple[int, tuple]] = []
        for i in order:
            p = patterns[i]
            same = 0
            while same < len(path) and same < len(p) - 1 and path[same][0] == p[same]:
                same += 1
            del path[same:]
            state = path[-1][1] if path else self.root
            for a in p[same:-1]:
                state = self.push(state, self.extend(state)[0], a)
                path.append((a, state))
            out[i] = int(self.extend(state)[1][p[-1]]) if len(state[0]) else 0
        return out


def frequent_patterns(edges: DataFrame, nodes: DataFrame, share: float = 0.06, least: int = 12, min_len: int = 3, max_len: int = 5) -> DataFrame:
    """pattern (steps joined by ' > '), length, support, share: all lists of different steps in at least ``share`` of all sequences and ``least`` of them."""
    w = cut(words(steps(edges, nodes), max_len), "sequences")
    return mine(w, share, least, min_len, max_len)


def mine(w: DataFrame, share: float, least: int, min_len: int, max_len: int) -> DataFrame:
    spark = w.sparkSession
    result = "pattern string, length int, support bigint, share double"
    total = w.count()
    need = max(least, ceil(Fraction(str(share)) * total))
    # steps in enough sequences: at most (distinct steps of a sequence)/share of them
    common = sorted(r.step for r in w.select(F.explode(F.array_distinct("word")).alias("step")).groupBy("step").count().where(F.col("count") >= need).collect())
    if not common:
        return spark.createDataFrame([], result)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(common)
        for b in batches:
            lists = b.column(0)
            at = pc.index_in(lists.flatten().cast(pa.string()), value_set=names).to_numpy(zero_copy_only=False)
            owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(~np.isnan(at.astype(float)))
            at, owner = at[keep].astype(np.int32), owner[keep]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
            at, owner = at[fresh], owner[fresh]
            off = np.searchsorted(owner, np.arange(b.num_rows + 1))
            rows = [at[off[i] : off[i + 1]].tolist() for i in range(b.num_rows)]
            rows = [shortened(r, max_len) if len(r) >= LONG else r for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["w"])

    coded = w.select("word").mapInArrow(encode, "w array<int>").where(F.size("w") > 0).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    coded = cut(coded, "coded")
    distinct, weight, letters = coded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    k = len(common)
    parts = max(1, ceil(distinct / WORDS_PER_TASK), min(ceil(4 * k * letters / DIAGRAM_BYTES), distinct // LEAST_WORDS))
    # about as many words in each task, the same ones in both phases: a task of few words would find many locally frequent patterns
    spread = coded.repartition(parts, F.xxhash64("w"))
    local = Fraction(need, max(weight, 1))

    def load(batches: Iterator[pa.RecordBatch]) -> tuple[Diagram, int]:
        ws, ns = [], []
        for b in batches:
            ws += b.column(0).to_pylist()
            ns += b.column(1).to_pylist()
        return Diagram(ws, ns, k), sum(ns)

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, here = load(batches)
        if here:
            found = [p for p, _ in d.frequent(max(1, ceil(local * here)), max_len) if len(p) >= min_len]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["p"])

    candidates = cut(spread.mapInArrow(mined, "p array<int>").distinct(), "candidates")
    n_cand = candidates.count()
    passes = max(1, ceil(n_cand / CANDIDATES_PER_PASS))
    counted = None
    for i in range(passes):
        # at most about CANDIDATES_PER_PASS short lists of numbers at once
        some = [tuple(r.p) for r in (candidates if passes == 1 else candidates.where(F.pmod(F.xxhash64("p"), F.lit(passes)) == i)).collect()]
        sent = spark.sparkContext.broadcast(some)

        def recount(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            d, here = load(batches)
            if here:
                c = d.count(sent.value)
                yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in sent.value], pa.list_(pa.int32())), pa.array(c, pa.int64())], names=["p", "c"])

        one = spread.mapInArrow(recount, "p array<int>, c bigint").groupBy("p").agg(F.sum("c").alias("support")).where(F.col("support") >= need)
        counted = one if counted is None else counted.unionByName(one)
    names = F.array(*[F.lit(s) for s in common])
    return counted.select(F.array_join(F.transform("p", lambda i: F.get(names, i)), " > ").alias("pattern"), F.size("p").alias("length"), "support", (F.col("support") / total).alias("share"))

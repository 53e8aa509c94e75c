"""Template matching and region packing.

The first embedding of a template at a seed is the one that a depth-first search with ascending candidates finds first.  It does
not depend on what other seeds absorbed, so those of all seeds and all templates are found together, level by level:

* a candidate must have around it what the template's node has (counts of neighbours by direction and type); such candidates are
  listed once for each place and kind of template node, as many as a template has nodes;
* each (template, seed) has one partial mapping.  A level gives the next nodes their least free candidates: all that hang on mapped
  nodes, those of one type in the search's order, as only nodes of one type compete.  A mapping that is completed so is the one the
  search finds, which takes the same choices and never has to go back;
* only for seeds that come to a dead end are the mappings enumerated, by a chain of joins in the search's order, where leaves of one
  kind stand in ascending order, and the least mapping is taken.

Packing is greedy by (template, seed position), but in rounds: a candidate is taken once no undecided earlier one could absorb
any of its nodes, and dropped once a taken one did.  The outcome is that of the sequential greedy choice.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import cut, drop
from ..sources.views import Graph
from .graph import context_nodes, shared_objects
from .order import numbered, smallest


#: Items that the driver decides at once.
SMALL = 100_000


@dataclass(frozen=True)
class Template:
    """A small typed pattern: nodes id -> type, directed edges, the anchor's id (or None)."""

    tpl_id: str
    nodes: dict[str, str]
    edges: tuple[tuple[str, str], ...]
    anchor: str | None = None
    support: int = 0

    def simple(self) -> list[tuple[str, str]]:
        return sorted({(a, b) for a, b in self.edges if a != b})

    def root(self) -> str:
        """The anchor, else the node of greatest degree, the first of equals."""
        if self.anchor in self.nodes:
            return self.anchor
        e = self.simple()
        deg = {n: sum((a == n) + (b == n) for a, b in e) for n in self.nodes}
        return max(self.nodes, key=lambda n: deg[n])

    def order(self) -> list[str]:
        """Breadth first from the root, successors by id, then predecessors by id."""
        e, out = self.simple(), [self.root()]
        for n in out:
            for m in sorted(b for a, b in e if a == n) + sorted(a for a, b in e if b == n):
                if m not in out:
                    out.append(m)
        return out


def typed_links(g: Graph) -> DataFrame:
    """gid, a, d, b, bt: distinct links without self-loops, in direction d (o: a -> b, i: b -> a), with b's type."""
    e = g.edges.where("src <> dst").select("gid", "src", "dst").distinct()
    x = e.select("gid", F.explode(F.array(F.struct(F.col("src").alias("a"), F.lit("o").alias("d"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.lit("i").alias("d"), F.col("src").alias("b")))).alias("x")).select("gid", "x.a", "x.d", "x.b")
    t = g.nodes.select("gid", F.col("nid").alias("b"), F.col("ntype").alias("bt"))
    return x.join(t, ["gid", "b"]).select("gid", "a", "d", "b", "bt")


def _around(t: Template, n: str) -> dict[str, int]:
    """What a node of a template has around it: number of neighbours by 'direction:type'."""
    return dict(Counter([f"o:{t.nodes[b]}" for a, b in t.simple() if a == n] + [f"i:{t.nodes[a]}" for a, b in t.simple() if b == n]))


_NEED = "array<struct<k: string, c: bigint>>"


def _has():
    """The node's surroundings (``around``) hold all that is needed (``need``)."""
    return F.forall("need", lambda x: F.coalesce(F.try_element_at("around", x.k), F.lit(0)) >= x.c)


def surroundings(links: DataFrame) -> DataFrame:
    """gid, a, around: numbers of different neighbours by 'direction:type'; one entry a type."""
    n = links.groupBy("gid", "a", "d", "bt").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("gid", "a").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("d", F.lit(":"), "bt"), "n"))).alias("around"))


def seeds(g: Graph, links: DataFrame, t: Template, signature: bool = True) -> DataFrame:
    """gid, x0, npos: nodes of the root's type with at least its in and out degree and, with ``signature``, all of its (direction, neighbour type) pairs."""
    r, e = t.root(), t.simple()
    need = {("o", t.nodes[b]) for a, b in e if a == r} | {("i", t.nodes[a]) for a, b in e if b == r}
    n_out, n_in = sum(a == r for a, _ in e), sum(b == r for _, b in e)
    s = g.nodes.where(F.col("ntype") == t.nodes[r]).select("gid", F.col("nid").alias("a"), "npos")
    d = links.groupBy("gid", "a").agg(F.sum((F.col("d") == "o").cast("int")).alias("n_out"), F.sum((F.col("d") == "i").cast("int")).alias("n_in"), *[F.max((F.col("d") == x) & (F.col("bt") == y)).alias(f"p{i}") for i, (x, y) in enumerate(sorted(need))])
    cond = (F.col("n_out") >= n_out) & (F.col("n_in") >= n_in)
    if signature:
        for i in range(len(need)):
            cond = cond & F.col(f"p{i}")
    return s.join(d.where(cond), ["gid", "a"]).select("gid", F.col("a").alias("x0"), "npos")


@dataclass(frozen=True)
class _Step:
    """Template nodes that get their images at once: the least free ones of a kind beside an image."""

    level: int
    parent: int  # place in the order
    kind: tuple  # (direction, type, what is around)
    places: tuple[int, ...]
    others: tuple[tuple[int, str], ...]  # further mapped nodes (place, direction) they must be beside


def _steps(t: Template) -> list[_Step]:
    order, e = t.order(), t.simple()
    at = {n: i for i, n in enumerate(order)}
    level, last, out = {0: 0}, {t.nodes[order[0]]: 0}, []
    for i, n in enumerate(order[1:], 1):
        cons = [(at[a], "o") for a, b in e if b == n and at[a] < i] + [(at[b], "i") for a, b in e if a == n and at[b] < i]
        (parent, d), others = cons[0], tuple(cons[1:])
        kind = (d, t.nodes[n], tuple(sorted(_around(t, n).items())))
        before = last.get(t.nodes[n])  # the one of this type that chooses before
        run = next((s for s in out if before in s.places), None)
        if run and not others and not run.others and (run.parent, run.kind) == (parent, kind):
            out[out.index(run)] = _Step(run.level, parent, kind, (*run.places, i), ())
            level[i] = run.level
        else:
            level[i] = 1 + max(level[p] for p in [parent, *[p for p, _ in others], *([before] if before is not None else [])])
            out.append(_Step(level[i], parent, kind, (i,), others))
        last[t.nodes[n]] = i
    return out


def first_embeddings(g: Graph, templates: list[Template]) -> DataFrame:
    """gid, tpos, tpl_id, anchor_type, seed, npos, nodes: of each template and seed the first complete mapping, if any."""
    spark = g.nodes.sparkSession
    used = {i: t for i, t in enumerate(templates) if len(t.nodes) > 1 and len(t.order()) == len(t.nodes)}  # others can't be grown from a seed
    most = max([len(t.nodes) for t in used.values()], default=1)
    links = cut(typed_links(g), "links")
    around = cut(surroundings(links), "surroundings")
    steps = {i: _steps(t) for i, t in used.items()}
    kinds = {k: n for n, k in enumerate(sorted({s.kind for ss in steps.values() for s in ss}))}
    roots = spark.createDataFrame([(i, t.tpl_id, len(t.nodes), t.nodes[t.root()], list(_around(t, t.root()).items())) for i, t in used.items()], f"tpos int, tpl_id string, n int, ntype string, need {_NEED}")
    start = g.nodes.select("gid", F.col("nid").alias("a"), "npos", "ntype").join(F.broadcast(roots), "ntype").join(around, ["gid", "a"]).where(_has())
    start = cut(start.select("gid", "tpos", "n", F.col("a").alias("seed"), "npos", F.create_map(F.lit(0), "a").alias("m")), "seeds")
    table = spark.createDataFrame([(n, d, t, list(need)) for (d, t, need), n in kinds.items()], f"kind int, d string, bt string, need {_NEED}")
    free = links.join(F.broadcast(table.where("size(need) = 1 AND need[0].c = 1")), ["d", "bt"]).select("gid", "a", "kind", "b")  # a leaf needs its link only
    inner = links.join(F.broadcast(table.where("NOT (size(need) = 1 AND need[0].c = 1)")), ["d", "bt"]).join(around.select("gid", F.col("a").alias("b"), "around"), ["gid", "b"]).where(_has()).select("gid", "a", "kind", "b")
    fit = cut(free.unionByName(inner), "candidates")
    lists = cut(smallest(fit, ["gid", "a", "kind"], "b", most).groupBy("gid", "a", "kind").agg(F.array_sort(F.collect_list("b")).alias("l")), "lists")
    state, done = start, []
    for level in range(1, max([s.level for ss in steps.values() for s in ss], default=0) + 1):
        now = [(i, s) for i, ss in steps.items() for s in ss if s.level == level]
        groups = spark.createDataFrame([(i, s.parent, kinds[s.kind], list(s.places), [(p, d) for p, d in s.others]) for i, s in now], "tpos int, parent int, kind int, places array<int>, others array<struct<p: int, d: string>>")
        r = state.join(F.broadcast(groups), "tpos").withColumn("a", F.element_at("m", F.col("parent")))
        images = F.map_values("m")
        plain = r.where("size(others) = 0").join(lists, ["gid", "a", "kind"], "left")
        got = F.slice(F.filter("l", lambda c: ~F.array_contains(images, c)), F.lit(1), F.size("places"))
        plain = plain.select("gid", "tpos", "n", "seed", "npos", "m", F.when(F.size(got) == F.size("places"), F.zip_with("places", got, lambda p, c: F.struct(p.alias("p"), c.alias("c")))).alias("new"))
        if any(s.others for _, s in now):
            x = r.where("size(others) > 0").join(fit, ["gid", "a", "kind"]).where(~F.array_contains(images, F.col("b"))).drop("a", "kind")
            for k in range(max(len(s.others) for _, s in now)):
                side = x.where(F.size("others") > k).withColumns({"a": F.element_at("m", F.col("others")[k].p), "d": F.col("others")[k].d})
                x = x.where(F.size("others") <= k).unionByName(side.join(links, ["gid", "a", "d", "b"], "left_semi").drop("a", "d"))
            key = ["gid", "tpos", "seed", "places"]
            x = x.groupBy(*key).agg(F.min("b").alias("b"))
            bound = r.where("size(others) > 0").select("gid", "tpos", "n", "seed", "npos", "m", "places").join(x, key, "left")
            plain = plain.unionByName(bound.select("gid", "tpos", "n", "seed", "npos", "m", F.when(F.col("b").isNotNull(), F.array(F.struct(F.element_at("places", 1).alias("p"), F.col("b").alias("c")))).alias("new")))
        new = plain.groupBy("gid", "tpos", "n", "seed", "npos").agg(F.first("m").alias("m"), F.flatten(F.collect_list("new")).alias("new"), F.max(F.col("new").isNull()).alias("dead")).where("NOT dead")
        new = cut(new.select("gid", "tpos", "n", "seed", "npos", F.map_concat("m", F.map_from_entries("new")).alias("m")), "mapped")
        done.append(new.where(F.size("m") == F.col("n")))
        state = new.where(F.size("m") < F.col("n"))
    out = start.limit(0) if not done else reduce(DataFrame.unionByName, done)
    out = cut(out.select("gid", "tpos", "seed", "npos", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("m", i)).alias("nodes")), "embedded")
    stuck = cut(start.select("gid", "tpos", "seed", "npos").join(out, ["gid", "tpos", "seed"], "left_anti"), "stuck")
    for i in sorted(x.tpos for x in stuck.select("tpos").distinct().collect()):
        if len(steps[i]) > 1:  # a single step takes what there is
            few = lists.select("gid", "a", "kind", F.explode("l").alias("b"))
            out = out.unionByName(_enumerated(used[i], i, stuck.where(F.col("tpos") == i), links, fit, few, kinds))
    tpl = roots.select("tpos", "tpl_id", F.col("ntype").alias("anchor_type"))
    return out.join(F.broadcast(tpl), "tpos").select("gid", "tpos", "tpl_id", "anchor_type", "seed", "npos", "nodes")


def _enumerated(t: Template, tpos: int, at: DataFrame, links: DataFrame, fit: DataFrame, few: DataFrame, kinds: dict) -> DataFrame:
    """The least of all mappings of one template at the given seeds."""
    order, e = t.order(), t.simple()
    place = {n: i for i, n in enumerate(order)}
    x = at.select("gid", F.col("seed").alias("x0"), "npos")
    seen: dict[tuple, int] = {}
    for i, n in enumerate(order[1:], 1):
        cons = [(place[a], "o") for a, b in e if b == n and place[a] < i] + [(place[b], "i") for a, b in e if a == n and place[b] < i]
        around = tuple(sorted(_around(t, n).items()))
        leaf = sum(c for _, c in around) == 1
        (p, d), others = cons[0], cons[1:]
        side = (few if leaf else fit).where(F.col("kind") == kinds[d, t.nodes[n], around])
        x = x.join(side.select("gid", F.col("a").alias(f"x{p}"), F.col("b").alias(f"x{i}")), ["gid", f"x{p}"])
        for q, d2 in others:
            x = x.join(links.where(F.col("d") == d2).select("gid", F.col("a").alias(f"x{q}"), F.col("b").alias(f"x{i}")), ["gid", f"x{q}", f"x{i}"], "left_semi")
        for j in range(i):
            if t.nodes[order[j]] == t.nodes[n]:
                x = x.where(F.col(f"x{i}") != F.col(f"x{j}"))
        if leaf:
            if (before := seen.get((p, d, t.nodes[n]))) is not None:
                x = x.where(F.col(f"x{i}") > F.col(f"x{before}"))
            seen[p, d, t.nodes[n]] = i
    cols = [f"x{i}" for i in range(1, len(order))]
    m = x.groupBy("gid", "x0", "npos").agg(F.min(F.struct(*cols)).alias("m"))
    return m.select("gid", F.lit(tpos).alias("tpos"), F.col("x0").alias("seed"), "npos", F.array("x0", *[f"m.{c}" for c in cols]).alias("nodes"))


def greedy_disjoint(cands: DataFrame, group: list[str], key: str = "o", uses: str = "uses", takes: str = "takes") -> DataFrame:
    """Rows chosen by taking rows in order of ``key`` (unique in its group), skipping any that use an item an earlier chosen one takes.

    Rounds decide all rows that no undecided earlier one bears on; once no more than SMALL items are undecided, they are decided
    in order on the driver.
    """
    items = cands.select(*group, key, F.explode(uses).alias("item"), takes).select(*group, key, "item", F.array_contains(takes, F.col("item")).alias("takes"))
    live = cut(items, "items")
    chosen = None
    while left := live.count():
        if left <= SMALL:
            now = _in_order(live, group, key)
            chosen = now if chosen is None else chosen.unionByName(now)
            break
        first = live.where("takes").groupBy(*group, "item").agg(F.min(key).alias("first"))
        state = live.join(first, [*group, "item"], "left").groupBy(*group, key).agg(F.min(F.coalesce("first", key)).alias("least"))
        now = cut(state.where(F.col("least") >= F.col(key)).select(*group, key), "chosen")
        chosen = now if chosen is None else chosen.unionByName(now)
        gone = live.where("takes").join(now, [*group, key], "left_semi").select(*group, "item").distinct()
        hit = live.join(gone, [*group, "item"], "left_semi").select(*group, key).distinct()
        rest = cut(live.join(hit.unionByName(now).distinct(), [*group, key], "left_anti"), "items")
        drop(live)
        live = rest
    return cands.limit(0) if chosen is None else cands.join(chosen, [*group, key], "left_semi")


def _in_order(live: DataFrame, group: list[str], key: str) -> DataFrame:
    """The same choice over at most SMALL items, one after the other."""
    cands: dict[tuple, list[tuple]] = {}
    for r in live.collect():
        cands.setdefault((tuple(r[c] for c in group), r[key]), []).append((r["item"], r["takes"]))
    taken: set[tuple] = set()
    out = []
    for g, k in sorted(cands, key=lambda x: x[1]):
        if not any((g, i) in taken for i, _ in cands[g, k]):
            taken |= {(g, i) for i, t in cands[g, k] if t}
            out.append((*g, k))
    return live.sparkSession.createDataFrame(out, live.select(*group, key).schema)


def _absorbing(g: Graph, emb: DataFrame, share_k: int, min_absorb: int, shared_by: str = "processes") -> DataFrame:
    """Embeddings with ``absorb``: their nodes that are not shared, of those that absorb enough."""
    if share_k < 0:
        return emb.withColumn("absorb", F.col("nodes")).where(F.size("absorb") >= min_absorb)
    if shared_by == "edges":
        sh = context_nodes(g, share_k).join(g.nodes.where(F.lower("ntype").contains("process")).select("gid", "nid"), ["gid", "nid"], "left_anti")
    else:
        sh = shared_objects(g, share_k)
    x = emb.select("gid", "tpos", "seed", F.explode("nodes").alias("nid")).join(sh, ["gid", "nid"], "left_anti").groupBy("gid", "tpos", "seed").agg(F.collect_list("nid").alias("absorb"))
    return emb.join(x, ["gid", "tpos", "seed"]).where(F.size("absorb") >= min_absorb)


def fold_counts(g: Graph, templates: list[Template], share_k: int = 2, min_absorb: int = 2) -> dict[int, int]:
    """Position of each template -> number of regions that it folds alone, over all graphs; all templates at once."""
    c = cut(_absorbing(g, cut(first_embeddings(g, templates), "embeddings"), share_k, min_absorb), "absorbing")
    c = numbered(c, ["npos", "seed"], ["gid", "tpos"], name="o").withColumnsRenamed({"nodes": "uses", "absorb": "takes"})
    got = greedy_disjoint(cut(c, "alone"), ["gid", "tpos"]).groupBy("tpos").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a template
    return {i: 0 for i in range(len(templates))} | {r.tpos: r.n for r in got}


def find_regions(g: Graph, templates: list[Template], share_k: int = 2, min_absorb: int = 2, max_instances: int = 100, max_total: int = 1000, shared_by: str = "processes") -> DataFrame:
    """gid, ridx, tpl_id, anchor_type, seed, nodes, absorb: greedy non-overlapping regions.

    A region absorbs its nodes that are not shared by ``share_k`` processes (share_k < 0: all); regions that would absorb fewer
    than ``min_absorb`` are none.  With shared_by='edges' a node is shared by ``share_k`` edges to processes, and processes
    themselves are never shared.  At most ``max_instances`` regions of a template and ``max_total`` in a graph.
    """
    if not templates:
        raise ValueError("no templates")
    if shared_by not in ("processes", "edges"):
        raise ValueError(f"shared_by: {shared_by}")
    c = _absorbing(g, cut(first_embeddings(g, templates), "embeddings"), share_k, min_absorb, shared_by)
    c = cut(numbered(c, ["tpos", "npos", "seed"], ["gid"], name="o"), "candidates")
    while True:
        r = cut(greedy_disjoint(c.withColumnsRenamed({"nodes": "uses", "absorb": "takes"}), ["gid"]), "regions")
        ranked = cut(r.select("gid", "tpos", "o").withColumn("rn", F.row_number().over(W.partitionBy("gid", "tpos").orderBy("o"))), "ranked")
        # a template over its cap stops there: later seeds of it absorb nothing, and what they blocked is free again
        over = ranked.where(F.col("rn") == max_instances).select("gid", "tpos", F.col("o").alias("stop"))
        bad = ranked.where(F.col("rn") > max_instances).groupBy("gid").agg(F.min("tpos").alias("tpos"))
        over = over.join(bad, ["gid", "tpos"], "left_semi")
        if over.isEmpty():
            break
        c = cut(c.join(over, ["gid", "tpos"], "left").where("stop IS NULL OR o <= stop").drop("stop"), "candidates")
    r = numbered(r, ["o"], ["gid"]).where(F.col("rn") <= max_total)
    return cut(r.select("gid", (F.col("rn") - 1).cast("bigint").alias("ridx"), "tpl_id", "anchor_type", "seed", F.col("uses").alias("nodes"), F.array_sort("takes").alias("absorb")), "regions")


def match_profile(g: Graph, templates: list[Template], regions: DataFrame) -> DataFrame:
    """tpl_id, n_seeds, n_embeddings, n_regions: how many seeds each template has, how many of them embed it, and how many regions came of it."""
    links = cut(typed_links(g), "links")
    s = None
    for t in templates:
        one = seeds(g, links, t).agg(F.count(F.lit(1)).alias("n_seeds")).select(F.lit(t.tpl_id).alias("tpl_id"), "n_seeds")
        s = one if s is None else s.unionByName(one)
    e = first_embeddings(g, templates).groupBy("tpl_id").agg(F.count(F.lit(1)).alias("n_embeddings"))
    r = regions.groupBy("tpl_id").agg(F.count(F.lit(1)).alias("n_regions"))
    return s.join(e, "tpl_id", "left").join(r, "tpl_id", "left").fillna(0)


def isomorphic(a: Template, b: Template) -> bool:
    """Whether some renaming keeps types and links (self-loops and repeats aside); templates are small."""
    ea, eb = set(a.simple()), set(b.simple())
    if sorted(a.nodes.values()) != sorted(b.nodes.values()) or len(ea) != len(eb):
        return False
    degree = lambda e, n: (sum(x == n for x, _ in e), sum(y == n for _, y in e))
    order = sorted(a.nodes, key=lambda n: degree(ea, n), reverse=True)

    def grow(m: dict[str, str]) -> bool:
        if len(m) == len(order):
            return True
        n = order[len(m)]
        for c in b.nodes:
            if c in m.values() or b.nodes[c] != a.nodes[n] or degree(eb, c) != degree(ea, n):
                continue
            if all(((n, x) in ea) == ((c, y) in eb) and ((x, n) in ea) == ((y, c) in eb) for x, y in m.items()) and grow({**m, n: c}):
                return True
        return False

    return grow({})

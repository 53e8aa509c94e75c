"""Node features: sinusoidal degree encodings, one-hot types, structural columns; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import Graph
from .graph import degrees
from .order import numbered
from .skew import wide_percentiles

ENCODINGS = ("none", "dual_naive", "rate", "rate_single", "rate_ratio", "rate_ratio_only", "rate_rank")
STRUCTURAL = ("log_deg", "out_in_ratio", "nbr_type_div", "self_loop")


def tape(v: Column, dim: int = 8, base: float = 10_000.0, layout: str = "interleaved") -> Column:
    """Sinusoidal embedding of log1p(max(v, 0)), dim entries; sines and cosines alternate, or stand in two halves (``concatenated``, without the clamp)."""
    if layout not in ("interleaved", "concatenated"):
        raise ValueError(f"layout: {layout}")
    x = F.log1p(F.greatest(v.cast("double"), F.lit(0.0))) if layout == "interleaved" else F.log1p(v.cast("double"))
    angles = [x / (base ** (2 * i / dim)) for i in range((dim + 1) // 2)]
    if layout == "concatenated":
        return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles])
    return F.array(*[f(a) for a in angles for f in (F.sin, F.cos)][: dim])


def vocabulary(nodes: DataFrame) -> list[str]:
    """Node types in order; one entry a type, which a graph has few of."""
    return sorted(r[0] for r in nodes.select(F.coalesce("ntype", F.lit("unknown"))).distinct().collect())


def onehot(ntype: Column, vocab: list[str]) -> Column:
    """0/1 by vocabulary order; types outside the vocabulary give zeros."""
    t = F.coalesce(ntype, F.lit("unknown"))
    return F.array(*[F.when(t == v, 1.0).otherwise(0.0) for v in vocab]) if vocab else F.array().cast("array<double>")


def with_ranks(d: DataFrame) -> DataFrame:
    """``rank_in``, ``rank_out``: places of the degrees within the graph by (value, npos), scaled to 0..1; one node has 0."""
    n = d.groupBy("gid").agg(F.count(F.lit(1)).alias("_n"))
    for c in ("in", "out"):
        d = numbered(d, [f"mu_{c}", "npos"], ["gid"], name=f"_r_{c}")
    scaled = lambda c: F.when(F.col("_n") > 1, (F.col(f"_r_{c}") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return d.join(n, "gid").withColumns({"rank_in": scaled("in"), "rank_out": scaled("out")}).drop("_n", "_r_in", "_r_out")


def encoding(name: str, dim: int = 8, base: float = 10_000.0) -> Column:
    """Array column of an encoding, over the columns of ``degrees`` (and of ``with_ranks`` for rate_rank)."""
    if name not in ENCODINGS:
        raise ValueError(f"encoding: {name}")
    t = lambda c: tape(F.col(c) if isinstance(c, str) else c, dim, base)
    ratio = [t(F.col(f"mu_{s}") / F.greatest(F.col(f"cnt_{s}"), F.lit(1))) for s in ("in", "out")]
    counts = [t("cnt_in"), t("cnt_out")]
    parts = {
        "none": [],
        "dual_naive": counts,
        "rate": [t("mu_in"), t("mu_out")],
        "rate_single": [t(F.col("mu_in") + F.col("mu_out"))],
        "rate_ratio": counts + ratio,
        "rate_ratio_only": ratio,
        "rate_rank": [t("rank_in"), t("rank_out")],
    }[name]
    return F.concat(*parts) if parts else F.array().cast("array<double>")


def structural(g: Graph, true_diversity: bool = False) -> DataFrame:
    """gid, nid, npos and the structural columns.

    ``nbr_type_div`` follows the published definition, which adds a node's own type for each of its edges (so it is 1/#types for
    any node with an edge); with ``true_diversity`` the neighbours' types are counted instead.
    """
    d = degrees(g)
    n_types = g.nodes.groupBy("gid").agg(F.count_distinct("ntype").alias("_types"))
    loops = g.edges.where("src = dst").groupBy("gid", F.col("src").alias("nid")).agg(F.count(F.lit(1)).alias("self_loop"))
    x = g.nodes.select("gid", "nid", "npos").join(d, ["gid", "nid"]).join(loops, ["gid", "nid"], "left").join(n_types, "gid")
    if true_diversity:
        t = g.nodes.select("gid", F.col("nid").alias("k"), "ntype")
        a = g.edges.select("gid", F.col("src").alias("nid"), F.col("dst").alias("k")).unionByName(g.edges.select("gid", F.col("dst").alias("nid"), F.col("src").alias("k"))).distinct()
        div = a.join(t, ["gid", "k"]).groupBy("gid", "nid").agg(F.count_distinct("ntype").alias("_div"))
        x = x.join(div, ["gid", "nid"], "left")
        kinds = F.coalesce("_div", F.lit(0))
    else:
        kinds = F.when(F.col("cnt_in") + F.col("cnt_out") > 0, 1).otherwise(0)
    return x.select(
        "gid", "nid", "npos", F.log1p(F.col("mu_in") + F.col("mu_out")).alias("log_deg"), (F.col("mu_out") / (F.col("mu_in") + 1)).alias("out_in_ratio"), (kinds / F.greatest(F.col("_types"), F.lit(1))).alias("nbr_type_div"), F.coalesce("self_loop", F.lit(0)).cast("double").alias("self_loop")
    )


def robust(df: DataFrame, cols: tuple[str, ...], by: str = "gid", eps: float = 1e-9) -> DataFrame:
    """Columns as (x - median) / IQR within the group, an IQR below eps taken as 1.  The percentiles are exact, of groups of any size."""
    x = df.join(wide_percentiles(df, [by], {f"_{k}_{c}": (c, q) for c in cols for k, q in enumerate((0.25, 0.5, 0.75))}), by)
    for c in cols:
        iqr = F.col(f"_2_{c}") - F.col(f"_0_{c}")
        x = x.withColumn(c, (F.col(c) - F.col(f"_1_{c}")) / F.when(iqr < eps, 1.0).otherwise(iqr))
    return x.select(df.columns)


def features(g: Graph, encoding_name: str = "rate", vocab: list[str] | None = None, semantic: str = "onehot", structural_cols: tuple[str, ...] = STRUCTURAL, scale: bool = False, dim: int = 8, base: float = 10_000.0) -> DataFrame:
    """gid, nid, npos, label, vec: one-hot type, encoding and structural columns, one after the other."""
    if semantic not in ("onehot", "none"):
        raise ValueError(f"semantic: {semantic}")
    if set(structural_cols) - set(STRUCTURAL):
        raise ValueError(f"structural_cols: {structural_cols}")
    d = g.nodes.join(degrees(g), ["gid", "nid"])
    d = with_ranks(d) if encoding_name == "rate_rank" else d
    parts = [onehot(F.col("ntype"), vocabulary(g.nodes) if vocab is None else vocab)] if semantic == "onehot" else []
    parts.append(encoding(encoding_name, dim, base))
    if structural_cols:
        s = structural(g)
        s = robust(s, structural_cols) if scale else s
        d = d.join(s.select("gid", "nid", *structural_cols), ["gid", "nid"])
        parts.append(F.array(*[F.col(c) for c in structural_cols]))
    return d.select("gid", "nid", "npos", "label", F.concat(*parts).alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, floor: float = 1e-12) -> Column:
    """v divided by its length (at least ``floor``)."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return F.transform(v, lambda x: x / n)


def mean_neighbours(g: Graph, feats: DataFrame) -> DataFrame:
    """gid, nid, vec: mean of the neighbours' vectors over undirected edges with multiplicity; nodes without neighbours are left out."""
    e = g.edges.select("gid", F.explode(F.array(F.struct(F.col("src").alias("nid"), F.col("dst").alias("nb")), F.struct(F.col("dst").alias("nid"), F.col("src").alias("nb")))).alias("x")).groupBy("gid", "x.nid", "x.nb").agg(F.count(F.lit(1)).cast("double").alias("w"))
    x = e.join(feats.select("gid", F.col("nid").alias("nb"), "vec"), ["gid", "nb"]).select("gid", "nid", "w", F.posexplode("vec").alias("i", "v"))
    m = x.groupBy("gid", "nid", "i").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return m.groupBy("gid", "nid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s.v).alias("vec"))



def document_vectors(docs: DataFrame, vectors: DataFrame, dim: int, positional_below: int = 100_000, base: float = 10_000.0) -> DataFrame:
    """key, vec: mean of the vectors of a document's known words, each with the sinusoidal position of its place among them added.

    ``docs``: key, words (array); ``vectors``: word, vec (array of dim).  Unknown words are left out, documents of
    ``positional_below`` words or more get no positions, documents without a known word a zero vector.
    """
    words = docs.select("key", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    m = mean_of_words(words, vectors, dim, positional_below, base)
    return docs.select("key").join(m, "key", "left").select("key", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def mean_of_words(words: DataFrame, vectors: DataFrame, dim: int, positional_below: int = 100_000, base: float = 10_000.0) -> DataFrame:
    """The same of documents that are one row a word (key, n: words of the document, pos, word), so that none is ever gathered; documents without a known word are left out."""
    known = numbered(words.join(vectors.select("word", "vec"), "word"), ["pos"], ["key"])
    x = known.select("key", "n", (F.col("rn") - 1).alias("p"), F.posexplode("vec").alias("i", "v"))
    angle = F.col("p") * F.pow(F.lit(base), -(F.col("i") - F.col("i") % 2) / F.lit(float(dim)))
    place = F.when(F.col("n") >= positional_below, 0.0).when(F.col("i") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))
    return x.groupBy("key", "i").agg(F.avg(F.col("v") + place).alias("v")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s.v).alias("vec"))

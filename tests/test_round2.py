"""Loading in true order, checks that fail when they should, mining without shared context, exact percentiles and the smaller operators."""

import io
import json
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.functions import tables
from provspark.operators import alerts, graph, match, metrics, mine, reduce, skew, stats
from provspark.operators.order import numbered
from provspark.sources import cdm, files, lines
from provspark.sources.views import Graph

NODES = "gid string, nid string, npos long, ntype string, label int"
EDGES = "gid string, eidx long, src string, dst string, etype string, ts long, mu double"


def test_lines_in_order(spark, tmp_path):
    """Many blocks of several files: places follow path and line, without gaps."""
    want = []
    for f in ("b.txt", "a.txt", "c.txt"):
        (tmp_path / f).write_text("".join(f"{f} {i} {'x' * (i % 50)}\n" for i in range(3000)))
    for f in ("a.txt", "b.txt", "c.txt"):
        want += [(f, f"{f} {i} {'x' * (i % 50)}") for i in range(3000)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted((r.pos, r.file_name, r.value) for r in lines.lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [g[0] for g in got] == list(range(9000)) and [g[1:] for g in got] == want


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as t:
        for name, text in (("readme", b"no"), ("all.tsv", b"a\tprocess\tb\tfile\tread\t500\nb\tfile\tc\tprocess\twrite\t500\nshort\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    g = files.read_scenes(spark, str(tmp_path / "s.tar.gz"))
    assert [(r.eidx, r.src, r.etype) for r in g.edges.orderBy("eidx").collect()] == [(0, "a", "read"), (1, "b", "write")]
    assert {r.label for r in g.nodes.collect()} == {1}


def rec(kind, host, **body):
    return json.dumps({"datum": {f"x.cdm.{kind}": body}, "hostId": host})


def test_records_of_all_kinds(spark, tmp_path):
    raw = [
        rec("Subject", "A", uuid="S1", type="SUBJECT_PROCESS"), rec("FileObject", "A", uuid="F1", type="FILE_OBJECT_REGULAR"), rec("Principal", "A", uuid="P1", type="PRINCIPAL_LOCAL"),
        rec("Unit", "B", uuid="U1", type="SUBJECT_UNIT"), rec("SrcSinkObject", None, uuid="K1", type="SRC_SINK_OBJECT"), rec("IpcObject", "A", uuid="I1", type="FILE_OBJECT_LINK"),
        rec("Event", "A", uuid="E1", type="FLOWS", names=["read_X"], subject="S1", predicateObject="F1", timestampNanos=5), rec("Event", "B", uuid="E2", type="EVENT_WRITE", names=["no"], subject="S1", predicateObject="F2", timestampNanos=6),
        json.dumps({"type": "EVENT_OPEN", "uuid": "E3", "subject": "S1", "predicateObject": "K1", "hostId": "A"}), json.dumps({"uuid": "E4", "subject": "S1", "predicateObject": {"x.UUID": "P1"}, "names": {"array": [{"string": "Mk"}, "z"]}}),
    ]
    df = spark.createDataFrame([(i, "f", r) for i, r in enumerate(raw)], "rec_id long, file_name string, raw string")
    g = cdm.load(df)
    assert {r.nid: r.ntype for r in g.nodes.collect()} == {"s1": "process", "f1": "file", "p1": "principal", "u1": "unit", "k1": "sink", "i1": "link", "f2": "object"}
    assert [(r.eidx, r.dst, r.etype) for r in g.edges.orderBy("eidx").collect()] == [(6, "f1", "read_x"), (7, "f2", "write"), (8, "k1", "open"), (9, "p1", "mk")]
    only = cdm.load(df, hosts=["A"])
    assert {r.nid for r in only.nodes.collect()} == {"s1", "f1", "p1", "k1", "i1"} and {r.eidx for r in only.edges.collect()} == {6, 8, 9}
    assert {r.eidx for r in cdm.load(df.withColumn("rec_id", F.col("rec_id") * 10), max_records=7).edges.collect()} == {60}
    for f in ("t1.bin.1.gz", "t1.bin.2.gz"):
        import gzip

        (tmp_path / f).write_bytes(gzip.compress("\n".join(raw).encode()))
    two = cdm.read_graphs_of(spark, str(tmp_path), ["bin.1", "bin.2@8"])
    assert {(r.gid, r.n_edges) for r in graph.graph_stats(two).collect()} == {("t1.bin.1.gz", 4), ("t1.bin.2.gz", 2)}


def test_names_and_specs():
    assert lines.parse_gids("0-2, 7,5-6") == [0, 1, 2, 5, 6, 7] and lines.parse_gids("") == []
    assert lines.parse_spec("bin.119@500") == ("bin.119", 500) and lines.parse_spec(" a ") == ("a", None) and lines.parse_spec("a@0") == ("a", None)
    names = ["t.bin.1.gz", "t.bin.11.gz", "x.gz"]
    assert lines.resolve_name(names, "bin.1") == "t.bin.1.gz" and lines.resolve_name(names, "x") == "x.gz"
    with pytest.raises(FileNotFoundError):
        lines.resolve_name(names, "bin.2")


def small(spark):
    nodes = [("g", n, i, t, 0) for i, (n, t) in enumerate([("a", "process"), ("b", "file"), ("c", "file"), ("d", "process")])]
    edges = [("g", i, s, d, e, 1, 1.0) for i, (s, d, e) in enumerate([("a", "b", "r"), ("a", "b", "r"), ("a", "c", "w"), ("d", "c", "w")])]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_each_check_can_fail(spark):
    g = small(spark)
    ok = reduce.edge_dedup(g)
    bad = lambda r: {x.check for x in reduce.invariants(g, r).collect() if x.violations}
    assert bad(ok) == bad(reduce.identity(g)) == set()
    e, n = ok.graph.edges, ok.graph.nodes
    with_edges = lambda x: reduce.Reduced(Graph(n, x), ok.node_map, ok.edge_map)
    assert bad(with_edges(e.withColumn("mu", F.lit(9.0)))) == {"mass_total", "mass_edge"}
    assert bad(with_edges(e.withColumn("dst", F.when(F.col("eidx") == 0, "zz").otherwise(F.col("dst"))))) == {"external", "endpoints"}
    assert bad(reduce.Reduced(ok.graph, ok.node_map, ok.edge_map.where("eidx <> 3"))) == {"cover", "mass_edge", "external"}
    assert bad(reduce.Reduced(Graph(n.unionByName(n.withColumn("nid", F.concat("nid", F.lit("2")))), e), ok.node_map, ok.edge_map)) == {"nodes_monotone"}
    assert "edges_monotone" in bad(with_edges(e.unionByName(e).unionByName(e)))
    sane = lambda r: {x.check for x in reduce.node_map_sanity(g, r).collect() if x.violations}
    assert sane(ok) == set()
    extra = spark.createDataFrame([("g", "regionM1", 9, "process", 0)], NODES)
    assert sane(reduce.Reduced(Graph(n.unionByName(extra), e), ok.node_map, ok.edge_map)) == {"reachable"}
    assert sane(reduce.Reduced(ok.graph, ok.node_map.where("nid <> 'a'"), ok.edge_map)) == {"total"}
    assert sane(reduce.Reduced(ok.graph, ok.node_map.withColumn("new_nid", F.lit("q")), ok.edge_map)) == {"image_exists"}
    assert {(x.nid, x.mass_in, x.mass_out) for x in reduce.node_mass(ok).collect()} == {("a", 0, 3), ("b", 2, 0), ("c", 2, 0), ("d", 0, 1)}


def shared_window(spark, gid):
    """A parent and a library that eight processes share, and three sockets that each has for itself."""
    nodes, edges = [(gid, "P", 0, "process", 0), (gid, "L", 1, "file", 0)], []
    for p in range(8):
        nodes.append((gid, f"p{p}", len(nodes), "process", 0))
        own = [("P", f"p{p}", "fork"), (f"p{p}", "L", "mmap")]
        for k in range(3):
            nodes.append((gid, f"s{p}_{k}", len(nodes), "socket", 0))
            own.append((f"p{p}", f"s{p}_{k}", "connect"))
        edges += [(gid, len(edges) + i, s, d, e, 1, 1.0) for i, (s, d, e) in enumerate(own)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_mining_without_shared_context(spark):
    g, later = shared_window(spark, "w1"), shared_window(spark, "w2")
    t = mine.mine(g, ["process"], min_support=5, context_k=2)
    assert t and all("file" not in x.nodes.values() for x in t)
    r = match.find_regions(later, t)
    assert r.count() >= 8
    after = reduce.collapse(later, r)
    assert not [x for x in reduce.invariants(later, after).collect() if x.violations]


def test_fold_counts_and_variants(spark):
    g = shared_window(spark, "w")
    star = match.Template("s", {"0": "process", "1": "socket", "2": "socket", "3": "socket"}, (("0", "1"), ("0", "2"), ("0", "3")), "0")
    four = match.Template("f", {**star.nodes, "4": "socket"}, (*star.edges, ("0", "4")), "0")
    assert match.fold_counts(g, [star, four, star]) == {0: 8, 1: 0, 2: 8}
    private = graph.drop_nodes(g, graph.context_nodes(g, 2))
    assert [(len(t.nodes), t.support) for t in mine.fan_out_templates(private, ["process"], 3, 5)] == [(4, 8)]
    assert [(len(t.nodes), t.support) for t in mine.mine(private, ["process"], 5, merged_first=True)] == [(4, 8)]
    assert [tuple(x) for x in mine.absorb_conflicts(g).collect()] == [("w", 1, 9, 0)]
    assert [tuple(x) for x in mine.absorb_conflicts(small(spark), 1).collect()] == [("g", 1, 3, 1)]
    p = {(r.proc, r.ntype, r.d): (r.n, r.n_private) for r in graph.egonet_profile(g).collect()}
    assert p["p0", "socket", "o"] == (3, 3) and p["p0", "file", "o"] == (1, 0) and p["P", "process", "o"] == (8, 8)
    lost = graph.missing(spark.createDataFrame([("w", "p0"), ("w", "nope"), ("w", "nope")], "gid string, nid string"), g.nodes)
    assert [tuple(r) for r in lost.collect()] == [("w", "nope")]


@pytest.mark.parametrize("light", [1, 100])
def test_percentiles(spark, light):
    r = random.Random(1)
    rows = [(f"k{i % 3 if i < 900 else 3}", r.choice([r.gauss(0, 1), r.random() * 1e12, 0.0, 1.5, -1e-300])) for i in range(905)]
    bad = [("k0", None), ("k0", float("nan")), ("k1", float("inf")), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows + bad, "k string, v double")
    qs = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {(x.k, x.q): x.value for x in skew.percentiles(df, ["k"], "v", qs, light=light, buckets=16).collect()}
    assert set(got) == {(k, q) for k in ("k0", "k1", "k2", "k3") for q in qs}
    for (k, q), v in got.items():
        assert v == pytest.approx(np.quantile([b for a, b in rows if a == k], q), rel=1e-12, abs=1e-290)
    one = skew.wide_percentiles(df.withColumn("w", F.col("v") * 2), ["k"], {"a": ("v", 0.5), "b": ("w", 0.5)}, light=light).collect()
    assert all(x.b == x.a * 2 for x in one if abs(x.a) > 1e-200)
    whole = skew.percentiles(df, [], "v", (0.5,), light=light).collect()
    assert whole[0].value == pytest.approx(np.quantile([b for _, b in rows] + [1.0], 0.5))
    assert skew.percentiles(df.limit(0), ["k"], "v", (0.5,)).count() == 0


def test_numbered_groups(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("o"), "id", F.lit(2).alias("w"))
    got = numbered(df, ["o", "id"], ["g"], sums={"s": "w"}).collect()
    for g in range(3):
        want = sorted((r.o, r.id) for r in got if r.g == g)
        assert [(r.o, r.id) for r in sorted((r for r in got if r.g == g), key=lambda r: r.rn)] == want
        assert sorted(r.rn for r in got if r.g == g) == list(range(1, len(want) + 1)) and all(r.s == 2 * r.rn for r in got)


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Session())


def test_small_operators(spark, tmp_path):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("n", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 4.0), ("n", None)], "k string, v double")
    assert {r.k: r.status for r in stats.full_match(a, b, ["k"], "v").collect()} == {"x": "same", "y": "changed", "z": "only_new", "n": "same"}
    assert {r.k: r.score for r in stats.outer_scores(b, a.withColumnRenamed("v", "score"), ["k"]).collect()} == {"x": 1.0, "y": 2.0, "z": -1e9, "n": -1e9}
    assert metrics.zeroed(a, "v").agg(F.sum("v")).first()[0] == 0 and metrics.pick(b, {"k": "z"}, ("v", "k")).collect()[0] == (None, 4.0)
    with pytest.raises(ValueError):
        metrics.zeroed(a, "nope")
    d = spark.createDataFrame([(float(i % 7), f"c{i % 9}") for i in range(400)], "d double, c string")
    mean, lo, hi = stats.bootstrap_mean(d, 4000)
    assert lo < mean < hi and abs((hi - lo) - 2 * 1.96 * 2 / 20) < 0.04 and stats.bootstrap_mean(d, 300) == stats.bootstrap_mean(d.repartition(3), 300)
    _, clo, chi = stats.bootstrap_mean(d, 1000, cluster="c")
    assert clo < mean < chi
    files.write_summary(a, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 3
    spark.createDataFrame([("1", 0.5, 1, [2]), ("2", None, None, None)], "nid string, score double, y int, attacks array<int>").write.parquet(str(tmp_path / "p"))
    assert {(r.nid, r.score, r.y, tuple(r.attacks)) for r in files.read_scores(spark, str(tmp_path / "p")).collect()} == {("1", 0.5, 1, (2,)), ("2", -1e9, 0, ())}
    (tmp_path / "l.csv").write_text("node,other,loss\n1,x,0.5\n2,y,bad\n")
    assert [tuple(r) for r in files.read_losses(spark, str(tmp_path / "l.csv")).collect()] == [("1", 0.5)]
    s = spark.createDataFrame([("g", str(i), i, float(i), int(i > 7)) for i in range(10)], "gid string, nid string, npos long, score double, y int")
    e = spark.createDataFrame([("g", i, str(i), str(i + 1), "e", 1, 1.0) for i in range(9)], EDGES)
    big = alerts.uncapped(s, e, top_k=2, q=0.5).collect()
    assert {r.nid for r in big} == {"5", "6", "7", "8", "9"}
    t = alerts.alert_totals(alerts.alert_metrics(alerts.clusters(s, e, top_k=2, bfs_q=0.5), s)).first()
    assert (t.windows, t.gt, t.covered) == (1, 2, 2)

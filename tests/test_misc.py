"""Sources, sinks, features, metrics, statistics, ordering and streaming on small inputs."""

import gzip
import json
import random
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from provspark.functions import normal
from provspark.operators import detect, features, graph, metrics, order, stats
from provspark.sources import cdm, files, views
from provspark.streaming import operators as st


def test_normal_forms(spark):
    rows = [(" EVENT_Read ", "FILE_OBJECT_FILE"), ("event_", " Unprincipled"), (None, None), ("  ", ""), ("event", "Weird ")]
    df = spark.createDataFrame(rows, "e string, t string")
    got = [tuple(r) for r in df.select(normal.etype_form("e"), normal.type_form("t")).collect()]
    assert got == [("read", "file"), ("event", "object"), ("event", None), ("event", ""), ("event", "weird")]


@pytest.mark.parametrize("parts", [1, 7])
def test_numbered(spark, parts):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.randrange(5), i) for i in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = order.numbered(spark.createDataFrame(rows, "g string, v int, i int"), ["v", "i"], ["g"], sums={"run": "v"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = set()
    for g in ("a", "b", None):
        total = 0
        for n, (_, v, i) in enumerate(sorted(x for x in rows if x[0] == g), 1) if g else enumerate(sorted((x for x in rows if x[0] is None), key=lambda x: x[1:]), 1):
            total += v
            want.add((g, v, i, n, total))
    assert {tuple(x) for x in got} == want


def test_tape_and_encodings(spark):
    df = spark.createDataFrame([(3.0, 2, 1, 6.0, 1.0)], "v double, cnt_in long, cnt_out long, mu_in double, mu_out double")
    x = np.log1p(3.0) / 10000 ** (2 * np.arange(4) / 8)
    want = np.stack([np.sin(x), np.cos(x)], 1).ravel()
    assert np.allclose(df.select(features.tape(F.col("v"))).first()[0], want)
    assert np.allclose(df.select(features.tape(F.col("v"), layout="concatenated")).first()[0], np.concatenate([np.sin(x), np.cos(x)]))
    assert len(df.select(features.tape(F.col("v"), 5)).first()[0]) == 5
    for name, n in (("none", 0), ("dual_naive", 16), ("rate", 16), ("rate_single", 8), ("rate_ratio", 32), ("rate_ratio_only", 16)):
        assert len(df.select(features.encoding(name)).first()[0]) == n
    with pytest.raises(ValueError):
        features.encoding("other")


def test_features_and_detector(spark, sf):
    g = views.g_events(spark, sf)
    f = features.features(g, "rate_rank", scale=True).cache()
    n = len(features.vocabulary(g.nodes))
    assert {len(r.vec) for r in f.select("vec").collect()} == {n + 16 + 4}
    m = detect.fit(f, group="gid")
    more = m.add(f.withColumn("gid", F.lit("other")), group="gid")
    assert more.experts.count() == m.experts.count() + 1
    s = detect.score(f, m)
    assert s.where("score < -1e-9 OR score > 2").count() == 0
    assert detect.score(f, detect.Ensemble(m.experts.limit(0))).where("benign").count() == 0


def test_mahalanobis(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 4)) @ r.normal(size=(4, 4)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    got = np.array([y.distance for y in detect.mahalanobis(df, df).orderBy("id").collect()])
    c = np.cov(x.T, bias=True)
    c = (1 - 1e-3) * c + 1e-3 * np.diag(np.diag(c)) + 1e-9 * np.eye(4)
    d = x - x.mean(0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d), rtol=1e-6)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0.1, 0, 1), (0.2, 0, 2), (None, 1, 3)], "score double, y int, pos int")
    for t in ("average", "stable"):
        assert np.isnan(metrics.roc_auc(df, t).first().auc)
    assert metrics.best_f1(df).first().f1 == 0.0
    c = metrics.confusion(df.withColumn("pred", F.lit(1)).limit(0)).first()
    assert (c.tp, c.precision, c.fpr) == (0, 0.0, 0.0)


def test_stats(spark):
    d = lambda v: spark.createDataFrame([(float(x),) for x in v], "d double")
    assert stats.wilcoxon(d([1, 2, 3, 4, 5])) == pytest.approx(2 / 32)
    assert stats.wilcoxon(d([1, 2, 3, 4, 5]), "greater") == pytest.approx(1 / 32)
    assert stats.wilcoxon(d([0, 0])) == 1.0
    assert stats.wilcoxon(d([1, -1, 2, -2, 3, -3])) == pytest.approx(1.0)
    assert stats.wilcoxon(d(range(1, 40))) < 1e-6
    assert stats.tost(d([0.01, -0.01, 0.02, -0.02, 0.0, 0.01]), 0.5) == pytest.approx(1 / 64)
    p = spark.createDataFrame([(1, 0)] * 5 + [(0, 1)] + [(1, 1)] * 4, "a int, b int")
    assert stats.mcnemar(p, "a", "b") == (5, 1, pytest.approx(14 / 64))
    m, lo, hi = stats.bootstrap_mean(d(range(20)), 500)
    assert lo < m == 9.5 < hi
    w = stats.win_tie_loss(d([1, 0, -1, 2])).first()
    assert (w.wins, w.ties, w.losses, w["mean"]) == (2, 1, 1, 0.5)


REC = [
    {"datum": {"x.Subject": {"uuid": "S1", "cmdLine": {"string": "sh"}}}},
    {"datum": {"x.Event": {"uuid": "E1", "type": "EVENT_READ", "subject": {"x.UUID": "S1"}, "predicateObject": {"x.UUID": "F1"}, "timestampNanos": {"long": 5}}}},
    {"datum": {"x.FileObject": {"uuid": "F1", "type": "FILE_OBJECT_DIRECTORY", "path": "/a"}}},
    {"datum": {"x.Event": {"uuid": "E2", "type": "EVENT_WRITE", "subject": "S2", "predicateObject": "N1", "timestampNanos": 7}}},
    {"datum": {"x.NetFlowObject": {"uuid": "N1", "type": "NET_FLOW_OBJECT", "localAddress": "l", "localPort": 1, "remoteAddress": "r", "remotePort": 2}}},
    {"datum": {"x.Event": {"uuid": "E3", "type": "EVENT_FCNTL", "subject": "S1", "predicateObject": "N1", "timestampNanos": 8}}},
    {"datum": {"x.Event": {"uuid": "E4", "type": "EVENT_WRITE", "subject": "S1", "predicateObject": None, "timestampNanos": 8}}},
]


def test_cdm(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        f.write("\n\n".join(map(json.dumps, REC)))
    raw = cdm.read_ndjson(spark, str(tmp_path / "r.json.gz"))
    assert raw.count() == len(REC)
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(REC)], "rec_id long, raw string")
    g = cdm.load(df)
    assert {r.nid: r.ntype for r in g.nodes.collect()} == {"s1": "process", "f1": "dir", "s2": "process", "n1": "netflow"}
    assert sorted((r.src, r.dst, r.etype, r.ts) for r in g.edges.collect()) == [("s1", "f1", "read", 5), ("s1", "n1", "fcntl", 8), ("s2", "n1", "write", 7)]
    assert cdm.load(df, ts_window=(6, 8)).edges.count() == 2
    t = cdm.store(df)
    assert [(r.kind, r.index_id) for r in t["nodes"].orderBy("index_id").collect()] == [("NetFlowObject", 0), ("Subject", 1), ("FileObject", 2)]
    assert [(r.src_index, r.operation, r.dst_index) for r in t["event"].collect()] == [(2, "EVENT_READ", 1)]
    assert t["subject"].first().path == "uuid:s1"


def test_cdm_eight_kinds(spark):
    rec = [
        {"datum": {"x.Event": {"uuid": "E1", "type": "EVENT_READ", "subject": "S1", "predicateObject": "I1", "timestampNanos": 5}}},
        {"datum": {"x.IpcObject": {"uuid": "I1", "type": "IPC_OBJECT", "fd": 1}}},
        {"type": "RECORD_PRINCIPAL", "datum": {"uuid": "P1", "groupIds": [{"groupId": "7"}]}},
        {"datum": {"x.Principal": {"uuid": "P2", "type": "PRINCIPAL_LOCAL"}}},
        {"type": "RECORD_SRC_SINK_OBJECT", "datum": {"uuid": "K1", "type": "SRC_SINK_OBJECT"}},
        {"type": "RECORD_UNIT", "datum": {"uuid": "U1", "type": "SUBJECT_UNIT"}},
        {"datum": {"x.UnitDependency": {"uuid": "D1", "unit": "U1"}}},
        {"datum": {"x.Host": {"uuid": "H1", "hostName": "h"}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rec)], "rec_id long, raw string")
    g = cdm.load(df)
    assert {r.nid: r.ntype for r in g.nodes.collect()} == {"s1": "process", "i1": "ipc", "p1": "object", "p2": "principal", "k1": "sink", "u1": "unit"}
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("s1", "i1")]
    assert cdm.store(df)["nodes"].count() == 0


def test_tsv_and_json_graphs(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\ta\t2\tb\tread\t7\nshort\t1\n2\tc\t3\ta\twrite\t7\n9\ta\t9\ta\tx\t500\n")
    g = files.read_scenes(spark, str(tmp_path / "a.tsv"))
    assert sorted((r.gid, r.nid, r.ntype, r.label) for r in g.nodes.collect()) == [("500", "9", "a", 1), ("7", "1", "a", 0), ("7", "2", "b", 0), ("7", "3", "a", 0)]
    assert [(r.gid, r.ts, r.etype) for r in g.edges.orderBy("gid", "ts").collect()] == [("500", 0, "x"), ("7", 0, "read"), ("7", 1, "write")]
    assert files.read_scenes(spark, str(tmp_path / "a.tsv"), gids=[7]).edges.count() == 2
    files.write_graphs(g, str(tmp_path / "out"))
    back = files.read_graphs(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.nodes.select("gid", "nid", "ntype", "label").collect())) == sorted(map(tuple, g.nodes.select("gid", "nid", "ntype", "label").collect()))
    assert sorted(map(tuple, back.edges.select("gid", "src", "dst", "etype").collect())) == sorted(map(tuple, g.edges.select("gid", "src", "dst", "etype").collect()))


def test_ground_truth_and_cache(spark, tmp_path):
    (tmp_path / "node_1.csv").write_text('AB-1 ,{"a": 1, "b": 2},5\nCD-2,x,6\n')
    got = files.read_ground_truth(spark, str(tmp_path / "node_1.csv")).orderBy("index_id").collect()
    assert [tuple(r) for r in got] == [("ab-1", '{"a": 1, "b": 2}', 5), ("cd-2", "x", 6)]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert files.cached(spark, f"file://{tmp_path}/c", "stage", {"a": 1}, make).count() == 3
    assert files.cached(spark, f"file://{tmp_path}/c", "stage", {"a": 2}, make).count() == 3 and len(calls) == 2


def zigzag(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_avro(spark, tmp_path):
    text = lambda s: zigzag(len(s)) + s
    schema = {"type": "record", "name": "R", "namespace": "x.y", "fields": [{"name": "datum", "type": [{"type": "record", "name": "Subject", "fields": [{"name": "uuid", "type": {"type": "fixed", "name": "UUID", "size": 16}}, {"name": "cmdLine", "type": ["null", "string"]}, {"name": "tags", "type": {"type": "array", "items": "int"}}, {"name": "w", "type": "double"}, {"name": "kind", "type": {"type": "enum", "name": "K", "symbols": ["A", "B"]}}]}]}]}
    one = lambda i: zigzag(0) + bytes([i] * 16) + zigzag(1) + text(b"sh") + zigzag(2) + zigzag(7) + zigzag(-9) + zigzag(0) + struct.pack("<d", 0.5) + zigzag(1)
    meta = zigzag(1) + text(b"avro.schema") + text(json.dumps(schema).encode()) + zigzag(0)
    body = one(1) + one(2)
    data = b"Obj\x01" + meta + b"s" * 16 + zigzag(2) + zigzag(len(body)) + body + b"s" * 16
    (tmp_path / "a.bin.gz").write_bytes(gzip.compress(data))
    rows = files.read_avro_as_json(spark, str(tmp_path / "a.bin.gz")).collect()
    rec = json.loads(rows[0].raw)["datum"]["x.y.Subject"]
    assert len(rows) == 2 and rec == {"uuid": "01010101-0101-0101-0101-010101010101", "cmdLine": {"string": "sh"}, "tags": [7, -9], "w": 0.5, "kind": "B"}
    df = files.read_avro_as_json(spark, str(tmp_path / "a.bin.gz"))
    assert cdm.load(df).nodes.count() == 2


def test_leave_one_out_takes_all_groups(spark, sf):
    from provspark.plans.queries import QUERIES

    t = pq.read_table(f"{sf}/embeddings.parquet", columns=["label", "embedding"]).to_pydict()
    x, grp = np.array(t["embedding"], float), np.array(t["label"])
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    x = unit(x)
    centre = {g: unit(x[grp == g].mean(0)) for g in set(t["label"])}
    want = {g: float(np.mean(1 - (x[grp == g] @ np.stack([c for h, c in centre.items() if h != g]).T).max(1))) for g in centre}
    got = {r.grp: r.mean_score for r in QUERIES["leave_one_out"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(got) == 10


def test_scan_looks_for_labels(spark, tmp_path):
    from provspark.plans.queries import QUERIES

    late, other = "aaaaaaaa-0000-0000-0000-00000000000a", "bbbbbbbb-0000-0000-0000-00000000000b"
    spark.createDataFrame([(1, "f1", f'{{"uuid": "{late.upper()}", "x": "{other}"}}'), (2, "f1", f'"{late}"'), (3, "f2", None), (4, "f2", f'"{other}"')], "rec_id long, file_name string, raw string").write.parquet(f"{tmp_path}/tccdmdatum.parquet")
    spark.createDataFrame([(f" {late.upper()} ", "a", 1), (None, "b", 2)], "uuid string, attributes string, index_id long").write.parquet(f"{tmp_path}/gt_nodes.parquet")
    spark.createDataFrame([("g", 100, late), ("g", 0, other)], "gid string, eidx long, src string").write.parquet(f"{tmp_path}/edges.parquet")
    assert sorted((r.file_name, r.n_records, r.n_hits) for r in QUERIES["scan_files"](spark, str(tmp_path)).collect()) == [("f1", 2, 1), ("f2", 1, 0)]


def test_pairs_keep_slots_of_repeated_rows(spark, tmp_path):
    from provspark.plans.queries import QUERIES

    a = [("c", "f1", 0.25), ("c", "f1", 0.25), ("c", "f2", 0.5), ("c", "f3", 0.1), ("c", "only", 1.0), (None, "f1", 1.0)]
    b = [("c", "f1", 0.75), ("c", "f2", 0.25), ("c", "f2", 0.5), ("c", "f2", 0.25), ("c", "f2", None), ("c", "f3", 0.1), (None, "f1", 0.0)]
    for name, rows in (("e6_alert_full", a), ("e6_alert_full_v3", b)):
        spark.createDataFrame(rows, "config string, file string, F1_alert double").write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    assert sorted(map(tuple, QUERIES["paired_diff"](spark, d).collect())) == [("c", "f1", 0.5), ("c", "f2", -0.125), ("c", "f3", 0.0)]
    assert tuple(QUERIES["win_tie_loss"](spark, d).first())[:4] == (1, 1, 1, 0.125)
    got = {r.stat: r.value for r in QUERIES["paired_tests"](spark, d).collect()}
    assert got["mean"] == 0.125 and (got["only_a"], got["only_b"]) == (1.0, 1.0)


def test_splits(spark):
    g = spark.createDataFrame([(str(i), i >= 8) for i in range(10)], "gid string, attack boolean")
    s = {r.gid: r.part for r in graph.benign_split(g, 0.75).collect()}
    assert s["8"] == s["9"] == "test" and sum(v == "train" for v in s.values()) == 6


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/edges.parquet").where("src IS NOT NULL AND dst IS NOT NULL").limit(400)
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    schema = e.schema
    src = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = st.stream_edge_dedup(src(), watermark="0 seconds").writeStream.format("memory").queryName("dedup").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(mu) FROM (SELECT gid, start, src, dst, etype, max(mu) mu FROM dedup GROUP BY ALL)").first()[0] == 400.0
    q = st.stream_last_neighbours(src(), 3).writeStream.format("memory").queryName("last").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    got = {(r.gid, r.nid): r.neighbours for r in spark.sql("SELECT * FROM last").collect()}
    rows = e.select("gid", "eidx", "src", "dst").collect()
    key = next(iter(got))
    want = sorted({(r.eidx, r.dst) for r in rows if (r.gid, r.src) == key} | {(r.eidx, r.src) for r in rows if (r.gid, r.dst) == key}, reverse=True)[:3]
    assert got[key] == [b for _, b in want]


def test_document_vectors(spark):
    docs = spark.createDataFrame([("a", ["x", "?", "y", "x"]), ("b", ["?"]), ("c", [])], "key string, words array<string>")
    v = {"x": [1.0, 2.0, 3.0], "y": [0.0, -1.0, 5.0]}
    got = {r.key: r.vec for r in features.document_vectors(docs, spark.createDataFrame(list(v.items()), "word string, vec array<double>"), 3).collect()}
    div = np.exp(np.arange(0, 3, 2) * (-np.log(10000.0) / 3))
    pe = np.zeros((3, 4))
    pe[:, 0::2], pe[:, 1::2] = np.sin(np.arange(3)[:, None] * div), np.cos(np.arange(3)[:, None] * div)
    assert np.allclose(got["a"], (np.array([v["x"], v["y"], v["x"]]) + pe[:, :3]).mean(0))
    assert got["b"] == got["c"] == [0.0] * 3

"""File formats in and out."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered
from .lines import lines
from .views import Graph

_TSV = "src string, src_type string, dst string, dst_type string, event string, gid bigint"
_GRAPH = "gid string, nodes map<string, struct<type: string, attrs: map<string, string>>>, edges array<struct<src: string, dst: string, etype: string, ts: bigint, mu: double>>, labels map<string, int>, meta map<string, string>"


def read_scenes(spark: SparkSession, path: str, gids: list[int] | None = None, split: str = "scenes", label_scene: int = 5, max_lines: int | None = None) -> Graph:
    """Tab-separated scene files, plain, gzip or the first .tsv of a tar archive (src, src_type, dst, dst_type, event, gid); shorter rows are left out; ts is the row's place in its graph; a node's first type stays; whole graphs are labelled by scene (gid // 100) or by 125 <= gid < 150."""
    if split not in ("scenes", "range"):
        raise ValueError(f"split: {split}")
    raw = lines(spark, path, ".tsv").select("pos", F.split("value", "\t").alias("c"))
    if max_lines is not None:
        raw = raw.where(F.col("pos") < max_lines)
    t = raw.where(F.size("c") >= 6).select("pos", *[F.get("c", F.lit(i)).cast(x.split()[1]).alias(x.split()[0]) for i, x in enumerate(_TSV.split(", "))])
    if gids is not None:
        t = t.where(F.col("gid").isin(gids))
    t = numbered(t, ["pos"], ["gid"])
    g = F.col("gid").cast("string").alias("gid")
    attack = (F.floor(F.col("gid") / 100) == label_scene) if split == "scenes" else F.col("gid").between(125, 149)
    edges = t.select(g, (F.col("rn") - 1).cast("bigint").alias("eidx"), "src", "dst", F.col("event").alias("etype"), (F.col("rn") - 1).cast("bigint").alias("ts"), F.lit(1.0).alias("mu"))
    ends = t.select("gid", "pos", attack.cast("int").alias("label"), F.explode(F.array(F.struct(F.col("src").alias("nid"), F.col("src_type").alias("t"), F.lit(0).alias("o")), F.struct(F.col("dst").alias("nid"), F.col("dst_type").alias("t"), F.lit(1).alias("o")))).alias("x"))
    nodes = ends.groupBy("gid", "x.nid").agg(F.min(F.struct((F.col("pos") * 2 + F.col("x.o")).alias("p"), "x.t")).alias("f"), F.max("label").alias("label"))
    return Graph(nodes.select(g, "nid", F.col("f.p").alias("npos"), F.col("f.t").alias("ntype"), "label"), edges)


def write_graphs(g: Graph, path: str) -> None:
    """One JSON object a graph.  For exchange with tools that want whole graphs: a graph must fit a row; keep large ones as Parquet."""
    n = g.nodes.groupBy("gid").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("npos", "nid", "ntype"))), lambda x: F.struct(x.nid, F.struct(x.ntype.alias("type"))))).alias("nodes"), F.map_from_entries(F.collect_list(F.when(F.col("label") == 1, F.struct("nid", "label")))).alias("labels"))
    e = g.edges.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("eidx", "src", "dst", "etype", "ts", "mu"))), lambda x: F.struct(x.src.alias("src"), x.dst.alias("dst"), x.etype.alias("etype"), x.ts.alias("ts"), x.mu.alias("mu"))).alias("edges"))
    n.join(e, "gid", "left").write.mode("overwrite").json(path)


def read_graphs(spark: SparkSession, path: str) -> Graph:
    r = spark.read.schema(_GRAPH).json(path)
    n = r.select("gid", "labels", F.posexplode(F.map_entries("nodes")).alias("npos", "x")).select("gid", F.col("x.key").alias("nid"), F.col("npos").cast("bigint").alias("npos"), F.col("x.value.type").alias("ntype"), F.coalesce(F.try_element_at("labels", F.col("x.key")), F.lit(0)).alias("label"))
    e = r.select("gid", F.posexplode("edges").alias("eidx", "e")).select("gid", F.col("eidx").cast("bigint").alias("eidx"), "e.*").withColumn("mu", F.coalesce("mu", F.lit(1.0)))
    return Graph(n, e)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """uuid, attributes, index_id of CSV files without a header; the attributes may hold commas."""
    t = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", ",").alias("c"))
    return t.select(F.lower(F.trim(F.get("c", F.lit(0)))).alias("uuid"), F.array_join(F.slice("c", F.lit(2), F.greatest(F.size("c") - 2, F.lit(0))), ",").alias("attributes"), F.get("c", F.size("c") - 1).try_cast("bigint").alias("index_id"))


def scan(records: DataFrame, gt: DataFrame) -> DataFrame:
    """file_name, n_records, ts_lo, ts_hi, n_hits: records of each file, their known times, and labelled uuids they name.  ``records``: file_name, raw; ``gt``: nid."""
    low = F.lower("raw")
    ts = F.regexp_extract("raw", r'"timestampNanos[\\"]*:\s*(?:\{[\\"]*long[\\"]*:\s*)?(\d+)', 1).try_cast("bigint")
    own = records.groupBy("file_name").agg(F.count("raw").alias("n_records"), F.min(ts).alias("ts_lo"), F.max(ts).alias("ts_hi"))
    ids = records.select("file_name", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"), F.lit(0)))).alias("nid"))
    hits = ids.join(gt.select("nid"), "nid", "left_semi").distinct().groupBy("file_name").agg(F.count(F.lit(1)).alias("n_hits"))
    return own.join(hits, "file_name", "left").fillna(0, ["n_hits"])


def max_loss(losses: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, loss: the greatest loss of each node over all files, 0 for nodes without one."""
    m = losses.groupBy("node").agg(F.max("loss").alias("loss"))
    return nodes.select("node").distinct().join(m, "node", "left").select("node", F.coalesce("loss", F.lit(0.0)).alias("loss"))


def fingerprint(params: dict) -> str:
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, stage: str, params: dict, make) -> DataFrame:
    """A stage's table at a path made of all its parameters; made and written if it isn't there."""
    path = f"{root.rstrip('/')}/{stage}-{fingerprint(params)}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Result rows in typed columns; rows with other columns merge by name when read with mergeSchema."""
    rows.write.mode("append").parquet(path)


def write_jdbc(rows: DataFrame, url: str, name: str, batch: int = 50_000, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=name, batchsize=str(batch), **options).mode("append").save()


def write_summary(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, replacing what is there."""
    rows.write.mode("overwrite").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """nid, score, y, attacks (array of int) of stored score files (Parquet); ids as text, a missing score is -1e9, attacks may be missing."""
    t = spark.read.parquet(path)
    attacks = F.coalesce(F.col("attacks").cast("array<int>"), F.array().cast("array<int>")) if "attacks" in t.columns else F.array().cast("array<int>")
    return t.select(F.col("nid").cast("string").alias("nid"), F.coalesce(F.col("score").cast("double"), F.lit(-1e9)).alias("score"), F.coalesce(F.col("y").cast("int"), F.lit(0)).alias("y"), attacks.alias("attacks"))


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """node, loss of CSV files with a header; other columns are not parsed, rows without a number are left out."""
    t = spark.read.option("header", True).csv(path).select(F.col("node").cast("string").alias("node"), F.col("loss").try_cast("double").alias("loss"))
    return t.where("node IS NOT NULL AND loss IS NOT NULL")


class _Avro:
    """Reader of Avro object container bytes: values as JSON-able objects with union tags, fixed(16) as UUID text."""

    def __init__(self, data: bytes):
        self.b, self.p = data, 0

    def long(self) -> int:
        n = shift = 0
        while True:
            c = self.b[self.p]
            self.p += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        self.p += n
        return self.b[self.p - n : self.p]

    def value(self, s, names: dict):
        if isinstance(s, list):
            i = self.long()
            v = self.value(s[i], names)
            t = s[i]["name"] if isinstance(t := s[i], dict) and "name" in s[i] else t["type"] if isinstance(t, dict) else t
            return None if t == "null" else {self.full(t, names): v}
        if isinstance(s, str):
            if s in names:
                return self.value(names[s], names)
            return {"null": lambda: None, "boolean": lambda: self.take(1) == b"\x01", "int": self.long, "long": self.long, "float": lambda: struct.unpack("<f", self.take(4))[0], "double": lambda: struct.unpack("<d", self.take(8))[0], "bytes": lambda: self.take(self.long()).hex(), "string": lambda: self.take(self.long()).decode("utf-8", "replace")}[s]()
        t = s["type"]
        if t == "record":
            return {f["name"]: self.value(f["type"], names) for f in s["fields"]}
        if t == "enum":
            return s["symbols"][self.long()]
        if t == "fixed":
            h = self.take(s["size"]).hex()
            return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}".upper() if s["size"] == 16 else h
        if t in ("array", "map"):
            out: list = []
            while n := self.long():
                if n < 0:
                    n = -n
                    self.long()
                for _ in range(n):
                    out.append((self.take(self.long()).decode(), self.value(s["values"], names)) if t == "map" else self.value(s["items"], names))
            return dict(out) if t == "map" else out
        return self.value(t, names)

    @staticmethod
    def full(t: str, names: dict) -> str:
        return next((n for n in names if n.rpartition(".")[2] == t and "." in n), t)


def _named(s, out: dict, space: str = "") -> dict:
    if isinstance(s, list):
        for x in s:
            _named(x, out, space)
    elif isinstance(s, dict):
        space = s.get("namespace", space)
        if s.get("name"):
            out[s["name"]] = s
            out[f"{space}.{s['name']}" if space and "." not in s["name"] else s["name"]] = s
        for f in s.get("fields", []):
            _named(f["type"], out, space)
        for k in ("items", "values", "type"):
            if isinstance(s.get(k), (dict, list)):
                _named(s[k], out, space)
    return out


def avro_records(data: bytes) -> Iterator[dict]:
    """Records of an Avro object container (codec null or deflate, optionally gzipped as a whole)."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 47)
    if data[:4] != b"Obj\x01":
        raise ValueError("not an Avro object container")
    r = _Avro(data)
    r.p = 4
    meta = r.value({"type": "map", "values": "bytes"}, {})
    schema, codec = json.loads(bytes.fromhex(meta["avro.schema"])), bytes.fromhex(meta.get("avro.codec", "")).decode() or "null"
    if codec not in ("null", "deflate"):
        raise ValueError(f"codec {codec}")
    names = _named(schema, {})
    r.take(16)
    while r.p < len(data):
        n, size = r.long(), r.long()
        block = r.take(size)
        r.take(16)
        b = _Avro(zlib.decompress(block, -15) if codec == "deflate" else block)
        for _ in range(n):
            yield b.value(schema, names)


def read_avro_as_json(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, file_name, raw: the records of Avro files as JSON texts with union tags; a file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, key, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, texts = [], []
                for i, rec in enumerate(avro_records(data)):
                    ids.append((key << 32) + i)
                    texts.append(json.dumps(rec, ensure_ascii=False))
                    if len(ids) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(texts)], names=["rec_id", "file_name", "raw"])
                        ids, texts = [], []
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(texts)], names=["rec_id", "file_name", "raw"])

    f = spark.read.format("binaryFile").load(path)
    f = numbered(f.select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("name")), ["path"]).join(f.select("path", "content"), "path")
    return f.select("name", F.col("rn").cast("bigint"), "content").mapInArrow(run, "rec_id bigint, file_name string, raw string")

"""Audit records as graphs and as a relational store (S8, S9, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import bare, etype_form, type_form
from ..functions.tables import cut
from ..operators import nested
from ..operators.order import numbered
from .lines import files_in, lines, parse_spec, resolve_name
from .views import Graph

#: Event types whose arrow points from the object to the subject in the store.
READ_LIKE = ("EVENT_EXECUTE", "EVENT_LSEEK", "EVENT_MMAP", "EVENT_OPEN", "EVENT_ACCEPT", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG", "EVENT_READ_SOCKET_PARAMS", "EVENT_CHECK_FILE_ATTRIBUTES", "READ")
#: Event types the store leaves out.
LEFT_OUT = ("EVENT_FCNTL", "EVENT_OTHER", "EVENT_ADD_OBJECT_ATTRIBUTE", "EVENT_FLOWS_TO")

#: Types that only occur in graphs of records, and their canonical type.
OBJECT_TYPES = {"file_object_link": "link", "file_object_regular": "file", "src_sink_object": "sink", "principal_local": "principal", "subject_unit": "unit", "subject_user": "user"}


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, file_name, raw of text files (gzip and tar too), one record a line, blank lines left out.  rec_id is the line's place over all files in order of path."""
    return lines(spark, path).where(F.trim("value") != "").select(F.col("pos").alias("rec_id"), "file_name", F.col("value").alias("raw"))


def _f(name: str):
    return F.try_element_at("fields", F.lit(name))


def load(records: DataFrame, gid: str | None = "cdm", ts_window: tuple[int, int] | None = None, hosts: list[str] | None = None, max_records: int | None = None) -> Graph:
    """Graph of raw records (rec_id, raw), or with gid=None one graph a file (rec_id, file_name, raw).

    Subjects are nodes of type ``process``; objects (files, netflows, units, principals, sources and sinks, ipc) have their mapped type and upgrade a placeholder of type ``object`` (a later
    subject does not); events are edges subject -> predicateObject, left out without both ends; ends without a record of their
    own are ``process`` (or the event's subjectType) and ``object``.  An event's type is what follows EVENT_, else the first of its
    names, else its type.  Records of a known host that is not among ``hosts`` are left out; ``max_records`` are the first of a graph.
    Edges and nodes are in the order of rec_id.
    """
    part = F.lit(gid) if gid is not None else F.coalesce("file_name", F.lit(""))
    x = records.select("rec_id", "raw", part.alias("part"))
    if max_records is not None:
        x = numbered(x, ["rec_id"], ["part"]).where(F.col("rn") <= max_records)
    r = nested.flatten_records(x, kinds=nested.GRAPH_KINDS, part_col="part")
    r = cut(r.select("part", "rec_id", "kind", F.lower("uuid").alias("uuid"), "host", "name", "fields"), "records")
    if hosts is not None:
        r = r.where(F.col("host").isNull() | (F.col("host") == "") | F.col("host").isin(hosts))
    named = F.when(~F.coalesce(bare(_f("type")), F.lit("")).startswith("event_") & (F.col("name") != ""), F.lower("name"))
    ev = r.where("kind = 'Event'").select("part", "rec_id", F.lower(_f("subject")).alias("src"), F.lower(_f("predicateObject")).alias("dst"), F.coalesce(named, etype_form(_f("type"))).alias("etype"), F.coalesce(_f("timestampNanos").try_cast("bigint"), F.lit(0)).alias("ts"), F.coalesce(F.nullif(_own_type(_f("subjectType")), F.lit("")), F.lit("process")).alias("stype"))
    ev = ev.where("src IS NOT NULL AND src <> '' AND dst IS NOT NULL AND dst <> ''")
    if ts_window:
        ev = ev.where(F.col("ts").between(*ts_window))
    ev = cut(ev, "cdm_events")
    own = F.coalesce(F.nullif(_own_type(_f("type")), F.lit("")), F.lit("object"))
    defs = r.where("kind <> 'Event' AND uuid IS NOT NULL AND uuid <> ''").select("part", F.col("uuid").alias("nid"), (F.col("rec_id") * 3).alias("pos"), F.when(F.col("kind") == "Subject", "process").otherwise(own).alias("t"), (F.col("kind") != "Subject").alias("upgrade"))
    ends = ev.select("part", F.explode(F.array(F.struct(F.col("src").alias("nid"), (F.col("rec_id") * 3 + 1).alias("pos"), F.col("stype").alias("t")), F.struct(F.col("dst").alias("nid"), (F.col("rec_id") * 3 + 2).alias("pos"), F.lit("object").alias("t")))).alias("x")).select("part", "x.nid", "x.pos", "x.t", F.lit(False).alias("upgrade"))
    n = defs.unionByName(ends).groupBy("part", "nid").agg(F.min(F.struct("pos", "t")).alias("first"), F.min(F.when(F.col("upgrade") & (F.col("t") != "object"), F.struct("pos", "t"))).alias("up"))
    kind = F.when((F.col("first.t") == "object") & F.col("up").isNotNull(), F.col("up.t")).otherwise(F.col("first.t"))
    nodes = n.select(F.col("part").alias("gid"), "nid", F.col("first.pos").alias("npos"), kind.alias("ntype"), F.lit(0).alias("label"))
    edges = ev.select(F.col("part").alias("gid"), F.col("rec_id").alias("eidx"), "src", "dst", "etype", "ts", F.lit(1.0).alias("mu"))
    return Graph(nodes, edges)


def _own_type(c):
    """Canonical type of a record's node."""
    form = type_form(c)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OBJECT_TYPES.items() for x in kv]), form), form)


def read_graphs_of(spark: SparkSession, folder: str, specs: list[str], **kw) -> Graph:
    """One graph a file: ``specs`` are short names of files of the folder, with @n for their first n records.  Other options are those of ``load``."""
    out, names = None, files_in(spark, folder)
    for spec in specs:
        short, most = parse_spec(spec)
        g = load(read_ndjson(spark, f"{folder}/{resolve_name(names, short)}"), gid=None, max_records=most, **kw)
        out = g if out is None else Graph(out.nodes.unionByName(g.nodes), out.edges.unionByName(g.edges))
    return out


def store(records: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """netflow, subject, file, nodes and event tables.

    index_id runs over netflows, then subjects, then files, by rec_id; hash_id is sha256 of the uuid.  With ``strict`` only
    records with all their naming fields count.  Events need both ends in the store (the object is looked up among files, then
    netflows, then subjects); read-like ones point from the object to the subject; some types are left out.
    """
    r = cut(nested.flatten_records(records).where("uuid IS NOT NULL").select("rec_id", "kind", "uuid", "fields"), "records")
    net = [_f(x) for x in ("localAddress", "localPort", "remoteAddress", "remotePort")]
    full = F.when(F.col("kind") == "NetFlowObject", net[0].isNotNull() & net[1].isNotNull() & net[2].isNotNull() & net[3].isNotNull()).when(F.col("kind") == "Subject", _f("cmdLine").isNotNull()).otherwise(F.coalesce(_f("path"), _f("filename")).isNotNull())
    n = r.where("kind <> 'Event'")
    n = n.where(full) if strict else n
    place = F.when(F.col("kind") == "NetFlowObject", 0).when(F.col("kind") == "Subject", 1).otherwise(2)
    n = numbered(n.select("rec_id", "kind", F.lower("uuid").alias("node_uuid"), "fields", place.alias("place")), ["place", "rec_id"])
    n = cut(n.withColumns({"hash_id": F.sha2("node_uuid", 256), "index_id": (F.col("rn") - 1).cast("bigint")}), "store_nodes")
    one = lambda kind, **cols: n.where(F.col("kind") == kind).select("node_uuid", "hash_id", *[c.alias(k) for k, c in cols.items()], "index_id")
    tables = {
        "netflow": one("NetFlowObject", src_addr=net[0], src_port=net[1], dst_addr=net[2], dst_port=net[3]),
        "subject": one("Subject", path=fill_label(_f("path"), F.col("node_uuid")), cmd=_f("cmdLine")),
        "file": one("FileObject", path=fill_label(F.coalesce(_f("path"), _f("filename")), F.col("node_uuid"))),
    }
    ids = n.select("node_uuid", "kind", "hash_id", "index_id")
    tables["nodes"] = ids
    ev = r.where("kind = 'Event'").select(F.lower("uuid").alias("event_uuid"), _f("type").alias("operation"), F.lower(_f("subject")).alias("s"), F.lower(_f("predicateObject")).alias("o"), _f("timestampNanos").try_cast("bigint").alias("timestamp")).where(F.col("operation").isNotNull() & ~F.col("operation").isin(*LEFT_OUT) & F.col("timestamp").isNotNull())
    sub = ids.where("kind = 'Subject'").select(F.col("node_uuid").alias("s"), F.col("hash_id").alias("sh"), F.col("index_id").alias("si"))
    order = F.when(F.col("kind") == "FileObject", 0).when(F.col("kind") == "NetFlowObject", 1).otherwise(2)
    obj = ids.groupBy(F.col("node_uuid").alias("o")).agg(F.min_by(F.struct("hash_id", "index_id"), order).alias("x")).select("o", F.col("x.hash_id").alias("oh"), F.col("x.index_id").alias("oi"))
    e, back = ev.join(sub, "s").join(obj, "o"), F.col("operation").isin(*READ_LIKE)
    swap = lambda a, b, name: F.when(back, F.col(b)).otherwise(F.col(a)).alias(name)
    tables["event"] = e.select(swap("sh", "oh", "src_hash"), swap("si", "oi", "src_index"), "operation", swap("oh", "sh", "dst_hash"), swap("oi", "si", "dst_index"), "event_uuid", "timestamp")
    return tables


def fill_label(value, uuid):
    """A label, or one made of the uuid where it is missing."""
    return F.when(value.isNull() | (value == ""), F.concat(F.lit("uuid:"), uuid)).otherwise(value)

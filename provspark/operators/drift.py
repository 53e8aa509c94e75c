"""Problem 5: schemas that drift between files.

Method: every file's columns are profiled (type, filled values, name, and a value sketch), neighbouring versions are compared by a
bipartite matching between fields that went and fields that came, weighted by values, types and name similarity, and matched
columns are unified.

* A record meets the one of the same name in the file before in one shuffle, by a window over the versions of its series, with
  only the fields that went or came; all comparing is then within a row.
* The sketch of a field is the least of each of HASHES hashes of its (record, value) pairs over the common records.  Two fields
  equal in a share of 0.9 of the rows have a Jaccard similarity of 0.9 / 1.1 at least, so AGREE or more of 48 minima agree but
  for a chance of 4e-9; sizes that differ by more than a tenth exclude a pair for certain.  Only pairs of fields that the sketches
  leave are counted, exactly, over all common records.

Only profiles and sketches (fields of a file) meet in one group; a file or series that holds a third of all rows is spread over
its records.

Defined results
* a record is named by (config, file); of repeated rows the first by line counts; rows without one of both names are in the
  unified table but in no comparison;
* an empty CSV field or a null is missing; a field without values is an integer (all its values, none, are integers);
* values are equal if their texts are, or if both are numbers of equal value;
* blank lines, repeated headers, byte order marks and trailing carriage returns are no data; cells beyond the header are
  dropped, missing cells are missing; a name repeated in a header counts once, its first column;
* a file without a header line or rows has no fields; null file_no or line_no rows are ignored.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.tables import cut

SAME = 0.9
#: Hashes of a sketch, and how many minima of two must agree.
HASHES, AGREE = 48, 22
NAMED = ("config", "file")
_INT, _DEC, _BOOL = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"), re.compile(r"true|false", re.I)
#: Types as bits: what a value may not be is set; a column's bits are the union.
NOT_INT, NOT_DEC, NOT_BOOL = 1, 2, 4


def _split(line: str) -> list[str]:
    return next(csv.reader([line]), [])


def csv_lines(lines: DataFrame) -> DataFrame:
    """Lines split into cells, blank lines left out; line 1 of a file is its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            out = {k: [] for k in ("series", "file_name", "file_no", "line_no", "is_header", "cells")}
            for s, f, n, i, line in zip(*d.values(), strict=True):
                line = line.removeprefix("\ufeff").rstrip("\r\n")
                if not line.strip():
                    continue
                for k, v in zip(out, (s, f, n, i, i == 1, _split(line)), strict=True):
                    out[k].append(v)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    cols = lines.select("series", "file_name", F.col("file_no").cast("int"), F.col("line_no").cast("bigint"), "line").where("line IS NOT NULL AND file_no IS NOT NULL AND line_no IS NOT NULL AND file_name IS NOT NULL")
    return cols.mapInArrow(run, "series string, file_name string, file_no int, line_no bigint, is_header boolean, cells array<string>")


def csv_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """series, file_name, file_no, line_no, names (array), cells (array): data lines with their file's header; and the headers.

    The headers, one row a file, are joined to the lines; Spark splits a file of many lines by itself (skew join).
    """
    split = csv_lines(lines)
    head = split.where("is_header").groupBy("series", "file_name", "file_no").agg(F.min_by("cells", "line_no").alias("names"))
    rows = split.where("NOT is_header").join(head, [split.series.eqNullSafe(head.series), split.file_name == head.file_name, split.file_no == head.file_no]).select(split["*"], head.names)
    return rows.where("cells != names").select("series", "file_name", "file_no", "line_no", "names", "cells"), head


def csv_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, fields).  rows: series, file_name, ord, line_no, k_config, k_file and pairs (field, value or null) of each record; fields: one row per (file, field)."""
    rows, head = csv_records(lines)
    pair = F.transform(F.array_distinct("names"), lambda n: F.struct(n.alias("field"), F.nullif(F.get("cells", (F.array_position("names", n) - 1).cast("int")), F.lit("")).alias("value")))
    value = lambda name: F.get(F.filter("pairs", lambda p: p.field == name), 0).value
    wide = rows.select("series", "file_name", F.col("file_no").cast("bigint").alias("ord"), "line_no", pair.alias("pairs"))
    fields = head.select("series", "file_name", F.col("file_no").cast("bigint").alias("ord"), F.explode(F.array_distinct("names")).alias("field")).withColumn("stored", F.lit(None).cast("string"))
    return wide.select("series", "file_name", "ord", "line_no", *[value(n).alias(f"k_{n}") for n in NAMED], "pairs"), fields


def cells_of(rows: DataFrame) -> DataFrame:
    """One row per (record, field)."""
    return rows.select("series", "file_name", "ord", "line_no", "k_config", "k_file", F.explode("pairs").alias("p")).select("*", "p.field", "p.value").drop("p")


_STORED = {T.IntegerType: "integer", T.LongType: "integer", T.ShortType: "integer", T.ByteType: "integer", T.DoubleType: "decimal", T.FloatType: "decimal", T.DecimalType: "decimal", T.BooleanType: "boolean"}


def stored_rows(tables: list[tuple[str, DataFrame]], series: str) -> tuple[DataFrame, DataFrame]:
    """The same two frames of stored tables, in the order given."""
    rows, fields = None, []
    for i, (name, df) in enumerate(tables, 1):
        kinds = {f.name: _STORED.get(type(f.dataType), "text") for f in df.schema}
        fields += [(series, name, i, f, k) for f, k in kinds.items()]
        pair = F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.col(f"`{f}`").cast("string"), F.lit("")).alias("value")) for f in kinds])
        named = [F.nullif(F.col(n).cast("string") if n in kinds else F.lit(None).cast("string"), F.lit("")).alias(f"k_{n}") for n in NAMED]
        one = df.select(F.lit(series).alias("series"), F.lit(name).alias("file_name"), F.lit(i).cast("bigint").alias("ord"), F.xxhash64(*[f"`{f}`" for f in kinds]).alias("line_no"), *named, pair.alias("pairs"))
        rows = one if rows is None else rows.unionByName(one)
    return rows, tables[0][1].sparkSession.createDataFrame(fields, "series string, file_name string, ord bigint, field string, stored string")


def profiles(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Type, filled count and value sketch of every (file, field); the fields of files without rows are there too."""
    v = F.col("value")
    bits = F.when(v.isNull(), 0).otherwise(
        F.when(v.rlike(f"^(?:{_INT.pattern})$"), NOT_BOOL).otherwise(F.when(v.rlike(f"^(?:{_DEC.pattern})$"), NOT_INT | NOT_BOOL).otherwise(F.when(v.rlike("^(?i:true|false)$"), NOT_INT | NOT_DEC).otherwise(NOT_INT | NOT_DEC | NOT_BOOL)))
    )
    key = ["series", "file_name", "ord", "field"]
    got = cells.groupBy(*key).agg(F.bit_or(bits).alias("bits"), F.count("value").alias("filled"))
    kind = F.coalesce("stored", F.when(F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(NOT_INT) == 0, "integer").when(F.col("bits").bitwiseAND(NOT_DEC) == 0, "decimal").when(F.col("bits").bitwiseAND(NOT_BOOL) == 0, "boolean").otherwise("text"))
    g = got.select(*[F.col(k).alias(f"g_{k}") for k in key], "bits", "filled")
    on = [fields.series.eqNullSafe(g.g_series), *[fields[k] == g[f"g_{k}"] for k in key[1:]]]
    return fields.join(g, on, "left").select(*key, kind.alias("kind"), F.coalesce("filled", F.lit(0)).alias("filled"))


def matching(weights: dict[tuple[str, str], float]) -> set[tuple[str, str]]:
    """Bipartite matching of greatest total weight between old and new fields (augmenting paths with potentials)."""
    old, new = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    flip = len(old) > len(new)
    rows, cols = (new, old) if flip else (old, new)
    cost = [[-weights.get((c, r) if flip else (r, c), 0.0) for c in cols] for r in rows]
    n, m, inf = len(rows), len(cols), float("inf")
    u, v, p = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0, least, seen, way = i, 0, [inf] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while p[j0]:
            seen[j0], i0, delta, j1 = True, p[j0], inf, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    d = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if d < least[j]:
                        least[j], way[j] = d, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    pairs = [(rows[p[j] - 1], cols[j - 1]) for j in range(1, m + 1) if p[j]]
    return {x for x in ((b, a) if flip else (a, b) for a, b in pairs) if x in weights}


def name_likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def _versions(fields: DataFrame) -> DataFrame:
    """v_series, v_file, v_ord, version (from 1 in each series), versions: one row a file."""
    files = fields.select(F.col("series").alias("v_series"), F.col("file_name").alias("v_file"), F.col("ord").alias("v_ord")).distinct()
    w = W.partitionBy("v_series")
    return files.withColumn("version", F.row_number().over(w.orderBy("v_ord", "v_file"))).withColumn("versions", F.max("version").over(w))


def _of(df: DataFrame, files: DataFrame) -> DataFrame:
    on = [df.series.eqNullSafe(files.v_series), df.file_name == files.v_file, df.ord == files.v_ord]
    return df.join(files, on).drop("v_series", "v_file", "v_ord")


def moved_fields(prof: DataFrame, files: DataFrame) -> DataFrame:
    """series, version, change (added, removed or retyped against the version before), field, kind."""
    w = W.partitionBy("series", "field").orderBy("version")  # one row a file
    p = _of(prof, files).withColumns({"before": F.lag("version").over(w), "old_kind": F.lag("kind").over(w), "after": F.lead("version").over(w)})
    here = F.coalesce(F.col("before") == F.col("version") - 1, F.lit(False))
    next_ = F.coalesce(F.col("after") == F.col("version") + 1, F.lit(False))
    event = lambda cond, change, at: F.when(cond, F.struct(F.lit(change).alias("change"), at.alias("version")))
    events = F.array(
        event((F.col("version") > 1) & ~here, "added", F.col("version")),
        event(here & (F.col("old_kind") != F.col("kind")), "retyped", F.col("version")),
        event((F.col("version") < F.col("versions")) & ~next_, "removed", F.col("version") + 1),
    )
    return p.select("series", "field", "kind", F.explode(events).alias("e")).where("e IS NOT NULL").select("series", "e.version", "e.change", "field", "kind")


def _common(rows: DataFrame, moved: DataFrame, files: DataFrame) -> DataFrame:
    """series, version, h, o, n: of each record that stands in a file and in the one before, the values of the fields that went and came."""
    names = lambda c: F.collect_list(F.when(F.col("change") == c, F.col("field")))
    per = moved.groupBy("series", "version").agg(names("removed").alias("gone"), names("added").alias("came")).where("size(gone) > 0 AND size(came) > 0")
    sides = F.array(F.struct(F.col("version").alias("version"), F.col("came").alias("came"), F.array().cast("array<string>").alias("gone")), F.struct((F.col("version") - 1).alias("version"), F.array().cast("array<string>").alias("came"), F.col("gone").alias("gone")))
    want = per.select(F.col("series").alias("w_series"), F.explode(sides).alias("x")).groupBy("w_series", F.col("x.version").alias("w_version")).agg(F.flatten(F.collect_list("x.came")).alias("came"), F.flatten(F.collect_list("x.gone")).alias("gone"))
    r = _of(rows.where("k_config IS NOT NULL AND k_file IS NOT NULL"), files)
    r = r.join(want, [r.series.eqNullSafe(want.w_series), r.version == want.w_version])
    number = lambda v: v.rlike(f"^(?:{_DEC.pattern})$")
    norm = lambda v: F.when(number(v), F.concat(F.lit("n"), (v.try_cast("double") + 0.0).cast("string"))).otherwise(F.concat(F.lit("t"), v))
    pick = lambda c: F.transform(F.filter("pairs", lambda p: F.array_contains(c, p.field) & p.value.isNotNull()), lambda p: F.struct(p.field.alias("field"), norm(p.value).alias("k")))
    r = r.select("series", "version", "k_config", "k_file", "line_no", pick("gone").alias("o"), pick("came").alias("n"))
    w = W.partitionBy("series", "k_config", "k_file").orderBy("version", "line_no")  # a record's versions
    r = r.withColumn("last", F.lag("version").over(w)).where("last IS NULL OR last <> version")  # of repeated rows the first
    r = r.withColumns({"last": F.lag("version").over(w), "o": F.lag("o").over(w)}).where("last = version - 1")
    return r.select("series", "version", F.xxhash64("k_config", "k_file").alias("h"), "o", "n").where("size(o) + size(n) > 0")


def _candidates(common: DataFrame, moved: DataFrame, same: float) -> DataFrame:
    """series, version, old_field, new_field, weight: pairs of fields that their sketches do not exclude."""
    x = common.select("series", "version", "h", F.explode(F.concat(F.transform("o", lambda p: F.struct(F.lit("removed").alias("change"), p.field.alias("field"), p.k.alias("k"))), F.transform("n", lambda p: F.struct(F.lit("added").alias("change"), p.field.alias("field"), p.k.alias("k"))))).alias("x"))
    x = x.select("series", "version", "x.change", "x.field", F.xxhash64("h", "x.k").alias("v"))
    s = x.groupBy("series", "version", "change", "field").agg(F.count(F.lit(1)).alias("filled"), F.array(*[F.min(F.xxhash64(F.lit(i), "v")) for i in range(HASHES)]).alias("sketch"))
    kinds = moved.select(F.col("series").alias("m_series"), F.col("version").alias("m_version"), F.col("change").alias("m_change"), F.col("field").alias("m_field"), "kind")
    s = s.join(kinds, [s.series.eqNullSafe(kinds.m_series), s.version == kinds.m_version, s.change == kinds.m_change, s.field == kinds.m_field]).select(s["*"], "kind")

    def pairs(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        old, new = ([r for r in rows if r["change"] == c] for c in ("removed", "added"))
        out = []
        if old and new:
            n = [np.array([r["filled"] for r in x], float) for x in (old, new)]
            fit = np.minimum.outer(*n) >= same * np.maximum.outer(*n) - 1e-9
            agree = (np.array([r["sketch"] for r in old])[:, None] == np.array([r["sketch"] for r in new])[None]).sum(2)
            for i, j in np.argwhere(fit & (agree >= AGREE)):
                a, b = old[i], new[j]
                weight = 10 + agree[i, j] / HASHES + 0.5 * (a["kind"] == b["kind"]) + name_likeness(a["field"], b["field"])
                out.append({"series": a["series"], "version": a["version"], "old_field": a["field"], "new_field": b["field"], "weight": float(weight)})
        return pa.Table.from_pylist(out, schema=pa.schema([("series", pa.string()), ("version", pa.int32()), ("old_field", pa.string()), ("new_field", pa.string()), ("weight", pa.float64())]))

    # a group is the moved fields of one file
    return s.groupBy("series", "version").applyInArrow(pairs, "series string, version int, old_field string, new_field string, weight double")


def changes(rows: DataFrame, fields: DataFrame, same: float = SAME) -> DataFrame:
    """series, file_name, ord, version, change, old_field, new_field, share: every change of each file against the one before it in its series."""
    files = cut(_versions(fields), "files")
    moved = cut(moved_fields(profiles(cells_of(rows), fields), files), "moved")
    common = cut(_common(rows, moved, files), "common")
    cand = cut(_candidates(common, moved, same), "candidates")
    per = cand.groupBy("series", "version").agg(F.collect_list(F.struct("old_field", "new_field")).alias("pairs")).withColumnsRenamed({"series": "c_series", "version": "c_version"})
    at = common.join(per, [common.series.eqNullSafe(per.c_series), common.version == per.c_version]).select("series", "version", "o", "n", F.explode("pairs").alias("p"))
    value = lambda side, f: F.get(F.filter(side, lambda x: x.field == F.col(f)), F.lit(0)).k
    at = at.select("series", "version", "p.old_field", "p.new_field", value("o", "p.old_field").alias("a"), value("n", "p.new_field").alias("b")).where("a IS NOT NULL OR b IS NOT NULL")
    exact = at.groupBy("series", "version", "old_field", "new_field").agg((F.sum(F.coalesce((F.col("a") == F.col("b")).cast("bigint"), F.lit(0))) / F.count(F.lit(1))).alias("share"))
    c = cand.withColumnsRenamed({x: f"c_{x}" for x in ("series", "version", "old_field", "new_field")})
    exact = exact.where(F.col("share") >= same).join(c, [exact.series.eqNullSafe(c.c_series), *[exact[x] == c[f"c_{x}"] for x in ("version", "old_field", "new_field")]]).select(exact["*"], "weight")

    def match(key: tuple, t: pa.Table) -> pa.Table:
        got = {(r["old_field"], r["new_field"]): r for r in t.to_pylist()}
        kept = matching({k: r["weight"] + 4 * r["share"] for k, r in got.items()}) if got else ()
        return pa.Table.from_pylist([{k: r[k] for k in ("series", "version", "old_field", "new_field", "share")} for k, r in got.items() if k in kept], schema=pa.schema([("series", pa.string()), ("version", pa.int32()), ("old_field", pa.string()), ("new_field", pa.string()), ("share", pa.float64())]))

    renamed = cut(exact.groupBy("series", "version").applyInArrow(match, "series string, version int, old_field string, new_field string, share double"), "renamed")
    ends = F.array(F.struct(F.lit("removed").alias("c"), F.col("old_field").alias("f")), F.struct(F.lit("added").alias("c"), F.col("new_field").alias("f")))
    ro = renamed.select(F.col("series").alias("r_series"), F.col("version").alias("r_version"), F.explode(ends).alias("r"))
    rest = moved.join(ro, [moved.series.eqNullSafe(ro.r_series), moved.version == ro.r_version, moved.change == ro.r.c, moved.field == ro.r.f], "left_anti")
    rest = rest.select("series", "version", "change", F.when(F.col("change") == "added", "").otherwise(F.col("field")).alias("old_field"), F.when(F.col("change") == "removed", "").otherwise(F.col("field")).alias("new_field"), F.lit(None).cast("double").alias("share"))
    out = renamed.select("series", "version", F.lit("renamed").alias("change"), "old_field", "new_field", "share").unionByName(rest)
    f = files.withColumnRenamed("version", "f_version")
    return out.join(f, [out.series.eqNullSafe(f.v_series), out.version == f.f_version]).select("series", F.col("v_file").alias("file_name"), F.col("v_ord").alias("ord"), "version", "change", "old_field", "new_field", "share")


def latest_names(fields: DataFrame, change: DataFrame) -> DataFrame:
    """j_series, j_ord, j_file, j_field, latest: the name that each field of each file has in the end, by the renames of later files of its series."""
    ren = change.where("change = 'renamed'").select("series", "ord", "old_field", "new_field")

    def names(key: tuple, batch: pa.Table) -> pa.Table:
        """(series, ord, field) -> latest name, for all fields that were ever renamed; a group is the renames of one series."""
        d = sorted(batch.to_pylist(), key=lambda r: r["ord"])
        out = []
        for i, r in enumerate(d):
            name = r["new_field"]
            for s in d[i + 1 :]:
                if s["ord"] > r["ord"] and s["old_field"] == name:
                    name = s["new_field"]
            out.append({"r_series": r["series"], "r_ord": r["ord"], "r_field": r["old_field"], "latest": name})
        return pa.Table.from_pylist(out, schema=pa.schema([("r_series", pa.string()), ("r_ord", pa.int64()), ("r_field", pa.string()), ("latest", pa.string())]))

    m = ren.groupBy("series").applyInArrow(names, "r_series string, r_ord bigint, r_field string, latest string")
    # the next rename of this name in a later file
    f = fields.select("series", "ord", "file_name", "field")
    j = f.join(m, [f.series.eqNullSafe(m.r_series), f.field == m.r_field, m.r_ord > f.ord], "left")
    return j.groupBy("series", "ord", "file_name", "field").agg(F.min_by("latest", "r_ord").alias("latest")).select(F.col("series").alias("j_series"), F.col("ord").alias("j_ord"), F.col("file_name").alias("j_file"), F.col("field").alias("j_field"), F.coalesce("latest", "field").alias("latest"))


def unify(rows: DataFrame, fields: DataFrame, change: DataFrame) -> DataFrame:
    """All cells under their field's latest name: series, file_name, line_no, config, file, field, kind and value.

    ``kind`` is the one type that the field has over all files of its series: integers among decimals are decimals, any other mix
    is text; files without values of a field do not count.
    """
    j = cut(latest_names(fields, change), "names")
    cells = cells_of(rows)
    prof = profiles(cells, fields).where("filled > 0")
    one = prof.join(j, [prof.series.eqNullSafe(j.j_series), prof.ord == j.j_ord, prof.file_name == j.j_file, prof.field == j.j_field])
    kinds = F.collect_set("kind")
    kind = F.when(F.size(kinds) == 1, kinds[0]).when(F.size(F.array_except(kinds, F.array(F.lit("integer"), F.lit("decimal")))) == 0, "decimal").otherwise("text")
    one = one.groupBy(F.col("series").alias("o_series"), F.col("latest").alias("o_latest")).agg(kind.alias("kind"))
    j = j.join(one, [j.j_series.eqNullSafe(one.o_series), j.latest == one.o_latest], "left").drop("o_series", "o_latest")
    x = cells.join(j, [cells.series.eqNullSafe(j.j_series), cells.ord == j.j_ord, cells.file_name == j.j_file, cells.field == j.j_field])
    return x.select("series", "file_name", "line_no", F.col("k_config").alias("config"), F.col("k_file").alias("file"), F.col("latest").alias("field"), F.coalesce("kind", F.lit("integer")).alias("kind"), "value")


def unified_table(rows: DataFrame, fields: DataFrame, change: DataFrame) -> DataFrame:
    """One typed table of all rows: series, file_name, line_no and a column for each latest field name, in order of name.

    A column has the type that all series agree on, by the rule of ``unify``.  Names that differ by case only, or are one of the
    three before, get a number behind.  The names, as many as the series have fields, come to the driver as the table's schema.
    """
    j = cut(latest_names(fields, change), "names")
    prof = profiles(cells_of(rows), fields)
    kinds = prof.join(j, [prof.series.eqNullSafe(j.j_series), prof.ord == j.j_ord, prof.file_name == j.j_file, prof.field == j.j_field]).groupBy("latest").agg(F.collect_set(F.when(F.col("filled") > 0, F.col("kind"))).alias("kinds"))
    per = j.groupBy("j_series", "j_ord", "j_file").agg(F.map_from_entries(F.collect_list(F.struct("j_field", "latest"))).alias("names"))
    x = rows.join(per, [rows.series.eqNullSafe(per.j_series), rows.ord == per.j_ord, rows.file_name == per.j_file])
    value = F.map_from_entries(F.transform("pairs", lambda p: F.struct(F.element_at("names", p.field), p.value)))
    x = x.select("series", "file_name", "line_no", value.alias("v"))
    used, cols = {"series", "file_name", "line_no"}, []
    for r in sorted(kinds.collect()):
        k = set(r.kinds)
        kind = k.pop() if len(k) == 1 else "integer" if not k else "decimal" if k <= {"integer", "decimal"} else "text"
        name, i = r.latest, 2
        while name.lower() in used:
            name, i = f"{r.latest}_{i}", i + 1
        used.add(name.lower())
        c = F.try_element_at("v", F.lit(r.latest))
        cols.append((c if kind == "text" else c.try_cast({"integer": "bigint", "decimal": "double", "boolean": "boolean"}[kind])).alias(name))
    return x.select("series", "file_name", "line_no", *cols)

"""Problem 5 against a plain version."""

import csv
import random
import re
from collections import defaultdict

import pyarrow.parquet as pq

from provspark.operators import drift as D


def kind(values):
    values = [v for v in values if v]
    for name, rx in (("integer", r"[+-]?\d+"), ("decimal", r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"), ("boolean", "(?i:true|false)")):
        if all(re.fullmatch(rx, v) for v in values):
            return name
    return "text"


def same(a, b):
    if a is None or b is None:
        return False
    try:
        return a == b or float(a) == float(b)
    except ValueError:
        return False


def compare(name, old, new):
    (of, ok, orows), (nf, nk, nrows) = old, new
    gone, came = [f for f in of if f not in nf], [f for f in nf if f not in of]
    pairs = []
    for a in gone:
        for b in came:
            n = eq = 0
            for key in orows.keys() & nrows.keys():
                x, y = orows[key].get(a) or None, nrows[key].get(b) or None
                if x is not None or y is not None:
                    n += 1
                    eq += same(x, y)
            if n and eq >= 0.9 * n:
                pairs.append((a, b))
    out = [(name, "renamed", a, b) for a, b in pairs]
    out += [(name, "removed", a, "") for a in gone if a not in {x for x, _ in pairs}]
    out += [(name, "added", "", b) for b in came if b not in {y for _, y in pairs}]
    return out + [(name, "retyped", f, f) for f in of if f in nf and ok[f] != nk[f]]


def csv_files(t):
    files = defaultdict(list)
    for s, f, n, i, line in zip(*[t[c] for c in ("series", "file_name", "file_no", "line_no", "line")], strict=True):
        files[s, n, f].append((i, line))
    out = {}
    for key, lines in files.items():
        rows = [next(csv.reader([x])) for _, line in sorted(lines, key=lambda x: x[0]) if line and (x := line.removeprefix("\ufeff").rstrip("\r\n")).strip()]
        head = rows[0]
        rows = [dict(zip(head, r, strict=False)) for r in rows[1:] if r != head]
        named = {}
        for r in rows:
            if r.get("config") and r.get("file"):
                named.setdefault((r["config"], r["file"]), r)
        out[key] = (head, {f: kind([r.get(f) for r in rows]) for f in head}, named)
    return out


def test_csv(spark, sf):
    t = pq.read_table(f"{sf}/alert_lines.parquet").to_pydict()
    files = csv_files(t)
    want = []
    for a, b in zip(sorted(files), sorted(files)[1:], strict=False):
        if a[0] == b[0]:
            want += compare(b[2], files[a], files[b])
    rows, fields = D.csv_rows(spark.read.parquet(f"{sf}/alert_lines.parquet"))
    got = [tuple(r) for r in D.changes(rows, fields).select("file_name", "change", "old_field", "new_field").collect()]
    assert len(want) > 10 and sorted(got) == sorted(want)


def test_stored(spark, sf):
    names = ["e6_alert_full", "e6_alert_full_v2", "e6_alert_full_v3"]
    ts = []
    for n in names:
        t = pq.read_table(f"{sf}/{n}.parquet")
        kinds = {f.name: {"int32": "integer", "int64": "integer", "double": "decimal", "bool": "boolean"}.get(str(f.type), "text") for f in t.schema}
        named = {}
        for r in t.to_pylist():
            if r["config"] and r["file"]:
                named.setdefault((r["config"], r["file"]), {k: None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for k, v in r.items()})
        ts.append((list(kinds), kinds, named))
    want = [x for i in (1, 2) for x in compare(names[i], ts[i - 1], ts[i])]
    rows, fields = D.stored_rows([(n, spark.read.parquet(f"{sf}/{n}.parquet")) for n in names], "s")
    got = [tuple(r) for r in D.changes(rows, fields).select("file_name", "change", "old_field", "new_field").collect()]
    assert sorted(got) == sorted(want) and len(want) > 5


def lines(spark, rows):
    return spark.createDataFrame(rows, "series string, file_name string, file_no int, line_no int, line string")


def test_edges(spark):
    f = [("s", "f1", 1), ("s", "f2", 2), (None, "f3", 1), ("e", "f4", 1)]
    text = [(*f[0], 1, "\ufeffconfig,file,a,b,b"), (*f[0], 2, 'c,f,"x, y",1,2\r'), (*f[0], 3, ""), (*f[0], 4, None), (*f[0], 5, 'c,f,"x, y",1,2'), (*f[0], 6, "config,file,a,b,b"), (*f[0], 7, ",f,z")]
    text += [(*f[1], 1, "file,config,new,b"), (*f[1], 2, 'f,c,"x, y",t'), (*f[2], 1, "config,file,q"), (*f[3], None, "x"), ("e", "f5", None, 1, "x")]
    rows, fields = D.csv_rows(lines(spark, text))
    ch = D.changes(rows, fields)
    assert sorted(tuple(r)[1:2] + tuple(r)[4:7] for r in ch.collect()) == [("f2", "renamed", "a", "new"), ("f2", "retyped", "b", "b")]
    uni = D.unify(rows, fields, ch).where("field = 'new'").collect()
    assert sorted((r.file_name, r.line_no, r.value) for r in uni) == [("f1", 2, "x, y"), ("f1", 5, "x, y"), ("f1", 7, "z"), ("f2", 2, "x, y")]
    assert {(r.file_name, r.field, r.kind) for r in D.unify(rows, fields, ch).collect()} >= {("f1", "new", "text"), ("f1", "b", "text")}
    wide = D.unified_table(rows, fields, ch)
    assert wide.columns == ["series", "file_name", "line_no", "b", "config", "file", "new", "q"] and dict(wide.dtypes)["new"] == "string"
    assert sorted((r.file_name, r.line_no, r.new, r.b) for r in wide.collect()) == [("f1", 2, "x, y", "1"), ("f1", 5, "x, y", "1"), ("f1", 7, "z", None), ("f2", 2, "x, y", "t")]
    rows, fields = D.csv_rows(lines(spark, []))
    assert D.changes(rows, fields).count() == 0


def test_renames_among_many_fields(spark):
    """Fields with common values, changed values and missing rows: what the sketches leave is what counting all pairs gives."""
    r = random.Random(4)
    n, head = 60, [f"c{i}" for i in range(30)]
    old = {k: {h: r.choice(["", "0", "1", "1.0", str(r.randrange(5)), str(r.random())]) for h in head} for k in range(n)}
    new_head = [f"d{i}" for i in range(30)]
    new = {k: {b: (v if r.random() < (0.99, 0.93, 0.9, 0.85, 0.5)[i % 5] else "7") for i, (b, v) in enumerate(zip(new_head, (old[k][h] for h in head), strict=True))} for k in range(n) if k % 9}
    text = [("s", "f1", 1, 1, ",".join(["config", "file", *head]))] + [("s", "f1", 1, k + 2, ",".join([f"c{k}", "f", *old[k].values()])) for k in old]
    text += [("s", "f2", 2, 1, ",".join(["config", "file", *new_head]))] + [("s", "f2", 2, k + 2, ",".join([f"c{k}", "f", *new[k].values()])) for k in new]
    t = {c: [x[i] for x in text] for i, c in enumerate(("series", "file_name", "file_no", "line_no", "line"))}
    files = csv_files(t)
    a, b = (files[k] for k in sorted(files))
    want = sorted(compare("f2", a, b))
    got = sorted(tuple(x) for x in D.changes(*D.csv_rows(lines(spark, text))).select("file_name", "change", "old_field", "new_field").collect())
    assert got == want and 5 < sum(x[1] == "renamed" for x in want) < 30


def test_matching():
    assert D.matching({("a", "x"): 5.0, ("a", "y"): 6.0, ("b", "y"): 5.5}) == {("a", "x"), ("b", "y")}
    assert D.matching({("a", "x"): 1.0}) == {("a", "x")}

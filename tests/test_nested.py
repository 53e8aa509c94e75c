"""Problem 1 against a plain recursive version."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from provspark.operators import nested as N


def unwrap(v):
    while isinstance(v, dict) and len(v) == 1 and ((k := next(iter(v))) in N.WRAPPERS or "." in k):
        v = v[k]
    return v


def strict(x):
    raise ValueError(x)


def brute(rows):
    best, out = {}, []
    for rec_id, raw in rows:
        try:
            r = json.loads(raw, parse_constant=strict)
        except (ValueError, TypeError):
            continue
        if not isinstance(r, dict) or rec_id is None:
            continue
        kind, v = N.RECORD_TYPES.get(unwrap(r.get("type")) if isinstance(unwrap(r.get("type")), str) else None), r.get("datum")
        while True:
            if isinstance(v, str):
                try:
                    v = json.loads(v, parse_constant=strict)
                except ValueError:
                    v = None
            elif isinstance(v, dict) and len(v) == 1 and ((k := next(iter(v))) in N.WRAPPERS or "." in k):
                if "." in k:
                    kind = k.rpartition(".")[2]
                v = v[k]
            else:
                break
        if kind not in N.KINDS or not isinstance(v, dict):
            continue
        u = unwrap(v.get("uuid"))
        key = (kind, u.lower()) if isinstance(u, str) else (kind, None, rec_id)
        if key not in best or best[key][0] > rec_id:
            best[key] = (rec_id, v)

    def walk(rec_id, v, path, parent):
        if isinstance(v, dict):
            for k, x in v.items():
                x = unwrap(x)
                if k in N.LONE and isinstance(x, dict):
                    x = [x]
                walk(rec_id, x, f"{path}.{k}", parent)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                x, p = unwrap(x), f"{path}[{i}]"
                if isinstance(x, dict):
                    out.append((rec_id, parent, p))
                walk(rec_id, x, p, p if isinstance(x, dict) else parent)

    for rec_id, v in best.values():
        walk(rec_id, v, "$", "$")
    return sorted(out)


CASES = [
    None,
    "",
    "   ",
    "[1, 2]",
    "nul",
    '{"a":1} x',
    '{"type":"RECORD_EVENT","datum":{"uuid":"A","parameters":[{"a":1},null,{"b":[{"c":2},[{"d":3}]]}]}}',
    '{"type":"RECORD_EVENT","datum":{"uuid":"a","parameters":[{"a":1}]}}',
    '{"type":{"string":"RECORD_SUBJECT"},"datum":{"x.Subject":{"uuid":{"x.UUID":"s1"},"iterations":{"units":{"array":[{"u":1},{"u":2}]}}}}}',
    '{"datum":"{\\"x.y.FileObject\\":{\\"uuid\\":\\"f\\\\u0031\\",\\"baseObject\\":{\\"x.A\\":{\\"hashes\\":{\\"type\\":\\"t\\",\\"hash\\":\\"[{\\\\\\"\\"}}}}}"}',
    '{"datum":{"x.NetFlowObject":{"addresses":[{"a":"\\\\"},{"b":"\\""}],"m":{"map":{"k":[{"z":{}}]}}}}}',
    '{"datum":{"x.NetFlowObject":{"addresses":[{"a":1},{"b":2]}}}}',
    '{"datum":{"x.NetFlowObject":{"uuid":null,"addresses":[{"a":01}]}}}',
    '{"datum":{"x.NetFlowObject":{"uuid":null,"addresses":[{"a":1},]}}}',
    '{"datum":{"x.NetFlowObject":{"uuid":null,"addresses":[{"a" 1}]}}}',
    '{"datum":{"x.NetFlowObject":{"uuid":null,"addresses":[{"a":"\\q"}]}}}',
    '{"datum":{"x.NetFlowObject":{"uuid":null,"addresses":[ { "a" : -1.5e+3 , "b":[ ] , "c":{ } } ]}}} ',
    '{"datum":{"x.Event":{"uuid":"unclosed","parameters":[{"a":"b}]}}}',
    '\\"{',
    '{"datum":{"x.Event":{"uuid":"after","parameters":[{"ä":"→","tag":{"tagId":1}}]}}}',
    '{"datum":{"x.Principal":{"uuid":"p","groupIds":[{"g":1}]}},"type":"RECORD_EVENT"}',
    '{"datum":null,"type":"RECORD_EVENT"}',
    '{"datum":{"x.Event":{"uuid":"tab	","parameters":[{}]}}}',
    "{}",
    '{"datum":{"x.Event":{"uuid":"deep","parameters":' + '{"components":' * 40 + "[{}]" + "}" * 40 + "}}}",
]


def spark_rows(spark, rows, **kw):
    df = spark.createDataFrame([(i, r, "x") for i, r in rows], "rec_id bigint, raw string, kind string")
    return sorted(tuple(x) for x in N.item_table(N.flatten_records(df, **kw)).select("rec_id", "parent_path", "child_path").collect())


@pytest.mark.parametrize("fields", [False, True])
def test_cases(spark, fields):
    rows = list(enumerate(CASES, 1)) + [(None, CASES[6])]
    assert spark_rows(spark, rows, with_fields=fields) == brute(rows)


def test_table(spark, sf):
    t = pq.read_table(f"{sf}/tccdmdatum.parquet", columns=["rec_id", "raw"]).to_pydict()
    rows = list(zip(t["rec_id"], t["raw"], strict=True))
    want = brute(rows)
    assert len(want) > 100
    assert spark_rows(spark, rows, with_fields=False) == want


def test_fields(spark):
    df = spark.createDataFrame([(7, CASES[6])], "rec_id bigint, raw string")
    r = N.flatten_records(df)
    assert r.select("fields").first()[0] == {"uuid": "A"}
    got = {x.child_path: x.fields for x in N.item_table(r).collect()}
    assert got["$.parameters[0]"] == {"a": "1"} and got["$.parameters[2].b[1][0]"] == {"d": "3"}


def scalars(rows):
    """Every scalar that isn't null of every record, by (rec_id, body or item, path below it); those in arrays by full path and position."""
    fields, values = {}, []

    def text(x):
        return x if isinstance(x, str) else json.dumps(x)

    def walk(rec_id, v, path, owner, below):
        if isinstance(v, dict):
            for k, x in v.items():
                x = unwrap(x)
                if k in N.LONE and isinstance(x, dict):
                    walk(rec_id, [x], f"{path}.{k}", owner, "")
                elif isinstance(x, dict | list):
                    walk(rec_id, x, f"{path}.{k}", owner, f"{below}{k}.")
                elif x is not None:
                    fields[rec_id, owner, below + k] = text(x)
        else:
            for i, x in enumerate(v):
                x, p = unwrap(x), f"{path}[{i}]"
                if isinstance(x, dict | list):
                    walk(rec_id, x, p, p if isinstance(x, dict) else owner, "")
                elif x is not None:
                    values.append((rec_id, owner, p, i, text(x)))

    for rec_id, body in rows:
        walk(rec_id, body, "$", "$", "")
    return fields, sorted(values)


def test_scalars_of_inner_objects_and_arrays(spark):
    body = {
        "uuid": "u", "names": {"array": ["a", None, {"string": "b"}, 3]}, "none": None, "empty": [], "grid": [[1, 2], [True, []]],
        "baseObject": {"x.A": {"permission": {"x.P": 7}, "epoch": None, "properties": {"map": {"tag": "t", "n": 1}}}},
        "parameters": [{"valueBytes": "v", "kind": {"of": {"k": "deep"}, "z": 1}, "libs": ["x", "y"]}, {"tag": {"tagId": "q", "ids": [5]}}],
    }
    rows = [(1, body), (2, {"uuid": "w", "a": {"b": [{"c": {"d": 1, "e": [2]}}]}}), (3, {"uuid": "plain"})]
    df = spark.createDataFrame([(i, json.dumps({"datum": {"x.Event": b}})) for i, b in rows], "rec_id bigint, raw string")
    r = N.flatten_records(df, with_values=True)
    got = {(x.rec_id, "$", k): v for x in r.collect() for k, v in x.fields.items()}
    got |= {(x.rec_id, x.child_path, k): v for x in N.item_table(r).collect() for k, v in x.fields.items()}
    fields, values = scalars(rows)
    assert got == fields and got[1, "$", "baseObject.permission"] == "7" and got[1, "$", "baseObject.properties.tag"] == "t"
    have = N.value_table(r).collect()
    assert sorted((x.rec_id, x.parent_path, x.child_path, x.pos, x.value) for x in have) == values and len(values) == 10
    assert {x.table for x in have} == {"names", "grid", "parameters.libs", "parameters.tag.ids", "a.b.c.e"}


def test_scalars_of_table(spark, sf):
    rec = {x.rec_id: x for x in N.flatten_records(spark.read.parquet(f"{sf}/tccdmdatum.parquet"), with_values=True).collect()}
    t = pq.read_table(f"{sf}/tccdmdatum.parquet", columns=["rec_id", "raw"]).to_pydict()
    rows = []
    for i, raw in zip(t["rec_id"], t["raw"], strict=True):
        if i in rec:
            v = json.loads(raw).get("datum")
            while isinstance(v, str) or (isinstance(v, dict) and len(v) == 1 and ((k := next(iter(v))) in N.WRAPPERS or "." in k)):
                v = json.loads(v) if isinstance(v, str) else v[k]
            rows.append((i, v))
    fields, values = scalars(rows)
    got = {(i, "$", k) for i, x in rec.items() for k in x.fields} | {(i, y.child_path, k) for i, x in rec.items() for y in x["items"] for k in y.fields}
    assert got == set(fields)
    assert sorted((i, v.parent_path, v.child_path, v.pos) for i, x in rec.items() for v in x["values"]) == [v[:4] for v in values] and len(values) > 50


def test_empty(spark):
    assert spark_rows(spark, []) == []
    b = N.flatten_batch(pa.array([], pa.int64()), pa.array([], pa.large_string()), True)
    assert b.num_rows == 0

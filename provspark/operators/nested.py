"""Problem 1: deeply nested JSON records into flat related tables.

Method: Arrow-buffer flattening.  The bytes of a whole Arrow batch of texts are indexed at once (quotes, escapes, brackets,
commas and colons found with vector operations, depth by a running sum), the grammar is checked on the token table, and the
containers of the batch become one Arrow list array (list offsets over child tokens).  Child arrays come out level by level
with ``list_parent_indices`` and ``take``: record keys and parent paths are propagated by taking with the parent index.  No
text is parsed by itself; only distinct key spellings that hold a backslash are decoded one by one.

Defined results
* null, blank, cut off or otherwise invalid texts (strict JSON: no NaN, no trailing text): no record, no row;
* a record of another kind, or whose body is no object: no record;
* null ``rec_id``: no record, as rows could not name it;
* several records of one (kind, uuid ignoring case): the one with the smallest ``rec_id``; records without uuid all stay;
* null items keep their position and give no row; empty arrays give no row; a key repeated in an object counts each time;
* scalars are fields of the body or item they stand in, those in plain objects inside it under their dotted path; null ones are left
  out; of fields of one name the last in the text stays (a key that holds dots itself may be named like a path);
* scalars in arrays are rows of their own (``value_table``), with the item or body above them as their parent; null ones are left out;
* extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("Event", "Subject", "FileObject", "NetFlowObject")
#: Kinds that make nodes or edges of a graph.
GRAPH_KINDS = (*KINDS, "Unit", "Principal", "SrcSinkObject", "IpcObject")
RECORD_TYPES = {"RECORD_EVENT": "Event", "RECORD_SUBJECT": "Subject", "RECORD_FILE_OBJECT": "FileObject", "RECORD_NET_FLOW_OBJECT": "NetFlowObject", "RECORD_UNIT": "Unit", "RECORD_PRINCIPAL": "Principal", "RECORD_SRC_SINK_OBJECT": "SrcSinkObject", "RECORD_IPC_OBJECT": "IpcObject"}
#: Beginnings of a body's type that tell the kind where nothing else does.
TYPE_BEGINS = (("EVENT_", "Event"), ("SUBJECT_", "Subject"), ("FILE_OBJECT", "FileObject"), ("NET_FLOW", "NetFlowObject"))
#: Keys of one-key objects that only wrap a value (besides dotted type names).
WRAPPERS = ("array", "map", "string", "long", "int", "bytes")
#: Fields that may hold a lone object in place of an array of one.
LONE = ("parameters", "components", "tag", "iterations", "units", "hashes", "addresses", "aliases")

_WS, _QUOTE, _BACK, _OBJ, _OBJ_END, _ARR, _ARR_END, _COLON, _COMMA, _STR, _SCALAR = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11
_LUT = np.zeros(256, np.uint8)
for _chars, _code in ((" \t\n\r", _WS), ('"', _QUOTE), ("\\", _BACK), ("{", _OBJ), ("}", _OBJ_END), ("[", _ARR), ("]", _ARR_END), (":", _COLON), (",", _COMMA)):
    for _c in _chars:
        _LUT[ord(_c)] = _code
_ESCAPES = np.zeros(256, np.uint8)
for _c, _v in zip('"\\/bfnrt', '"\\/\b\f\n\r\t', strict=True):
    _ESCAPES[ord(_c)] = ord(_v)
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_SCALAR_RE = r"^[ \t\r\n]*(true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)[ \t\r\n]*$"


def _gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as one binary array (a ragged take)."""
    n = (end - start).astype(np.int64)
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], n)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[at]))])


def _cat(*parts: pa.Array | str) -> pa.Array:
    kind = pa.large_string()
    return pc.binary_join_element_wise(*[pa.scalar(p, kind) if isinstance(p, str) else p for p in parts], pa.scalar("", kind))


def _decoded(a: pa.Array) -> pa.Array:
    """Bodies of JSON strings as text.  Those without a backslash are taken as they are; others are decoded together, but for \\u."""
    has = pc.match_substring(a, b"\\")
    if not pc.any(has).as_py():
        return a.cast(pa.large_string())
    at = np.flatnonzero(has.to_numpy(zero_copy_only=False))
    some = a.take(pa.array(at))
    off = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
    buf = np.frombuffer(some.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    first = _escape_starts(buf, off)
    keep = np.ones(len(buf), bool)
    keep[first] = False
    out = buf.copy()
    out[first + 1] = np.where(_ESCAPES[buf[first + 1]] > 0, _ESCAPES[buf[first + 1]], buf[first + 1])
    size = np.add.reduceat(np.append(keep, False), np.minimum(off[:-1], len(keep))).astype(np.int64)
    size[np.diff(off) == 0] = 0
    new = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=new[1:])
    done = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(new), pa.py_buffer(np.ascontiguousarray(out[keep]))])
    rows = np.unique(np.searchsorted(off, first[buf[first + 1] == ord("u")], "right") - 1)
    texts = done.to_pylist() if len(rows) else None
    if texts is not None:
        for r in rows:
            texts[r] = json.loads(b'"' + some[int(r)].as_py() + b'"').encode("utf-8", "replace")
        done = pa.array(texts, pa.large_binary())
    where = np.zeros(len(a), np.int64)
    where[at] = np.arange(len(at)) + len(a)
    where = np.where(where > 0, where, np.arange(len(a)))
    return pa.concat_arrays([a, done]).take(pa.array(where)).cast(pa.large_string(), safe=False)


def _escape_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions of backslashes that start an escape (those at even places of a run of backslashes inside one text)."""
    b = np.flatnonzero(buf == ord("\\"))
    if not len(b):
        return b
    row = np.searchsorted(off, b, "right")
    fresh = np.ones(len(b), bool)
    fresh[1:] = (np.diff(b) != 1) | (np.diff(row) != 0)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(b)), 0))
    even = (np.arange(len(b)) - start) % 2 == 0
    b = b[even]
    return b[b + 1 < len(buf)]


class Tokens:
    """The token table of a batch of JSON texts: kind, span, text, parent container; ``ok`` tells which texts are valid JSON."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        self.n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if self.n else np.zeros(0, np.uint8)
        off = off - off[0]
        self.buf, ok = buf, np.ones(self.n, bool)
        if not len(buf):
            self.kind = self.start = self.end = self.row = self.parent = np.zeros(0, np.int64)
            self.ok = np.zeros(self.n, bool)
            self._children()
            return
        cls = _LUT[buf]
        esc = _escape_starts(buf, off)
        escaped = np.zeros(len(buf) + 1, bool)
        escaped[esc + 1] = True
        q = np.flatnonzero(cls == _QUOTE)
        q = q[~escaped[q]]
        base = np.searchsorted(q, off)
        count = np.diff(base)
        ok &= count % 2 == 0
        qrow = np.searchsorted(off, q, "right") - 1
        opens = (np.arange(len(q)) - base[qrow]) % 2 == 0

        def inside(p: np.ndarray) -> np.ndarray:
            return (np.searchsorted(q, p) - base[np.searchsorted(off, p, "right") - 1]) % 2 == 1

        def bad(p: np.ndarray) -> None:
            ok[np.searchsorted(off, p, "right") - 1] = False

        ctrl = np.flatnonzero(buf < 0x20)
        bad(ctrl[inside(ctrl)])
        nxt = buf[esc + 1]
        bad(esc[(_ESCAPES[nxt] == 0) & (nxt != ord("u"))])
        u = esc[nxt == ord("u")]
        padded = np.append(_HEX[buf], [False] * 6)
        bad(u[~(padded[u + 2] & padded[u + 3] & padded[u + 4] & padded[u + 5])])

        p = np.flatnonzero(cls >= _OBJ)
        p = p[~inside(p)]
        so = q[opens]
        close = np.append(q, len(buf))[np.flatnonzero(opens) + 1] if len(q) else so
        srow = qrow[opens]
        se = np.minimum(close + 1, off[srow + 1])
        start = np.concatenate([p, so])
        order = np.argsort(start, kind="stable")
        start = start[order]
        end = np.concatenate([p + 1, se])[order]
        kind = np.concatenate([cls[p], np.full(len(so), _STR, np.uint8)])[order]
        row = np.searchsorted(off, start, "right") - 1
        # scalars: what is not blank between two tokens
        nonws = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(cls != _WS, out=nonws[1:])
        firsts = np.searchsorted(row, np.arange(self.n))
        lasts = np.searchsorted(row, np.arange(self.n), "right")
        gs = np.concatenate([off[:-1], end])
        ge = np.concatenate([np.where(firsts < lasts, start[np.minimum(firsts, max(len(start) - 1, 0))] if len(start) else off[1:], off[1:]), np.where(np.append(row[1:], -1) == row, np.append(start[1:], 0), off[row + 1])])
        gr = np.concatenate([np.arange(self.n), row])
        real = (ge > gs) & (nonws[np.maximum(ge, gs)] > nonws[gs])
        gs, ge, gr = gs[real], ge[real], gr[real]
        if len(gs):
            d = _gather(buf, gs, ge).dictionary_encode()
            fine = pc.match_substring_regex(d.dictionary, _SCALAR_RE).to_numpy(zero_copy_only=False)
            ok[gr[~fine[d.indices.to_numpy()]]] = False
        start = np.concatenate([start, gs])
        order = np.argsort(start, kind="stable")
        self.start = start[order]
        self.end = np.concatenate([end, ge])[order]
        self.kind = np.concatenate([kind, np.full(len(gs), _SCALAR, np.uint8)])[order]
        self.row = np.concatenate([row, gr])[order]
        self._grammar(ok)

    def _grammar(self, ok: np.ndarray) -> None:
        def keep(m: np.ndarray) -> None:
            self.kind, self.start, self.end, self.row = self.kind[m], self.start[m], self.end[m], self.row[m]

        keep(ok[self.row])
        step = np.isin(self.kind, (_OBJ, _ARR)).astype(np.int64) - np.isin(self.kind, (_OBJ_END, _ARR_END))
        run = np.cumsum(step)
        first = np.searchsorted(self.row, np.arange(self.n))
        before = np.append(0, run)[first]
        depth = run - before[self.row]  # after the token
        ok[self.row[depth < 0]] = False
        lasts = np.searchsorted(self.row, np.arange(self.n), "right")
        has = lasts > first
        ok &= has
        ok[has] &= depth[lasts[has] - 1] == 0
        m = ok[self.row]
        depth, step = depth[m], step[m]
        keep(m)
        level = np.where(step > 0, depth - 1, np.where(step < 0, depth + 1, depth))  # containers around it; a closing one belongs to its own
        self.parent = np.full(len(level), -1, np.int64)
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange((level.max() if len(level) else 0) + 2))
        above = np.zeros(0, np.int64)
        for k in range(len(cuts) - 1):
            at = order[cuts[k] : cuts[k + 1]]
            if k and len(at):
                self.parent[at] = above[np.searchsorted(above, at) - 1]
            above = at[(self.kind[at] == _OBJ) | (self.kind[at] == _ARR)]
        kind, row, n = self.kind, self.row, len(self.kind)
        prev = np.append(0, kind[:-1])[:n]
        prev = np.where(np.append(-1, row[:-1])[:n] == row, prev, 0)
        prev2 = np.append([0, 0], prev[1:-1] if n > 1 else [])[:n] if n > 1 else np.zeros(n, np.int64)
        prev2 = np.append(0, prev[:-1])[:n]
        prev2 = np.where(prev == 0, 0, prev2)
        ctx = np.where(self.parent >= 0, kind[self.parent], 0)
        starts = (kind == _STR) | (kind == _SCALAR) | (kind == _OBJ) | (kind == _ARR)
        self.is_key = (kind == _STR) & (ctx == _OBJ) & ((prev == _OBJ) | (prev == _COMMA))
        prev_key = np.append(False, self.is_key[:-1])[:n]
        prev_end = np.isin(prev, (_STR, _SCALAR, _OBJ_END, _ARR_END)) & ~prev_key
        good = np.where(
            starts,
            np.where(ctx == 0, prev == 0, np.where(ctx == _ARR, (prev == _ARR) | (prev == _COMMA), (prev == _COLON) | self.is_key)),
            np.where(
                kind == _COLON,
                (ctx == _OBJ) & prev_key,
                np.where(
                    kind == _COMMA,
                    (ctx != 0) & prev_end,
                    np.where(kind == _OBJ_END, (ctx == _OBJ) & ((prev == _OBJ) | prev_end), (ctx == _ARR) & ((prev == _ARR) | prev_end)),
                ),
            ),
        )
        ok[row[~good]] = False
        self.is_value = starts & ~self.is_key & ok[row]
        self.ok = ok
        self._children()

    def _children(self) -> None:
        """Containers as one Arrow list array over their child values, by list offsets."""
        if not len(self.kind):
            self.is_value = self.is_key = np.zeros(0, bool)
        values = np.flatnonzero(self.is_value)
        boxes = values[(self.kind[values] == _OBJ) | (self.kind[values] == _ARR)]
        inner = values[self.parent[values] >= 0]
        order = np.argsort(self.parent[inner], kind="stable")
        child = inner[order]
        off = np.searchsorted(self.parent[child], np.append(boxes, len(self.kind)))
        self.ordinal = np.full(len(self.kind) + 1, -1, np.int64)
        self.ordinal[boxes] = np.arange(len(boxes))
        self.boxes, self.size = boxes, np.diff(off)
        self.lists = pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pa.array(child, pa.int64()))
        self.only = np.append(child, 0)[np.minimum(off[:-1], len(child))] if len(boxes) else np.zeros(0, np.int64)
        roots = values[self.parent[values] < 0]
        self.root = np.full(self.n, -1, np.int64)
        self.root[self.row[roots]] = roots
        # wrappers: one-key objects with a wrapping key; links to the value inside
        one = np.flatnonzero((self.size == 1) & (self.kind[boxes] == _OBJ)) if len(boxes) else np.zeros(0, np.int64)
        self.link = np.arange(len(self.kind))
        self.wrap_key = {}
        if len(one):
            keys = self.keys(self.only[one]).dictionary_encode()
            wraps = np.array([k in WRAPPERS or "." in k for k in keys.dictionary.to_pylist()], bool)[keys.indices.to_numpy()]
            self.link[boxes[one[wraps]]] = self.only[one[wraps]]
        self.step = self.link.copy()
        while True:  # pointers of pointers, until all reach the wrapped value
            again = self.link[self.link]
            if np.array_equal(again, self.link):
                break
            self.link = again

    def keys(self, values: np.ndarray) -> pa.Array:
        """Key of each member value (two tokens before it: key, colon, value)."""
        k = values - 2
        return _decoded(_gather(self.buf, self.start[k] + 1, self.end[k] - 1))

    def text(self, tokens: np.ndarray) -> pa.Array:
        """Text of scalars and strings, null for null and for containers."""
        s = self.kind[tokens] == _STR
        plain = s | (self.kind[tokens] == _SCALAR)
        a = self.start[tokens] + s
        b = np.where(plain, self.end[tokens] - s, a)
        out = _decoded(_gather(self.buf, a, b))
        trimmed = pc.utf8_trim(out, characters=" \t\r\n")
        out = pc.if_else(pa.array(s), out, trimmed)
        none = pc.and_(pa.array(~s), pc.equal(out, pa.scalar("null", pa.large_string())))
        return pc.if_else(pc.or_(none, pa.array(~plain)), pa.scalar(None, pa.large_string()), out)

    def members(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``boxes``, child value, place) of all children of these containers, by Arrow list kernels."""
        sub = self.lists.take(pa.array(self.ordinal[boxes]))
        child = sub.flatten().to_numpy(zero_copy_only=False)
        parent = pc.list_parent_indices(sub).to_numpy(zero_copy_only=False)
        first = np.searchsorted(parent, np.arange(len(boxes)))
        return parent, child, np.arange(len(child)) - first[parent] if len(child) else child

    def lookup(self, boxes: np.ndarray, name: str) -> np.ndarray:
        """The last member of this name of each object, or -1."""
        out = np.full(len(boxes), -1, np.int64)
        objects = np.flatnonzero(self.kind[boxes] == _OBJ)
        parent, child, _ = self.members(boxes[objects])
        # keys of the right length only are looked at
        cand = np.flatnonzero((self.end[child - 2] - self.start[child - 2] - 2) == len(name)) if len(child) else child
        if len(cand):
            hit = pc.equal(_gather(self.buf, self.start[child[cand] - 2] + 1, self.end[child[cand] - 2] - 1), name.encode()).to_numpy(zero_copy_only=False)
            out[objects[parent[cand[hit]]]] = child[cand[hit]]
        return out


def _walk(t: Tokens, body: np.ndarray, rec: np.ndarray, values: dict[str, list] | None = None) -> dict[str, list]:
    """Items (objects in arrays) below the bodies, level by level.  ``rec``: the record index of each body.  ``values`` gets the scalars in arrays."""
    out: dict[str, list] = {k: [] for k in ("rec", "parent", "child", "field", "pos", "token")}
    box = body
    path = pa.array(["$"] * len(box), pa.large_string())
    parent = path
    while len(box):
        up, child, place = t.members(box)
        real = t.link[child]
        kind = t.kind[real]
        if values is not None:
            v = np.flatnonzero(((kind == _STR) | (kind == _SCALAR)) & (t.kind[box[up]] == _ARR))
            text = t.text(real[v])
            there = pc.is_valid(text)
            v = v[there.to_numpy(zero_copy_only=False)]
            if len(v):
                at = pa.array(up[v])
                values["rec"].append(rec[up[v]])
                values["parent"].append(parent.take(at))
                values["child"].append(_cat(path.take(at), "[", pa.array(place[v]).cast(pa.large_string()), "]"))
                values["pos"].append(place[v])
                values["text"].append(text.filter(there))
        keep = np.flatnonzero((kind == _OBJ) | (kind == _ARR))
        up, child, place, real, kind = up[keep], child[keep], place[keep], real[keep], kind[keep]
        if not len(child):
            break
        in_object = t.kind[box[up]] == _OBJ
        above = path.take(pa.array(up))
        par = parent.take(pa.array(up))
        o = np.flatnonzero(in_object)
        keys = t.keys(child[o]) if len(o) else pa.array([], pa.large_string())
        names = _cat(".", keys) if len(o) else keys
        lone = np.zeros(len(child), bool)
        if len(o):
            lone[o] = pc.is_in(keys, pa.array(LONE, pa.large_string())).to_numpy(zero_copy_only=False)
            lone &= kind == _OBJ
            names = _cat(names, pc.if_else(pa.array(lone[o]), pa.scalar("[0]", pa.large_string()), pa.scalar("", pa.large_string())))
        a = np.flatnonzero(~in_object)
        index = _cat("[", pa.array(place[a]).cast(pa.large_string()), "]")
        where = np.empty(len(child), np.int64)
        where[o] = np.arange(len(o))
        where[a] = len(o) + np.arange(len(a))
        tail = pa.concat_arrays([names.cast(pa.large_string()), index]).take(pa.array(where))
        new = _cat(above, tail)
        item = (~in_object & (kind == _OBJ)) | lone
        at = pa.array(np.flatnonzero(item))
        out["rec"].append(rec[up][item])
        out["parent"].append(par.take(at))
        out["child"].append(new.take(at))
        out["pos"].append(np.where(in_object, 0, place)[item])
        out["token"].append(real[item])
        parent = pc.if_else(pa.array(item), new, par)
        rec, box, path = rec[up], real, new
    return out


def _empty_items(with_fields: bool) -> pa.DataType:
    fields = [("parent_path", pa.string()), ("child_path", pa.string())]
    if with_fields:
        fields += [("pos", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))]
    return pa.struct(fields)


_VALUES = pa.struct([("parent_path", pa.string()), ("child_path", pa.string()), ("pos", pa.int32()), ("value", pa.string())])


def _maps(t: Tokens, objects: np.ndarray) -> pa.Array:
    """Scalars of each object and of the plain objects inside it as a map path -> text (wrappers removed), null values left out."""
    ups, children, names = [], [], []
    top, box, prefix = np.arange(len(objects)), objects, None
    while len(box):
        at, child, _ = t.members(box)
        if not len(child):
            break
        kind, name = t.kind[t.link[child]], t.keys(child)
        plain = (kind == _OBJ) & ~pc.is_in(name, pa.array(LONE, pa.large_string())).to_numpy(zero_copy_only=False)
        if prefix is not None:
            name = _cat(prefix.take(pa.array(at)), ".", name)
        scalar = (kind == _STR) | (kind == _SCALAR)
        ups.append(top[at][scalar])
        children.append(child[scalar])
        names.append(name.filter(pa.array(scalar)))
        top, box, prefix = top[at][plain], t.link[child[plain]], name.filter(pa.array(plain))
    up, child = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ups, children))
    keys = pa.chunked_array(names, pa.large_string()).combine_chunks()
    order = np.lexsort((child, up))  # as in the text
    text = t.text(t.link[child[order]])
    there = np.flatnonzero(pc.is_valid(text).to_numpy(zero_copy_only=False))
    up, keys = up[order[there]], keys.take(pa.array(order[there]))
    # a map key may be there once: the last stays
    code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(up) else np.zeros(0, np.int64)
    _, back = np.unique((up * (code.max() + 1 if len(code) else 1) + code)[::-1], return_index=True)
    last = np.sort(len(code) - 1 - back)
    off = np.searchsorted(up[last], np.arange(len(objects) + 1)).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(off, pa.int32()), keys.take(pa.array(last)).cast(pa.string()), text.take(pa.array(there[last])).cast(pa.string()))


def _texts(t: Tokens, tokens: np.ndarray) -> np.ndarray:
    """Texts of tokens (-1: none), wrappers removed."""
    out = np.full(len(tokens), None, object)
    has = tokens >= 0
    out[has] = t.text(t.link[tokens[has]]).to_pylist()
    return out


def _first_of(t: Tokens, tokens: np.ndarray) -> np.ndarray:
    """Texts of the first items of arrays (-1: none)."""
    out = np.full(len(tokens), -1, np.int64)
    has = np.flatnonzero(tokens >= 0)
    box = t.link[tokens[has]]
    has, box = has[t.kind[box] == _ARR], box[t.kind[box] == _ARR]
    up, child, place = t.members(box)
    if len(child):
        out[has[up[place == 0]]] = child[place == 0]
    return _texts(t, out)


def flatten_batch(rec_id: pa.Array, raw: pa.Array, with_fields: bool = False, with_values: bool = False, wanted: tuple[str, ...] = KINDS, part: pa.Array | None = None) -> pa.RecordBatch:
    """One row per valid record of the wanted kinds: rec_id, kind, uuid, fields, values (list), items (list).

    With ``part`` records are read as a graph's: it comes along as a column, as do ``host`` (the record's hostId, else the body's) and
    ``name`` (the first of the body's names); a record without ``datum`` is its own body; the kind is else told by the beginning of the
    body's type, or, where it has a subject, that of an event.
    """
    graph = part is not None
    there = pc.and_(pc.is_valid(rec_id), pc.is_valid(raw))
    rec_id, raw = rec_id.filter(there), raw.filter(there)
    part = part.filter(there) if graph else None
    n = len(rec_id)
    host = np.full(n, None, object)
    kind = np.full(n, None, object)
    parts: list[tuple] = []
    rows, texts, first = np.arange(n), raw, True
    while len(rows):
        t = Tokens(texts)
        at = np.flatnonzero(t.root >= 0)
        cur, rec = t.root[at], rows[at]
        if first:
            obj = t.kind[cur] == _OBJ
            cur, rec = cur[obj], rec[obj]
            outer = t.lookup(cur, "type")
            word = _texts(t, outer)
            named = np.array([RECORD_TYPES.get(w) for w in word], object) if len(word) else word
            kind[rec] = named
            inside = t.lookup(cur, "datum")
            if graph:
                host[rec] = _texts(t, t.lookup(cur, "hostId"))
                inside = np.where(inside >= 0, inside, cur)
            cur = inside
            rec, cur = rec[cur >= 0], cur[cur >= 0]
            first = False
        while True:  # off with the wrappers; the innermost dotted key names the kind
            w = np.flatnonzero(t.step[cur] != cur)
            if not len(w):
                break
            inner = t.step[cur[w]]
            keys = t.keys(inner).to_pylist()
            dotted = [i for i, k in enumerate(keys) if "." in k]
            kind[rec[w[dotted]]] = [keys[i].rpartition(".")[2] for i in dotted] or kind[rec[w[dotted]]]
            cur = cur.copy()
            cur[w] = inner
        body = t.kind[cur] == _OBJ
        if body.any():
            parts.append((t, cur[body], rec[body]))
        text = np.flatnonzero(t.kind[cur] == _STR)
        rows = rec[text]
        texts = t.text(cur[text]) if len(text) else None
    ids, kinds, uuids, roots, lists, items, whose = [], [], [], [], [], [], []
    for t, body, rec in parts:
        if graph:
            no = np.flatnonzero(~np.isin(kind[rec].astype(str), GRAPH_KINDS))
            word = _texts(t, t.lookup(body[no], "type"))
            subject = t.lookup(body[no], "subject") >= 0
            kind[rec[no]] = [next((k for b, k in TYPE_BEGINS if w and w.startswith(b)), "Event" if s else o) for w, s, o in zip(word, subject, kind[rec[no]], strict=True)]
        known = np.isin(kind[rec].astype(str), wanted)
        body, rec = body[known], rec[known]
        if not len(rec):
            continue
        uuid = _texts(t, t.lookup(body, "uuid"))
        values: dict[str, list] | None = {k: [] for k in ("rec", "parent", "child", "pos", "text")} if with_values else None
        got = _walk(t, body, np.arange(len(rec)), values)
        if got["rec"]:
            owner = np.concatenate(got["rec"])
            order = np.argsort(owner, kind="stable")
            cols = [pa.chunked_array(got[k]).combine_chunks().take(pa.array(order)).cast(pa.string()) for k in ("parent", "child")]
            if with_fields:
                cols += [pa.array(np.concatenate(got["pos"])[order], pa.int32()), _maps(t, np.concatenate(got["token"])[order])]
            owner = owner[order]
        else:
            owner, cols = np.zeros(0, np.int64), [pa.array([], f.type) for f in _empty_items(with_fields)]
        off = pa.array(np.searchsorted(owner, np.arange(len(rec) + 1)).astype(np.int32), pa.int32())
        items.append(pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(cols, fields=list(_empty_items(with_fields)))))
        ids.append(rec_id.take(pa.array(rec)))
        if graph:
            own = _texts(t, t.lookup(body, "hostId"))
            whose.append((part.take(pa.array(rec)), [h or o for h, o in zip(host[rec], own, strict=True)], _first_of(t, t.lookup(body, "names")).tolist()))
        kinds += kind[rec].tolist()
        uuids += uuid.tolist()
        if with_fields:
            roots.append(_maps(t, body))
        if with_values:
            owner = np.concatenate([np.zeros(0, np.int64), *values["rec"]])
            order = np.argsort(owner, kind="stable")
            parent, child, text = (pa.chunked_array(values[k], pa.large_string()).combine_chunks().take(pa.array(order)).cast(pa.string()) for k in ("parent", "child", "text"))
            pos = pa.array(np.concatenate([np.zeros(0, np.int64), *values["pos"]])[order], pa.int32())
            off = pa.array(np.searchsorted(owner[order], np.arange(len(rec) + 1)).astype(np.int32), pa.int32())
            lists.append(pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([parent, child, pos, text], fields=list(_VALUES))))
    extra = [("part", pa.string()), ("host", pa.string()), ("name", pa.string())] if graph else []
    schema = [("rec_id", pa.int64()), ("kind", pa.string()), ("uuid", pa.string())] + extra + ([("fields", pa.map_(pa.string(), pa.string()))] if with_fields else []) + ([("values", pa.list_(_VALUES))] if with_values else []) + [("items", pa.list_(_empty_items(with_fields)))]

    def joined(parts: list, kind: pa.DataType) -> pa.Array:
        return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)

    data = [joined(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(uuids, pa.string())]
    if graph:
        data += [joined([w[0] for w in whose], pa.string()), *[pa.array([x for w in whose for x in w[i]], pa.string()) for i in (1, 2)]]
    data += [joined(roots, pa.map_(pa.string(), pa.string()))] if with_fields else []
    data += [joined(lists, pa.list_(_VALUES))] if with_values else []
    return pa.RecordBatch.from_arrays([*data, joined(items, schema[-1][1])], schema=pa.schema(schema))


def _spark_schema(with_fields: bool, with_values: bool = False, graph: bool = False) -> str:
    item = "parent_path string, child_path string" + (", pos int, fields map<string,string>" if with_fields else "")
    item = ", ".join(x.replace(" ", ": ", 1) for x in item.split(", "))
    return "rec_id bigint, kind string, uuid string, " + ("part string, host string, name string, " if graph else "") + ("fields map<string,string>, " if with_fields else "") + ("values array<struct<parent_path: string, child_path: string, pos: int, value: string>>, " if with_values else "") + f"items array<struct<{item}>>"


#: Bytes of text whose tokens are held at once; a batch of more is cut.
BATCH_BYTES = 16 << 20


def _cuts(raw: pa.Array) -> list[tuple[int, int]]:
    """(first, number) of rows that hold about BATCH_BYTES each; one record may be larger."""
    size = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False))
    if not len(size) or size[-1] <= BATCH_BYTES:
        return [(0, len(raw))]
    at = np.unique(np.append(0, np.searchsorted(size, np.arange(BATCH_BYTES, size[-1], BATCH_BYTES), "right")))
    return [(int(a), int(b - a)) for a, b in zip(at, np.append(at[1:], len(raw)), strict=True) if b > a]


def flatten_records(df: DataFrame, id_col: str = "rec_id", raw_col: str = "raw", with_fields: bool = True, with_values: bool = False, kinds: tuple[str, ...] = KINDS, part_col: str | None = None) -> DataFrame:
    """Valid records of the kinds, one row each with its items, the delivery with the smallest id of each (kind, uuid).

    With ``part_col`` records are read as those of graphs (see ``flatten_batch``), and each part, say a file, keeps its own delivery.
    Identical deliveries meet in a grouped minimum with map-side combining, so a record delivered many times costs one row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b.column(0).cast(pa.int64()), b.column(1).cast(pa.large_string())
            for first, n in _cuts(raw) if b.num_rows else ():
                yield flatten_batch(ids.slice(first, n), raw.slice(first, n), with_fields, with_values, kinds, b.column(2).slice(first, n) if part_col else None)

    cols = [F.col(id_col).cast("bigint").alias("rec_id"), F.col(raw_col).cast("string").alias("raw")] + ([F.col(part_col).cast("string").alias("part")] if part_col else [])
    flat = df.select(cols).where("raw IS NOT NULL").mapInArrow(run, _spark_schema(with_fields, with_values, bool(part_col)))
    by = ["kind", *(["part"] if part_col else [])]
    rest = [c for c in flat.columns if c not in ("rec_id", "uuid", *by)]
    alone = F.when(F.col("uuid").isNull(), F.col("rec_id"))
    return (
        flat.groupBy(*by, F.lower("uuid").alias("uuid_key"), alone.alias("alone"))
        .agg(F.min_by(F.struct("rec_id", "uuid", *rest), "rec_id").alias("r"))
        .select("r.rec_id", "kind", "r.uuid", *by[1:], *[f"r.{c}" for c in rest])
    )


def item_table(records: DataFrame) -> DataFrame:
    """Child rows of all depths: rec_id, kind, table (path without positions), parent_path, child_path and, if kept, pos and fields."""
    i = records.select("rec_id", "kind", F.explode("items").alias("i"))
    cols = [c for c in ("pos", "fields") if c in records.schema["items"].dataType.elementType.names]
    name = F.regexp_replace("i.child_path", r"\[\d+\]", "")
    return i.select("rec_id", "kind", F.regexp_replace(name, r"^\$\.", "").alias("table"), "i.parent_path", "i.child_path", *[f"i.{c}" for c in cols])


def value_table(records: DataFrame) -> DataFrame:
    """Scalars in arrays of all depths: rec_id, kind, table (path without positions), parent_path (the item or body above), child_path, pos, value."""
    v = records.select("rec_id", "kind", F.explode("values").alias("v"))
    name = F.regexp_replace("v.child_path", r"\[\d+\]", "")
    return v.select("rec_id", "kind", F.regexp_replace(name, r"^\$\.", "").alias("table"), "v.parent_path", "v.child_path", "v.pos", "v.value")

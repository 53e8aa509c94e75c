"""Problem 6: encoding a corpus with a public byte-level tokenizer.

Method: Spark higher-order functions fold ranked merges over byte arrays of distinct words, with a literal rank map; decoding
concatenates binary pieces.  All of it is one column expression: no Python worker, no shuffle, one pass over the texts.

* A text is split by the tokenizer's pattern; its words are handled in blocks, each distinct word of a block once.
* A word that is a token is looked up; any other becomes its bytes, over whose pairs an ``aggregate`` folds: each step merges the
  leftmost pair of lowest rank and looks up the two pairs beside it.
* The rank map is a set of literal arrays: pairs of bytes by their two values, pairs of longer pieces by a perfect hash
  (displacements per bucket), so a look-up is a few array accesses, not a walk through 50,000 map entries.  It is built on the
  driver from the rank file, whose size is fixed.
* A step costs as much as the word is long, so a long word is folded in tiles of TILE bytes, each overlapping the next by half.  Two
  tiles that hold the same token at the same place are joined there.  Every two neighbours of the result are then neighbours in a
  tile, and a sequence of tokens is the one that the merges give if each two neighbours in it are.  Where two tiles have no token in
  common, the word is folded as a whole.

Defined results: null and empty texts give an empty list, and decode to ''; blank texts are encoded like others; any length of
text and word is taken whole; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rank file where no path is given: one of the package of public tokenizers.
RANKS = "byte_bpe_50k.tiktoken"
#: Words of a block: within one, equal words are encoded once.
BLOCK = 1024
#: Bytes of a tile of a long word.
TILE = 64
#: The characters that the pattern's \s stands for (Unicode white space).
_WS = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The splitting pattern of the rank files, with \s and \S spelled out, as Java's own \s is ASCII only.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Between the pieces of a literal; no token has it.
_SEP = "\ue000"
#: No rank; what a rank is multiplied by to stand with an id in one number; the id of the ends (all others are less).
_NONE, _ID, _END = 2**31 - 1, 2**17, 2**16 - 1


def _slots(keys: list[int], size: int, buckets: int) -> tuple[list[int], list[int]]:
    """A perfect hash: displacement of each bucket, and the key index (or -1) of each slot.  slot = (key % size + d * (1 + key % (size - 2))) % size."""
    groups: list[list[int]] = [[] for _ in range(buckets)]
    for i, k in enumerate(keys):
        groups[k % buckets].append(i)
    disp, slots = [0] * buckets, [-1] * size
    for b in sorted(range(buckets), key=lambda b: -len(groups[b])):
        for d in range(10 * size):
            at = [(keys[i] % size + d * (1 + keys[i] % (size - 2))) % size for i in groups[b]]
            if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                break
        else:
            raise ValueError("two keys can't be told apart")
        disp[b] = d
        for s, i in zip(at, groups[b], strict=True):
            slots[s] = i
    return disp, slots


def _pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> merged id: how each token comes about, by merging its bytes with the ranks below its own."""
    out = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            i = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], _NONE) if parts[i] + parts[i + 1] != token else _NONE)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out[ranks[parts[0]], ranks[parts[1]]] = rank
    return out


def _next_prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@lru_cache(maxsize=4)
def _tables(path: str | None) -> dict[str, object]:
    if path is None:
        from public_tokenizers import path as place

        path = place(RANKS)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if max(ranks.values()) >= _END:
        raise ValueError(f"ids of {path} reach {max(ranks.values())}; they must stay below {_END}")
    pairs = _pairs(ranks)
    size, buckets = _next_prime(len(ranks) * 13 // 10 + 100), _next_prime(len(ranks) // 3 + 10)
    keys = [a * 65536 + b for a, b in pairs]
    merged = list(pairs.values())
    disp, slots = _slots(keys, size, buckets)
    whole = []
    for token, rank in ranks.items():
        try:
            whole.append((token.decode(), rank))
        except UnicodeDecodeError:  # part of a character: never a whole word
            pass
    assert not any(_SEP in w for w, _ in whole), "a token has the separator"
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) >> 2 for w, _ in whole]
    wdisp, wslots = _slots(hashes, size, buckets)
    n = max(ranks.values()) + 1
    by_id = [b""] * n
    for token, rank in ranks.items():
        by_id[rank] = token
    text = [""] * n
    for w, rank in whole:
        text[rank] = w
    return {
        "size": size,
        "buckets": buckets,
        "disp": ",".join(map(str, disp)),
        "packed": ",".join(str(keys[i] * 65536 + merged[i] if i >= 0 else -1) for i in slots),
        "wdisp": ",".join(map(str, wdisp)),
        "wslots": ",".join(str(whole[i][1] if i >= 0 else -1) for i in wslots),
        "text": _SEP.join(text),
        "bytes": ",".join(str(ranks[bytes([i])]) for i in range(256)),
        "two": ",".join(str(ranks.get(bytes([i, j]), _NONE) * _ID + ranks[bytes([i])]) for i in range(256) for j in range(256)),
        "size_of": ",".join(str(len(b)) for b in by_id),
        "hex": ",".join(b.hex() for b in by_id),
    }


def _numbers(s: str, kind: str) -> Column:
    """A literal array (the optimizer folds it)."""
    return F.split(F.lit(s), ",").cast(f"array<{kind}>")


def _bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _slot(key: Column, disp: Column, size: int, buckets: int) -> Column:
    return ((key % size) + F.get(disp, (key % buckets).cast("int")) * (key % (size - 2) + 1)) % size


def encode_word(word: Column, path: str | None = None, tile: int = TILE) -> Column:
    """Ids of one word (a match of the pattern)."""
    t = _tables(path)
    size, buckets = t["size"], t["buckets"]
    disp, packed = _numbers(t["disp"], "bigint"), _numbers(t["packed"], "bigint")
    byte_ids, two, sizes = _numbers(t["bytes"], "int"), _numbers(t["two"], "bigint"), _numbers(t["size_of"], "int")

    def entry(key: Column) -> Column:  # of a piece and the one behind it, as left * 65536 + right: rank of the pair and the piece's id
        def found(x: Column) -> Column:
            return F.when(F.shiftright(x, 16) == key, x.bitwiseAND(65535)).otherwise(F.lit(_NONE)) * _ID + F.shiftright(key, 16)

        return _bind(F.get(packed, _slot(key, disp, size, buckets).cast("int")), found)

    def pair(a: Column, b: Column) -> Column:
        return a.cast("bigint") * 65536 + b

    chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    start = F.transform(F.filter(chars, lambda c: c != ""), F.ascii)

    def fold(raw: Column) -> Column:
        """Ids of some bytes."""
        n = F.size(raw)
        end = F.array(F.lit(_NONE * _ID + _END))  # on either side, so that every pair has two neighbours; no pair with it has a rank
        last = F.get(byte_ids, F.get(raw, n - 1)) + F.lit(_NONE * _ID)
        first = F.concat(end, F.zip_with(F.slice(raw, F.lit(1), n - 1), F.slice(raw, F.lit(2), n - 1), lambda x, y: F.get(two, x * 256 + y)), F.array(last), end)

        def step(acc: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                m = F.shiftright(least, 17)

                def at(p: Column) -> Column:  # p: the pair's place, from 1
                    near = F.transform(F.array(pair(F.get(acc, p - 2).bitwiseAND(_ID - 1), m), pair(m, F.get(acc, p + 1).bitwiseAND(_ID - 1))), entry)
                    return F.concat(F.slice(acc, F.lit(1), p - 2), near, F.slice(acc, p + 2, n))

                return F.when(m == _NONE, acc).otherwise(_bind(F.array_position(acc, least).cast("int"), at))

            return _bind(F.array_min(acc), merge)

        merged = F.aggregate(F.sequence(F.lit(2), n), first, step, lambda acc: F.transform(F.slice(acc, F.lit(2), F.size(acc) - 2), lambda x: x.bitwiseAND(_ID - 1).cast("int")))
        return F.when(n < 2, F.transform(raw, lambda x: F.get(byte_ids, x))).otherwise(merged)

    def chain(ids: Column, begin: Column) -> Column:
        """Tokens of a tile that begins at a byte, as place * 2^17 + id."""

        def add(acc: Column, i: Column) -> Column:
            far = lambda x: F.array((F.shiftright(x, 17) + F.get(sizes, x.bitwiseAND(_ID - 1).cast("int"))) * _ID + i)
            return F.concat(acc, _bind(F.element_at(acc, -1), far))

        return F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), F.array(begin * _ID + F.get(ids, F.lit(0))), add)

    def joined(tt: Column) -> Column:
        """Ids of tiles joined at common tokens; null if two tiles have none."""

        def parts(cuts: Column) -> Column:
            own = lambda k: F.filter(F.get(tt, k), lambda x: (x >= F.get(cuts, k)) & (x < F.get(cuts, k + 1)))
            ids = F.flatten(F.transform(F.sequence(F.lit(0), F.size(tt) - 1), lambda k: F.transform(own(k), lambda x: x.bitwiseAND(_ID - 1).cast("int"))))
            return F.when(~F.exists(cuts, lambda c: c.isNull()), ids)

        common = F.transform(F.sequence(F.lit(0), F.size(tt) - 2), lambda k: F.array_min(F.array_intersect(F.get(tt, k), F.get(tt, k + 1))))
        return _bind(F.concat(F.array(F.lit(0).cast("bigint")), common, F.array(F.lit(2**62))), parts)

    def bytes_to_ids(raw: Column) -> Column:
        def attempt(half: Column) -> Column:
            tiles = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(raw) / half).cast("int") - 2, F.lit(0)))
            folded = F.transform(tiles, lambda k: fold(F.slice(raw, k * half + 1, half * 2)))
            many = lambda tt: _bind(F.transform(tt, lambda ids, k: chain(ids, (k * half).cast("bigint"))), joined)
            return _bind(folded, lambda tt: F.when(F.size(tt) == 1, F.get(tt, F.lit(0))).otherwise(many(tt)))

        halves = F.array(F.lit(tile // 2), F.lit(2**29))  # in tiles, or as a whole
        long = F.aggregate(halves, F.lit(None).cast("array<int>"), lambda acc, half: F.when(acc.isNotNull(), acc).otherwise(attempt(half)))
        return F.when(F.size(raw) <= tile, fold(raw)).otherwise(long)

    def known(h: Column) -> Column:
        return F.get(_numbers(t["wslots"], "int"), _slot(h, _numbers(t["wdisp"], "bigint"), size, buckets).cast("int"))

    def choose(i: Column) -> Column:
        is_it = (i >= 0) & (F.get(F.split(F.lit(t["text"]), _SEP), i) == word)
        return F.when(is_it, F.array(i)).otherwise(_bind(start, bytes_to_ids))

    return _bind(_bind(F.shiftrightunsigned(F.xxhash64(word), 2), known), choose)


def encode(text: Column, path: str | None = None) -> Column:
    """Token ids of a text: array of int, empty for null and empty texts."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))

    def block(ws: Column) -> Column:
        def coded(distinct: Column) -> Column:
            return _bind(F.transform(distinct, lambda w: encode_word(w, path)), lambda codes: F.flatten(F.transform(ws, lambda w: F.get(codes, (F.array_position(distinct, w) - 1).cast("int")))))

        return _bind(F.array_distinct(ws), coded)

    def blocks(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(BLOCK))
        return F.flatten(F.transform(starts, lambda i: _bind(F.slice(ws, i + 1, F.lit(BLOCK)), block)))

    return _bind(words, blocks)


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of token ids: their binary pieces, concatenated; null ids give null."""
    pieces = F.split(F.lit(_tables(path)["hex"]), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of every document."""
    return docs.select("doc_id", encode(F.col("text"), path).alias("ids"))

"""Problem 6 against the tokenizer's own library, and there and back."""

import base64
import random

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from provspark.llm import tokens as T

TEXTS = [
    None, "", " ", "   ", "\n", "a", "ab", " the", "Hello, world! It's 12345 o'clock, they'll've said.", "x" * 3000, "日本語のテキスト、全部。" * 40, "é́\U0001f600‍\U0001f468  　 x\u0085y",
    "tab\tand  two   blanks \n\n end  ", "<|endoftext|>", "\x00\x01\x1c\x7f", "ÄÖÜ ß 㐀 ٣٤ Ⅷ ½", "for(i=0;i<10;i++){a[i]+=0xDEADbeef;}  // ok", "b4f" * 700 + " " * 500 + "q", "'s't're've'm'll'd'S'x", "",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_texts(spark, name):
    path = P.path(name + ".tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("ids", F.lit("clash"))
    got = T.encode_documents(df, path).withColumn("back", T.decode(F.col("ids"), path)).collect()
    for r in got:
        assert r.ids == enc.encode_ordinary(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]
        assert r.back == (TEXTS[r.doc_id] or "")


def test_long_words(spark):
    """Tiles join to what the whole word gives, also where a word repeats itself; time grows with its length, not with the square."""
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    some = lambda al, n: "".join(r.choice(al) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["x" * 3000, "ab" * 900, "abc" * 777, "aab" * 700, "=" * 3001, "9" * 1000, "日" * 1500, "のの" * 300 + "ABC" * 200, "é" * 300, some("aeiou日本語", 2000)]
    words += [some(letters[: r.choice([2, 3, 5, 26])], r.randrange(40, 1500)) for _ in range(40)]
    words += [some(letters, 200_000)]
    got = T.encode_documents(spark.createDataFrame(list(enumerate(words)), "doc_id int, text string")).collect()
    assert len(got) == len(words)
    for x in got:
        assert x.ids == enc.encode_ordinary(words[x.doc_id]), words[x.doc_id][:50]


def test_ids_too_large(tmp_path):
    f = tmp_path / "ranks"
    f.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % (i + 65_400) for i in range(256)))
    with pytest.raises(ValueError, match="must stay below"):
        T.encode(F.col("text"), str(f))


def test_table(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    d = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in zip(d["doc_id"], d["text"], strict=True)}
    got = {r.doc_id: r.ids for r in T.encode_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want


def test_no_python_and_no_shuffle(spark, sf):
    node, names = T.encode_documents(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan(), []
    while True:
        names.append(node.nodeName())
        if not node.children().size():
            break
        assert node.children().size() == 1
        node = node.children().apply(0)
    assert not [n for n in names if "Exchange" in n or "Python" in n or "Arrow" in n], names


def test_empty(spark):
    assert T.encode_documents(spark.createDataFrame([], "doc_id int, text string")).count() == 0

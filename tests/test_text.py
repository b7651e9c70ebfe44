from __future__ import annotations

import uuid
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions import text as X
from siltstone.functions.stemmer import stem


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("ChunkFile", ["chunk", "file"]),
        ("chunk_file", ["chunk", "file"]),
        ("NewVectorInputSparse", ["new", "vector", "input", "sparse"]),
        ("sha256Hash", ["sha256", "hash"]),
        ("HTTPClient", ["http", "client"]),
        ("the func for return", []),
        ("", []),
        (None, []),
        (" \t\n", []),
        ("foo.bar(baz, qux)", ["foo", "bar", "baz", "qux"]),
    ],
)
def test_words(spark, text, wanted):
    assert one(spark, X.words(F.col("t")), t=text) == wanted


@pytest.mark.parametrize("word, wanted", [("hashes", "hash"), ("files", "file"), ("chunks", "chunk"), ("vectors", "vector"), ("results", "result"), ("classes", "class"), ("indexes", "index"), ("computing", "comput"), ("running", "run"), ("indexing", "index"), ("computed", "comput"), ("hashed", "hash"), ("collection", "collect"), ("hash", "hash"), ("entries", "entri"), ("hopping", "hop"), ("hoping", "hope"), ("ties", "tie"), ("gas", "gas"), ("sky", "sky"), ("by", "by")])
def test_stems(word, wanted):
    assert stem(word) == wanted


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefghilmnoprstuy'", max_size=14))
def test_stem_never_fails(word):
    assert len(stem(word)) <= len(word) + 1


def test_token_hash(spark):
    for w in ("chunk", "file", "hash", "sha256", "é"):
        assert one(spark, X.token_hash(F.col("t")), t=w) == zlib.crc32(w.encode())


@pytest.mark.parametrize("repo, path, name, index", [("testrepo", "test.go", "Greet", 0), ("testrepo", "test.go", "", 1), ("r", "ü/ä.py", "x", 7), ("", "", "", 0)])
def test_chunk_id(spark, repo, path, name, index):
    got = one(spark, X.chunk_id(F.col("r"), F.col("p"), F.col("n"), F.col("i")), r=repo, p=path, n=name, i=index)
    assert got == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{repo}:{path}:{name}:{index}"))


def test_enriched(spark):
    df = spark.createDataFrame([("a.go", "go", "function", "F", "body"), (None, None, None, None, None)], "p string, l string, k string, n string, c string")
    rows = [r[0] for r in df.select(X.enriched(*[F.col(c) for c in "plknc"])).collect()]
    assert rows == ["File: a.go\nLanguage: go\nFunction: F\n\nbody", "File: \nLanguage: \nType: Chunk\n\n"]


@pytest.mark.parametrize(
    "text, wanted",
    [("no citations here", []), ("[3] then [1] and [2]", [1, 2, 3]), ("[1] and again [1]", [1]), ("[see] this [1]", [1]), ("ref [12]", [12]), ("[99999999999999999999999] [2]", [2]), (None, [])],
)
def test_citations(spark, text, wanted):
    assert one(spark, A.citations(F.col("t")), t=text) == wanted


def test_flags(spark):
    rows = [("It does not contain enough.", True, True), ("  \n", False, False), (None, False, False), ("I CANNOT answer", True, True), ("fine", True, False)]
    df = spark.createDataFrame([(t,) for t, *_ in rows], "t string")
    got = [tuple(r) for r in df.select(A.well_formed(F.col("t")), A.refuses(F.col("t"))).collect()]
    assert got == [(w, r) for _, w, r in rows]


def test_prompt(spark):
    block = A.rendered(F.lit(1), F.col("r"), F.lit("a.go"), F.lit("1-2"), F.col("k"), F.col("s"), F.col("c"))
    df = spark.createDataFrame([("repo", "function", "F", "x"), ("", "", "F", "x\n"), (None, None, None, None)], "r string, k string, s string, c string")
    assert [r[0] for r in df.select(block).collect()] == ["[1] repo/a.go:1-2, function: F\nx\n", "[1] a.go:1-2, symbol: F\nx\n", "[1] a.go:1-2\n\n"]
    empty = df.limit(1).select(A.prompt(F.lit("why"), F.lit(None).cast("array<string>"))).first()[0]
    assert empty == "Question: why\n\nContext:\n(no chunks retrieved)\n\nAnswer the question based on the chunks above.\n"

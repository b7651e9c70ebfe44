from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import changes, chunking, dense, evaluate, sparse

FILES = "repo string, file_path string, language string, content string, extra int"


def windows(spark, n, size=40, overlap=5):
    df = spark.createDataFrame([("r", "a.txt", "text", "\n".join(f"l{i}" for i in range(n)), 1)], FILES)
    return sorted((r.start_line, r.end_line) for r in chunking.windows(df, size, overlap).collect())


@pytest.mark.parametrize("n, wanted", [(1, [(1, 1)]), (40, [(1, 40)]), (41, [(1, 40), (36, 41)]), (75, [(1, 40), (36, 75)]), (76, [(1, 40), (36, 75), (71, 76)])])
def test_windows(spark, n, wanted):
    assert windows(spark, n) == wanted


def test_windows_cover_every_line(spark):
    for n in (3, 7, 10, 23):
        for size, overlap in ((4, 1), (5, 0), (3, 2)):
            seen = {i for a, b in windows(spark, n, size, overlap) for i in range(a, b + 1)}
            assert seen == set(range(1, n + 1))
    with pytest.raises(ValueError):
        chunking.window_starts(F.lit(3), 4, 4)


def test_windows_of_blank_null_and_empty(spark):
    df = spark.createDataFrame([("r", "a", "text", " \n\t\n", 1), ("r", "b", "text", None, 1), ("r", "c", "text", "", 1)], FILES)
    assert chunking.windows(df).count() == 0
    assert chunking.chunks(df.limit(0)).count() == 0


GO = """package main

import "fmt"

// Greet says hello.
// It takes a name.
func Greet(name string) string {
\treturn fmt.Sprintf("} %s {", name) // not a brace: }
}

type T struct{ a int }

/* Doc
of a method */
func (t *T) Run() {
\tx := `{ raw
func fake() {`
\t_ = x
}
"""


def test_go_functions():
    assert chunking.go_functions(GO) == [("Greet", 4, 8), ("Run", 12, 18)]
    assert chunking.go_functions("package x\nfunc a() {") is None
    assert chunking.go_functions("package x\n") == []


@pytest.mark.parametrize("signature", ["F() interface{}", "F() map[string]struct{}", "F(x interface{}) (a struct{ b int }, err error)", "F[T any](x []T) func(T) interface{ M() }", "F(\n\ta int,\n) *T", "(r *R[T]) F() chan<- struct{}", "F() []interface {\n\tM()\n}"])
def test_go_result_types_with_braces(signature):
    body = f"func {signature} {{\n\treturn g()\n}}"
    source = f"package x\n\n{body}\n\nvar y = 1\n"
    assert chunking.go_functions(source) == [("F", 2, 2 + body.count("\n"))]


def test_go_functions_without_a_body():
    assert chunking.go_functions("package x\nfunc a() int\n\nfunc b() struct{}\nfunc c() {}\nvar m = map[string]int{}\n") == [("a", 1, 1), ("b", 3, 3), ("c", 4, 4)]


def test_go_chunks(spark):
    long = "package p\n\nfunc Big() {\n" + "\n".join(f"\tx{i}()" for i in range(100)) + "\n}\n"
    df = spark.createDataFrame([("r", "a.go", "go", GO, 1), ("r", "b.go", "go", long, 2), ("r", "c.go", "go", "func broken( {", 3), ("r", "d.go", "go", None, 4)], FILES)
    rows = chunking.go_chunks(df).orderBy("file_path", "start_line").collect()
    a = [(r.name, r.chunk_type, r.start_line, r.end_line) for r in rows if r.file_path == "a.go"]
    assert a == [("", "block", 1, 4), ("Greet", "function", 5, 9), ("", "block", 10, 12), ("Run", "function", 13, 19)]
    big = [r for r in rows if r.file_path == "b.go" and r.chunk_type == "function"]
    assert len(big) == 3 and [r.name for r in big] == ["Big", "", ""]
    assert sum(r.file_path == "c.go" for r in rows) == 1 and not any(r.file_path == "d.go" for r in rows)
    assert {r.extra for r in rows} == {1, 2, 3}


def corpus(spark, texts):
    return sparse.tokenized(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", F.col("t"))


def postings(words):
    counts, stats = sparse.term_counts(words), sparse.corpus_stats(words)
    return sparse.weights(counts, sparse.idf(counts, stats), stats)


def test_idf(spark):
    words = corpus(spark, ["alpha beta", "alpha gamma", "beta delta"])
    found = {r.token: r.idf for r in sparse.idf(sparse.term_counts(words), sparse.corpus_stats(words)).collect()}
    assert found["alpha"] == pytest.approx(math.log(1.6)) and found["delta"] == pytest.approx(math.log(8 / 3))
    assert sparse.corpus_stats(words).first().avgdl == 2


def test_bm25_saturates_and_prefers_short_texts(spark):
    w = {r.id: r.weight for r in postings(corpus(spark, ["foo foo foo foo foo", "foo bar baz qux quux", "unrelated filler text padding"])).where("token = 'foo'").collect()}
    assert w[0] == pytest.approx(0.637808, abs=1e-5) and w[1] == pytest.approx(0.461758, abs=1e-5)


def test_stems_are_added_not_counted_in_length(spark):
    words = corpus(spark, ["hashes", "hash"])
    counts = {(r.id, r.token): (r.tf, r.length) for r in sparse.term_counts(words, stems=True).collect()}
    assert counts == {(0, "hashes"): (1, 1), (0, "hash"): (1, 1), (1, "hash"): (1, 1)}


def test_sparse_of_empty_and_null(spark):
    words = corpus(spark, ["the of", "", None])
    assert postings(words).count() == 0
    assert sparse.corpus_stats(words.limit(0)).first().n == 0
    assert sparse.sparse_vectors(postings(words)).count() == 0


def test_sparse_search_ties_and_missing(spark):
    p = postings(corpus(spark, ["alpha beta", "alpha beta", "gamma delta"]))
    q = spark.createDataFrame([("q", ["alpha", "alpha"]), ("none", ["zeta"]), ("empty", [])], "query_id string, words array<string>")
    assert [(r.query_id, r.id, r.rank) for r in sparse.search(q, p, 2).orderBy("rank").collect()] == [("q", 0, 1), ("q", 1, 2)]


def test_dense_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    monkeypatch.setattr(dense, "VECTOR_BLOCK", 7)
    rng = random.Random(1)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(5)] for i in range(40)}
    vectors[40] = vectors[3]
    rows = [*vectors.items(), (41, [0.0] * 5), (42, None), (43, []), (44, [1.0, 2.0])]
    v = spark.createDataFrame([(i, x, i % 2) for i, x in rows], "id bigint, vector array<double>, half int")
    q = v.where("id % 5 = 0").withColumnRenamed("id", "query_id")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    got = {(r.query_id, r["rank"]): r.id for r in dense.top_k(q, v, 4).collect()}
    same = {(r.query_id, r["rank"]): r.id for r in dense.top_k(q, v, 4, same=["half"]).collect()}
    for i in range(0, 41, 5):
        order = sorted((j for j in vectors if j != i), key=lambda j: (-round(cos(vectors[i], vectors[j]), 9), j))
        assert [got[i, n] for n in range(1, 5)] == order[:4]
        assert [same[i, n] for n in range(1, 5)] == [j for j in order if j % 2 == i % 2][:4]


@pytest.mark.parametrize("shard, block", [(20_000, 20_000), (40, 3)])
def test_sparse_against_brute_force(spark, monkeypatch, shard, block):
    """Shards and blocks of any size, names as ids, filters, a word that all texts hold, ties, repeated and null queries."""
    monkeypatch.setattr(sparse, "SHARD", shard)
    monkeypatch.setattr(sparse, "QUERIES", block)
    rng = random.Random(3)
    words = ["all", *[f"w{i}" for i in range(12)]]
    rows = [(f"t{i:03d}", w, "ab"[i % 2], rng.choice([1.0, 0.5, rng.random()])) for i in range(150) for w in ["all", *rng.sample(words[1:], 3)]]
    p = spark.createDataFrame(rows, "id string, token string, repo string, weight double")
    asked = [(f"q{i}", rng.sample(words, 3) + ["none", "all", "all"], [["a"], [], None, ["x"]][i % 4]) for i in range(8)] + [("empty", [], None), ("null", None, None), (None, ["all"], None)]
    q = spark.createDataFrame(asked, "query_id string, words array<string>, only array<string>")
    for filters in (None, {"only": "repo"}):
        got = {}
        for r in sparse.search(q, p, 7, filters=filters).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.score, 9), r["rank"]))
        for key, its, only in asked[:8]:
            scores = {}
            for i, w, repo, weight in rows:
                if w in its and (not filters or not only or repo in only):
                    scores[i] = scores.get(i, 0) + weight
            best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:7]
            assert got.get(key, []) == [(i, round(s, 9), n + 1) for n, (i, s) in enumerate(best)]
        assert set(got) <= {k for k, _, _ in asked[:8]}


def test_sparse_of_no_postings(spark):
    p = spark.createDataFrame([], "id bigint, token string, weight double")
    q = spark.createDataFrame([("q", ["a"])], "query_id string, words array<string>")
    assert sparse.search(q, p, 3).count() == 0 and sparse.search(q.limit(0), p, 3).count() == 0


def test_sparse_vectors_are_checked(spark):
    cases = [([1, 2], [0.5, 0.1], None), ([], [], None), (None, [0.1], "missing"), ([1], [0.1, 0.2], "different lengths"), ([1, None], [0.1, 0.2], "null entry"), ([1, 1], [0.1, 0.2], "repeated index")]
    df = spark.createDataFrame([(i, v) for i, v, _ in cases], "i array<bigint>, v array<double>")
    assert [r[0] for r in df.select(sparse.validate(F.col("i"), F.col("v"))).collect()] == [w for *_, w in cases]


def test_dense_of_names_in_blocks_or_not(spark, monkeypatch):
    """Both ways give the same: queries that every task holds, and queries in blocks; ids may be names, filters must be equal."""
    rng = random.Random(9)
    rows = [(f"v{i:02d}", [rng.gauss(0, 1) for _ in range(5)], "ab"[i % 2]) for i in range(40)] + [("zero", [0.0] * 5, "a"), ("short", [1.0], "a"), ("null", None, "a"), ("copy", None, None)]
    rows[-1] = ("copy", rows[0][1], "a")
    v = spark.createDataFrame(rows, "id string, vector array<double>, label string").repartition(3)
    q = v.withColumnRenamed("id", "query_id")
    one = {tuple(r) for r in dense.top_k(q, v, 4, same=["label"]).collect()}
    monkeypatch.setattr(dense, "HELD", 0)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    monkeypatch.setattr(dense, "VECTOR_BLOCK", 9)
    assert one == {tuple(r) for r in dense.top_k(q, v, 4, same=["label"]).collect()} and len(one) == 41 * 4
    assert {(r[1], r[3]) for r in one if r[0] == "v00" and r[3] == 1} == {("copy", 1)} and not any(r[0] == r[1] for r in one)
    assert dense.top_k(q.limit(0), v, 4).count() == dense.top_k(q, v.limit(0), 4).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 3)], "query_id string, id int, rank int")
    b = spark.createDataFrame([("q", 1, 50), ("q", 2, 3)], "query_id string, id int, rank int")
    rows = dense.fuse([a, b], 5).orderBy("rank").collect()
    assert [(r.id, round(r.score, 4)) for r in rows] == [(2, 0.0317), (1, 0.0255)]
    assert [r.id for r in dense.fuse([b, a], 5).orderBy("rank").collect()] == [2, 1]


def test_validate(spark):
    cases = [([[1.0], [2.0]], None), ([], "empty batch"), (None, "empty batch"), ([[1.0], []], "empty vector"), ([[1.0], None], "empty vector"), ([[1.0], [1.0, 2.0]], "ragged batch"), ([[1.0, 2.0]], "unexpected dimension")]
    df = spark.createDataFrame([(v,) for v, _ in cases], "v array<array<double>>")
    assert [r[0] for r in df.select(dense.validate(F.col("v"), 1)).collect()] == [w for _, w in cases]


def test_classes(spark):
    disk = spark.createDataFrame([("r", "same", "1"), ("r", "old", "1"), ("r", "other", "2"), ("r", "new", "1"), (None, "n", "1")], "repo string, file_path string, file_hash string")
    v = changes.INDEX_VERSION
    t = lambda s: f"2025-01-0{s} 00:00:00"
    states = spark.createDataFrame([("r", "same", "0", v, t(1)), ("r", "same", "1", v, t(2)), ("r", "old", "1", "v0", t(1)), ("r", "other", "1", v, t(1)), ("r", "gone", "1", v, None), (None, "n", "1", v, t(1)), ("r", "", "1", v, t(1)), ("r", None, "1", v, t(1))], "repo string, file_path string, file_hash string, index_version string, seen_at string").withColumn("seen_at", F.to_timestamp("seen_at"))
    known = changes.latest_states(states, F.col("seen_at"))
    got = {(r.repo, r.file_path): r["class"] for r in changes.classify(disk, known).collect()}
    assert got == {("r", "same"): "unchanged", ("r", "old"): "refresh", ("r", "other"): "changed", ("r", "new"): "new", ("r", "gone"): "stale", (None, "n"): "unchanged"}


def test_rewrites(spark):
    stored = spark.createDataFrame([("a", "r", "f", "1"), ("b", "r", "g", "1"), ("c", "r", "f", "0")], "chunk_id string, repo string, file_path string, file_hash string")
    new = spark.createDataFrame([("a", "r", "f", "9")], stored.schema)
    assert {(r.chunk_id, r.file_hash) for r in changes.upsert(stored, new, "chunk_id").collect()} == {("a", "9"), ("b", "1"), ("c", "0")}
    assert {r.chunk_id for r in changes.delete_paths(stored, spark.createDataFrame([("r", "g"), ("r", "g")], "repo string, file_path string")).collect()} == {"a", "c"}
    now = spark.createDataFrame([("r", "f", "1")], "repo string, file_path string, file_hash string")
    assert {r.chunk_id for r in changes.delete_orphans(stored, now).collect()} == {"a", "b"}


def test_metrics(spark):
    q = spark.createDataFrame([("pos", "why", "concept", ["c", "z"], ["S"], None), ("neg", "why", "negative", None, None, 0.5), ("none", "why", None, ["x"], [], None)], "query_id string, query string, query_type string, expected_files array<string>, expected_symbols array<string>, top1_score_below double")
    r = spark.createDataFrame([("pos", i + 1, 1.0, f, "") for i, f in enumerate("abcde")] + [("neg", 1, 0.4, "a", "")], "query_id string, rank int, score double, file_path string, name string")
    m = {x.query_id: x for x in evaluate.per_query(r, q).collect()}
    assert (m["pos"].hit_1, m["pos"].hit_3, m["pos"].hit_5) == (False, True, True)
    assert m["pos"].mrr_5 == pytest.approx(1 / 3) and m["pos"].recall_5 == 0.5
    assert m["neg"].negative_pass and m["none"].query_type == "untyped" and m["none"].mrr_5 == 0 and m["none"].negative_pass is None
    a = evaluate.aggregate(evaluate.per_query(r, q)).first()
    assert (a.queries, a.positive, a.hit_5, a.negative_pass_rate) == (3, 2, 0.5, 1.0)


def test_run_aggregate(spark):
    rows = [("r", "concept", True, 1.0, None, None, 30), ("r", "concept", False, 0.0, None, None, 10), ("r", "negative", False, 0.0, True, None, 20), ("r", "concept", True, 1.0, None, "lost", 999), ("e", "negative", False, 0.0, False, "lost", 1)]
    m = spark.createDataFrame(rows, "run string, query_type string, hit boolean, share double, negative_pass boolean, error string, ms bigint")
    m = m.select("run", "query_type", "negative_pass", "error", *[F.col("hit").alias(f"hit_{k}") for k in (1, 3, 5)], *[F.col("share").alias(c) for c in ("mrr_5", "recall_5", "recall_10")], *[F.col("ms").alias(c) for c in evaluate.TIMES])
    got = {r.run: r for r in evaluate.run_aggregate(m, ["run"]).collect()}
    r, e = got["r"], got["e"]
    assert (r.queries, r.positive, r.negative, r.errors, r.hit_1, r.mrr_5, r.negative_pass_rate, r.total_p50_ms, r.total_p95_ms) == (4, 2, 1, 1, 0.5, 0.5, 1.0, 20, 30)
    assert (e.queries, e.positive, e.negative, e.errors, e.hit_1, e.total_p50_ms) == (1, 0, 0, 1, 0.0, None)


def test_percentiles(spark):
    df = spark.createDataFrame([("k", float(x)) for x in range(10, 101, 10)] + [("k", None)], "k string, v double")
    r = evaluate.percentiles(df, F.col("v"), ["k"]).first()
    assert (r.n, r.p50, r.p95) == (10, 50.0, 100.0)


def test_golden_validation(spark):
    schema = "query_id string, query string, query_type string, expected_files array<string>, expected_symbols array<string>"
    df = spark.createDataFrame([("a", "x", "concept", ["f"], None), ("a", "x", "negative", None, None), (None, "x", "negative", None, None), ("b", "", "concept", ["f"], None), ("c", "x", "concept", [], None)], schema)
    assert {(r.query_id, r.problem) for r in evaluate.invalid_queries(df).collect()} == {("a", "duplicate id"), (None, "missing id"), ("b", "empty query"), ("c", "no expectation")}
    assert [r.problem for r in evaluate.invalid_queries(df.limit(0)).collect()] == ["no queries"]

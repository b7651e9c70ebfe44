from __future__ import annotations

import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siltstone import report
from siltstone.operators import dense, evaluate
from siltstone.operators.store import Store
from siltstone.plans import evaluation, index, search
from siltstone.sources import golden


def test_arguments():
    assert search.mode_of(None) == search.mode_of(" HYBRID ") == "hybrid" and search.mode_of("Sparse") == "sparse"
    with pytest.raises(ValueError):
        search.mode_of("fuzzy")
    assert search.listed(" go, ,rust,") == ["go", "rust"] and search.listed(None) == []
    with pytest.raises(ValueError):
        search.limit_of(0)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "load.py").write_text("def load_config(path):\n    return open(path)\n")
    (root / "save.py").write_text("def save_file(path):\n    pass\n")
    (root / "rank.go").write_text("package rank\n\n// Rank sorts results.\nfunc Rank(xs []int) []int {\n\treturn xs\n}\n")
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    index.run(spark, s, "c", index.scan(spark, str(root), "repo"), dim=16)
    return s


def ask(spark, store, text, **request):
    q = spark.createDataFrame([("q", text)], "query_id string, query string")
    return search.search(spark, store, "c", q, search.Request(**request)).orderBy("rank").collect()


def test_modes_and_filters(spark, store):
    assert ask(spark, store, "load config", mode="sparse", limit=1)[0].name == "load_config"
    assert ask(spark, store, "the of", mode="sparse") == []
    assert len(ask(spark, store, "anything", mode="dense", limit=2)) == 2
    assert {r.language for r in ask(spark, store, "load config rank", mode="hybrid", languages=("go",))} == {"go"}
    assert ask(spark, store, "load", mode="hybrid", repos=("none",)) == []
    with pytest.raises(ValueError):
        search.search(spark, store, "missing", spark.createDataFrame([], "query_id string, query string"))


def test_answers(spark, store):
    q = spark.createDataFrame([("q", "load config"), ("z", "zzz")], "query_id string, query string")
    found = search.search(spark, store, "c", q, search.Request("sparse", 5))
    rows = {r.query_id: r for r in search.generate(search.prompts(found, q, 1), search.echo).collect()}
    assert rows["q"].text == "load config: 1 chunks [1]: load_config" and rows["z"].text == "zzz: 0 chunks" and rows["q"].error is None

    def failing():
        def answer(system, user):
            raise OSError("no model")

        return answer

    assert {r.error for r in search.generate(search.prompts(found, q, 1), failing).collect()} == {"OSError: no model"}


def test_golden(spark, tmp_path):
    path = tmp_path / "g.yaml"
    path.write_text("queries:\n- {id: a, query: load, type: concept, expected: {files: [load.py]}}\n- {id: n, query: no, type: negative, negative: {top1_score_below: 0.5}}\n")
    assert golden.load(spark, path).count() == 2 and golden.load(spark, path, "negative").first().top1_score_below == 0.5
    with pytest.raises(ValueError):
        golden.load(spark, path, "other")
    path.write_text("queries:\n- {id: a, query: load, type: concept}\n")
    with pytest.raises(ValueError):
        golden.load(spark, path)


def test_hints():
    assert "running?" in search.hint(ConnectionRefusedError("x")) and "too long" in search.hint(TimeoutError()) and "installed" in search.hint(OSError("404: model not found"))
    assert search.hint(OSError("disk")) == "OSError: disk"


def test_search_reads_stored_counts(spark, store):
    """No text is cut into words in a search, folders are filtered, and vectors are not shuffled."""
    q = spark.createDataFrame([("q", "load config")], "query_id string, query string")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = lambda df: df._jdf.queryExecution().toString()
    terms = plan(store.terms("c", ("repo",), ("go",)).where(F.col("token").isin("load")))
    folders = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", terms)[1]
    assert "repo" in folders and "language" in folders and "generation" in folders
    assert re.search(r"PushedFilters: \[.*token", terms)
    branch = plan(search.sparse_branch(store, "c", q, 5, search.Request(languages=("go",))))
    assert "enriched_text" not in branch and "content" not in branch
    vectors = dense.top_k(q.select("query_id", F.array(*[F.lit(1.0)] * 16).alias("vector")), store.read("c").select(F.col("chunk_id").alias("id"), F.col("dense").alias("vector")), 3)
    physical = vectors._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical[physical.index("MapInArrow") :]


def test_words_weigh_alike_in_searches_of_a_part(spark, store):
    all_, some = (ask(spark, store, "load config", mode="sparse", limit=1, **r)[0] for r in ({}, {"languages": ("python",)}))
    assert all_.chunk_id == some.chunk_id and all_.score == pytest.approx(some.score)


def test_embedders_are_checked(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(70)], "id int, t string").coalesce(1)
    sizes = search.embedder(lambda: lambda texts: [[float(len(texts)), 1.0] for _ in texts])
    assert [r[0][0] for r in df.select(sizes(F.col("t"))).collect()] == [32.0] * 64 + [6.0] * 6
    for reply, message in ((lambda texts: [[1.0]], "1 vectors for 32 texts"), (lambda texts: [[1.0]] * len(texts), "not 2")):
        with pytest.raises(Exception, match=message):
            df.select(search.embedder(lambda reply=reply: reply, 2)(F.col("t"))).collect()


def test_evaluation_run_and_comparison(spark, store, tmp_path):
    schema = golden.SCHEMA
    rows = [("a", "load config", "navigation", None, None, None, ["load.py"], None, None), ("b", "save file", "", None, None, None, None, ["nothing"], None), ("n", "zzz", "negative", None, None, None, None, None, None)]
    queries = spark.createDataFrame(rows, schema)
    done = evaluation.run(spark, store, "c", queries, search.Request("sparse", 10), "g.yaml", model=search.echo, generator="echo")
    total = done["aggregate"]
    assert (total["queries"], total["positive"], total["negative"], total["errors"], total["hit_1"], total["negative_pass_rate"]) == (3, 2, 1, 0, 0.5, 1.0)
    assert set(done["by_type"]) == {"navigation", "untyped", "negative"} and done["answer"]["generated"] == 3 and done["answer"]["generator"] == "echo"
    first = done["queries"][0]
    assert first["query_id"] == "a" and first["top_results"][0]["file_path"] == "load.py" and first["answer"]["is_well_formed"]
    text = report.evaluation(done)
    assert "failures:" in text and "  b (untyped): nothing expected" in text and "p95" in text
    with pytest.raises(ValueError):
        evaluation.run(spark, store, "c", queries, search.Request("sparse", 5))
    broken = evaluation.run(spark, store, "c", queries, search.Request("dense", 10), embed=lambda t: F.when(t != "zzz", index.fake_vectors(t, 16)))
    assert broken["aggregate"]["errors"] == 1 and broken["aggregate"]["negative"] == 0 and [q["error"] for q in broken["queries"]][2]
    for name, r in (("one", done), ("two", broken)):
        (tmp_path / f"{name}.json").write_text(report.as_json(r))
    paths = [str(tmp_path / f"{n}.json") for n in ("one", "two")]
    rows = evaluate.comparison(golden.reports(spark, paths)).orderBy("position").collect()
    assert rows[0].hit_1 == 0.5 and rows[0].hit_1_delta == 0 and rows[1].negative_pass_delta == -100.0 and rows[1].mode == "dense"
    table = report.comparison(rows, ["x", "y"])
    assert "changes against x" in table and "y: -100.0" in table and "h@1" in table
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ValueError, match="bad.json"):
        golden.reports(spark, [str(tmp_path / "bad.json")])


def test_reports():
    assert report.results([]) == report.NOTHING
    r = Row(rank=1, score=0.5, repo="r", file_path="a.go", language="go", start_line=1, end_line=2, name="F", content="x")
    assert report.results([r]) == "1. score 0.5000\n   r/a.go (go), lines 1-2\n   name: F\n\nx\n"
    total = dict.fromkeys(("hit_1", "hit_3", "hit_5", "mrr_5", "recall_5"), 0.0) | {"queries": 2, "positive": 0, "negative": 1, "errors": 0, "recall_10": 0.2, "negative_pass_rate": 1.0} | {f"{t}_p{p}_ms": 3 for t in ("total", "embed", "search") for p in (50, 95)}
    made = {"run_id": "r", "dataset": "d", "collection": "c", "mode": "sparse", "limit": 10, "embedder": "e", "aggregate": total, "by_type": {"negative": {"queries": 1, "positive": 0, "hit_5": 0.0, "negative_pass_rate": 1.0}}, "queries": []}
    text = report.evaluation(made)
    assert "hit_1         n/a" in text and "recall gap" not in text and "pass 1.000" in text
    assert "recall gap 0.200" in report.evaluation(made | {"aggregate": total | {"positive": 1}})
    assert report.as_json([{"a": 1, "b": None, "c": 0, "d": "", "e": 0.0}]) == '[\n  {\n    "a": 1,\n    "e": 0.0\n  }\n]'

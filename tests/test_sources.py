from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators.store import Store
from siltstone.plans import index
from siltstone.sources import config
from siltstone.sources.config import Config, binary, glob_pattern
from siltstone.sources.repo import RepoSource
from siltstone.streaming import watch


def tree(root, files):
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


def test_globs():
    import re

    yes = [("*_test.go", "_test.go"), ("a?c", "abc"), ("[^x]y", "ay"), ("[a-c]", "b"), (r"\*", "*"), ("a.b", "a.b")]
    no = [("*_test.go", "x.go"), ("[^x]y", "xy"), ("*", "a/b"), ("a.b", "axb")]
    assert all(re.fullmatch(glob_pattern(g), s) for g, s in yes)
    assert not any(re.fullmatch(glob_pattern(g), s) for g, s in no)
    assert glob_pattern("[abc") is None and glob_pattern("x\\") is None


def test_config_file(tmp_path):
    (tmp_path / "c.yaml").write_text("languages: {zig: ['.zig']}\nskip_dirs: [out]\n")
    c = config.load(tmp_path / "c.yaml")
    assert c.extensions() == {".zig": "zig"} and c.skip_files == ["*_test.go"]
    (tmp_path / "d.yaml").write_text("skip_file_patterns: []\n")
    assert config.load(tmp_path / "d.yaml").skip_files == []
    assert Config({"b": [".h"], "a": [".h"]}).extensions() == {".h": "a"}


def test_skips(spark):
    cases = {"a.go": None, "a_test.go": "pattern", "_private.py": None, "x/__init__.py": None, ".x/a.go": "folder", "vendor/a.go": "folder", "x/.a.go": "hidden", "README": "extension", "A.PY": None, None: "no path"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert [r[0] for r in df.select(Config().skipped(F.col("p"))).collect()] == list(cases.values())


def test_binary(spark):
    cases = [(b"", True), (b"text", False), (b"a\0b", True), (b"x" * 7999 + b"\0", True), (b"x" * 8000 + b"\0", False), (b"\x10\x0f", False)]
    df = spark.createDataFrame([(bytearray(b),) for b, _ in cases], "b binary")
    assert [r[0] for r in df.select(binary(F.col("b"))).collect()] == [w for _, w in cases]


def test_repo_scan_and_index(spark, tmp_path):
    root = str(tmp_path / "repo")
    tree(root, {"a.py": "def f():\n    pass\n", "_p.py": "x = 1\n", "pkg/__init__.py": "y = 2\n", "empty.py": "", "bin/x.py": "z\n", ".hid/x.py": "z\n", "b.bin.py": b"\0\1", "m.go": "package m\n\nfunc A() {\n}\n"})
    files = index.scan(spark, root, "repo")
    assert {r.file_path for r in files.collect()} == {"a.py", "_p.py", "pkg/__init__.py", "m.go"}
    store = Store(spark, str(tmp_path / "store"))
    assert store.names() == [] and store.read("c") is None
    assert index.run(spark, store, "c", files, dim=8)["new"] == 4
    assert store.names() == ["c"]
    first = {r.chunk_id: r.dense for r in store.read("c").collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in first.values())
    before = store.properties("c")
    assert index.run(spark, store, "c", index.scan(spark, root, "repo"), dim=8)["unchanged"] == 4
    assert store.properties("c") == before
    tree(root, {"a.py": "def g():\n    pass\n"})
    os.remove(os.path.join(root, "_p.py"))
    counts = index.run(spark, store, "c", index.scan(spark, root, "repo"), dim=8)
    assert (counts["changed"], counts["stale"], counts["unchanged"]) == (1, 1, 2)
    rows = store.read("c").collect()
    assert {r.file_path for r in rows} == {"a.py", "pkg/__init__.py", "m.go"} and {r.name for r in rows if r.file_path == "a.py"} == {"g"}
    assert store.terms("c").where("token = 'def'").count() == 1 and store.frequencies("c")[1].first().n == len(rows)
    with pytest.raises(ValueError, match="8 numbers"):
        store.publish("c", store.read("c"), 9, ["repo"])
    for path in ("a.py", "pkg/__init__.py", "m.go"):
        os.remove(os.path.join(root, path))
    emptied = index.run(spark, store, "c", index.scan(spark, root, "repo"), dim=8, repos=["repo"])
    assert emptied["stale"] == 3 and store.read("c") is None and store.names() == ["c"]
    assert store.delete("c") and store.names() == []


def chunk_rows(spark, rows):
    """(chunk_id, repo, language, text) as chunks with vectors of two numbers."""
    df = spark.createDataFrame(rows, "chunk_id string, repo string, language string, enriched_text string")
    return df.select("*", F.concat("chunk_id", F.lit(".x")).alias("file_path"), F.lit("h").alias("file_hash"), F.lit("v").alias("index_version"), F.current_timestamp().alias("indexed_at"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("dense"))


def test_store_rewrites_only_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish("c", chunk_rows(spark, [("1", "a", "go", "alpha"), ("2", "b", "go", "alpha beta"), ("3", None, "py", "gamma")]), 2, ["a", "b", None])
    first = store.properties("c")
    store.publish("c", chunk_rows(spark, [("4", "b", "py", "delta")]), 2, ["b"])
    now = store.properties("c")
    assert now["repos"]["a"] == now["repos"][""] == first["repos"]["a"] != now["repos"]["b"]
    assert {r.chunk_id for r in store.read("c").collect()} == {"1", "3", "4"}
    assert {r.chunk_id for r in store.read("c", (None,)).collect()} == {"3"} and {r.chunk_id for r in store.read("c", ("b", "a"), ("py",)).collect()} == {"4"}
    idfs, stats = store.frequencies("c")
    assert {r.token: r.df for r in idfs.collect()} == {"alpha": 1, "gamma": 1, "gamma": 1, "delta": 1} and (stats.first().n, stats.first().avgdl) == (3, 1.0)
    store.upsert("c", chunk_rows(spark, [("4", "b", "py", "epsilon"), ("5", "b", "go", "zeta")]), 2)
    assert {(r.chunk_id, r.enriched_text) for r in store.read("c", ("b",)).collect()} == {("4", "epsilon"), ("5", "zeta")}
    # Two pointers stay, and what they name; nothing else.
    assert len(store._pointers("c")) == 2 and len(os.listdir(tmp_path / "s" / "c" / "chunks")) == 3
    for bad in ([("6", "b", "go", "x"), ("6", "b", "go", "y")], [(None, "b", "go", "x")]):
        with pytest.raises(ValueError, match="nothing was published"):
            store.publish("c", chunk_rows(spark, bad), 2, ["b"])
    assert store.read("c", ("b",)).count() == 2


def test_store_slots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "old").mkdir(parents=True)
    (tmp_path / "s" / "old" / "CURRENT").write_text("{}")
    with pytest.raises(ValueError, match="earlier version"):
        store.ensure("old", 3)
    for slots, message in ((["dense"], "no sparse slot"), ([], "no dense slot"), (["dense", "sparse"], "4 numbers, not 3")):
        (tmp_path / "s" / "c").mkdir(exist_ok=True)
        store._point("c", {"schema": 2, "slots": slots, "dense_dim": 4, "repos": {}, "corpus": ""})
        with pytest.raises(ValueError, match=message):
            store.ensure("c", 3)
    store.ensure("c", 4)
    store.ensure("none", 4)


def test_a_writer_that_dies_leaves_what_was(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.publish("c", chunk_rows(spark, [("1", "a", "go", "alpha")]), 2, ["a"])
    monkeypatch.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.publish("c", chunk_rows(spark, [("2", "a", "go", "beta")]), 2, ["a"])
    assert [r.chunk_id for r in Store(spark, str(tmp_path / "s")).read("c").collect()] == ["1"]


def test_index_infers_the_dimension_and_checks_vectors_first(spark, tmp_path):
    root = str(tmp_path / "r")
    tree(root, {"a.py": "def f():\n    pass\n"})
    store = Store(spark, str(tmp_path / "s"))
    index.run(spark, store, "c", index.scan(spark, root, "r"), embed=lambda text: F.array(*[F.lit(0.5)] * 5).cast("array<float>"))
    assert store.properties("c")["dense_dim"] == 5
    tree(root, {"b.py": "y = 1\n"})
    for embed, problem in ((lambda text: F.lit(None).cast("array<float>"), "empty vector"), (lambda text: F.array(F.lit(1.0)).cast("array<float>"), "unexpected dimension")):
        with pytest.raises(ValueError, match=problem):
            index.run(spark, store, "c", index.scan(spark, root, "r"), embed=embed)
    assert {r.file_path for r in store.read("c").collect()} == {"a.py"}


def test_scratch_is_removed(spark):
    from siltstone.session import kept, materialize, scratch

    with scratch(spark):
        inside = materialize(spark.range(3))
        with scratch(spark):
            deeper = materialize(inside)
            assert deeper.count() == 3
        assert inside.count() == 3
        held = kept(spark, ("t",), lambda: spark.range(2))
    path = lambda df: df.inputFiles()[0].removeprefix("file://")
    assert not any(os.path.exists(path(df)) for df in (inside, deeper, held))
    assert kept(spark, ("t",), lambda: spark.range(2)).count() == 2  # made anew, and then kept
    assert kept(spark, ("t",), lambda: spark.range(9)).count() == 2


def test_root_with_a_skipped_name(spark, tmp_path):
    tree(str(tmp_path / "build"), {"a.py": "x\n"})
    assert index.scan(spark, str(tmp_path / "build"), "r").count() == 0


def test_debounce(spark):
    df = spark.createDataFrame([("r", 0.0), ("r", 0.3), ("r", 0.7), ("r", 1.21), ("s", 0.1), ("r", None)], "repo string, t double").withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long")))
    got = sorted((r.repo, r.events) for r in watch.debounce(df, "ts", ["repo"]).collect())
    assert got == [("r", 1), ("r", 3), ("s", 1)]


def test_relevant(spark):
    cases = {"a.go": True, "x/.a.go": False, "a_test.go": False, ".git/a.go": True, "notes": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert [r[0] for r in df.select(watch.relevant(F.col("p"))).collect()] == list(cases.values())


def test_follow(spark, tmp_path):
    root = str(tmp_path / "repo")
    tree(root, {"a.py": "x\n"})
    spark.dataSource.register(RepoSource)
    changes = spark.readStream.format("repo").option("mode", "changes").option("state", str(tmp_path / "listings")).load(root)
    runs = []

    def run():
        runs.append(1)
        if len(runs) == 1:
            raise OSError("logged, not fatal")

    q = watch.follow(changes, run, str(tmp_path / "checkpoint"), every="200 milliseconds", gap_ms=400)
    try:
        for step in range(2):
            end = time.time() + 40
            while len(runs) <= step and time.time() < end:
                time.sleep(0.2)
            tree(root, {f"n{step}.py": "y\n"})
        assert len(runs) >= 2 and q.isActive
        assert len(os.listdir(tmp_path / "listings")) <= 4 and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    finally:
        q.stop()


def test_bursts_settle_without_a_later_event(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = watch.settled(spark.readStream.schema("repo string").text(str(inbox)).toDF("repo"), ["repo"], 1500)
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(processingTime="100 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for name, lines in (("1", "a\nb\n"), ("2", "a\n")):
            (tmp_path / name).write_text(lines)
            os.rename(tmp_path / name, inbox / name)
        end = time.time() + 60
        while spark.table("bursts").count() < 2 and time.time() < end:
            time.sleep(0.3)
        assert sum(r.events for r in spark.table("bursts").collect()) == 3 and {r.repo for r in spark.table("bursts").collect()} == {"a", "b"}
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_deep_folders_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    from siltstone.sources import repo

    root = str(tmp_path / "deep")
    tree(root, {f"d{i}/e{j}/f.py": "x\n" for i in range(3) for j in range(3)} | {"top.py": "y\n"})
    monkeypatch.setattr(repo, "OPENED", 2)
    parts = repo.RepoReader(root, []).partitions()
    assert {f for p in parts for f in p.folders} == {"d1", "d2", "d0/e0", "d0/e1", "d0/e2"}
    assert sorted(r[0] for p in parts for r in repo.RepoReader(root, []).read(p)) == sorted([f"d{i}/e{j}/f.py" for i in range(3) for j in range(3)] + ["top.py"])

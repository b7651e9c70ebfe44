"""Collections of chunks under one folder: rows by generation, repository and language, published by numbered pointers.

A collection holds chunks with their dense vectors, the counts of their words (the sparse side), and the frequencies of
words over the whole collection. A generation is what one run wrote; a pointer says which generation is current for each repository. A
run writes the repositories it changed, and nothing of the others. Pointers are small files with growing numbers that
appear by a rename, and the newest is the one that counts: a reader sees either what was or what is, and a writer that dies leaves
what was. The pointer before the newest and its generations stay for readers who began earlier; older ones are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import changes, sparse

#: Version of the layout.
SCHEMA = 2
KEPT = 2
KEYS = ("chunk_id", "repo", "file_path", "language", "file_hash", "index_version", "indexed_at")


class Store:
    """Collections below `root`, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- Pointers. --

    def _names_in(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self._fs.exists(self._path(path)) else []

    def _pointers(self, name: str) -> list[str]:
        return [p for p in self._names_in(f"{self.root}/{name}") if p.startswith("pointer-") and p.endswith(".json")]

    def _pointer(self, name: str, file: str) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}/{file}", wholetext=True).collect()))

    def _point(self, name: str, properties: dict) -> None:
        """Publish by a rename to the next number; fails if another run took it."""
        there = self._pointers(name)
        number = int(there[-1][8:-5]) + 1 if there else 1
        new, to = self._path(f"{self.root}/{name}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}/pointer-{number:012d}.json")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(properties).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(new, to):
            raise OSError(f"another run published {name} meanwhile")
        for old in self._pointers(name)[:-KEPT]:
            self._fs.delete(self._path(f"{self.root}/{name}/{old}"), False)
        held = {g for p in self._pointers(name) for g in (lambda x: {*x["repos"].values(), x["corpus"]})(self._pointer(name, p))}
        for folder in ("chunks", "terms", "idf", "corpus"):
            for g in self._names_in(f"{self.root}/{name}/{folder}"):
                if g.startswith("generation=") and g[11:] not in held:
                    self._fs.delete(self._path(f"{self.root}/{name}/{folder}/{g}"), True)

    def names(self) -> list[str]:
        """Collections with a published state, by name."""
        return [n for n in self._names_in(self.root) if self._pointers(n)]

    def properties(self, name: str) -> dict | None:
        there = self._pointers(name)
        return self._pointer(name, there[-1]) if there else None

    def ensure(self, name: str, dim: int | None) -> None:
        """Check an existing collection: its layout, its dense and sparse slots, and its dimension. A missing one is made by the first write."""
        there = self.properties(name)
        advice = f"delete collection {name} and index again"
        if there is None:
            if self._fs.exists(self._path(f"{self.root}/{name}/CURRENT")):
                raise ValueError(f"collection {name} has the layout of an earlier version; {advice}")
            return
        if there.get("schema") != SCHEMA:
            raise ValueError(f"collection {name} has layout {there.get('schema')}, not {SCHEMA}; {advice}")
        for slot in ("dense", "sparse"):
            if slot not in there.get("slots", []):
                raise ValueError(f"collection {name} has no {slot} slot; {advice}")
        if dim is not None and there["dense_dim"] != dim:
            raise ValueError(f"collection {name} holds vectors of {there['dense_dim']} numbers, not {dim}; {advice}, or choose another collection")

    # -- Reading. --

    def _current(self, name: str, folder: str, repos: tuple[str | None, ...] | None, languages: tuple[str, ...] | None) -> DataFrame | None:
        """Rows of the current generations; the filters are on folders only, so that others are never listed as input."""
        there = self.properties(name)
        if there is None or not there["repos"]:
            return None
        rows = self._rows(name, folder, there)
        if repos:
            rows = rows.where(_among([r or "" for r in repos]))
        if languages:
            rows = rows.where(F.col("language").isin(*languages))
        return rows.drop("generation")

    def read(self, name: str, repos: tuple[str | None, ...] | None = None, languages: tuple[str, ...] | None = None) -> DataFrame | None:
        """Chunks, of some repositories and languages only if given; None if there is no collection, or nothing in it."""
        return self._current(name, "chunks", repos, languages)

    def terms(self, name: str, repos: tuple[str | None, ...] | None = None, languages: tuple[str, ...] | None = None) -> DataFrame | None:
        """(id, token, length, tf, repo, language): how often each word and stem is in each chunk."""
        return self._current(name, "terms", repos, languages)

    def frequencies(self, name: str) -> tuple[DataFrame, DataFrame] | None:
        """(token, df, idf) and (n, avgdl) over the whole collection."""
        there = self.properties(name)
        if there is None:
            return None
        return tuple(self.spark.read.parquet(f"{self.root}/{name}/{part}/generation={there['corpus']}") for part in ("idf", "corpus"))

    # -- Writing. --

    def publish(self, name: str, rows: DataFrame, dim: int, repos: list[str | None], stems: bool = True) -> None:
        """Make rows the current state of the given repositories; repositories without rows leave the collection.

        rows holds the columns of KEYS, enriched_text and dense. All that can be wrong with them is found before anything is
        published: null or repeated ids, vectors of another dimension. Words are counted once here; a search only reads.
        """
        self.ensure(name, dim)
        there = self.properties(name) or {"repos": {}, "schemas": {}}
        generation = uuid.uuid4().hex
        by = ("repo", "language")
        to = {part: f"{self.root}/{name}/{part}/generation={generation}" for part in ("chunks", "terms", "idf", "corpus")}
        rows.repartition("repo", "language", F.pmod(F.xxhash64("file_path"), F.lit(64))).sortWithinPartitions("repo", "language", "file_path").write.partitionBy(*by).parquet(to["chunks"])
        held = self.spark.read.schema(rows.schema).parquet(to["chunks"])
        checked = held.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_if(F.coalesce(F.size("dense"), F.lit(-1)) != dim).alias("wrong"), F.collect_set(F.coalesce("repo", F.lit(""))).alias("repos")).first()
        if checked["wrong"] or checked["n"] != checked["ids"]:
            for path in to.values():
                self._fs.delete(self._path(path), True)
            raise ValueError(f"{checked['wrong']} vectors do not have {dim} numbers, {checked['n'] - checked['ids']} chunks have no id or one that repeats; nothing was published")
        words = sparse.tokenized(held, "chunk_id", F.col("enriched_text"), by)
        counts = sparse.term_counts(words, stems).select("id", "token", "length", "tf", *by)
        counts.repartition("repo", "language", F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("repo", "language", "token").write.partitionBy(*by).parquet(to["terms"])
        current = {r: g for r, g in there["repos"].items() if r not in [x or "" for x in repos]} | dict.fromkeys(checked["repos"], generation)
        properties = {"schema": SCHEMA, "dense_dim": dim, "distance": "cosine", "slots": ["dense", "sparse"], "stems": stems, "repos": current, "corpus": generation}
        properties["schemas"] = {"chunks": _ddl(rows), "terms": _ddl(counts)}
        self._weigh(name, properties, to)
        self._point(name, properties)

    def _weigh(self, name: str, properties: dict, to: dict[str, str]) -> None:
        """Frequencies over all current chunks, from the stored counts of their words."""
        chunks, terms = (self._rows(name, part, properties) for part in ("chunks", "terms"))
        n = chunks.agg(F.count("*").alias("n"))
        # Rows of a word and of its stem hold the length alike.
        total = terms.groupBy("id").agg(F.first("length").alias("length")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
        n.join(F.broadcast(total)).select("n", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("avgdl")).coalesce(1).write.parquet(to["corpus"])  # one row each
        stats = self.spark.read.parquet(to["corpus"])
        sparse.idf(terms, stats).sort("token").write.parquet(to["idf"])

    def _rows(self, name: str, part: str, properties: dict) -> DataFrame:
        """Rows of the generation that the properties name for each repository."""
        by: dict[str, list[str]] = {}
        for repo, generation in properties["repos"].items():
            by.setdefault(generation, []).append(repo)
        current: Column = F.lit(False)
        for generation, own in by.items():
            current = current | ((F.col("generation") == generation) & _among(own))
        return self.spark.read.schema(properties["schemas"][part]).parquet(f"{self.root}/{name}/{part}").where(current)

    def upsert(self, name: str, arriving: DataFrame, dim: int) -> None:
        """Insert or replace chunks by id, within the repositories that arrive; ids must be unique."""
        repos = [r[0] for r in arriving.select("repo").distinct().collect()]  # one row per repository
        stored = self.read(name, tuple(repos)) if repos else None
        self.publish(name, arriving if stored is None else changes.upsert(stored, arriving, "chunk_id"), dim, repos)

    def file_states(self, name: str) -> DataFrame | None:
        stored = self.read(name)
        return None if stored is None else changes.latest_states(stored, stored["indexed_at"])

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(f"{self.root}/{name}"), True)


def _among(repos: list[str]) -> Column:
    """Whether a row's repository is one of these; an empty name stands for null."""
    named = F.col("repo").isin([r for r in repos if r])
    return named | F.col("repo").isNull() if "" in repos else named


def _ddl(rows: DataFrame) -> str:
    """The rows' schema with the folders' columns at the end, all as text that Spark reads."""
    return ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c not in ("repo", "language")) + ", generation string, repo string, language string"

"""The life of an index: scan, classify, chunk, embed, publish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import changes, chunking, dense
from siltstone.operators.store import Store
from siltstone.session import materialize, scratch
from siltstone.sources.config import Config, binary
from siltstone.sources.repo import RepoSource

#: Numbers of a stand-in vector in a collection that has none yet.
DIMENSION = 384


def scan(spark: SparkSession, root: str, repo: str, config: Config = Config(), languages: list[str] | None = None) -> DataFrame:
    """(repo, file_path, language, content, file_hash) of the source files below a folder."""
    spark.dataSource.register(RepoSource)
    files = spark.read.format("repo").option("skip_dirs", ",".join(config.skip_dirs)).load(root)
    files = files.where(config.skipped(F.col("file_path")).isNull() & ~binary(F.col("content")))
    files = files.select(F.lit(repo).alias("repo"), "file_path", config.language(F.col("file_path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("file_hash"))
    return files.where(F.col("language").isin(languages)) if languages else files


def fake_vectors(text: Column, dim: int) -> Column:
    """A unit vector that depends on the text alone; for tests and runs without a model."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.xxhash64(text, i) / F.lit(float(1 << 63)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: (x / norm).cast("float"))


def run(
    spark: SparkSession,
    store: Store,
    name: str,
    files: DataFrame,
    dim: int | None = None,
    embed: Callable[[Column], Column] | None = None,
    languages: list[str] | None = None,
    repos: list[str] | None = None,
    size: int = chunking.WINDOW,
    overlap: int = chunking.OVERLAP,
) -> dict[str, int]:
    """Bring a collection up to date with files; gives the number of files of each class.

    repos: the repositories that files are all of, also those of which no file is left; if not given, those of the files. languages: the
    languages that were scanned; chunks of others stay. dim: the vectors' dimension; if not given, that of the collection, or of
    the first vector. Nothing is written if nothing changed. A change rewrites its repositories and leaves the others alone; vectors of
    chunks whose text stayed the same are taken over. Removed files go and changed ones come at once, when the whole is published.
    """
    with scratch(spark):
        return _run(spark, store, name, materialize(files, "files"), dim, embed, languages, repos, size, overlap)


def _run(
    spark: SparkSession,
    store: Store,
    name: str,
    files: DataFrame,
    dim: int | None,
    embed: Callable[[Column], Column] | None,
    languages: list[str] | None,
    repos: list[str] | None,
    size: int,
    overlap: int,
) -> dict[str, int]:
    repos = [r[0] for r in files.select("repo").distinct().collect()] if repos is None else repos  # one row per repository
    store.ensure(name, dim)
    stored = store.read(name, tuple(repos)) if repos else None
    states = stored.where(F.col("language").isin(languages)) if stored is not None and languages else stored
    if states is None:
        known = files.select("repo", "file_path", "file_hash", F.lit("").alias("index_version")).limit(0)
    else:
        known = changes.latest_states(states, F.col("indexed_at"))
    kinds = materialize(changes.classify(files, known), "classes")
    counts = dict.fromkeys(changes.CLASSES, 0) | {r["class"]: r["count"] for r in kinds.groupBy("class").count().collect()}
    if not any(counts[c] for c in ("changed", "new", "refresh", "stale")):
        return counts
    cut = chunking.chunks(files, size, overlap).withColumn("indexed_at", F.current_timestamp()).withColumn("index_version", F.lit(changes.INDEX_VERSION))
    cut = cut.withColumn("enriched_text", X.enriched(F.col("file_path"), F.col("language"), F.col("chunk_type"), F.col("name"), F.col("content")))
    cut = materialize(changes.last_by_id(cut, "chunk_id", "start_line"), "chunks")
    if not files.isEmpty() and cut.isEmpty():
        raise ValueError("no chunk came out of the files")
    properties = store.properties(name)
    vector = embed(F.col("enriched_text")) if embed else fake_vectors(F.col("enriched_text"), dim or (properties or {}).get("dense_dim") or DIMENSION)
    if stored is not None:
        before = stored.select(F.sha2("enriched_text", 256).alias("_text"), F.col("dense").alias("_dense")).dropDuplicates(["_text"])
        cut = cut.withColumn("_text", F.sha2("enriched_text", 256)).join(before, "_text", "left")
        cut = materialize(cut.withColumn("dense", F.coalesce("_dense", vector)).drop("_text", "_dense"), "vectors")
    else:
        cut = materialize(cut.withColumn("dense", vector), "vectors")
    if dim is None:
        first = cut.select(F.size("dense").alias("n")).where("n > 0").first()
        dim = (properties or {}).get("dense_dim") or (first["n"] if first else DIMENSION)
    wrong = cut.select(dense.validate(F.array("dense"), dim).alias("problem")).where("problem IS NOT NULL").first()
    if wrong:
        raise ValueError(f"{wrong['problem']} among the vectors of the chunks, which need {dim} numbers; nothing was written")
    if stored is not None and languages:
        cut = cut.unionByName(stored.where(~F.col("language").isin(languages)).select(*cut.columns))
    store.publish(name, cut, dim, repos)
    return counts

"""Incremental indexing: state per file, classes of change, and the rewrite of a chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version of the representation; chunks of another version are written anew.
INDEX_VERSION = "sparse-bm25-snowball-v1"
CLASSES = ("unchanged", "changed", "new", "refresh", "stale")


def latest_states(states: DataFrame, by: Column) -> DataFrame:
    """(repo, file_path, file_hash, index_version): the last row of each file by `by`, ties to the larger hash and version.

    Rows without a path are left out; null repos count as one repository.
    """
    rows = states.where("file_path IS NOT NULL AND file_path <> ''").withColumn("_order", F.struct(F.coalesce(by.cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("t"), F.coalesce("file_hash", F.lit("")).alias("h"), F.coalesce("index_version", F.lit("")).alias("v")))
    best = rows.groupBy("repo", "file_path").agg(F.max("_order").alias("o"))
    return best.select("repo", "file_path", F.col("o.h").alias("file_hash"), F.col("o.v").alias("index_version"))


def classify(disk: DataFrame, states: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """(repo, file_path, file_hash, class) from disk(repo, file_path, file_hash) and one state per file: a full outer join.

    new: no state; stale: no file; changed: another hash; refresh: another version of the same hash; else unchanged.
    Null repos match each other; null hashes differ from every hash.
    """
    d, s = disk.select("repo", "file_path", "file_hash").alias("d"), states.alias("s")
    joined = d.join(s, F.expr("d.repo <=> s.repo AND d.file_path = s.file_path"), "full_outer")
    kind = (
        F.when(F.col("s.file_path").isNull(), "new")
        .when(F.col("d.file_path").isNull(), "stale")
        .when(F.coalesce(F.col("d.file_hash") != F.col("s.file_hash"), F.lit(True)), "changed")
        .when(F.coalesce(F.col("s.index_version") != F.lit(version), F.lit(True)), "refresh")
        .otherwise("unchanged")
    )
    return joined.select(F.coalesce("d.repo", "s.repo").alias("repo"), F.coalesce("d.file_path", "s.file_path").alias("file_path"), F.coalesce("d.file_hash", "s.file_hash").alias("file_hash"), kind.alias("class"))


def last_by_id(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """One row of each id: that with the largest `order`; rows with null ids are left out. Combined before the shuffle."""
    best = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r"))
    return best.select("r.*")


def upsert(stored: DataFrame, arriving: DataFrame, id_col: str) -> DataFrame:
    """stored with rows of the same id replaced and the others added; arriving ids must be unique."""
    return stored.join(arriving.select(id_col), id_col, "left_anti").select(*stored.columns).unionByName(arriving.select(*stored.columns))


def delete_paths(stored: DataFrame, paths: DataFrame) -> DataFrame:
    """stored without the chunks of the given (repo, file_path)."""
    return stored.join(paths.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti").select(*stored.columns)


def delete_orphans(stored: DataFrame, current: DataFrame) -> DataFrame:
    """stored without chunks of a current (repo, file_path) whose hash is another than the file's."""
    hashes = current.select("repo", "file_path", F.col("file_hash").alias("_now")).distinct()
    return stored.join(hashes, ["repo", "file_path"], "left").where("_now IS NULL OR file_hash <=> _now").select(*stored.columns)

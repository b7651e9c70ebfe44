"""Near-duplicate records: hash minima with banding, signature verification, exact check, components.

Only distinct feature sets are compared: rows with the same content (or the same features) share
one representative, so a group of copies costs one record however large it is. Pairs of
representatives that agree in a band are candidates; the bits of their minima estimate their
similarity, and those near or above the threshold are checked exactly. Components come from alternating
large-star and small-star over the verified links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

#: Fixed rule for drawing the hash functions.
SEED = 20_240_817
#: Members of one bucket that meet within one task; larger buckets meet block by block.
BLOCK = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(33)


class Shingler:
    """Sorted distinct 64-bit hashes of runs of `size` consecutive words; lives in a Python worker."""

    def __init__(self, size: int, word: str) -> None:
        self.size, self.words = size, re.compile(word)
        self.factors = [np.uint64(2 * k + 0x9E3779B97F4A7C15) for k in range(size)]
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found, size, known = self.words.findall(text), self.size, self.known
        if len(found) < size:
            return np.zeros(0, np.uint64)
        if len(known) > 1_000_000:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        at = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        mix = at[: len(at) - size + 1] * self.factors[0]
        for k in range(1, size):
            mix = _mixed(mix) + at[k : len(at) - size + 1 + k] * self.factors[k]
        return np.unique(_mixed(mix))


@dataclass(frozen=True)
class Likeness:
    """size: words of a feature. least: features a text needs. threshold: Jaccard similarity of a link.

    rows: minima of a band. miss: chance at most that a pair right at the threshold shares no band.
    """

    size: int = 5
    least: int = 1
    threshold: float = 0.8
    rows: int = 3
    miss: float = 1e-3
    word: str = r"[A-Za-z0-9_]+"

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - self.threshold**self.rows))


def _factors(count: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return (rng.integers(1, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[:, None]


def _minima(features: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function (multiply and shift) over the features."""
    return ((factors * features[None, :]) >> np.uint64(32)).min(axis=1)


def _bits(minima: np.ndarray) -> np.ndarray:
    """The lowest bit of each minimum; 64 of them in a number, the last filled up with zeros."""
    packed = np.packbits((minima & np.uint64(1)).astype(bool))
    return np.pad(packed, (0, -len(packed) % 8)).view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, how: Likeness) -> DataFrame:
    """(id, digest, bands, bits): a 128-bit digest of each text's features, a hash of each band of its minima, and
    one bit of each minimum, 64 in a number.

    Rows with null ids, null texts or too few features are left out. Each text is read once, whole.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, factors = Shingler(how.size, how.word), _factors(how.bands * how.rows)
        turn = np.arange(how.bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for batch in batches:
            ids, digests, bands, bits = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = shingle(text)
                if len(x) < max(1, how.least):
                    continue
                minima = _minima(x, factors)
                bits.append(_bits(minima))
                minima = minima.reshape(how.bands, how.rows)
                mix = turn.copy()
                for k in range(how.rows):
                    mix = _mixed(mix + minima[:, k] * np.uint64(0x9E3779B97F4A7C15))
                ids.append(key)
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                bands.append(mix.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(digests, pa.binary()), _lists(bands, np.int64), _lists(bits, np.int64)], ["id", "digest", "bands", "bits"])

    return rows.mapInArrow(run, f"id {kind}, digest binary, bands array<bigint>, bits array<bigint>")


def features(df: DataFrame, id_col: str, text_col: str, how: Likeness) -> DataFrame:
    """(id, features array<bigint>) of each text that is not null."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(how.size, how.word)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle(t).view(np.int64) for t in batch.column(1).to_pylist()], np.int64)], ["id", "features"])

    return rows.mapInArrow(run, f"id {kind}, features array<bigint>")


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)], dtype=np.int32), np.concatenate(arrays) if arrays else np.zeros(0, kind))


def representatives(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every row of `sketches`, and (rep, bands, bits) of each distinct feature set; rep is the smallest id."""
    held = materialize(sketched, "sketches")
    first = held.groupBy("digest").agg(F.min("id").alias("rep"))
    members = materialize(held.select("id", "digest").join(first, "digest").select("id", "rep"), "members")
    return members, held.join(members.where("id = rep").select("id"), "id", "left_semi").select(F.col("id").alias("rep"), "bands", "bits")


def candidates(reps: DataFrame, how: Likeness, block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b of all representatives that share a band, and whose bits agree as often as those of a link do.

    A bit of a minimum agrees with chance (1 + s) / 2 at similarity s; pairs four standard deviations below
    that of the threshold are left out. Every pair of a bucket is given, also in buckets of any size: a bucket is cut into blocks of
    `block` members, and each pair of blocks is its own group of work.
    """
    keys = reps.select(F.explode("bands").alias("bucket"), "rep")
    # A bucket of one member has no pair; counts are combined before the shuffle.
    sizes = keys.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    there = keys.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    there = materialize(there.join(reps.select("rep", "bits"), "rep"), "buckets")
    count, chance = how.bands * how.rows, (1 + how.threshold) / 2
    differ = F.aggregate(F.zip_with("bits", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    left = there.select("bucket", "rep", "bits", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    right = there.select("bucket", F.col("rep").alias("rep_b"), F.col("bits").alias("bits_b"), F.col("block").alias("block_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_b"))
    met = left.alias("l").join(right.alias("r"), F.expr("l.bucket = r.bucket AND l.block = r.other_b AND l.other = r.block_b AND l.rep < r.rep_b"))
    met = met.where(differ <= count * (1 - chance) + 4 * math.sqrt(count * chance * (1 - chance)))
    return met.select(F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct()


def similar_pairs(reps: DataFrame, df: DataFrame, id_col: str, text_col: str, how: Likeness) -> DataFrame:
    """(a, b, similarity) with a < b of all representatives whose Jaccard similarity reaches the threshold.

    Only texts of candidates are read again, and each pair is checked exactly.
    """
    pairs = materialize(candidates(reps, how), "candidates")
    asked = pairs.select(F.col("a").alias(id_col)).unionByName(pairs.select(F.col("b").alias(id_col))).distinct()
    sets = materialize(features(df.select(id_col, text_col).join(asked, id_col, "left_semi"), id_col, text_col, how).dropDuplicates(["id"]), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("features").alias("features_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("features").alias("features_b")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("features_a", "features_b")))
    both = both.select("a", "b", (F.col("shared") / (F.size("features_a") + F.size("features_b") - F.col("shared"))).alias("similarity"))
    return both.where(F.col("similarity") >= how.threshold)


#: Links of a node above which its least neighbour is broadcast: at most one row in this many links is.
HUB = 100_000


def _to_least(links: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """links with m, the least neighbour of their `key`, from least(key, m, links). Those of hubs don't gather in one task."""
    hubs = least.where(F.col("links") > HUB).select(key, F.col("m").alias("hub"))
    marked = links.join(F.broadcast(hubs), key, "left")
    others = marked.where("hub IS NULL").drop("hub").join(least.where(F.col("links") <= HUB).select(key, "m"), key)
    return marked.where("hub IS NOT NULL").withColumnRenamed("hub", "m").unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, by alternating large-star and small-star.

    edges(a, b); a component is named after its smallest node. Each step is grouped per node with
    combined minima only, so no neighbourhood is ever gathered in one task; steps are written to
    the shared folder. Goes on until a round changes nothing.
    """
    now = materialize(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "star")
    before = None
    while True:
        # Large-star: every larger neighbour is linked with the smallest of the node's own neighbourhood.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("links"))
        large = _to_least(both.where("v > u"), least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Small-star: every smaller neighbour and the node itself are linked with the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("links"))
        small = _to_least(large, least, "v").select(F.col("m").alias("x"), F.col("u").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("v").alias("y"))).where("x <> y")
        now = materialize(small.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "star")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()


def groups(df: DataFrame, id_col: str, text_col: str, how: Likeness) -> DataFrame:
    """(id, rep, group): one row for each row with enough features; ids must be unique.

    group is the smallest id that is reached over links of at least the threshold. Rows with null ids, null
    texts or too few features have no row; a row without partners is its own group.
    """
    members, reps = representatives(sketches(df, id_col, text_col, how))
    linked = components(similar_pairs(reps, df, id_col, text_col, how))
    return members.join(linked, members["rep"] == linked["node"], "left").select(F.col("id").alias(id_col), "rep", F.coalesce("component", "rep").alias("group"))


#: Rows of one representative that meet those of another, or each other, in one task.
ROWS = 1000


def row_pairs(members: DataFrame, links: DataFrame, rows: int = ROWS) -> DataFrame:
    """(a, b) with a < b: all pairs of rows whose representatives are the same or linked.

    The number of pairs of rows is what it is; rows of one representative are cut into blocks, and any two blocks
    that must meet do so by themselves, however many rows are copies of each other.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"), F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    held = members.join(sizes, "rep").select("rep", "id", "n", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    x = held.where("n > 1").select("rep", F.col("id").alias("a"), F.col("block").alias("one"), every("blocks").alias("two"))
    y = held.where("n > 1").select("rep", F.col("id").alias("b"), every("blocks").alias("one"), F.col("block").alias("two"))
    same = x.join(y, ["rep", "one", "two"]).where("a < b").select("a", "b")
    cut = sizes.select("rep", "blocks")
    met = links.select("a", "b").join(cut.toDF("a", "na"), "a").join(cut.toDF("b", "nb"), "b").select("a", "b", "nb", every("na").alias("one")).select("a", "b", "one", every("nb").alias("two"))
    first = met.join(held.select(F.col("rep").alias("a"), F.col("block").alias("one"), F.col("id").alias("p")), ["a", "one"]).select("p", "b", "two")
    across = first.join(held.select(F.col("rep").alias("b"), F.col("block").alias("two"), F.col("id").alias("q")), ["b", "two"])
    return same.unionByName(across.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))

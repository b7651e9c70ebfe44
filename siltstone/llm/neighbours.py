"""Most similar vectors for every vector, by collision counting over single projections.

Each vector is projected onto lines. Along every line the vectors stand in sorted order, and a window around
the query's own place is opened; only the members of a window are walked, each adding one to its count. A vector that
lies in the windows of enough lines (the collision threshold) is verified by its exact cosine. Queries whose windows gave
too few neighbours have them widened (virtual rehashing: the same arrays, of which only the newly opened ends are walked).

So that arrays stay short, vectors meet in cells around pivots that are drawn from the data. A vector is at home in the
cells of its few nearest pivots and meets whoever shares one of them, so within a cell collisions count for both sides
at once. Pivots grow with the data and are found in two steps, nearest heads first. Equal vectors are searched once.

Where the k nearest are wanted however far they are, vectors that windows and near cells left with fewer
than k meet every vector, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize


@dataclass(frozen=True)
class Search:
    """k: neighbours of each vector. least: similarity below which a neighbour doesn't count.

    pivots: most pivots (their sample is the only part of the data that the driver and every task
    hold: pivots * dim * 4 bytes, 25 MB for 96 numbers). cell: vectors for each pivot, as far as pivots go round.
    homes: cells that a vector is in. heads: heads whose pivots it looks at; under: heads that list a pivot.
    lines, collisions: lines, and how many must agree. radii: distances of unit vectors, in the order in which windows are opened;
    the half width for a distance r is r / sqrt(dim), the standard deviation of the projected difference of vectors r apart.
    block: cells of more than twice as many vectors are cut into blocks, any two of which meet.
    asked: vectors of each side that meet in one task where every vector is met.
    whole: go on, for vectors with fewer than k neighbours of at least `least`, until they have k of any similarity.
    """

    k: int = 10
    least: float = 0.8
    pivots: int = 65_536
    cell: int = 200
    homes: int = 4
    heads: int = 8
    under: int = 3
    lines: int = 16
    collisions: int = 7
    radii: tuple[float, ...] = (0.45, 0.64)
    block: int = 1024
    asked: int = 16_384
    whole: bool = False
    seed: int = 7


def usable(vector: Column, dim: int) -> Column:
    """Exactly dim numbers, none of them null or NaN, not all zero."""
    return (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float32).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _lines(m: np.ndarray, s: Search) -> np.ndarray:
    """Random mixtures of the vectors' differences from their mean, so that lines lie where the vectors spread; of length 1."""
    lines = (m - m.mean(axis=0)).T @ np.random.default_rng(s.seed).normal(size=(len(m), s.lines))
    size = np.linalg.norm(lines, axis=0)
    return lines / np.where(size > 0, size, 1.0)


def _walk(order: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """owner * n + member for every member of the slice begin:end of a sorted array that each owner has opened."""
    sizes = np.maximum(end - begin, 0)
    at = np.repeat((begin - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    keys = np.repeat(owner * np.int32(n), sizes)
    keys += order[at]
    return keys


def _verified(m: np.ndarray, single: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of at least `least`, and their similarity; single precision first leaves out what lies clearly below."""
    kept = [np.zeros(0, bool)]
    for i in range(0, len(a), 100_000):
        kept.append(np.einsum("ij,ij->i", single[a[i : i + 100_000]], single[b[i : i + 100_000]]) >= least - 1e-5)
    keep = np.concatenate(kept)
    a, b = a[keep], b[keep]
    sims = np.round(np.einsum("ij,ij->i", m[a], m[b]), 6)
    good = sims >= least
    return a[good], b[good], sims[good]


def _best(q: np.ndarray, o: np.ndarray, sims: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `size` most similar of each query, ties to the smaller id."""
    at = np.lexsort((ids[o], -sims, q))
    q, o, sims = q[at], o[at], sims[at]
    counts = np.bincount(q, minlength=1)
    top = np.arange(len(q)) - (np.cumsum(counts) - counts)[q] < size
    return q[top], o[top], sims[top]


def nearest_in_cell(m: np.ndarray, ids: np.ndarray, s: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, similarity to 6 decimals): up to k + 1 for each vector of a cell, itself left out.

    Rows of m are unit vectors, in an order that depends on nothing but their ids. A query is done once more than k
    neighbours lie so near that its windows show all such, or the windows are at their widest.
    """
    n, dim = m.shape
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    single = m.astype(np.float32)
    placed = np.ascontiguousarray((single @ _lines(m, s).astype(np.float32)).T)
    orders = np.argsort(placed, axis=1, kind="stable").astype(np.int32)
    sorted_ = np.take_along_axis(placed, orders, axis=1)
    place = np.empty_like(orders)
    np.put_along_axis(place, orders, np.arange(n, dtype=np.int32)[None, :], axis=1)
    width = s.radii[0] / dim**0.5
    # Two vectors are in each other's windows or not at all: only the upper half of a window is walked, for both.
    high = np.stack([np.searchsorted(x, x + width, "right") for x in sorted_])
    keys = np.concatenate([_walk(order, order, np.arange(1, n + 1), end, n) for order, end in zip(orders, high)])
    counts = np.bincount(keys, minlength=n * n).astype(np.uint8).reshape(n, n)
    counts += counts.T.copy()
    a, b = np.divmod(np.flatnonzero(counts >= s.collisions), n)
    a, b, sims = _verified(m, single, a[a < b], b[a < b], s.least)
    q, o, sims = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sims, sims])
    low = np.stack([np.searchsorted(x, x - width, "left") for x in sorted_])
    for i, radius in enumerate(s.radii):
        enough = np.bincount(q[2 - 2 * sims <= radius * radius], minlength=n) > s.k
        rest = np.flatnonzero(~enough)
        if i + 1 == len(s.radii) or not len(rest):
            break
        width = s.radii[i + 1] / dim**0.5
        ends = []
        turn = np.arange(len(rest), dtype=np.int32)
        for j, (order, x) in enumerate(zip(orders, sorted_)):
            at = place[j, rest]
            lo, hi = np.searchsorted(x, x[at] - width, "left"), np.searchsorted(x, x[at] + width, "right")
            ends += [_walk(order, turn, lo, low[j, at], n), _walk(order, turn, high[j, at], hi, n)]
            low[j, at], high[j, at] = lo, hi
        before = counts[rest]
        counts[rest] = before + np.bincount(np.concatenate(ends), minlength=len(rest) * n).astype(np.uint8).reshape(len(rest), n)
        a, b = np.divmod(np.flatnonzero((counts[rest] >= s.collisions) & (before < s.collisions)), n)
        a = rest[a]
        a, b, more = _verified(m, single, a[a != b], b[a != b], s.least)
        q, o, sims = np.concatenate([q, a]), np.concatenate([o, b]), np.concatenate([sims, more])
    q, o, sims = _best(q, o, sims, ids, s.k + 1)
    return ids[q], ids[o], sims


def nearest_of_all(own: np.ndarray, own_ids: np.ndarray, asking: np.ndarray, asking_ids: np.ndarray, s: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for asking vectors among all indexed ones, of any similarity: every indexed vector is looked at.

    Single precision chooses, with room for its error; what is chosen is verified in double precision.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 22) // max(1, len(own)))
    own32, asking32 = own.astype(np.float32), asking.astype(np.float32)
    for a in range(0, len(asking) if len(own) else 0, step):
        ids = asking_ids[a : a + step]
        sims = asking32[a : a + step] @ own32.T
        # One more than wanted, for the query itself; whatever rounds to the last one's similarity stays in.
        at = len(own) - s.k - 2
        least = np.partition(sims, at, axis=1)[:, at] - 1e-5 if at > 0 else np.full(len(ids), -2.0, np.float32)
        q, o = np.nonzero(sims >= least[:, None])
        other = own_ids[o] != ids[q]
        q, o = q[other], o[other]
        near = np.round(np.einsum("ij,ij->i", asking[a + q], own[o]), 6)
        q, o, near = _best(q, o, near, own_ids, s.k + 1)
        found.append((ids[q], own_ids[o], near))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Pivots:
    """The pivots, the first of which are heads, too: about the square root of their number."""

    def __init__(self, pivots: np.ndarray, s: Search) -> None:
        self.all, self.s = pivots.astype(np.float32), s
        self.head = self.all[: max(1, round(len(pivots) ** 0.5))]
        under = min(s.under, len(self.head))
        listed = np.argpartition(-(self.all @ self.head.T), under - 1, axis=1)[:, :under] if len(pivots) else np.zeros((0, 1), int)
        self.lists = [np.flatnonzero((listed == g).any(axis=1)) for g in range(len(self.head))]

    def homes(self, m: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first; -1 where there are fewer."""
        s, m = self.s, m.astype(np.float32)
        heads = min(s.heads, len(self.head))
        near = np.argpartition(-(m @ self.head.T), heads - 1, axis=1)[:, :heads]
        best = np.full((len(m), heads * s.homes), -9.0, np.float32)
        which = np.full(best.shape, -1, np.int64)
        for g, listed in enumerate(self.lists):
            rows, slot = np.nonzero(near == g)
            if not len(rows) or not len(listed):
                continue
            sims = m[rows] @ self.all[listed].T
            size = min(s.homes, len(listed))
            top = np.argpartition(-sims, size - 1, axis=1)[:, :size]
            to = slot[:, None] * s.homes + np.arange(size)
            best[rows[:, None], to] = np.take_along_axis(sims, top, axis=1)
            which[rows[:, None], to] = listed[top]
        # A pivot may be listed under several heads; a pivot that comes again is left out.
        at = np.argsort(which, axis=1, kind="stable")
        best, which = np.take_along_axis(best, at, axis=1), np.take_along_axis(which, at, axis=1)
        again = np.zeros(which.shape, bool)
        again[:, 1:] = which[:, 1:] == which[:, :-1]
        best[again], which[again] = -9.0, -1
        at = np.argsort(-best, axis=1, kind="stable")[:, : s.homes]
        return np.take_along_axis(which, at, axis=1)


def _pivots(reps: DataFrame, n: int, dim: int, s: Search) -> np.ndarray:
    """Unit vectors drawn by the hash of their ids, about one in `cell`; each partition sends its share only."""
    wanted = max(1, min(s.pivots, n // s.cell))
    # A share of the range of the hash: a fifth more than wanted, for chance, and then the first ones.
    share = min(1.0, 1.2 * wanted / max(1, n) + 50 / max(1, n))
    drawn = F.xxhash64("rep", F.lit(s.seed))
    some = reps.select("rep", "vector", drawn.alias("h")).where(F.col("h") <= F.lit(min(2**63 - 1, int(-(2**63) + share * (2**64 - 1)))) if share < 1 else F.lit(True)).toArrow()
    order = np.lexsort((some["rep"].to_numpy(), some["h"].to_numpy()))[:wanted]
    return _unit(_matrix(some["vector"], dim)[order]) if len(order) else np.zeros((0, dim))


def neighbours(vectors: DataFrame, dim: int, search: Search = Search()) -> DataFrame:
    """(id, rank, neighbour, similarity) from vectors (id bigint, vector array<double>), ranks from 1.

    Similarity is the cosine rounded to 6 decimals; ties go to the smaller neighbour. Unusable
    vectors and null ids are left out; an id counts once. Vectors are held as 32-bit floats.
    A neighbour below `least` doesn't count, so a row may have fewer than k, or none; with `whole`, it
    has fewer than k only if there are no more vectors.
    """
    spark = vectors.sparkSession
    s = search
    rows = vectors.where(F.col("id").isNotNull() & usable(F.col("vector"), dim)).select("id", F.col("vector").cast("array<float>").alias("vector"))
    rows = materialize(rows.dropDuplicates(["id"]).withColumn("digest", F.md5(F.array_join(F.col("vector").cast("array<string>"), ","))), "vectors")
    # Copies of a vector: one of them is searched; ten others at most can be among anyone's ten.
    members = rows.select("id", "digest").join(rows.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "rep")
    members = materialize(members, "members")
    firsts = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= s.k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    reps = rows.join(members.where("id = rep").select("id"), "id", "left_semi").select(F.col("id").alias("rep"), "vector")
    n = members.where("id = rep").count()
    drawn = spark.sparkContext.broadcast(Pivots(_pivots(reps, n, dim, s), s))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = drawn.value.homes(_unit(_matrix(batch.column(1), dim)))
            held = homes >= 0
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32), pa.array(homes[held].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["rep", "vector", "cells"])

    routed = materialize(reps.mapInArrow(route, "rep bigint, vector array<float>, cells array<int>"), "cells")
    at_home = routed.select("rep", "vector", F.explode("cells").alias("cell"))
    # At most `pivots` rows: into how many blocks a large cell is cut.
    sizes = routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.when(F.count("*") > 2 * s.block, F.ceil(F.count("*") / s.block)).otherwise(1).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    blocked = at_home.join(F.broadcast(sizes), "cell").select("cell", "blocks", mine.alias("mine"), "rep", "vector")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("mine")))
    meeting = blocked.select("cell", "mine", F.explode(others).alias("other"), "rep", "vector").select("cell", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "rep", "vector")

    def table(q: np.ndarray, o: np.ndarray, sims: np.ndarray) -> pa.Table:
        return pa.table({"rep": pa.array(q, pa.int64()), "other": pa.array(o, pa.int64()), "similarity": pa.array(sims, pa.float64())})

    def in_cell(t: pa.Table) -> pa.Table:
        ids = t["rep"].to_numpy()
        order = np.argsort(ids)
        return table(*nearest_in_cell(_unit(_matrix(t["vector"], dim)[order]), ids[order], s))

    def of_all(t: pa.Table) -> pa.Table:
        home = np.asarray(t["home"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        ids, m = t["rep"].to_numpy(), _unit(_matrix(t["vector"], dim))
        return table(*nearest_of_all(m[home], ids[home], m[~home], ids[~home], s))

    def lists_of(hits: DataFrame, asked: DataFrame) -> DataFrame:
        """(rep, near): the k + 1 nearest ids of each asking vector, its own copies among them."""
        # Each vector's list is short: k + 1 entries from each of its cells or blocks, then of k + 1 copies at most.
        far = F.struct((-F.col("similarity")).alias("far"), F.col("other").alias("neighbour"))
        near = hits.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(far)), 1, s.k + 1).alias("near")).select("rep", F.explode("near").alias("x"))
        near = near.select("rep", F.col("x.neighbour").alias("other"), (-F.col("x.far")).alias("similarity")).unionByName(asked.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity")))
        copies = near.join(firsts.select(F.col("rep").alias("other"), "ids"), "other").select("rep", F.explode("ids").alias("neighbour"), "similarity")
        return copies.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "neighbour"))), 1, s.k + 1).alias("near"))

    out = "rep bigint, other bigint, similarity double"
    lists = lists_of(meeting.groupBy("cell", "x", "y").applyInArrow(in_cell, out), members.where("id = rep").select("rep"))
    if s.whole:
        lists = materialize(lists, "lists")
        short = lists.where(F.size("near") <= s.k).select("rep")
        if missing := short.count():
            blocks, turns = -(-n // s.asked), -(-missing // s.asked)
            block, turn = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(turns)).cast("int")
            indexed = reps.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), F.lit(True).alias("home"), "rep", "vector")
            asking = reps.join(short, "rep", "left_semi").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), turn.alias("turn"), F.lit(False).alias("home"), "rep", "vector")
            hits = indexed.unionByName(asking).groupBy("block", "turn").applyInArrow(of_all, out)
            lists = lists.where(F.size("near") > s.k).unionByName(lists_of(hits, short))
    own = members.join(lists, "rep").select("id", F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, s.k).alias("near"))
    return own.select("id", F.posexplode("near").alias("at", "x")).select("id", (F.col("at") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("similarity"))

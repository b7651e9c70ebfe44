"""Dense vectors: validation, exact top-k, and fusion of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.operators.sparse import rank

RRF_K = 60
#: Bytes of queries that every task may hold; more queries meet the vectors in blocks.
HELD = 64 << 20
#: Queries and vectors that meet in one task, where queries come in blocks.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 20_000
#: Queries that are multiplied at once with the vectors of a batch.
STRIP = 512


def validate(vectors: Column, expected: int | None = None) -> Column:
    """What is wrong with a batch of vectors: null if it is sound.

    A sound batch is not empty, holds no null or empty vector, and one dimension, the expected one if given.
    """
    sizes = F.transform(vectors, lambda v: F.size(v))
    first = F.try_element_at(sizes, F.lit(1))
    return (
        F.when(vectors.isNull() | (F.size(vectors) == 0), "empty batch")
        .when(F.exists(vectors, lambda v: v.isNull() | (F.size(v) == 0)), "empty vector")
        .when(F.exists(sizes, lambda n: n != first), "ragged batch")
        .when(F.lit(expected).isNotNull() & (first != F.lit(expected)), "unexpected dimension")
    )


class _Side:
    """Ids, unit vectors by dimension and the values of further columns of some rows; zero vectors and such with nulls are left out."""

    def __init__(self, ids: pa.Array, column: pa.Array, same: list[pa.Array]) -> None:
        starts = column.offsets.to_numpy()
        numbers = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
        sizes = np.diff(starts)
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = {}
        keys = ids.to_numpy(zero_copy_only=False)
        values = [x.to_numpy(zero_copy_only=False) for x in same]
        for dim in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dim)
            m = numbers[starts[own][:, None] + np.arange(dim)[None, :]]
            norm = np.linalg.norm(m, axis=1)
            good = norm > 0  # false for NaN
            own = own[good]
            self.by_dim[dim] = keys[own], m[good] / norm[good, None], [v[own] for v in values]


class _Best:
    """The k best of each query so far, ties to the smaller id."""

    def __init__(self, queries: _Side, k: int) -> None:
        self.q, self.k = queries, k
        self.rows: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, vectors: _Side) -> None:
        for dim, (vk, vm, vs) in vectors.by_dim.items():
            qk, qm, qs = self.q.by_dim.get(dim, (np.zeros(0), None, None))
            if not len(qk) or not len(vk):
                continue
            for a in range(0, len(qk), STRIP):
                exact = qm[a : a + STRIP] @ vm.T
                rounded = np.round(exact, 9)
                rounded[qk[a : a + STRIP, None] == vk[None, :]] = -9.0
                for x, y in zip(qs, vs):
                    rounded[x[a : a + STRIP, None] != y[None, :]] = -9.0
                at = rounded.shape[1] - self.k
                least = np.partition(rounded, at, axis=1)[:, at] if at > 0 else np.full(len(rounded), -8.0)
                for i in range(len(rounded)):
                    near = np.flatnonzero((rounded[i] >= least[i]) & (rounded[i] > -9.0))
                    ids, scores = vk[near], exact[i, near]
                    if (a + i, dim) in self.rows:
                        ids, scores = np.concatenate([self.rows[a + i, dim][0], ids]), np.concatenate([self.rows[a + i, dim][1], scores])
                    best = np.lexsort((ids, -np.round(scores, 9)))[: self.k]
                    self.rows[a + i, dim] = ids[best], scores[best]

    def batch(self, query_type: pa.DataType, id_type: pa.DataType) -> pa.RecordBatch:
        keys = [self.q.by_dim[dim][0][i] for (i, dim), (ids, _) in self.rows.items() for _ in ids]
        ids = [x for ids, _ in self.rows.values() for x in ids.tolist()]
        scores = np.concatenate([s for _, s in self.rows.values()]) if self.rows else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(keys, query_type), pa.array(ids, id_type), pa.array(scores, pa.float64())], ["query_id", "id", "score"])


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def top_k(queries: DataFrame, vectors: DataFrame, k: int, same: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k vectors with the largest cosine for each query, by exact search.

    queries(query_id, vector), vectors(id, vector); null, zero and wrongly sized vectors are left out, and a vector
    whose id equals the query's is not its own neighbour. `same` names columns of both sides that must be equal and not null: such a filter is
    applied before the ranking. Queries of up to HELD bytes go to every task, and vectors stay where they are: each partition keeps k rows
    of a query. More queries meet the vectors in blocks, so that no side is held whole anywhere.
    """
    same = same or []
    filled = " AND ".join(["vector IS NOT NULL AND size(vector) > 0", *[f"`{c}` IS NOT NULL" for c in same]])
    # New names, as queries are often taken from the vectors themselves: a group of both sides tells columns by their origin.
    q = queries.where(f"query_id IS NOT NULL AND {filled}").select(F.col("query_id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), *[F.col(c).alias(c) for c in same])
    v = vectors.where(f"id IS NOT NULL AND {filled}").select(F.col("id").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *[F.col(c).alias(c) for c in same])
    out = f"query_id {dict(q.dtypes)['query_id']}, id {dict(v.dtypes)['id']}, score double"
    count, numbers = q.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    if 8 * numbers + 100 * count <= HELD:
        held = q.toArrow()  # measured just now
        kinds = held.schema.field("query_id").type
        asked = q.sparkSession.sparkContext.broadcast([_one(held[c]) for c in ("query_id", "vector", *same)])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, column, *others = asked.value
            best, kind = _Best(_Side(ids, column, others), k), None
            for b in batches:
                kind = b.schema.field("id").type
                best.add(_Side(b.column(0), b.column(1), [b.column(2 + i) for i in range(len(same))]))
            if kind is not None:
                yield best.batch(kinds, kind)

        hits = v.mapInArrow(scan, out)
    else:
        qn, vn = -(-count // QUERY_BLOCK), max(1, -(-v.count() // VECTOR_BLOCK))
        left = q.select("*", F.pmod(F.xxhash64("query_id"), F.lit(qn)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(vn - 1))).alias("vb"))
        right = v.select("*", F.explode(F.sequence(F.lit(0), F.lit(qn - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(vn)).cast("int").alias("vb"))

        nothing = pa.schema([("query_id", to_arrow_type(q.schema["query_id"].dataType)), ("id", to_arrow_type(v.schema["id"].dataType)), ("score", pa.float64())]).empty_table()

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return nothing
            best = _Best(_Side(_one(a["query_id"]), _one(a["vector"]), [_one(a[c]) for c in same]), k)
            best.add(_Side(_one(b["id"]), _one(b["vector"]), [_one(b[c]) for c in same]))
            return pa.Table.from_batches([best.batch(a.schema.field("query_id").type, b.schema.field("id").type)])

        hits = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, out)
    return rank(hits, k, ["query_id"]).select("query_id", "id", "score", "rank")


def fuse(branches: list[DataFrame], k: int, base: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank) by reciprocal rank fusion of branches(query_id, id, rank)."""
    both = branches[0].select("query_id", "id", "rank")
    for b in branches[1:]:
        both = both.unionByName(b.select("query_id", "id", "rank"))
    scored = both.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(float(base)) + F.col("rank"))).alias("score"))
    return rank(scored, k, ["query_id"]).select("query_id", "id", "score", "rank")


def hybrid(sparse: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """Fusion of two branches of 2 k rows each; filters belong before the branches' own ranking."""
    return fuse([sparse.where(F.col("rank") <= 2 * k), dense.where(F.col("rank") <= 2 * k)], k)

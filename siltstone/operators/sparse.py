"""BM25 over words: corpus statistics, postings, and ranked retrieval for many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions import text as X
from siltstone.functions.stemmer import stem_column
from siltstone.session import bounded, materialize

K1, B = 0.5, 0.75
#: Texts of one shard: what a task scores at once, whatever the size of the corpus.
SHARD = 20_000
#: Queries of one block; each block meets each shard.
QUERIES = 20_000
#: Words that are broadcast at most; beyond, joins are left to sorting and adaptive execution.
WORDS = 500_000


def tokenized(df: DataFrame, id_col: str, text: Column, keep: Sequence[str] = ()) -> DataFrame:
    """(id, kept columns, words array<string>); null texts have no words, null ids no row."""
    return df.select(F.col(id_col).alias("id"), *keep, X.words(text).alias("words")).where("id IS NOT NULL")


def term_counts(tokens: DataFrame, stems: bool = False) -> DataFrame:
    """(id, token, length, kept columns, tf): how often each word is in each text, and the text's number of words without stems.

    Rows are counted in each partition before they are shuffled; where tokens are partitioned by id, nothing is.
    """
    keep = [c for c in tokens.columns if c not in ("id", "words")]
    # Outer, as an inner explode would have its list worked out a second time to drop empty ones.
    flat = tokens.select("id", *keep, F.size("words").alias("length"), F.explode_outer("words").alias("token")).where("token IS NOT NULL")
    counts = flat.groupBy("id", "token", "length", *keep).agg(F.count("*").alias("tf"))
    return with_stems(counts) if stems else counts


def with_stems(counts: DataFrame) -> DataFrame:
    """Term counts in which each word whose stem differs counts for its stem, too.

    Stems are worked out once per distinct word and joined back.
    """
    known = counts.select("token").distinct().withColumn("stem", stem_column("token"))
    known = known.where((F.col("stem") != F.col("token")) & ~F.col("stem").isin(X.STOP_WORDS))
    keys = [c for c in counts.columns if c != "tf"]
    more = counts.join(bounded(materialize(known, "stems"), WORDS), "token").withColumn("token", F.col("stem")).drop("stem")
    return counts.unionByName(more).groupBy(*keys).agg(F.sum("tf").alias("tf"))


def spread_counts(df: DataFrame, id_col: str, text: Column, keep: Sequence[str] = ()) -> DataFrame:
    """term_counts of a table of texts, which are shuffled by id, over all cores, so that their words are not."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return term_counts(tokenized(df.where(F.col(id_col).isNotNull()).repartition(parts, F.col(id_col)), id_col, text, keep))


def stats_of(df: DataFrame, id_col: str, base: DataFrame) -> DataFrame:
    """corpus_stats from the number of texts and their counts without stems, which add up to their lengths."""
    texts = df.where(F.col(id_col).isNotNull()).agg(F.count("*").alias("n"))
    total = base.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return texts.join(F.broadcast(total)).select("n", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("avgdl"))  # one row each


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """(n, avgdl) in one row: texts, those without words included, and their mean number of words; 0 and 0 if there are none."""
    return tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("words")), F.lit(0.0)).alias("avgdl"))


def idf(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, df, idf): smoothed inverse document frequency, always positive."""
    found = counts.groupBy("token").agg(F.count("*").alias("df"))
    value = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return found.join(F.broadcast(stats)).select("token", "df", value.alias("idf"))  # one row of statistics


def weights(counts: DataFrame, idfs: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(id, token, kept columns, weight) of every word of every text; weights that are not positive are left out."""
    norm = F.when(F.col("avgdl") > 0, 1.0 - b + b * F.col("length") / F.col("avgdl")).otherwise(1.0)
    weight = F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * norm)
    weighted = counts.join(idfs.select("token", "idf"), "token").join(F.broadcast(stats))  # one row of statistics
    return weighted.select(*[c for c in counts.columns if c not in ("length", "tf")], weight.alias("weight")).where("weight > 0")


def weigh(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """weights by the frequencies of the counts themselves, which are broadcast up to WORDS words."""
    return weights(counts, bounded(materialize(idf(counts, stats), "idf"), WORDS), stats)


def sparse_vectors(weighted: DataFrame) -> DataFrame:
    """(id, indices array<bigint>, values array<float>): weights of words with the same hash added, indexes ascending."""
    hashed = weighted.groupBy("id", X.token_hash(F.col("token")).alias("hash")).agg(F.sum("weight").cast("float").alias("weight"))
    rows = hashed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("hash", "weight"))).alias("v"))
    return rows.select("id", F.col("v.hash").alias("indices"), F.col("v.weight").alias("values"))


def validate(indices: Column, values: Column) -> Column:
    """What is wrong with a sparse vector: null if it is sound. An empty one is; indexes must be as many as values and not repeat."""
    return (
        F.when(indices.isNull() | values.isNull(), "missing")
        .when(F.size(indices) != F.size(values), "different lengths")
        .when(F.exists(indices, lambda i: i.isNull()) | F.exists(values, lambda v: v.isNull()), "null entry")
        .when(F.size(F.array_distinct(indices)) != F.size(indices), "repeated index")
    )


def rank(scored: DataFrame, k: int, keys: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each group with their rank from 1; ties go to the smaller id. Each partition keeps k first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(query_words: DataFrame, postings: DataFrame, k: int, filters: dict[str, str] | None = None, texts: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best texts of each query; texts that share no word don't appear.

    query_words(query_id, words): each distinct word weighs 1. `filters` names, for columns of lists in query_words, the column of
    postings whose value must be in the list, before the ranking; null and empty lists let everything pass.
    `texts`: about how many texts there are, if known.

    Only postings of words that are asked for are kept. They are shuffled by shards of texts, not by word, so a common word is spread over
    all shards; each shard scores its own texts in sorted arrays and keeps k rows of a query.
    """
    filters = filters or {}
    asked = materialize(query_words.where("query_id IS NOT NULL").select("query_id", F.array_distinct("words").alias("words"), *filters).where("size(words) > 0"), "asked")
    words = asked.select(F.explode("words").alias("token")).distinct()
    kept = postings.select("id", "token", *filters.values(), "weight").where("id IS NOT NULL")
    if words.count() <= WORDS:
        kept = kept.join(F.broadcast(words), "token", "left_semi")  # counted
    if texts is None:
        texts = postings.agg(F.approx_count_distinct("id")).first()[0]
    spark = postings.sparkSession
    shards = max(spark.sparkContext.defaultParallelism, -(-texts // SHARD))
    blocks = max(1, -(-asked.count() // QUERIES))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    right = kept.select(shard, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block") if blocks > 1 else F.lit(0).alias("block"), "*")
    left = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "*")

    nothing = pa.schema([("query_id", to_arrow_type(asked.schema["query_id"].dataType)), ("id", to_arrow_type(kept.schema["id"].dataType)), ("score", pa.float64())]).empty_table()

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return nothing
        ids = p["id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        ids = ids.dictionary_encode()
        order = np.argsort(np.asarray(ids.dictionary.to_pylist(), object), kind="stable") if len(ids.dictionary) else np.zeros(0, int)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        texts_ = place[np.asarray(ids.indices)] if len(order) else np.zeros(0, int)  # in the order of their ids
        token = p["token"].combine_chunks().dictionary_encode()
        at = np.argsort(np.asarray(token.indices), kind="stable")
        ends = np.cumsum(np.bincount(np.asarray(token.indices), minlength=len(token.dictionary)))
        spans = {w: (e - n, e) for w, e, n in zip(token.dictionary.to_pylist(), ends.tolist(), np.diff(ends, prepend=0).tolist())}
        texts_, weight = texts_[at], p["weight"].to_numpy()[at]
        values = {}
        for column in filters.values():
            own = np.empty(len(order), object)
            own[place[np.asarray(ids.indices)]] = p[column].to_numpy(zero_copy_only=False)
            values[column] = own
        rows: list[tuple[list, np.ndarray, np.ndarray]] = []
        wanted = [q[c].to_pylist() for c in filters]
        for n, (key, its) in enumerate(zip(q["query_id"].to_pylist(), q["words"].to_pylist())):
            slices = [slice(*spans[w]) for w in its if w in spans]
            if not slices:
                continue
            score = np.bincount(np.concatenate([texts_[s] for s in slices]), np.concatenate([weight[s] for s in slices]), len(order))
            for lists, column in zip(wanted, filters.values()):
                if lists[n]:
                    score[~np.isin(values[column], np.asarray(lists[n], object))] = 0
            near = np.flatnonzero(score > 0)
            if len(near) > k:
                rounded = np.round(score[near], 9)
                near = near[rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k]]
            near = near[np.lexsort((near, -np.round(score[near], 9)))][:k]
            rows.append(([key] * len(near), near, score[near]))
        near = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, int)
        keys = pa.array([key for r in rows for key in r[0]], q.schema.field("query_id").type)
        scores = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0)
        return pa.table({"query_id": keys, "id": ids.dictionary.take(pa.array(order[near])), "score": scores})

    types = dict(asked.dtypes)["query_id"], dict(postings.dtypes)["id"]
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, f"query_id {types[0]}, id {types[1]}, score double")
    return rank(met, k, ["query_id"]).select("query_id", "id", "score", "rank")

"""Searching a stored collection: modes, filters, one or many queries in one job."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions import text as X
from siltstone.functions.stemmer import stem_column
from siltstone.operators import dense, sparse
from siltstone.operators.store import Store
from siltstone.plans import index
from siltstone.session import bounded, materialize

MODES = ("dense", "sparse", "hybrid")


def mode_of(given: str | None) -> str:
    """The mode in any case; hybrid if none is given. Raises before any work is done."""
    mode = (given or "").strip().lower() or "hybrid"
    if mode not in MODES:
        raise ValueError(f"unknown mode {given!r}; use one of {', '.join(MODES)}")
    return mode


def listed(given: str | None) -> list[str]:
    """The parts of a list with commas, trimmed, without empty ones."""
    return [p.strip() for p in (given or "").split(",") if p.strip()]


def limit_of(given: int, least: int = 1) -> int:
    if given < least:
        raise ValueError(f"the limit must be at least {least}")
    return given


#: Distinct words of a request that are named in the scan itself; more are joined.
NAMED = 1000


@dataclass(frozen=True)
class Request:
    mode: str = "hybrid"
    limit: int = 5
    languages: tuple[str, ...] = ()
    repos: tuple[str, ...] = ()


def asked_words(queries: DataFrame, stems: bool) -> DataFrame:
    """(query_id, words): the words of each query and, with stems, their stems."""
    words = queries.select("query_id", X.words(F.col("query")).alias("words"))
    if not stems:
        return words
    flat = words.select("query_id", F.explode("words").alias("w"))
    both = flat.select("query_id", "w").unionByName(flat.select("query_id", stem_column("w").alias("w"))).where(~F.col("w").isin(X.STOP_WORDS))
    return both.groupBy("query_id").agg(F.collect_set("w").alias("words"))  # one query's words


def sparse_branch(store: Store, name: str, queries: DataFrame, k: int, request: Request) -> DataFrame:
    """Ranking by stored counts of words. Only rows of words that are asked for leave the scan, of the folders that the filters leave.

    Words weigh what they weigh in the whole collection, whatever the filters.
    """
    idfs, stats = store.frequencies(name)
    words = materialize(asked_words(queries, store.properties(name)["stems"]), "words")
    distinct = words.select(F.explode("words").alias("token")).distinct()
    terms = store.terms(name, request.repos, request.languages)
    count = distinct.count()
    if count <= NAMED:
        wanted = [r[0] for r in distinct.collect()]
        terms, idfs = (x.where(F.col("token").isin(wanted)) for x in (terms, idfs))
    elif count <= sparse.WORDS:
        terms, idfs = (x.join(F.broadcast(distinct), "token", "left_semi") for x in (terms, idfs))
    weights = sparse.weights(terms, bounded(idfs, sparse.WORDS), stats)
    return sparse.search(words, weights, k, texts=stats.first()["n"])


def search(spark: SparkSession, store: Store, name: str, queries: DataFrame, request: Request = Request(), embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, rank, score, and the chunk's columns) for queries(query_id, query), all in one job.

    Filters hold before each branch's ranking, as filters of folders. Payload is joined after the ranking. Sparse
    mode never embeds. Texts that share no word with a query don't appear in the sparse branch. Ties go to the smaller chunk_id.
    """
    mode, k = mode_of(request.mode), limit_of(request.limit)
    store.ensure(name, None)
    chunks = store.read(name, request.repos, request.languages)
    if chunks is None:
        raise ValueError(f"there is no collection {name}")
    branches = []
    deep = k if mode != "hybrid" else 2 * k
    if mode != "dense":
        branches.append(sparse_branch(store, name, queries, deep, request))
    if mode != "sparse":
        dim = store.properties(name)["dense_dim"]
        vector = embed(F.col("query")) if embed else index.fake_vectors(F.col("query"), dim)
        asked = materialize(queries.select("query_id", vector.alias("vector")), "asked")
        if asked.where(F.coalesce(F.size("vector"), F.lit(-1)) != dim).limit(1).count():
            raise ValueError(f"the queries' vectors must have {dim} numbers, as the collection's")
        branches.append(dense.top_k(asked, chunks.select(F.col("chunk_id").alias("id"), F.col("dense").alias("vector")), deep))
    best = materialize(branches[0] if len(branches) == 1 else dense.hybrid(*branches, k), "best")
    return bounded(best.withColumnRenamed("id", "chunk_id"), sparse.WORDS).join(chunks.drop("dense", "enriched_text"), "chunk_id")


def prompts(results: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, system, user): prompts of the first `limit` results of each query; all of them if it is 0 or less."""
    r = results if limit <= 0 else results.where(F.col("rank") <= limit)
    lines = F.format_string("%d-%d", "start_line", "end_line")
    block = A.rendered(F.col("rank"), F.col("repo"), F.col("file_path"), lines, F.col("chunk_type"), F.col("name"), F.col("content"))
    blocks = r.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return queries.join(blocks, "query_id", "left").select("query_id", F.lit(A.SYSTEM).alias("system"), A.prompt(F.col("query"), F.col("blocks")).alias("user"))


def hint(error: BaseException) -> str:
    """What went wrong with a model, and what may help: it is not there, too slow, or not installed."""
    text = f"{type(error).__name__}: {error}" if str(error) else type(error).__name__
    low = text.casefold()
    if isinstance(error, TimeoutError) or "timed out" in low or "deadline exceeded" in low:
        return f"{text} (the model took too long; give it more time or a smaller prompt)"
    if isinstance(error, ConnectionRefusedError) or "connection refused" in low:
        return f"{text} (is the model server running?)"
    if "404" in low or "not found" in low:
        return f"{text} (is the model installed on its server?)"
    return text


def generate(asked: DataFrame, make: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """(query_id, text, error, generate_ms): answers of a model that `make` opens once in each task, before its first prompt.

    An error of one prompt is kept beside it, with a hint, and stops nothing.
    """
    kind = dict(asked.dtypes)["query_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            out = []
            for key, system, user in zip(b["query_id"], b["system"], b["user"]):
                began = time.monotonic()
                try:
                    text, error = model(system, user), None
                except Exception as e:  # the model is foreign code
                    text, error = None, hint(e)
                out.append((key, text, error, int((time.monotonic() - began) * 1000)))
            yield pd.DataFrame(out, columns=["query_id", "text", "error", "generate_ms"])

    return asked.mapInPandas(run, f"query_id {kind}, text string, error string, generate_ms bigint")


#: Texts that a model of vectors gets at once.
BATCH = 32


def embedder(make: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int | None = None, batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function for `embed=` from a model that `make` opens once in each task and that takes lists of texts.

    A reply must have one vector for each text, all of one dimension (`dim`, if given); anything else fails the task with what is wrong.
    """

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            out: list[list[float]] = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].fillna("").tolist()
                reply = model(part)
                if len(reply) != len(part):
                    raise ValueError(f"{len(reply)} vectors for {len(part)} texts")
                out += reply
                sizes = {len(v) for v in out if v is not None}
                if any(v is None for v in reply) or len(sizes) != 1 or 0 in sizes or dim is not None and sizes != {dim}:
                    raise ValueError(f"vectors of {sorted(sizes)} numbers" + (f", not {dim}" if dim else " or none"))
            yield pd.Series(out)

    return F.pandas_udf(vectors, "array<float>")


def echo() -> Callable[[str, str], str]:
    """A stand-in for a model: names the question, how many chunks it got, and their symbols, or paths where they have none."""

    def answer(system: str, user: str) -> str:
        question = user.split("\n", 1)[0].removeprefix("Question: ")
        heads = re.findall(r"^\[[0-9]+\] (.*?):[0-9]+-[0-9]+(?:, \w+: (.*))?$", user, re.M)
        return f"{question}: {len(heads)} chunks [1]: {', '.join(name or path for path, name in heads)}" if heads else f"{question}: 0 chunks"

    return answer

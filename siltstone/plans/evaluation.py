"""An evaluation run: golden queries searched in one job, judged, answered if wanted, and reported as a whole."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import evaluate
from siltstone.operators.store import Store
from siltstone.plans import index, search
from siltstone.session import materialize

#: Results that recall needs.
LEAST = 10


def run(
    spark: SparkSession,
    store: Store,
    collection: str,
    queries: DataFrame,
    request: search.Request,
    dataset: str = "",
    embed: Callable[[Column], Column] | None = None,
    embedder: str = "stand-in",
    model: Callable[[], Callable[[str, str], str]] | None = None,
    generator: str = "",
    answer_limit: int = 5,
) -> dict:
    """The report of a run as nested dictionaries, made of collected rows: one per golden query, one per type, one for the run.

    All queries are searched in one job, so the times of a query are its share of the job's; those of answers are each its own.
    An answer's error stays with its query and stops nothing. A vector that can't be made is the query's error.
    """
    search.limit_of(request.limit, LEAST)
    began = time.monotonic()
    asked = queries.select("query_id", "query")
    failed = asked.limit(0).select("query_id", F.lit("").alias("error"))
    if request.mode != "sparse":
        dim = store.properties(collection)["dense_dim"]
        made = materialize(asked.select("query_id", "query", (embed(F.col("query")) if embed else index.fake_vectors(F.col("query"), dim)).alias("vector")), "vectors")
        failed = made.where(F.coalesce(F.size("vector"), F.lit(-1)) != dim).select("query_id", F.format_string("the vector does not have %d numbers", F.lit(dim)).alias("error"))
        asked = made.join(failed.select("query_id"), "query_id", "left_anti").select("query_id", "query")
    embedded = time.monotonic()
    found = materialize(search.search(spark, store, collection, asked, request, embed), "found")
    searched = time.monotonic()
    count = max(1, queries.count())
    share = lambda seconds: int(1000 * seconds / count)
    metrics = evaluate.per_query(found, queries).join(failed, "query_id", "left")
    metrics = metrics.select("*", F.lit(share(searched - began)).alias("total_ms"), F.lit(share(embedded - began)).alias("embed_ms"), F.lit(share(searched - embedded)).alias("search_ms"))
    metrics = materialize(metrics, "metrics")
    top = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "name", "score", "start_line", "end_line"))).alias("top_results"))  # `limit` of a query
    rows = metrics.join(queries.select("query_id", "query", "top1_score_below"), "query_id").join(top, "query_id", "left")
    report = {
        "run_id": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H-%M-%SZ"),
        "dataset": dataset,
        "collection": collection,
        "embedder": embedder,
        "mode": request.mode,
        "limit": request.limit,
        "aggregate": evaluate.run_aggregate(metrics, []).first().asDict(),
        "by_type": {r["query_type"]: r.asDict() for r in evaluate.by_type(metrics.where("error IS NULL")).collect()},
    }
    if model is not None:
        said = search.generate(search.prompts(found, asked, answer_limit), model)
        chunks = found.groupBy("query_id").agg(F.count_if((F.col("rank") <= answer_limit) | F.lit(answer_limit <= 0)).cast("int").alias("n_chunks"))
        answers = materialize(said.join(chunks, "query_id", "left").withColumn("answer_id", F.col("query_id")), "answers")
        scored = evaluate.answer_flags(answers).drop("answer_id_").join(answers.select("answer_id", "query_id", "text", "error", "generate_ms"), "answer_id").drop("answer_id")
        rows = rows.join(scored.select("query_id", F.struct(*[c for c in scored.columns if c != "query_id"]).alias("answer")), "query_id", "left")
        total = evaluate.answer_aggregate(answers.withColumn("run", F.lit(0)), queries, ["run"]).drop("run").first()
        report["answer"] = {"generator": generator} | (total.asDict() if total else {})
    report["queries"] = [r.asDict(recursive=True) for r in rows.orderBy("query_id").collect()]
    return report

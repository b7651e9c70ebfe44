"""Retrieval metrics of ranked results against golden queries, and aggregates of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import answers as A

DEPTHS = (1, 3, 5)
RECALL_GAP = 0.10


def invalid_queries(queries: DataFrame) -> DataFrame:
    """(query_id, problem) of each golden query that can't be evaluated; a dataset without queries has one row with a null id."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    again = queries.groupBy("query_id").count().where("query_id IS NOT NULL AND query_id <> '' AND count > 1").select("query_id", F.lit("duplicate id").alias("problem"))
    problem = (
        F.when(F.coalesce(F.col("query_id"), F.lit("")) == "", "missing id")
        .when(F.coalesce(F.col("query"), F.lit("")) == "", "empty query")
        .when((F.coalesce(F.col("query_type"), F.lit("")) != "negative") & none(F.col("expected_files")) & none(F.col("expected_symbols")), "no expectation")
    )
    single = queries.select("query_id", problem.alias("problem")).where("problem IS NOT NULL")
    empty = queries.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("query_id"), F.lit("no queries").alias("problem"))
    return single.unionByName(again).unionByName(empty)


def relevant(path: Column, symbol: Column, files: Column, symbols: Column) -> Column:
    """A result is relevant if its file or its symbol is expected; null counts as no expectation."""
    return F.coalesce(F.array_contains(files, path), F.lit(False)) | F.coalesce(F.array_contains(symbols, symbol) & (symbol != ""), F.lit(False))


def per_query(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query with its metrics, from results(query_id, rank, score, file_path, name).

    hit_1, hit_3, hit_5; mrr_5: 1 / rank of the first relevant result of five; recall_5, recall_10: found
    expected files / number of expected files, repeated ones counted; negative_pass: nothing found, or the best score
    below the query's limit. Queries without results have one row, with zeros.
    """
    q = queries.select("query_id", F.coalesce(F.nullif("query_type", F.lit("")), F.lit("untyped")).alias("query_type"), "expected_files", "expected_symbols", "top1_score_below")
    j = q.join(results.select("query_id", "rank", "score", "file_path", "name"), "query_id", "left")
    hit = relevant(F.col("file_path"), F.col("name"), F.col("expected_files"), F.col("expected_symbols")) & F.col("rank").isNotNull()
    expected = F.coalesce(F.array_contains("expected_files", F.col("file_path")), F.lit(False))
    found = {k: F.count_distinct(F.when(expected & (F.col("rank") <= k), F.col("file_path"))) for k in (5, 10)}
    g = j.groupBy("query_id").agg(
        F.first("query_type").alias("query_type"),
        F.count("rank").alias("results"),
        *[F.coalesce(F.max(hit & (F.col("rank") <= k)), F.lit(False)).alias(f"hit_{k}") for k in DEPTHS],
        F.coalesce(1.0 / F.min(F.when(hit & (F.col("rank") <= 5), F.col("rank"))), F.lit(0.0)).alias("mrr_5"),
        *[found[k].alias(f"found_{k}") for k in (5, 10)],
        F.first(F.size("expected_files")).alias("wanted"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.first("top1_score_below").alias("limit"),
    )
    recall = lambda k: F.when(F.col("wanted") > 0, F.col(f"found_{k}") / F.col("wanted")).otherwise(0.0)
    passed = (F.col("results") == 0) | F.coalesce((F.col("limit") > 0) & (F.col("top_score") < F.col("limit")), F.lit(False))
    return g.select("query_id", "query_type", "results", *[f"hit_{k}" for k in DEPTHS], "mrr_5", recall(5).alias("recall_5"), recall(10).alias("recall_10"), F.when(F.col("query_type") == "negative", passed).alias("negative_pass"))


def _means() -> list[Column]:
    positive = F.col("query_type") != "negative"
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(positive, F.col(c).cast("double"))), 6), F.lit(0.0)).alias(c)
    return [
        F.count("*").alias("queries"),
        F.count_if(positive).alias("positive"),
        *[mean(c) for c in ("hit_1", "hit_3", "hit_5", "mrr_5", "recall_5", "recall_10")],
        F.round(F.avg(F.col("negative_pass").cast("double")), 6).alias("negative_pass_rate"),
    ]


def aggregate(metrics: DataFrame) -> DataFrame:
    """Means over positive queries and the pass rate of negative ones, in one row; recall_gap with its flag."""
    gap = F.round(F.col("recall_10") - F.col("recall_5"), 6)
    return metrics.agg(*_means()).withColumn("recall_gap", gap).withColumn("wide_gap", gap >= RECALL_GAP)


def by_type(metrics: DataFrame) -> DataFrame:
    """The same means by type of query; negative queries report their pass rate only."""
    return metrics.groupBy("query_type").agg(*_means())


#: Times of a query, in milliseconds: all of it, making its vector, searching.
TIMES = ("total_ms", "embed_ms", "search_ms")


def run_aggregate(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run from metrics(keys, the columns of per_query, error, TIMES).

    queries, positive, negative and errors count rows; a row with an error counts nowhere else. Means are over positive queries, the pass
    rate over negative ones; p50 and p95 of each time by nearest rank, over all queries without errors.
    """
    good = F.col("error").isNull()
    positive, negative = good & (F.col("query_type") != "negative"), good & (F.col("query_type") == "negative")
    mean = lambda c, of: F.coalesce(F.round(F.avg(F.when(of, F.col(c).cast("double"))), 6), F.lit(0.0))
    place = lambda c, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN error IS NULL THEN {c} END)").cast("long")
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("queries"),
        F.count_if(positive).alias("positive"),
        F.count_if(negative).alias("negative"),
        F.count_if(~good).alias("errors"),
        *[mean(c, positive).alias(c) for c in ("hit_1", "hit_3", "hit_5", "mrr_5", "recall_5", "recall_10")],
        mean("negative_pass", negative).alias("negative_pass_rate"),
        *[place(c, p / 100).alias(f"{c[:-3]}_p{p}_ms") for c in TIMES for p in (50, 95)],
    )


#: Rates of the comparison of reports, with where they stand in a report.
COMPARED = {
    "hit_1": "aggregate.hit_1",
    "hit_3": "aggregate.hit_3",
    "hit_5": "aggregate.hit_5",
    "mrr_5": "aggregate.mrr_5",
    "recall_10": "aggregate.recall_10",
    "navigation_hit_5": "by_type.navigation.hit_5",
    "concept_hit_5": "by_type.concept.hit_5",
    "behavior_hit_5": "by_type.behavior.hit_5",
    "negative_pass": "by_type.negative.negative_pass_rate",
}


def comparison(reports: DataFrame) -> DataFrame:
    """(position, run_id, mode, dataset, rates, p50_ms, p95_ms, rates' changes) of reports(position, report as JSON text).

    What a report leaves out counts as 0. Changes are in percentage points against the report with the smallest position.
    """
    number = lambda path: F.coalesce(F.get_json_object("report", f"$.{path}").cast("double"), F.lit(0.0))
    text = lambda name: F.coalesce(F.get_json_object("report", f"$.{name}"), F.lit("-")).alias(name)
    flat = reports.select("position", text("run_id"), text("mode"), text("dataset"), *[number(p).alias(c) for c, p in COMPARED.items()], *[number(f"aggregate.total_{p}_ms").cast("long").alias(f"{p}_ms") for p in ("p50", "p95")])
    return flat.join(compare(flat, "position", list(COMPARED)).select("position", *[f"{c}_delta" for c in COMPARED]), "position")


def percentiles(df: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """(keys, n, p50, p95) by nearest rank; null values are left out."""
    rows = df.select(*keys, value.alias("v")).where("v IS NOT NULL")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95"))


def answer_flags(answers: DataFrame) -> DataFrame:
    """(answer_id, n_citations, n_valid, n_invalid, is_well_formed, is_refused) worked out from the text itself."""
    cited = A.citations(F.col("text"))
    rows = answers.select("answer_id", F.coalesce("n_chunks", F.lit(0)).alias("chunks"), cited.alias("cited"), A.well_formed(F.col("text")).alias("is_well_formed"), A.refuses(F.col("text")).alias("is_refused"))
    return rows.select("answer_id", F.size("cited").alias("n_citations"), A.valid_citations(F.col("cited"), F.col("chunks")).alias("n_valid"), (F.size("cited") - A.valid_citations(F.col("cited"), F.col("chunks"))).alias("n_invalid"), "is_well_formed", "is_refused")


def answer_aggregate(answers: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of answers by keys: well-formed of generated, cited of positive, all valid of positive cited, refused of negative.

    dangling counts answers with any invalid citation; p50 and p95 are of generate_ms by nearest rank. A rate without cases is null.
    """
    flags = answer_flags(answers)
    j = answers.join(flags, "answer_id").join(queries.select("query_id", "query_type"), "query_id", "left")
    made = F.col("error").isNull()
    positive, negative = made & (F.coalesce("query_type", F.lit("")) != "negative"), made & (F.coalesce("query_type", F.lit("")) == "negative")
    rate = lambda yes, of: F.round(F.count_if(yes & of) / F.nullif(F.count_if(of), F.lit(0)), 6)
    cited = F.col("n_citations") > 0
    return j.groupBy(*keys).agg(
        F.count_if(made).alias("generated"),
        F.count_if(~made).alias("errors"),
        rate(F.col("is_well_formed"), made).alias("well_formed_rate"),
        rate(cited, positive).alias("cited_rate"),
        rate(F.col("n_invalid") == 0, positive & cited).alias("all_valid_rate"),
        F.count_if(made & (F.col("n_invalid") > 0)).alias("dangling"),
        rate(F.col("is_refused"), negative).alias("refusal_rate"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN error IS NULL THEN generate_ms END)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN error IS NULL THEN generate_ms END)").alias("p95_ms"),
    )


def compare(reports: DataFrame, key: str, rates: list[str]) -> DataFrame:
    """Each report beside the first one by key: for every rate its value and the change in percentage points."""
    first = reports.agg(*[F.min_by(c, key).alias(f"_{c}") for c in rates])
    return reports.join(F.broadcast(first)).select(key, *rates, *[F.round((F.col(c) - F.col(f"_{c}")) * 100, 4).alias(f"{c}_delta") for c in rates])  # the first report is one row

"""Golden queries from YAML, and reports from JSON."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.evaluate import invalid_queries

SCHEMA = "query_id string, query string, query_type string, subtype string, filter_languages array<string>, filter_repos array<string>, expected_files array<string>, expected_symbols array<string>, top1_score_below double"


def load(spark: SparkSession, path: str | Path, query_type: str | None = None, subtype: str | None = None) -> DataFrame:
    """The queries of a YAML file with `queries:`; raises on queries that can't be evaluated, and if none are left."""
    import yaml

    rows = []
    for q in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("queries") or []:
        filters, expected, negative = q.get("filters") or {}, q.get("expected") or {}, q.get("negative") or {}
        below = negative.get("top1_score_below")
        rows.append((q.get("id"), q.get("query"), q.get("type"), q.get("subtype"), filters.get("languages"), filters.get("repos"), expected.get("files"), expected.get("symbols"), None if below is None else float(below)))
    df = spark.createDataFrame(rows, SCHEMA)
    if bad := invalid_queries(df).take(20):
        raise ValueError("; ".join(f"{r['query_id']}: {r['problem']}" for r in bad))
    for name, wanted in (("query_type", query_type), ("subtype", subtype)):
        df = df if wanted is None else df.where(df[name] == wanted)
    if df.isEmpty():
        raise ValueError("no query matches the type and subtype")
    return df


def reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(position, report): evaluation reports written as JSON, one per file, in the given order; raises on one that is missing or no JSON object."""
    parts = [spark.read.text(p, wholetext=True).select(F.lit(n).alias("position"), F.col("value").alias("report")) for n, p in enumerate(paths)]
    both = reduce(DataFrame.unionByName, parts)
    bad = both.where("get_json_object(report, '$.aggregate') IS NULL").select("position").collect()  # one row per given path
    if bad:
        raise ValueError("no reports: " + ", ".join(paths[r["position"]] for r in bad))
    return both

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import catalog


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["window_chunks", "chunk_ids", "tokens", "bm25_weights", "sparse_topk_filtered", "go_cover", "stored_changes", "unreadable_files", "eval_runs", "eval_per_query", "change_detection", "answer_flags"])
def test_against_sql(spark, smallest, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("source_files", "code_chunks", "documents", "golden_queries", "file_states", "eval_answers"):
        con.execute(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    df = entry.queries()[name](spark, smallest)
    columns = sorted(df.columns)
    shown = lambda rows: sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    wanted = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert shown(tuple(r) for r in df.select(*columns).collect()) == shown(wanted)

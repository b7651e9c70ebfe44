"""Following changes: bursts of events become sessions, each of which starts one indexing run."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.sources.config import Config

GAP = "500 milliseconds"
LATE = "10 seconds"
log = logging.getLogger(__name__)


def relevant(path: Column, config: Config = Config()) -> Column:
    """Whether a change of this path matters, judged by its base name alone."""
    return config.skipped(F.element_at(F.split(path, "/"), -1)).isNull()


def debounce(events: DataFrame, time: str, keys: list[str], gap: str = GAP, late: str | None = None) -> DataFrame:
    """(keys, first, last, events): one row per burst; an event within `gap` of the one before belongs to its burst.

    Works on tables and streams; for streams give `late`, how long to wait for late events, of which later
    ones are dropped. Rows without a time are left out; null keys make their own bursts.
    """
    rows = events.where(F.col(time).isNotNull())
    if late:
        rows = rows.withWatermark(time, late)
    bursts = rows.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events"))
    return bursts.select(*keys, "first", "last", "events")


def settled(changes: DataFrame, keys: list[str], gap_ms: int = 500) -> DataFrame:
    """(keys, events) of each burst of a stream, by the time of arrival: given when nothing has come for `gap_ms`.

    Every event starts the wait anew; a burst ends without a later event having to come. Null keys make their own bursts.
    """
    kinds = dict(changes.dtypes)

    def burst(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (events,) = state.get
            state.remove()
            yield pd.DataFrame([(*key, events)], columns=[*keys, "events"])
            return
        came = sum(len(b) for b in rows)
        state.update(((state.get[0] if state.exists else 0) + came,))
        state.setTimeoutDuration(gap_ms)

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "events long"])
    return changes.groupBy(*keys).applyInPandasWithState(burst, schema, "events long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def follow(changes: DataFrame, run: Callable[[], None], checkpoint: str, config: Config = Config(), every: str = GAP, gap_ms: int = 500) -> StreamingQuery:
    """Calls run once for each burst of relevant changes, when it has settled; a run that fails is logged, and following goes on."""

    def batch(df: DataFrame, epoch: int) -> None:
        if not df.count():  # reads every partition, as the state store wants
            return
        try:
            run()
        except Exception:
            log.exception("indexing run %s failed", epoch)

    events = changes.where(relevant(F.col("file_path"), config)).select(F.lit("all").alias("source"), "file_path")
    # One key, so one state: the query takes the session's settings as it starts, and the runs it calls keep theirs.
    spark = changes.sparkSession
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        return settled(events, ["source"], gap_ms).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)

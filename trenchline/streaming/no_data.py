"""The no-data counter as keyed stream state.

A stream over the fetch log keeps, for each feed, the run of empty fetches
that is under way.  A fetch with rows resets it; when a run reaches the
threshold, its row turns to a warning.  The state lives in the stream's
checkpoint, so the counter survives a restart.

One row is written for a run in every micro-batch that adds to it; the row
with most fetches is the run's last word (``latest_runs``).  Fetches of one
micro-batch are taken in time order, equal times with empty fetches first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trenchline.operators.ingest_log import CONSECUTIVE_EMPTY_THRESHOLD
from trenchline.streaming.ingest import LOG_SCHEMA

#: times are microseconds in the state and in Arrow
RUN_SCHEMA = "feed string, run_start bigint, run_end bigint, empty_batches bigint, first_alert_at bigint"
STATE_SCHEMA = "run_start bigint, run_end bigint, empty_batches bigint, first_alert_at bigint"


def _counter(threshold: int):
    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fetches = pd.concat(list(frames)).sort_values(["ts", "rows"], kind="stable")
        run = list(state.get) if state.exists else None
        touched = []
        for ts, rows in zip(fetches["ts"].tolist(), fetches["rows"].tolist()):
            if rows > 0:
                run = None
                continue
            if run is None:
                run = [ts, ts, 0, None]
                touched.append(run)
            elif not touched:
                touched.append(run)
            run[1], run[2] = ts, run[2] + 1
            if run[2] == threshold:
                run[3] = ts
        if run is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(run))
        out = pd.DataFrame([[key[0], *r] for r in touched], columns=["feed", "run_start", "run_end", "empty_batches", "first_alert_at"])
        yield out.astype({"run_start": "Int64", "run_end": "Int64", "empty_batches": "Int64", "first_alert_at": "Int64"})

    return count


def count_empty(log: DataFrame, threshold: int = CONSECUTIVE_EMPTY_THRESHOLD) -> DataFrame:
    """A stream of runs from a stream of fetches (feed, batch_ts, rows)."""
    ts = F.unix_micros(F.col("batch_ts").cast("timestamp"))
    fetches = log.where("batch_ts is not null").select(F.coalesce("feed", F.lit("")).alias("feed"), ts.alias("ts"), F.coalesce("rows", F.lit(0)).alias("rows"))
    return fetches.groupBy("feed").applyInPandasWithState(_counter(threshold), RUN_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def start_counter(
    spark: SparkSession, log_path: str, out_path: str, checkpoint_dir: str, threshold: int = CONSECUTIVE_EMPTY_THRESHOLD, files_per_batch: int | None = None
) -> StreamingQuery:
    """Follow the fetch log (Parquet files) up to what is there now; a later start goes on from there."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    runs = count_empty(reader.parquet(log_path), threshold)
    return runs.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True).start()


def latest_runs(spark: SparkSession, out_path: str, threshold: int = CONSECUTIVE_EMPTY_THRESHOLD) -> DataFrame:
    """The runs as ``empty_batch_runs`` gives them, with the feed in front."""
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    runs = spark.read.schema(RUN_SCHEMA).parquet(out_path).groupBy("feed", "run_start")
    runs = runs.agg(F.max("run_end").alias("run_end"), F.max("empty_batches").alias("empty_batches"), F.min("first_alert_at").alias("first_alert_at"))
    return runs.select("feed", moment("run_start").alias("run_start"), moment("run_end").alias("run_end"), "empty_batches", (F.col("empty_batches") >= threshold).alias("alert"), moment("first_alert_at").alias("first_alert_at"))

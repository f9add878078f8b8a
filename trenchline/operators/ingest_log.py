"""Fetch-log analysis: runs of empty fetches (M1) and the city-local day of
UTC event times (P1 for instants).

The fetch log has one row per fetch (``batch_ts, rows``).  A run of empty
fetches is a gaps-and-islands problem, usually solved with a window over the
whole log in one task.  Here islands are found inside each day of the log (a
window bounded by the fetch cadence) and reduced to one row each; islands
that touch midnight are then joined up through a window over one row per day.
No step puts the whole log into one task, and runs over several days come out
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trenchline.functions.dates import utc_instant_local_day

CONSECUTIVE_EMPTY_THRESHOLD = 3  # fixed value: warn after this many empty fetches in a row


def _islands(log: DataFrame, threshold: int, ts: str) -> DataFrame:
    """One row for each stretch of empty fetches inside a day of the log.

    Fetches of equal time are ordered by their rows (empty ones first) and
    then by the other columns, so the answer does not depend on partitioning."""
    others = [c for c in log.columns if c not in (ts, "rows")]
    day = F.to_date(F.col(ts))
    order = Window.partitionBy("_day").orderBy(ts, "rows", *others)
    b = log.where(F.col(ts).isNotNull()).withColumn("_day", day).withColumn("_ne", (F.coalesce("rows", F.lit(0)) > 0).cast("bigint"))
    b = b.withColumn("_pos", F.row_number().over(order)).withColumn("_island", F.sum("_ne").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # every island starts behind a fetch with rows, but for the first of a day
    nth = F.col("_pos") - F.max(F.when(F.col("_ne") == 1, F.col("_pos")).otherwise(F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("_nth", nth)
    return b.groupBy("_day", "_island").agg(
        F.min(F.when(F.col("_ne") == 0, F.col(ts))).alias("run_start"),
        F.max(F.when(F.col("_ne") == 0, F.col(ts))).alias("run_end"),
        F.count_if(F.col("_ne") == 0).alias("n"),
        # the first few times, as the alert may fall on any of them when the run began on an earlier day
        F.array_sort(F.collect_list(F.when((F.col("_ne") == 0) & (F.col("_nth") <= threshold), F.struct("_nth", F.col(ts).alias("at"))))).alias("first"),
    )


def empty_batch_runs(log: DataFrame, threshold: int = CONSECUTIVE_EMPTY_THRESHOLD, ts: str = "batch_ts") -> DataFrame:
    """M1: every run of consecutive empty fetches -> ``run_start, run_end,
    empty_batches, alert, first_alert_at`` (the fetch at which the counter
    reached ``threshold``; null when it never did)."""
    islands = _islands(log, threshold, ts)
    # one row per day: does it end in an empty stretch, how long is that, and is the whole day empty?
    days = islands.groupBy("_day").agg(F.max("_island").alias("_last"), F.max_by("n", "_island").alias("_tail"))
    whole = F.col("_last") == 0
    in_order = Window.orderBy("_day")
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_fed", F.lag("_tail").over(in_order) > 0)
    # the day (and island) in which the stretch at the end of this day began
    start = F.when(whole & F.coalesce("_fed", F.lit(False)), F.lit(None)).otherwise(F.struct(F.col("_day").alias("d"), F.col("_last").alias("i")))
    days = days.withColumn("_start", start).withColumn("_sum", F.sum("_tail").over(in_order))
    # stretches of whole empty days add up: the sum of tails before this day, less that before the day of their start
    anchor = F.when(F.col("_start").isNotNull(), F.col("_sum") - F.col("_tail"))
    days = days.withColumn("_anchor", anchor)
    days = days.select(
        "_day",
        F.when(F.col("_fed"), F.last("_start", ignorenulls=True).over(before)).alias("_from"),
        F.when(F.col("_fed"), F.col("_sum") - F.col("_tail") - F.last("_anchor", ignorenulls=True).over(before)).alias("_carried"),
    )
    parts = islands.where("n > 0").join(days, "_day")
    goes_on = (F.col("_island") == 0) & F.col("_from").isNotNull()
    carried = F.when(goes_on, F.col("_carried")).otherwise(F.lit(0))
    own = F.struct(F.col("_day").alias("d"), F.col("_island").alias("i"))
    left = F.lit(threshold) - F.col("carried")
    parts = parts.withColumn("run", F.when(goes_on, F.col("_from")).otherwise(own)).withColumn("carried", carried)
    hit = F.when((left >= 1) & (F.col("n") >= left), F.element_at("first", F.greatest(left, F.lit(1)).cast("int"))["at"])
    runs = parts.withColumn("hit", hit).groupBy("run").agg(
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("n").alias("empty_batches"), F.min("hit").alias("first_alert_at")
    )
    return runs.select("run_start", "run_end", "empty_batches", (F.col("empty_batches") >= threshold).alias("alert"), "first_alert_at")


def current_empty_run(log: DataFrame, threshold: int = CONSECUTIVE_EMPTY_THRESHOLD, ts: str = "batch_ts") -> DataFrame:
    """The no-data counter: one row ``empty_batches, alert`` for the fetches
    since the last one with rows (two small aggregates, no window)."""
    last = log.select(F.max(F.when(F.col("rows") > 0, F.col(ts)))).scalar()
    since = log.where(F.col(ts).isNotNull() & (last.isNull() | (F.col(ts) > last)))
    return since.agg(F.count(F.lit(1)).alias("empty_batches")).withColumn("alert", F.col("empty_batches") >= threshold)


def events_by_local_day(events: DataFrame, flag_type: str = "error") -> DataFrame:
    """P1 for UTC instants: ``local_day, n_events, n_flagged`` in city time."""
    return events.groupBy(utc_instant_local_day("ts").alias("local_day")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == F.lit(flag_type)).alias("n_flagged"),
    )

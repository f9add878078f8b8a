"""Day-level statistics: totals, series, records and the weekday comparison.

The reference answers each of these for one day ("yesterday").  Here every
operator is generalised to a day range (default: all days of the table), the
single-day answer being the row of that day.  All permit-level work is one
hash aggregate keyed by day (partial aggregation before the shuffle, so a day
holding a third of all rows costs no more than any other); everything after
it runs on one row per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trenchline.functions.dates import as_date, day_range_filter, local_day, weekday_name

DAY = "day"
ROLLING_WINDOW_DAYS = 730  # fixed value: history window of the comparison


def _in_range(permits: DataFrame, start=None, end=None, ts: str = "dig_date") -> DataFrame:
    """Rows with a day, in the range (rows without a date belong to no day)."""
    permits = permits.where(F.col(ts).isNotNull())
    cond = day_range_filter(ts, start, end)
    return permits if cond is None else permits.where(cond)


def daily_stats(permits: DataFrame, start=None, end=None) -> DataFrame:
    """A1: per day, permits, emergency permits, regular permits, distinct streets."""
    p = _in_range(permits, start, end)
    return (
        p.groupBy(local_day("dig_date").alias(DAY))
        .agg(
            F.count(F.lit(1)).alias("total_permits"),
            F.count_if(F.col("is_emergency")).alias("emergency_permits"),
            F.countDistinct("street_name").alias("unique_streets"),
        )
        .select(
            DAY,
            "total_permits",
            "emergency_permits",
            (F.col("total_permits") - F.col("emergency_permits")).alias("regular_permits"),
            "unique_streets",
        )
    )


def daily_counts(permits: DataFrame, start=None, end=None) -> DataFrame:
    """A2: per day with at least one permit: total and emergency counts."""
    p = _in_range(permits, start, end)
    return p.groupBy(local_day("dig_date").alias(DAY)).agg(
        F.count(F.lit(1)).alias("total_permits"),
        F.count_if(F.col("is_emergency")).alias("emergency_permits"),
    )


def day_spine(counts: DataFrame, start=None, end=None, lookback_days: int = 0) -> DataFrame:
    """Every calendar day of [start - lookback, end]; open ends come from the data.

    Built from one aggregate row, so its size is the length of the range, not
    the number of permits.
    """
    if start is not None and end is not None:
        lo, hi = as_date(start), as_date(end)
        base = counts.sparkSession.range(1)
    else:
        base = counts.agg(F.min(DAY).alias("lo"), F.max(DAY).alias("hi"))
        lo = as_date(start) if start is not None else F.col("lo")
        hi = as_date(end) if end is not None else F.col("hi")
    lo = F.date_sub(lo, lookback_days) if lookback_days else lo
    return base.select(F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))).alias(DAY))


def dense_days(counts: DataFrame, value_cols: list[str]) -> DataFrame:
    """Per-day rows -> every calendar day from the first to the last, with
    ``value_cols`` null on the days that had no row.

    Each day row is expanded up to the day before the next one (``lead`` over
    the per-day table, which holds one row per calendar day at most), so the
    gaps are filled without a min/max pass or a join: the permit scan behind
    ``counts`` runs once.
    """
    nxt = F.lead(DAY).over(Window.orderBy(DAY))
    seg = counts.select(DAY, *value_cols, nxt.alias("_next"))
    upto = F.coalesce(F.date_sub(F.col("_next"), 1), F.col(DAY))
    filled = seg.select(F.explode(F.sequence(F.col(DAY), upto, F.expr("INTERVAL 1 DAY"))).alias("_d"), DAY, *value_cols)
    first = F.col("_d") == F.col(DAY)
    return filled.select(F.col("_d").alias(DAY), *[F.when(first, F.col(c)).alias(c) for c in value_cols])


def daily_series(permits: DataFrame, start=None, end=None, last_days: int | None = None, as_of=None) -> DataFrame:
    """``date, regular_tickets, emergency_tickets`` for every day of the range,
    zero on days without permits (the chart input).

    ``last_days``: the days after ``as_of`` minus so many, up to ``as_of``
    (default: the latest dig day of the table)."""
    from trenchline.operators.quality import TIMESTAMPS, require_columns

    require_columns(permits, {"dig_date": TIMESTAMPS, "is_emergency": ("boolean",)})
    if last_days is not None:
        if start is not None or end is not None:
            raise ValueError("a series takes a range of days or a number of last days")
        counts = daily_counts(permits)
        latest = as_date(as_of) if as_of is not None else F.max(DAY)
        # one row with the range, joined with one row a day
        span = counts.agg(latest.alias("hi")).where("hi is not null")
        days = span.select(F.explode(F.sequence(F.date_sub("hi", last_days - 1), F.col("hi"), F.expr("INTERVAL 1 DAY"))).alias(DAY))
        days = days.join(counts, DAY, "left")
        return _series(days)
    counts = daily_counts(permits, start, end)
    if start is None and end is None:
        days = dense_days(counts, ["total_permits", "emergency_permits"])
    else:
        days = day_spine(counts, start, end).join(counts, DAY, "left")
    return _series(days)


def _series(days: DataFrame) -> DataFrame:
    return days.select(
        F.col(DAY).alias("date"),
        (F.coalesce("total_permits", F.lit(0)) - F.coalesce("emergency_permits", F.lit(0))).alias("regular_tickets"),
        F.coalesce("emergency_permits", F.lit(0)).alias("emergency_tickets"),
    )


def latest_day(series: DataFrame) -> DataFrame:
    """The last row of a daily series (one row), without sorting the series."""
    row = series.agg(F.max_by(F.struct(*series.columns), F.col("date")).alias("r"))
    return row.select("r.*")


def daily_records(permits: DataFrame, start=None, end=None) -> DataFrame:
    """The day with most permits and the day with most emergency permits.

    Ties go to the earliest day.  ``min_by`` over (-count, day) is an ordinary
    aggregate: partial per task, one row after the shuffle.
    """
    c = daily_counts(permits, start, end)
    agg = c.agg(
        F.min_by(DAY, F.struct(-F.col("total_permits"), F.col(DAY))).alias("d1"),
        F.max("total_permits").alias("n1"),
        F.min_by(DAY, F.struct(-F.col("emergency_permits"), F.col(DAY))).alias("d2"),
        F.max("emergency_permits").alias("n2"),
    )
    return agg.selectExpr("stack(2, 'most_tickets', d1, n1, 'most_emergency', d2, n2) as (record, day, count)")


def permit_summary(permits: DataFrame | None, start=None, end=None, counts: DataFrame | None = None) -> DataFrame:
    """A10: per day, total / emergency / regular counts and the emergency share
    in percent (unrounded; null when there are no permits).  ``counts``: day
    counts that are there already."""
    if counts is None:
        c = daily_counts(permits, start, end)
    else:
        c = counts.where(F.col(DAY).between(as_date(start or "0001-01-01"), as_date(end or "9999-12-31")))
    return c.select(
        DAY,
        F.col("total_permits").alias("total_count"),
        F.col("emergency_permits").alias("emergency_count"),
        (F.col("total_permits") - F.col("emergency_permits")).alias("regular_count"),
        F.try_divide(F.col("emergency_permits") * F.lit(100.0), F.col("total_permits")).alias("emergency_percent"),
    )


def _pct(actual, avg):
    return F.when(avg > 0, (actual - avg) / avg * F.lit(100.0)).when(avg.isNotNull(), F.lit(0.0))


def weekday_comparison(
    permits: DataFrame | None,
    start=None,
    end=None,
    window_days: int = ROLLING_WINDOW_DAYS,
    min_history_days: int | None = None,
    holidays: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Each day against the average of the same weekday in [day - window, day).

    History averages count only days that had permits (empty days are null in
    the spine, so AVG skips them).  A day without permits still gets a row:
    actual 0, the usual average, -100 %.  With no history the averages and
    the changes are 0.  ``min_history_days``: averages and changes become null
    when fewer history days exist.  ``holidays`` (a frame with a ``day`` column) are left
    out of the history.  ``counts``: day counts that are there already (see
    ``day_counts``), used instead of counting ``permits``.

    Plan: the permit scan feeds one hash aggregate by day; the window then runs
    on one row per calendar day (7 weekday partitions), which is small at any
    data size.
    """
    counts = daily_counts(permits) if counts is None else counts
    if start is not None or end is not None:
        # the history of `start` reaches window_days back; keep that range only
        lo = F.date_sub(as_date(start), window_days) if start is not None else None
        counts = counts.where((F.col(DAY) >= lo) if lo is not None else F.lit(True))
        if end is not None:
            counts = counts.where(F.col(DAY) <= as_date(end))
    if start is None and end is None:
        days = dense_days(counts, ["total_permits", "emergency_permits"])
    else:
        spine = day_spine(counts, start, end, lookback_days=window_days if start is not None else 0)
        days = spine.join(counts, DAY, "left")
    h_total, h_emergency = F.col("total_permits"), F.col("emergency_permits")
    if holidays is not None:
        # holiday days stay in the output but leave the history (null -> AVG skips)
        flags = holidays.select(F.col(DAY).cast("date").alias(DAY)).distinct().withColumn("_holiday", F.lit(True))
        days = days.join(flags, DAY, "left")
        h_total = F.when(F.col("_holiday").isNull(), h_total)
        h_emergency = F.when(F.col("_holiday").isNull(), h_emergency)
    days = days.withColumn("h_total", h_total).withColumn("h_emergency", h_emergency)
    w = Window.partitionBy(F.dayofweek(DAY)).orderBy(F.unix_date(DAY)).rangeBetween(-window_days, -1)
    with_hist = days.select(
        DAY,
        F.coalesce("total_permits", F.lit(0)).alias("actual_total"),
        F.coalesce("emergency_permits", F.lit(0)).alias("actual_emergency"),
        F.avg("h_total").over(w).alias("avg_t"),
        F.avg("h_emergency").over(w).alias("avg_e"),
        F.count("h_total").over(w).alias("num_days"),
    )
    if start is not None:
        with_hist = with_hist.where(F.col(DAY) >= as_date(start))
    none_yet = F.col("num_days") == 0
    avg_t = F.when(none_yet, F.lit(0.0)).otherwise(F.col("avg_t"))
    avg_e = F.when(none_yet, F.lit(0.0)).otherwise(F.col("avg_e"))
    if min_history_days is not None:
        short = F.col("num_days") < min_history_days
        avg_t = F.when(short, F.lit(None).cast("double")).otherwise(avg_t)
        avg_e = F.when(short, F.lit(None).cast("double")).otherwise(avg_e)
    out = with_hist.select(
        DAY,
        weekday_name(DAY).alias("day_name"),
        "actual_total",
        "actual_emergency",
        (F.col("actual_total") - F.col("actual_emergency")).alias("actual_regular"),
        avg_t.alias("avg_total"),
        avg_e.alias("avg_emergency"),
        "num_days",
    ).withColumn("avg_regular", F.col("avg_total") - F.col("avg_emergency"))
    return out.select(
        DAY,
        "day_name",
        "actual_total",
        "actual_emergency",
        "actual_regular",
        "avg_total",
        "avg_emergency",
        "avg_regular",
        "num_days",
        _pct(F.col("actual_total"), F.col("avg_total")).alias("total_diff_percent"),
        _pct(F.col("actual_emergency"), F.col("avg_emergency")).alias("emergency_diff_percent"),
        _pct(F.col("actual_regular"), F.col("avg_regular")).alias("regular_diff_percent"),
    )

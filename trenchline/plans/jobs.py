"""End-to-end jobs composed from the operators (E1 daily update, E2 full
refresh, E4 random permit post).

A job is one driver program: the few actions it runs are gates (one-row
aggregates) and table commits; every report is a lazy DataFrame over the
merged table, left for the caller to write or show.  Network fetch and
posting are out of scope: jobs start from landed files and end with text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trenchline.operators import cards, daily, day_counts, geo, ingest_log, normalize, pages, quality, rankings, sampling, table
from trenchline.sources import files
from trenchline.streaming import ingest


@dataclass
class DailyOutputs:
    version: int | None
    merge_report: DataFrame | None
    comparison: DataFrame
    summary: DataFrame
    leaderboard: DataFrame
    report_text: DataFrame
    leaderboard_text: DataFrame
    points: DataFrame
    no_data: DataFrame | None  # the counter of empty fetches, if there is a log


def daily_update(
    spark: SparkSession,
    target: table.PermitTable,
    batch_path: str,
    day,
    now=None,
    family: str = "api",
    min_rows: int = quality.MIN_ROWS_DAILY_UPDATE,
    multi_line: bool = False,
    log_path: str | None = None,
) -> DailyOutputs:
    """Landed feed -> conform -> gate -> merge by ticket -> reports for ``day``.

    Reports are computed on the merged table (the reference computed them on
    the last batch only): the day's rows from its month, the comparison from
    the kept day counts.  The feed is read once; the gate uses counts observed
    while it is landed.  An empty fetch is normal: it is logged (if
    ``log_path`` is given) and changes nothing.  Rows sent again without a
    change stay as they are, and a batch without any change skips the commit."""
    feed = f"staging/{uuid.uuid4().hex}"
    seen: dict = {}

    def check(metrics: dict) -> None:
        seen.update(metrics)
        if log_path is not None:
            ingest.append_log(spark, log_path, None, now, metrics["n_rows"], family)
        if metrics["n_rows"]:
            quality.check_gate(quality.gate_row(metrics, min_rows))

    try:
        if family == "api":
            raw = files.with_arrival(files.read_permits_json(spark, batch_path, multi_line))
        else:
            raw = files.land_csv(spark, batch_path, f"{target.root}/{feed}", multi_line)
        batch = normalize.conform(raw, keep_extra=True)
        version, report = table.merge_batch(target, batch, now=now, check=check, skip_unchanged=True)
    finally:
        target.drop_folder(feed)
    if not seen["n_rows"]:
        report = None
    merged = target.read(start=day, end=day)  # one day of one month
    counts = day_counts.read(target)
    comparison = daily.weekday_comparison(None, start=day, end=day, counts=counts)
    by_day = rankings.leaderboard_by_day(merged, k=5)
    return DailyOutputs(
        version=version,
        merge_report=report,
        comparison=comparison,
        summary=daily.permit_summary(None, start=day, end=day, counts=counts),
        leaderboard=rankings.leaderboard(merged, k=5),
        report_text=cards.report_texts(comparison),
        leaderboard_text=cards.leaderboard_texts(by_day),
        points=geo.map_points(merged),
        no_data=None if log_path is None else ingest_log.current_empty_run(ingest.read_fetch_log(spark, log_path, family)),
    )


def full_refresh_job(
    spark: SparkSession, target: table.PermitTable, csv_path: str, now=None, min_rows: int = quality.MIN_ROWS_FULL_REFRESH
) -> int:
    """Bulk CSV -> conform -> gate -> new table version (old one stays).

    The feed is parsed once.  The gate and the count of the stored rows (A9)
    come from counts observed in the writing pass and decide before the
    version is published."""
    feed = f"staging/{uuid.uuid4().hex}"
    try:
        permits = normalize.conform(files.land_csv(spark, csv_path, f"{target.root}/{feed}"), keep_extra=True)
        version = table.full_refresh(target, permits, now=now, check=lambda m: quality.check_gate(quality.gate_row(m, min_rows)))
    finally:
        target.drop_folder(feed)
    day_counts.refresh(target, version)
    return version


def random_permit_posts(permits: DataFrame, stored_pages: DataFrame | None = None, seed: int = 42, start=None, end=None) -> DataFrame:
    """Per dig day, one repeatable pseudo-random permit, its card and post
    text; the dig location comes from its stored page when there is one
    (``page_id`` = ticket)."""
    cond = None
    if start is not None or end is not None:
        from trenchline.functions.dates import day_range_filter

        cond = day_range_filter("dig_date", start, end)
    p = permits if cond is None else permits.where(cond)
    picked = sampling.sampled_permits(p, k=1, seed=seed)
    locs = None
    if stored_pages is not None:
        locs = pages.page_fields(stored_pages).select(
            F.col("page_id").cast("string").alias("dig_ticket_number"), F.col("location_of_dig").alias("location")
        )
    return cards.card_texts(cards.permit_cards(picked), locs)

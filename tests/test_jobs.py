"""End-to-end jobs: full refresh from CSV, daily update from JSON, random permit post."""

from pyspark.sql import functions as F

from trenchline.operators import table
from trenchline.plans import jobs
from trenchline.session import scratch_path
from trenchline.sources import files, fixtures
from conftest import SF_SMALL


def test_refresh_then_daily_update(spark, permits_small):
    base = scratch_path(spark, "jobs")
    files.write_csv(fixtures.raw_feed(permits_small, "csv"), f"{base}/bulk")
    t = table.PermitTable(spark, f"{base}/table")
    assert jobs.full_refresh_job(spark, t, f"{base}/bulk", now="2024-01-01 00:00:00") == 1
    day = permits_small.agg(F.max(F.to_date("dig_date"))).first()[0]
    recent = permits_small.where(F.to_date("dig_date") >= F.date_sub(F.lit(day), 30))
    files.write_json_lines(fixtures.raw_feed(recent, "api"), f"{base}/landing")
    out = jobs.daily_update(spark, t, f"{base}/landing", day=day, now="2024-01-02 00:00:00")
    assert out.version == 2
    rep = out.merge_report.first()
    assert rep.inserts == 0 and rep.updates == rep.batch_rows == recent.count()
    c = out.comparison.first()
    assert c.day == day and c.actual_total == recent.where(F.to_date("dig_date") == F.lit(day)).count()
    assert out.report_text.first().text.count("\n") == 9
    assert t.read().count() == permits_small.count()


def test_random_permit_posts(spark, permits_small):
    pg = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    posts = jobs.random_permit_posts(permits_small, pg, seed=7)
    n_days = permits_small.where("dig_date is not null").select(F.to_date("dig_date")).distinct().count()
    rows = posts.collect()
    assert len(rows) == n_days
    assert all(r.text.endswith(f"#{r.dig_ticket_number}") or "Emergency" in r.text for r in rows)

"""Registered end-to-end jobs (E1 daily update, E2 full refresh, E4 random permit post)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import table
from trenchline.plans import jobs
from trenchline.plans.catalog import permits, register, with_permits
from trenchline.plans.queries_daily import WEEKDAY_SQL
from trenchline.plans.queries_table import AUDIT_STAMPS, CSV_SQL, T0, T1, UPSERT_CTES
from trenchline.plans.queries_text import SAMPLE_SQL, card_text_sql
from trenchline.session import scratch_path
from trenchline.sources import files, fixtures
from trenchline.sources.fixtures import PERMITS_SQL


@register(
    "job_full_refresh",
    f"select *, timestamp '{T0}' as created_at, timestamp '{T0}' as updated_at from ({CSV_SQL}) c",
    stamps=AUDIT_STAMPS,
)
def q_job_full_refresh(spark, sf):
    """The bulk CSV export through the refresh job, gate and count of the stored rows included."""
    base = scratch_path(spark, "job")
    files.write_csv(fixtures.raw_feed(permits(spark, sf), "csv"), f"{base}/bulk")
    t = table.PermitTable(spark, f"{base}/table")
    jobs.full_refresh_job(spark, t, f"{base}/bulk", now=T0)
    return t.read()


# the weekday comparison over the merged permits, for their last day
MERGED_CTES = (
    f"base as ({PERMITS_SQL}),\n"
    + UPSERT_CTES.replace("from permits", "from base")
    + """,
permits as (
  select * exclude (created_at, updated_at) from existing where dig_ticket_number not in (select dig_ticket_number from latest)
  union all select * from latest)"""
)
JOB_SQL = f"""with {MERGED_CTES}
select day, day_name, actual_total, actual_emergency, actual_regular, avg_total, avg_emergency, avg_regular, num_days,
       total_diff_percent, emergency_diff_percent, regular_diff_percent
from ({WEEKDAY_SQL.replace(f"with permits as ({PERMITS_SQL}),", "with")}) w
where day = (select max(cast(dig_date as date)) from permits)"""


@register("job_daily_update", JOB_SQL, dates=["day"])
def q_job_daily_update(spark, sf):
    """A full refresh, then a daily feed with new, changed and repeated
    tickets through the update job; its comparison for the last day."""
    base = scratch_path(spark, "job")
    existing, batch = fixtures.upsert_inputs(permits(spark, sf))
    files.write_csv(fixtures.raw_feed(existing, "csv"), f"{base}/bulk")
    for arrival in (1, 2):  # copies of a ticket in the order they were sent
        files.write_json_lines(fixtures.raw_feed(batch.where(F.col("arrival") == arrival), "api"), f"{base}/landing/{arrival}")
    t = table.PermitTable(spark, f"{base}/table")
    jobs.full_refresh_job(spark, t, f"{base}/bulk", now=T0)
    day = permits(spark, sf).agg(F.max(F.to_date("dig_date"))).first()[0]
    return jobs.daily_update(spark, t, f"{base}/landing/*", day=day, now=T1).comparison


@register(
    "job_random_permits",
    f"""
select c.* from ({card_text_sql("select '' as dig_ticket_number, '' as location where false")}) c
join ({with_permits(SAMPLE_SQL)}) s on s.dig_ticket_number = c.dig_ticket_number
where s.rn = 1""",
)
def q_job_random_permits(spark, sf):
    """The post of one sampled permit of every dig day, with the location of
    its stored page (no test page has one)."""
    out = jobs.random_permit_posts(permits(spark, sf), fixtures.table(spark, sf, "pages"))
    return out.withColumn("byte_start", F.col("byte_start").cast("bigint")).withColumn("byte_end", F.col("byte_end").cast("bigint"))

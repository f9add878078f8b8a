"""Registered day-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import daily, day_counts, quality, table
from trenchline.plans.catalog import permits, register, with_permits
from trenchline.session import scratch_path

DAILY_COUNTS_CTE = """dc as (
  select cast(dig_date as date) as day,
         count(*) as total_permits,
         count_if(is_emergency) as emergency_permits
  from permits where dig_date is not null group by 1)"""

SPINE_CTE = """spine as (
  select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from dc)"""


@register(
    "daily_stats",
    with_permits(
        """
select cast(dig_date as date) as day,
       cast(count(*) as bigint) as total_permits,
       cast(count_if(is_emergency) as bigint) as emergency_permits,
       cast(count(*) - count_if(is_emergency) as bigint) as regular_permits,
       cast(count(distinct street_name) as bigint) as unique_streets
from permits where dig_date is not null group by 1"""
    ),
    dates=["day"],
)
def q_daily_stats(spark, sf):
    return daily.daily_stats(permits(spark, sf))


@register(
    "daily_counts",
    with_permits(
        """
select cast(dig_date as date) as day,
       cast(count(*) as bigint) as total_permits,
       cast(count_if(is_emergency) as bigint) as emergency_permits
from permits where dig_date is not null group by 1"""
    ),
    dates=["day"],
)
def q_daily_counts(spark, sf):
    return daily.daily_counts(permits(spark, sf))


@register(
    "daily_series",
    with_permits(
        """
select s.day as date,
       cast(coalesce(dc.total_permits, 0) - coalesce(dc.emergency_permits, 0) as bigint) as regular_tickets,
       cast(coalesce(dc.emergency_permits, 0) as bigint) as emergency_tickets
from spine s left join dc on dc.day = s.day""",
        DAILY_COUNTS_CTE + ",\n" + SPINE_CTE,
    ),
    dates=["date"],
)
def q_daily_series(spark, sf):
    return daily.daily_series(permits(spark, sf))


@register(
    "latest_day",
    with_permits(
        """
select s.day as date,
       cast(coalesce(dc.total_permits, 0) - coalesce(dc.emergency_permits, 0) as bigint) as regular_tickets,
       cast(coalesce(dc.emergency_permits, 0) as bigint) as emergency_tickets
from spine s left join dc on dc.day = s.day
where s.day = (select max(day) from spine)""",
        DAILY_COUNTS_CTE + ",\n" + SPINE_CTE,
    ),
    dates=["date"],
)
def q_latest_day(spark, sf):
    return daily.latest_day(daily.daily_series(permits(spark, sf)))


@register(
    "daily_records",
    with_permits(
        """
select 'most_tickets' as record, day, cast(total_permits as bigint) as count
from (select * from dc order by total_permits desc, day limit 1) a
union all
select 'most_emergency' as record, day, cast(emergency_permits as bigint) as count
from (select * from dc order by emergency_permits desc, day limit 1) b""",
        DAILY_COUNTS_CTE,
    ),
    dates=["day"],
)
def q_daily_records(spark, sf):
    return daily.daily_records(permits(spark, sf))


@register(
    "permit_summary",
    with_permits(
        """
select day,
       cast(total_permits as bigint) as total_count,
       cast(emergency_permits as bigint) as emergency_count,
       cast(total_permits - emergency_permits as bigint) as regular_count,
       emergency_permits * 100e0 / total_permits as emergency_percent
from dc""",
        DAILY_COUNTS_CTE,
    ),
    dates=["day"],
)
def q_permit_summary(spark, sf):
    return daily.permit_summary(permits(spark, sf))


WEEKDAY_SQL = with_permits(
    """
select day, dayname(day) as day_name,
       actual_total, actual_emergency, actual_total - actual_emergency as actual_regular,
       avg_total, avg_emergency, avg_total - avg_emergency as avg_regular, num_days,
       case when avg_total > 0 then (actual_total - avg_total) / avg_total * 100e0 else 0e0 end as total_diff_percent,
       case when avg_emergency > 0 then (actual_emergency - avg_emergency) / avg_emergency * 100e0 else 0e0 end
         as emergency_diff_percent,
       case when avg_total - avg_emergency > 0
            then ((actual_total - actual_emergency) - (avg_total - avg_emergency)) / (avg_total - avg_emergency) * 100e0
            else 0e0 end as regular_diff_percent
from (
  select day, actual_total, actual_emergency, num_days,
         case when num_days = 0 then 0e0 else avg_t end as avg_total,
         case when num_days = 0 then 0e0 else avg_e end as avg_emergency
  from (
    select s.day,
           cast(coalesce(c.total_permits, 0) as bigint) as actual_total,
           cast(coalesce(c.emergency_permits, 0) as bigint) as actual_emergency,
           avg(h.total_permits) as avg_t, avg(h.emergency_permits) as avg_e,
           cast(count(h.total_permits) as bigint) as num_days
    from spine s
    left join dc c on c.day = s.day
    left join dc h on dayofweek(h.day) = dayofweek(s.day) and h.day < s.day and h.day >= s.day - 730
    group by s.day, c.total_permits, c.emergency_permits) x) y""",
    DAILY_COUNTS_CTE + ",\n" + SPINE_CTE,
)


@register(
    "series_last_days",
    with_permits(
        """
select s.day as date,
       cast(coalesce(dc.total_permits, 0) - coalesce(dc.emergency_permits, 0) as bigint) as regular_tickets,
       cast(coalesce(dc.emergency_permits, 0) as bigint) as emergency_tickets
from spine s left join dc on dc.day = s.day
where s.day > (select max(day) from dc) - 30""",
        DAILY_COUNTS_CTE + ",\n" + SPINE_CTE,
    ),
    dates=["date"],
)
def q_series_last_days(spark, sf):
    """The last 30 days of the series; the input must have rows."""
    return daily.daily_series(quality.require_rows(permits(spark, sf)), last_days=30)


# days off, as month and day
HOLIDAYS = ["01-01", "07-04", "12-25"]
HISTORY_SQL = (
    WEEKDAY_SQL.replace(
        "left join dc h on",
        f"left join (select * from dc where strftime(day, '%m-%d') not in ({', '.join(repr(d) for d in HOLIDAYS)})) h on",
    )
    .replace("case when num_days = 0 then 0e0 else avg_t end", "case when num_days < 60 then null when num_days = 0 then 0e0 else avg_t end")
    .replace("case when num_days = 0 then 0e0 else avg_e end", "case when num_days < 60 then null when num_days = 0 then 0e0 else avg_e end")
    .replace("100e0 else 0e0 end", "100e0 when avg_total is not null then 0e0 end")
    .replace("            else 0e0 end as regular_diff_percent", "            when avg_total is not null then 0e0 end as regular_diff_percent")
)


@register("weekday_comparison_history", HISTORY_SQL, dates=["day"])
def q_weekday_comparison_history(spark, sf):
    """The comparison with holidays left out of the history, null below 60 days of history."""
    p = permits(spark, sf)
    days = daily.dense_days(daily.daily_counts(p), [])
    holidays = days.where(F.date_format("day", "MM-dd").isin(HOLIDAYS))
    return daily.weekday_comparison(p, min_history_days=60, holidays=holidays)


@register("weekday_comparison_kept", WEEKDAY_SQL, dates=["day"])
def q_weekday_comparison_kept(spark, sf):
    """The comparison from the day counts kept beside a table, brought
    up to date for the months that a merge has touched."""
    t = table.PermitTable(spark, scratch_path(spark, "table"))
    p = permits(spark, sf)
    early = p.where("dig_date < timestamp_ntz '1998-01-01' or dig_date is null")
    table.full_refresh(t, early, now="2024-01-01 00:00:00")
    day_counts.refresh(t)
    rest = p.where("dig_date >= timestamp_ntz '1998-01-01'").withColumn("arrival", F.lit(1))
    table.merge_batch(t, rest, now="2024-02-01 00:00:00")
    return daily.weekday_comparison(None, counts=day_counts.read(t))


@register("weekday_comparison", WEEKDAY_SQL, dates=["day"])
def q_weekday_comparison(spark, sf):
    return daily.weekday_comparison(permits(spark, sf))

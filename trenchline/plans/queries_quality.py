"""Registered checks, profiles and fetch-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import ingest_log, normalize, quality
from trenchline.plans.catalog import permits, register, with_permits
from trenchline.schema import PERMIT_SCHEMA, REQUIRED_COLUMNS
from trenchline.session import scratch_path
from trenchline.sources.fixtures import ingest_log_from_events, raw_feed, table
from trenchline.streaming import no_data


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


@register(
    "schema_check",
    with_permits(
        _union(
            [
                f"select '{c}' as column_name, true as present, cast(count(*) as bigint) as n_rows, "
                f"cast(count({c}) as bigint) as n_non_null from permits"
                for c in REQUIRED_COLUMNS
            ]
        )
    ),
)
def q_schema_check(spark, sf):
    """Required columns present, with their non-null counts."""
    return quality.schema_check(permits(spark, sf))


ABSENT = ["dig_location", "longitude"]


@register(
    "missing_columns",
    with_permits(
        _union(
            [
                f"select '{c}' as column_name, {str(c not in ABSENT).lower()} as present, cast(count(*) as bigint) as n_rows, "
                + ("cast(0 as bigint)" if c in ABSENT else f"cast(count({c}) as bigint)")
                + " as n_non_null from permits"
                for c in REQUIRED_COLUMNS
            ]
        )
    ),
)
def q_missing_columns(spark, sf):
    """The required columns of a feed that lacks two of them."""
    feed = normalize.rename_source_fields(raw_feed(permits(spark, sf), "api"))
    return quality.schema_check(feed.drop(*ABSENT))


@register(
    "quality_gate",
    with_permits(
        f"""
select cast(count(*) as bigint) as n_rows, cast(count(*) - count(dig_ticket_number) as bigint) as null_keys,
       true as has_key_column, cast({quality.MIN_ROWS_FULL_REFRESH} as bigint) as min_rows,
       count(*) > 0 and count(*) >= {quality.MIN_ROWS_FULL_REFRESH} as passed
from permits"""
    ),
)
def q_quality_gate(spark, sf):
    """The full-refresh gate (key column present, at least 100 rows)."""
    return quality.quality_gate(permits(spark, sf), min_rows=quality.MIN_ROWS_FULL_REFRESH)


@register(
    "profile",
    with_permits(
        _union(
            [
                f"select '{f.name}' as column_name, '{f.dataType.simpleString()}' as data_type, "
                f"cast(count(*) as bigint) as n_rows, cast(count(*) - count({f.name}) as bigint) as n_null, "
                f"case when count(*) > 0 then (count(*) - count({f.name})) * 100e0 / count(*) else 0e0 end as null_pct "
                f"from permits"
                for f in PERMIT_SCHEMA.fields
            ]
        )
    ),
)
def q_profile(spark, sf):
    """Type and null share of every column."""
    return quality.profile(permits(spark, sf))


PROFILE_VALUES_SQL = with_permits(
    f"""
select column_name, value, frequency, rank from (
  select c.column_name, c.value, c.frequency,
         cast(row_number() over (partition by c.column_name order by c.frequency desc, c.value) as bigint) as rank
  from c join d on d.column_name = c.column_name
  where d.n <= {quality.PROFILE_MAX_DISTINCT}) r
where rank <= {quality.PROFILE_TOP_VALUES}""",
    "v as ("
    + _union([f"select '{f.name}' as column_name, cast({f.name} as varchar) as value from permits" for f in PERMIT_SCHEMA.fields])
    + """),
c as (select column_name, value, cast(count(*) as bigint) as frequency from v where value is not null group by 1, 2),
d as (select column_name, count(*) as n from c group by 1)""",
)


@register("profile_values", PROFILE_VALUES_SQL)
def q_profile_values(spark, sf):
    """Commonest values of every column with at most 10 distinct values."""
    return quality.profile_values(permits(spark, sf))


INGEST_LOG_SQL = """
ev as (select time_bucket(interval '5 minutes', ts) as batch_ts, count(*) as n from events group by 1),
spine as (select unnest(generate_series(min(batch_ts), max(batch_ts), interval '5 minutes')) as batch_ts from ev),
log as (select s.batch_ts, cast(coalesce(ev.n, 0) as bigint) as rows from spine s left join ev on ev.batch_ts = s.batch_ts)"""


@register(
    "empty_batch_runs",
    f"""
with {INGEST_LOG_SQL.strip()},
b as (select batch_ts, rows, row_number() over (order by batch_ts) - 1 as g,
             coalesce(sum(case when rows > 0 then 1 else 0 end)
                      over (order by batch_ts rows between unbounded preceding and 1 preceding), 0) as ne_before
      from log),
runs as (select ne_before as run_key, min(batch_ts) as run_start, max(batch_ts) as run_end,
                cast(count(*) as bigint) as empty_batches, min(g) as g0
         from b where rows = 0 group by 1)
select run_start, run_end, empty_batches, empty_batches >= {ingest_log.CONSECUTIVE_EMPTY_THRESHOLD} as alert,
       b.batch_ts as first_alert_at
from runs left join b on runs.empty_batches >= {ingest_log.CONSECUTIVE_EMPTY_THRESHOLD}
                     and b.g = runs.g0 + {ingest_log.CONSECUTIVE_EMPTY_THRESHOLD - 1}""",
    stamps=["run_start", "run_end", "first_alert_at"],
)
def q_empty_batch_runs(spark, sf):
    """M1: runs of empty 5-minute fetches in the event feed, with the alert point."""
    return ingest_log.empty_batch_runs(ingest_log_from_events(table(spark, sf, "events")))


@register(
    "stream_empty_runs",
    f"""
with {INGEST_LOG_SQL.strip()},
b as (select batch_ts, rows, row_number() over (order by batch_ts) - 1 as g,
             coalesce(sum(case when rows > 0 then 1 else 0 end)
                      over (order by batch_ts rows between unbounded preceding and 1 preceding), 0) as ne_before
      from log)
select 'events' as feed, min(batch_ts) as run_start, max(batch_ts) as run_end, cast(count(*) as bigint) as empty_batches,
       count(*) >= {ingest_log.CONSECUTIVE_EMPTY_THRESHOLD} as alert,
       case when count(*) >= {ingest_log.CONSECUTIVE_EMPTY_THRESHOLD}
            then list_sort(list(batch_ts))[{ingest_log.CONSECUTIVE_EMPTY_THRESHOLD}] end as first_alert_at
from b where rows = 0 group by ne_before""",
    stamps=["run_start", "run_end", "first_alert_at"],
)
def q_stream_empty_runs(spark, sf):
    """The no-data counter as stream state, over a fetch log that lands
    in two parts; the stream is started anew for the second one."""
    base = scratch_path(spark, "no-data")
    log = ingest_log_from_events(table(spark, sf, "events")).withColumns({"feed": F.lit("events"), "batch_id": F.lit(None).cast("bigint")})
    half = F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
    for part in (log.where(F.col("batch_ts") < half), log.where(F.col("batch_ts") >= half)):
        part.write.mode("append").parquet(f"{base}/log")
        no_data.start_counter(spark, f"{base}/log", f"{base}/runs", f"{base}/checkpoint").awaitTermination()
    return no_data.latest_runs(spark, f"{base}/runs")


@register(
    "utc_to_local_day",
    """
select cast((ts at time zone 'UTC') at time zone 'America/Chicago' as date) as local_day,
       cast(count(*) as bigint) as n_events, cast(count_if(event_type = 'error') as bigint) as n_flagged
from events group by 1""",
    dates=["local_day"],
)
def q_utc_to_local_day(spark, sf):
    """P1 for instants: events per city-local day, errors as the flagged kind."""
    return ingest_log.events_by_local_day(table(spark, sf, "events"))

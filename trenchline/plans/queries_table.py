"""Registered source, normalisation and table queries.

Queries that exercise a file format first write the permit fixture in that
format to a fresh folder under the session's checkpoint dir (the shared
scratch area), then read it back through the source under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import normalize, table
from trenchline.plans.catalog import permits, register, with_permits
from trenchline.session import scratch_path
from trenchline.sources import files, fixtures

PERMIT_STAMPS = ["request_date", "dig_date", "expiration_date"]
AUDIT_STAMPS = PERMIT_STAMPS + ["created_at", "updated_at"]
T0 = "2024-01-01 00:00:00"
T1 = "2024-02-01 00:00:00"

BAD = f"cast(dig_ticket_number as bigint) % {fixtures.BAD_VALUE_EVERY} = 0"
WITH_BAD_VALUES_SQL = with_permits(
    f"""
select * replace (
  case when {BAD} then null else street_number_from end as street_number_from,
  case when {BAD} then null else latitude end as latitude)
from permits"""
)
PERMITS_ONLY_SQL = with_permits("select * from permits")
# A CSV field carries no difference between empty text and null: both read
# back as null (as with pandas' read_csv).
TEXT_FIELDS = ["dig_ticket_number", "permit_number", "street_name", "street_direction", "street_suffix",
               "dig_location", "contact_first_name", "contact_last_name"]
CSV_SQL = with_permits(
    "select * replace ("
    + ", ".join(f"nullif({c}, '') as {c}" for c in TEXT_FIELDS)
    + f""",
  case when {BAD} then null else street_number_from end as street_number_from,
  case when {BAD} then null else latitude end as latitude)
from permits"""
)


@register("scan_csv", CSV_SQL, stamps=PERMIT_STAMPS)
def q_scan_csv(spark, sf):
    """S1 + N1-N5: CSV export (upper-case header, US dates, Y/N) read back as text
    and conformed.  Half of the files have their columns in another order and
    carry one more; each is read by its own header."""
    path = scratch_path(spark, "csv")
    raw = fixtures.raw_feed(permits(spark, sf), "csv")
    even = F.col("DIG_TICKET#").cast("bigint") % 2 == 0
    files.write_csv(raw.where(even), f"{path}/a")
    files.write_csv(raw.where(~even).select(F.lit("x").alias("WARD"), *raw.columns[::-1]), f"{path}/b")
    return normalize.conform(files.read_permits_csv(spark, f"{path}/*"))


@register(
    "recent_stored",
    with_permits(
        f"""
select *, timestamp '{T0}' as created_at, timestamp '{T0}' as updated_at from permits
where dig_date >= cast((select max(cast(dig_date as date)) from permits) - 30 as timestamp)"""
    ),
    stamps=AUDIT_STAMPS,
)
def q_recent_stored(spark, sf):
    """K5 on the stored table: only the months that can hold such rows are read."""
    t = table.PermitTable(spark, scratch_path(spark, "table"))
    table.full_refresh(t, permits(spark, sf), now=T0)
    return t.recent(days=30)


@register("scan_json", WITH_BAD_VALUES_SQL, stamps=PERMIT_STAMPS)
def q_scan_json(spark, sf):
    """S2 + N1-N5: landed API feed (lower-case fields, ISO dates, true/false) as JSON Lines."""
    path = scratch_path(spark, "json")
    files.write_json_lines(fixtures.raw_feed(permits(spark, sf), "api"), path)
    return normalize.conform(files.read_permits_json(spark, path))


@register("normalize", WITH_BAD_VALUES_SQL, stamps=PERMIT_STAMPS)
def q_normalize(spark, sf):
    """N1-N5 on an all-text frame with API field names (no file in between)."""
    return normalize.conform(fixtures.raw_feed(permits(spark, sf), "api"))


@register("roundtrip_parquet", PERMITS_ONLY_SQL, stamps=PERMIT_STAMPS)
def q_roundtrip_parquet(spark, sf):
    """K1 + S3: snappy Parquet write, read back."""
    path = scratch_path(spark, "parquet")
    files.write_parquet(permits(spark, sf), path)
    return files.read_parquet(spark, path)


@register(
    "full_refresh",
    with_permits(f"select *, timestamp '{T0}' as created_at, timestamp '{T0}' as updated_at from permits"),
    stamps=AUDIT_STAMPS,
)
def q_full_refresh(spark, sf):
    """K2: the feed becomes a new table version with audit columns; read the current version."""
    t = table.PermitTable(spark, scratch_path(spark, "table"))
    table.full_refresh(t, permits(spark, sf), now=T0)
    return t.read()


@register("migrate_schema", PERMITS_ONLY_SQL, stamps=PERMIT_STAMPS)
def q_migrate_schema(spark, sf):
    """K6: a version in the old stored layout (text dates, 0/1 flag) rewritten
    in the current schema as the next version."""
    t = table.PermitTable(spark, scratch_path(spark, "table"))
    t.commit(normalize.to_export(permits(spark, sf)))
    table.migrate(t, normalize.conform)
    return t.read()


UPSERT_CTES = f"""existing as (
  select *, timestamp '{T0}' as created_at, timestamp '{T0}' as updated_at from permits
  where cast(dig_ticket_number as bigint) % 10 < 8),
batch as (
  select * replace (not is_emergency as is_emergency), 1 as arrival from permits
  where cast(dig_ticket_number as bigint) % 10 >= 6
  union all
  select * replace (not is_emergency as is_emergency, street_name || ' RESENT' as street_name), 2 as arrival
  from permits where cast(dig_ticket_number as bigint) % 50 = 9),
latest as (
  select * exclude (arrival, rn) from (
    select *, row_number() over (partition by dig_ticket_number order by arrival desc) as rn from batch) r
  where rn = 1)"""


def _b3(spark, sf):
    existing, batch = fixtures.upsert_inputs(permits(spark, sf))
    return table.with_audit(existing, T0), batch


@register(
    "upsert",
    with_permits(
        f"""
select l.*, coalesce(e.created_at, timestamp '{T1}') as created_at, timestamp '{T1}' as updated_at
from latest l left join existing e on e.dig_ticket_number = l.dig_ticket_number
union all
select * from existing where dig_ticket_number not in (select dig_ticket_number from latest)""",
        UPSERT_CTES,
    ),
    stamps=AUDIT_STAMPS,
)
def q_upsert(spark, sf):
    """Merge a re-sent batch into the table by ticket."""
    existing, batch = _b3(spark, sf)
    return table.upsert(existing, batch, now=T1)


@register(
    "merge_report",
    with_permits(
        """
select cast(coalesce(sum(copies), 0) as bigint) as batch_rows,
       cast(count(*) filter (where e.dig_ticket_number is null) as bigint) as inserts,
       cast(count(*) filter (where e.dig_ticket_number is not null) as bigint) as updates
from (select dig_ticket_number, count(*) as copies from batch group by 1) bk
left join existing e on e.dig_ticket_number = bk.dig_ticket_number""",
        UPSERT_CTES,
    ),
)
def q_merge_report(spark, sf):
    """Batch rows, new tickets, replaced tickets."""
    existing, batch = _b3(spark, sf)
    return table.merge_report(existing, batch)


@register(
    "recent_permits",
    with_permits(
        """
select * from permits
where dig_date >= cast((select max(cast(dig_date as date)) from permits) - 30 as timestamp)"""
    ),
    stamps=PERMIT_STAMPS,
)
def q_recent_permits(spark, sf):
    """K5: permits of the last 30 days before the latest dig day (and later)."""
    return table.recent_permits(permits(spark, sf), days=30)


@register(
    "overlap_window",
    with_permits(
        """
select * from permits
where request_date >= cast((select max(cast(request_date as date)) from permits) - 32 as timestamp)"""
    ),
    stamps=PERMIT_STAMPS,
)
def q_overlap_window(spark, sf):
    """The re-read window of an incremental fetch (30 + 2 days)."""
    return table.overlap_window(permits(spark, sf))


@register("stream_ingest", WITH_BAD_VALUES_SQL, stamps=PERMIT_STAMPS)
def q_stream_ingest(spark, sf):
    """The API feed landed as three shares of JSON Lines files, ingested by
    the streaming job one share per micro-batch (conform -> merge by ticket ->
    new table version); the final table version."""
    from trenchline.schema import PERMIT_COLUMNS
    from trenchline.streaming.ingest import fixed_clock, start_ingest

    base = scratch_path(spark, "stream")
    share = files.write_json_shares(fixtures.raw_feed(permits(spark, sf), "api"), f"{base}/landing", 3)
    t = table.PermitTable(spark, f"{base}/table")
    q = start_ingest(spark, f"{base}/landing/_share=*", t, f"{base}/checkpoint", f"{base}/log", files_per_batch=share, clock=fixed_clock(T1))
    q.awaitTermination()
    return t.read().select(*PERMIT_COLUMNS)


@register(
    "stream_upsert",
    with_permits(
        f"""
select * replace (
  case when {BAD} then null else street_number_from end as street_number_from,
  case when {BAD} then null else latitude end as latitude)
from (
  select l.*, coalesce(e.created_at, timestamp '{T1}') as created_at, timestamp '{T1}' as updated_at
  from latest l left join existing e on e.dig_ticket_number = l.dig_ticket_number
  union all
  select * from existing where dig_ticket_number not in (select dig_ticket_number from latest)) u""",
        UPSERT_CTES,
    ),
    stamps=AUDIT_STAMPS,
)
def q_stream_upsert(spark, sf):
    """R1-R3 with re-sent copies: the first load and then the whole batch, copies
    of a ticket in the order they were sent, through the streaming job."""
    from trenchline.streaming.ingest import fixed_clock, start_ingest

    base = scratch_path(spark, "stream_upsert")
    existing, batch = fixtures.upsert_inputs(permits(spark, sf))
    t = table.PermitTable(spark, f"{base}/table")
    for name, rows, clock in (("a", existing, T0), ("b", batch.where("arrival = 1"), T1), ("c", batch.where("arrival = 2"), T1)):
        files.write_json_lines(fixtures.raw_feed(rows, "api"), f"{base}/landing/{name}")
        if name != "b":  # b and c are one micro-batch
            q = start_ingest(spark, f"{base}/landing/*", t, f"{base}/checkpoint", f"{base}/log", clock=fixed_clock(clock))
            q.awaitTermination()
    return t.read()

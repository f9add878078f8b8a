"""Permit-shaped inputs derived from the TPC-H-style test tables.

There is no permit table in the test data, so the build derives one from
``orders`` joined to ``customer`` (one permit per order).  The same rule is
written once as Spark code (here) and once as SQL (``PERMITS_SQL``) for the
DuckDB oracle; both were checked to give identical rows.

All derived inputs keep every row of the source tables: the modulo
expressions below *shape values* (direction, suffix, a re-sent batch), they
never drop rows to make a check cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trenchline.schema import API_FIELD_NAMES, CSV_FIELD_NAMES, PERMIT_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Permits without a dig date: they belong to no day.
UNDATED_EVERY = 61


def permits_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one permit per order; 16 target columns, typed like the target schema."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    # No hint: customer grows with the data, so the join strategy is left to the
    # size estimate (autoBroadcastJoinThreshold) and AQE's runtime statistics.
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    key = F.col("o_orderkey")
    cust = F.col("o_custkey")
    ticket = key.cast("string")
    return j.select(
        ticket.alias("dig_ticket_number"),
        F.concat(F.lit("P"), ticket).alias("permit_number"),
        (F.col("o_orderdate") - F.expr("INTERVAL 2 DAYS")).alias("request_date"),
        F.when(key % UNDATED_EVERY != 0, F.col("o_orderdate")).alias("dig_date"),
        (F.col("o_orderdate") + F.expr("INTERVAL 28 DAYS")).alias("expiration_date"),
        (F.col("o_orderpriority") == F.lit("1-URGENT")).alias("is_emergency"),
        F.col("c_mktsegment").alias("street_name"),
        F.when(cust % 4 == 0, "N").when(cust % 4 == 1, "S").when(cust % 4 == 2, "E").otherwise("W").alias("street_direction"),
        (cust % 9000 + 1).alias("street_number_from"),
        (cust % 9000 + 5).alias("street_number_to"),
        F.when(cust % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("ST")).alias("street_suffix"),
        F.when(key % 7 == 0, F.lit(""))
        .when(key % 7 == 1, F.lit(None).cast("string"))
        .otherwise(F.lit("PARKWAY_STREET"))
        .alias("dig_location"),
        (F.lit(41.4) + (key % 1300) / F.lit(1000.0)).alias("latitude"),
        (F.lit(-88.1) + (key % 1100) / F.lit(1000.0)).alias("longitude"),
        F.when(cust % 11 == 0, F.lit("PAT")).when(cust % 11 == 1, F.lit(None).cast("string")).otherwise(F.lit("")).alias("contact_first_name"),
        _last_name(cust).alias("contact_last_name"),
    )


def permits_scaled(spark: SparkSession, sf_dir: str, factor: int) -> DataFrame:
    """B1 multiplied ``factor`` times by ticket offset (measurement input).

    Every copy keeps its day, customer and contractor, so per-day and
    per-contractor groups grow ``factor``-fold: the same hot keys, bigger."""
    base = permits_from_tpch(spark, sf_dir)
    out = base.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(factor - 1).cast("bigint"))))
    ticket = (F.col("dig_ticket_number").cast("bigint") + F.col("_copy") * F.lit(10_000_000_000)).cast("string")
    return out.withColumn("dig_ticket_number", ticket).withColumn("permit_number", F.concat(F.lit("P"), ticket)).drop("_copy")


def _last_name(cust: Column) -> Column:
    r = cust % 8
    return (
        F.when(r == 0, "PEOPLES GAS")
        .when((r == 1) & (cust % 5 == 0), "PEOPLE GAS")
        .when(r == 1, "People Gas")
        .when(r == 2, "ACME CONST. CO.")
        .when(r == 3, "Acme Construction Company")
        .when((r == 4) & (cust % 3 == 0), "m & j Asphalt *")
        .when((r == 4) & (cust % 3 == 1), "M & J Asphalt *")
        .when(r == 4, "M & J ASPHALT *")
        .when(r == 5, "SMITH CONSTR. (SL-1234)")
        .when(r == 6, "")
        .when(cust % 5 == 0, "CASA MEXICO")
        .otherwise(F.col("c_name"))
    )


# The same derivation for the DuckDB oracle (also runs on Spark SQL).
PERMITS_SQL = """
select cast(o_orderkey as varchar(20)) as dig_ticket_number,
       concat('P', cast(o_orderkey as varchar(20))) as permit_number,
       o_orderdate - interval '2' day  as request_date,
       case when o_orderkey % 61 != 0 then o_orderdate end as dig_date,
       o_orderdate + interval '28' day as expiration_date,
       o_orderpriority = '1-URGENT'    as is_emergency,
       c_mktsegment                    as street_name,
       case o_custkey % 4 when 0 then 'N' when 1 then 'S' when 2 then 'E' else 'W' end as street_direction,
       o_custkey % 9000 + 1            as street_number_from,
       o_custkey % 9000 + 5            as street_number_to,
       case when o_custkey % 5 = 0 then null else 'ST' end as street_suffix,
       case when o_orderkey % 7 = 0 then '' when o_orderkey % 7 = 1 then null
            else 'PARKWAY_STREET' end  as dig_location,
       41.4e0 + (o_orderkey % 1300) / 1000e0  as latitude,
       -88.1e0 + (o_orderkey % 1100) / 1000e0 as longitude,
       case when o_custkey % 11 = 0 then 'PAT' when o_custkey % 11 = 1 then null else '' end as contact_first_name,
       case o_custkey % 8 when 0 then 'PEOPLES GAS'
            when 1 then case when o_custkey % 5 = 0 then 'PEOPLE GAS' else 'People Gas' end
            when 2 then 'ACME CONST. CO.' when 3 then 'Acme Construction Company'
            when 4 then case o_custkey % 3 when 0 then 'm & j Asphalt *' when 1 then 'M & J Asphalt *' else 'M & J ASPHALT *' end
            when 5 then 'SMITH CONSTR. (SL-1234)'
            when 6 then '' else case when o_custkey % 5 = 0 then 'CASA MEXICO' else c_name end end as contact_last_name
from orders join customer on o_custkey = c_custkey
"""

# --- B2: the permit table as the two raw feeds would deliver it --------------
# Every value is text.  The CSV export writes US-style timestamps and Y/N flags,
# the API writes ISO timestamps and true/false.  Rows whose key is a multiple of
# 97 carry an unparsable street number and latitude, which must become null.
BAD_VALUE_EVERY = 97


def raw_feed(permits: DataFrame, family: str = "api") -> DataFrame:
    """B1 rendered as an all-text feed with the source's field names."""
    names = {v: k for k, v in (CSV_FIELD_NAMES if family == "csv" else API_FIELD_NAMES).items()}
    bad = F.col("dig_ticket_number").cast("bigint") % BAD_VALUE_EVERY == 0
    cols = []
    for c in PERMIT_COLUMNS:
        v = F.col(c)
        if c in ("request_date", "dig_date", "expiration_date"):
            fmt = "MM/dd/yyyy hh:mm:ss a" if family == "csv" else "yyyy-MM-dd'T'HH:mm:ss.SSS"
            v = F.date_format(v, fmt)
        elif c == "is_emergency":
            v = F.when(v, F.lit("Y" if family == "csv" else "true")).otherwise(F.lit("N" if family == "csv" else "false"))
        elif c == "street_number_from":
            v = F.when(bad, F.lit("N/A")).otherwise(v.cast("string"))
        elif c == "latitude":
            v = F.when(bad, F.lit("unknown")).otherwise(v.cast("string"))
        else:
            v = v.cast("string")
        cols.append(v.alias(names[c]))
    return permits.select(*cols)


# --- B3: an existing table and a re-sent batch --------------------------------
# existing = tickets with key % 10 < 8; batch = key % 10 >= 6 with the
# emergency flag flipped (so 6,7 are updates, 8,9 inserts), plus a second,
# later copy of every ticket with key % 50 == 9 carrying a new street name:
# the later copy must win.
def upsert_inputs(permits: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("dig_ticket_number").cast("bigint")
    existing = permits.where(k % 10 < 8)
    first = permits.where(k % 10 >= 6).withColumn("is_emergency", ~F.col("is_emergency")).withColumn("arrival", F.lit(1))
    again = (
        permits.where(k % 50 == 9)
        .withColumn("is_emergency", ~F.col("is_emergency"))
        .withColumn("street_name", F.concat(F.col("street_name"), F.lit(" RESENT")))
        .withColumn("arrival", F.lit(2))
    )
    return existing, first.unionByName(again)


# --- B7: fetch log derived from the event stream ----------------------------
def ingest_log_from_events(events: DataFrame, every: str = "5 minutes") -> DataFrame:
    """One row per fetch slot of ``every``; slots without events have rows = 0.

    The slot spine is built from the time range, so empty slots exist even
    though no event row carries them.
    """
    slot = F.window("ts", every).start.cast("timestamp_ntz")
    counts = events.groupBy(slot.alias("batch_ts")).agg(F.count(F.lit(1)).alias("rows"))
    bounds = counts.agg(F.min("batch_ts").alias("lo"), F.max("batch_ts").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {every}"))).alias("batch_ts"))
    return spine.join(counts, "batch_ts", "left").select("batch_ts", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))

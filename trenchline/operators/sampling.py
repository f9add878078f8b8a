"""Repeatable per-day sampling of permits (L4).

"A random permit of the day" becomes: the permit(s) of least priority of each
day, where the priority is the first 60 bits of md5(ticket || ':' || seed) as a
number, equal priorities by ticket.  The choice is repeatable for a seed,
independent of partitioning and task retries, and reproducible in any SQL
engine that has md5.

The least priority of a day is a hash aggregate over two columns (partial per
task, so a day that holds a third of all permits is no hot spot); its ticket
comes from a join back on (day, priority).  Whole rows, or more than one a
day, are taken in a single read: ``row_number() <= k`` leaves at most k rows of
a day in every task before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trenchline.functions.dates import local_day


def priority(seed: int):
    """The first 15 hex digits of md5(ticket || ':' || seed), as a bigint."""
    digest = F.md5(F.concat(F.col("dig_ticket_number"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _first(rows: DataFrame, k: int, *order: str) -> DataFrame:
    w = Window.partitionBy("day").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def sample_permits(permits: DataFrame, k: int = 1, seed: int = 42) -> DataFrame:
    """``day, rank, dig_ticket_number`` — k sampled permits per dig day."""
    dated = permits.where("dig_date is not null and dig_ticket_number is not null")
    p = dated.select(local_day("dig_date").alias("day"), "dig_ticket_number", priority(seed).alias("_p"))
    if k == 1:
        least = p.groupBy("day").agg(F.min("_p").alias("_p"))
        # one row per calendar day, so at most 3.7 million rows of two numbers whatever the table
        p = p.join(F.broadcast(least), ["day", "_p"])
    return _first(p, k, "_p", "dig_ticket_number").select("day", "rank", "dig_ticket_number")


def sampled_permits(permits: DataFrame, k: int = 1, seed: int = 42) -> DataFrame:
    """The full permit rows of the sample, in one read of the table."""
    dated = permits.where("dig_date is not null and dig_ticket_number is not null")
    rows = dated.withColumns({"day": local_day("dig_date"), "_p": priority(seed)})
    return _first(rows, k, "_p", "dig_ticket_number").select(*permits.columns)

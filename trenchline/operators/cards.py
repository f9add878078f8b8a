"""Permit listing, permit cards and report texts.

All are projections or small per-day aggregates over already aggregated
frames; the texts are column expressions (``functions.text``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trenchline.functions import text as tx


def permit_listing(permits: DataFrame, limit: int | None = None) -> DataFrame:
    """Ticket, request/dig day as text, street address, Yes/No flag,
    coordinates to 4 places; newest dig first.  ``limit`` for a short list."""
    suffix = F.when(F.col("street_suffix").isNotNull(), F.concat(F.lit(" "), F.col("street_suffix"))).otherwise(F.lit(""))
    out = permits.select(
        F.col("dig_ticket_number").alias("ticket"),
        F.date_format("request_date", "yyyy-MM-dd").alias("request_day"),
        F.date_format("dig_date", "yyyy-MM-dd").alias("dig_day"),
        F.concat(
            F.col("street_number_from").cast("string"), F.lit(" "), F.col("street_direction"), F.lit(" "), F.col("street_name"), suffix
        ).alias("location"),
        F.when(F.col("is_emergency"), F.lit("Yes")).otherwise(F.lit("No")).alias("emergency"),
        F.round("latitude", 4).alias("lat"),
        F.round("longitude", 4).alias("lon"),
    )
    if limit:
        out = out.orderBy(F.col("dig_day").desc(), F.col("ticket").desc()).limit(limit)
    return out


def permit_cards(permits: DataFrame) -> DataFrame:
    """``dig_ticket_number, address, work_type, is_emergency``."""
    return permits.select(
        "dig_ticket_number",
        tx.address(F.col("street_number_from"), F.col("street_direction"), F.col("street_name"), F.col("street_suffix")).alias(
            "address"
        ),
        tx.work_type(F.col("dig_location")).alias("work_type"),
        "is_emergency",
    )


def card_texts(cards: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """T4/T5: the post text of every card and the byte span of '#ticket'.

    ``locations`` (``dig_ticket_number, location``) supplies the looked-up
    dig location; cards without one get no location line."""
    c = cards
    if locations is not None:
        c = c.join(locations.select("dig_ticket_number", "location"), "dig_ticket_number", "left")
    else:
        c = c.withColumn("location", F.lit(None).cast("string"))
    txt = tx.card_text(F.col("address"), F.col("work_type"), F.col("dig_ticket_number"), F.col("is_emergency"), F.col("location"))
    link = F.concat(F.lit("#"), F.col("dig_ticket_number"))
    c = c.select("dig_ticket_number", txt.alias("text"), link.alias("link_text"))
    start, end = tx.link_span(F.col("text"), F.col("link_text"))
    return c.select("dig_ticket_number", "text", "link_text", start.alias("byte_start"), end.alias("byte_end"))


def report_texts(comparison: DataFrame, template: str | None = None) -> DataFrame:
    """One report text per day of a weekday comparison, in the standard
    wording or in that of a ``template`` (see ``text.report_fields``)."""
    if template is not None:
        return comparison.select("day", tx.fill_template(template, tx.report_fields()).alias("text"))
    return comparison.select(
        "day",
        tx.report_text(
            F.col("day_name"),
            F.col("actual_total"),
            F.col("actual_emergency"),
            F.col("actual_regular"),
            F.col("total_diff_percent"),
            F.col("emergency_diff_percent"),
            F.col("regular_diff_percent"),
        ).alias("text"),
    )


def leaderboard_texts(by_day: DataFrame) -> DataFrame:
    """One leaderboard text per day from ``day, rank, name, count`` rows
    (at most k rows per day, so the per-day list is bounded)."""
    lines = by_day.select("day", "rank", tx.leaderboard_line(F.col("rank"), F.col("name"), F.col("count")).alias("line"))
    per_day = lines.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    return per_day.select(
        "day", F.concat(F.lit(tx.LEADERBOARD_TITLE), F.array_join(F.transform("lines", lambda s: s["line"]), "")).alias("text")
    )

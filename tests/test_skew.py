"""Hot keys: one ticket re-sent for a third of a batch, one contractor and one
day holding a third of all permits.  Results stay exact and the plans
pre-aggregate before the shuffle."""

import datetime as dt

from pyspark.sql import functions as F

from trenchline.operators import daily, normalize, rankings, table


def _hot_permits(spark, n=3000):
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        day = dt.datetime(2024, 5, 1) if hot else dt.datetime(2024, 5, 2) + dt.timedelta(days=i % 40)
        last = "HOT DIGGERS INC" if hot else f"CO {i % 97}"
        rows.append((f"T{i}", day, i % 5 == 0, "MAIN", "", last, i % 7))
    return spark.createDataFrame(
        rows,
        "dig_ticket_number string, dig_date timestamp_ntz, is_emergency boolean, street_name string, "
        "contact_first_name string, contact_last_name string, arrival int",
    )


def test_hot_contractor_and_day(spark):
    p = _hot_permits(spark)
    top = rankings.leaderboard(p, k=3).collect()
    assert top[0]["name"] == "HOT Diggers Inc" and top[0]["count"] == 1000
    by_day = {(r.day, r.rank): r for r in rankings.leaderboard_by_day(p, k=2).collect()}
    assert by_day[(dt.date(2024, 5, 1), 1)]["count"] == 1000
    stats = {r.day: r.total_permits for r in daily.daily_stats(p).collect()}
    assert stats[dt.date(2024, 5, 1)] == 1000 and sum(stats.values()) == 3000
    plan = rankings.leaderboard(p, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_hot_ticket_in_batch(spark):
    p = _hot_permits(spark, 300)
    existing = table.with_audit(normalize.conform(p.where(F.col("arrival") == 0)), "2024-01-01 00:00:00")
    # a third of the batch is copies of one ticket; the copy with the largest arrival wins
    batch = p.withColumn("dig_ticket_number", F.when(F.col("dig_ticket_number").substr(2, 5).cast("int") % 3 == 0, F.lit("T0")).otherwise(F.col("dig_ticket_number")))
    batch = normalize.conform(batch, keep_extra=True)
    deduped = table.dedupe_batch(batch, order=("arrival",))
    hot = deduped.where("dig_ticket_number = 'T0'").first()
    assert hot["_copies"] == 100
    plan = deduped._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    merged = table.upsert(existing, batch, now="2024-02-01 00:00:00")
    assert merged.count() == merged.select("dig_ticket_number").distinct().count()

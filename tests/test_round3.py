"""Samples, profiles, series, heat layer, templates and the stream counter."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from trenchline.functions import text as tx
from trenchline.operators import cards, daily, geo, ingest_log, quality, sampling
from trenchline.session import scratch_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_read_once_and_sort_no_text(spark, permits_small):
    one = sampling.sample_permits(permits_small)
    assert "SortAggregate" not in plan_of(one)
    rows = sampling.sampled_permits(permits_small, k=1)
    plan = plan_of(rows)
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") >= 1 and plan.count("o_orderkey") and plan.count("orders.parquet") == 1
    assert {r.dig_ticket_number for r in rows.collect()} == {r.dig_ticket_number for r in one.collect()}


def test_profile_values_is_one_exact_scan(spark):
    rows = [(i, f"k{i % 10}", f"v{i % 11}", None, i % 2 == 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, ten string, eleven string, none string, `a b` boolean")
    got = [tuple(r) for r in quality.profile_values(df).orderBy("column_name", "rank").collect()]
    assert got == [("a b", "false", 500, 1), ("a b", "true", 500, 2)] + [("ten", f"k{i}", 100, i + 1) for i in range(5)]
    assert quality.profile_values(df.where("false")).count() == 0
    # a column whose many values come after the peek, and one with both zeros
    late = spark.range(5000).select(F.greatest(F.col("id") - 1500, F.lit(0)).alias("late"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(F.col("id") % 10 * 1.0).alias("zeros")).coalesce(1)
    assert {r.column_name for r in quality.profile_values(late).collect()} == {"zeros"}
    assert plan_of(quality.profile_values(df)).count("Scan") == 1 and "approx" not in plan_of(quality.profile_values(df))


def test_series_of_last_days(spark, permits_small):
    whole = {r.date: r for r in daily.daily_series(permits_small).collect()}
    last = daily.daily_series(permits_small, last_days=10).collect()
    assert len(last) == 10 and max(r.date for r in last) == max(whole)
    assert all(whole[r.date] == r for r in last)
    as_of = max(whole) + dt.timedelta(days=3)
    got = daily.daily_series(permits_small, last_days=5, as_of=as_of).collect()
    assert len(got) == 5 and max(r.date for r in got) == as_of
    assert daily.daily_series(permits_small.where("false"), last_days=5).count() == 0
    with pytest.raises(ValueError):
        daily.daily_series(permits_small, last_days=5, start="1996-01-01")
    with pytest.raises(quality.DataValidationError):
        quality.require_rows(permits_small.where("false"))


def test_heat_layer_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(["regular", "emergency"][i % 2], 41.8 + rng.random() / 50, -87.6 - rng.random() / 50) for i in range(40)] + [("regular", 41.81, -87.61)] * 30
    df = spark.createDataFrame(rows, "layer string, latitude double, longitude double")
    got = {(r.zoom, r.layer, r.x_cell, r.y_cell): (r.weight, r.intensity, r.opacity) for r in geo.heat_layer(df, zooms=(11, 13)).collect()}
    want = {}
    for zoom in (11, 13):
        for layer, lat, lon in rows:
            size = 256 * 2**zoom
            s = math.sin(lat * math.pi / 180)
            cx = math.floor((lon + 180) / 360 * size / 7)
            cy = math.floor((0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * size / 7)
            for dx in range(-5, 6):
                for dy in range(-5, 6):
                    w = round(1000 * min(1.0, max(0.0, (35 - 7 * math.hypot(dx, dy)) / 20)))
                    if w:
                        key = (zoom, layer, cx + dx, cy + dy)
                        want[key] = want.get(key, 0) + w
    assert {k: v[0] for k, v in got.items()} == want
    for k, (w, intensity, opacity) in got.items():
        assert intensity == pytest.approx(w / 1000 / 2 ** (13 - k[0])) and opacity == pytest.approx(max(0.4, min(1.0, intensity)))


def test_templates(spark, permits_small):
    c = daily.weekday_comparison(permits_small).orderBy(F.desc("day")).limit(1)
    row = c.first()
    text = cards.report_texts(c, "{day}: {actual_total} ({total_symbol}{total_diff_percent}% of {avg_total}) {{ok}}").first().text
    pct, avg = round(row.total_diff_percent, 1), round(row.avg_total, 1)
    assert text == f"{row.day}: {row.actual_total} ({tx.ARROW_DOWN if pct < 0 else tx.ARROW_UP}{abs(pct):.1f}% of {avg:.1f}) {{ok}}"
    with pytest.raises(ValueError):
        cards.report_texts(c, "{nothing}")


def brute_runs(rows, threshold):
    out, run = [], None
    for ts, n in sorted(rows, key=lambda r: (r[0], r[1])):
        if n > 0:
            run = None
            continue
        if run is None:
            run = [ts, ts, 0, None]
            out.append(run)
        run[1], run[2] = ts, run[2] + 1
        if run[2] == threshold:
            run[3] = ts
    return {(a, b, n, n >= threshold, at) for a, b, n, at in out}


@pytest.mark.parametrize("seed", range(4))
def test_empty_runs_in_batch_and_stream(spark, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1, 20)
    gap = [5, 60, 700, 2000][seed]  # runs over midnight, over whole days, days without fetches
    log = [(start + dt.timedelta(minutes=gap * (i - i % 7 // 6)), rng.choice([0, 0, 0, 0, 5])) for i in range(150)]
    df = spark.createDataFrame(log, "batch_ts timestamp_ntz, rows bigint")
    want = brute_runs(log, 3)
    assert {tuple(r) for r in ingest_log.empty_batch_runs(df.repartition(3)).collect()} == want
    at_end = [r for r in want if r[1] == max(ts for ts, _ in log)] if max(log, key=lambda r: (r[0], r[1]))[1] == 0 else []
    now = ingest_log.current_empty_run(df).first()
    assert (now.empty_batches, now.alert) == ((at_end[0][2], at_end[0][3]) if at_end else (0, False))
    if seed > 1:
        return
    from trenchline.streaming import no_data

    base = scratch_path(spark, "no-data")
    full = df.withColumn("feed", F.lit("api")).unionByName(df.withColumns({"feed": F.lit("csv"), "rows": F.lit(1).cast("bigint")})).withColumn("batch_id", F.lit(None).cast("bigint"))
    cut = log[70][0]
    for part in (full.where(F.col("batch_ts") <= F.lit(cut)), full.where(F.col("batch_ts") > F.lit(cut))):  # a restart between the two
        part.write.mode("append").parquet(f"{base}/log")
        no_data.start_counter(spark, f"{base}/log", f"{base}/runs", f"{base}/checkpoint").awaitTermination()
    got = no_data.latest_runs(spark, f"{base}/runs").collect()
    assert {r.feed for r in got} == {"api"} and {tuple(r)[1:] for r in got} == want


def test_undated_permits_are_on_no_map_and_no_day(spark, permits_small):
    from trenchline.operators import rankings

    assert permits_small.where("dig_date is null").count() > 0
    for out in (geo.map_points(permits_small), rankings.leaderboard_by_day(permits_small), rankings.leaderboard_by_day(permits_small, merge_names=True)):
        assert out.where("day is null").count() == 0

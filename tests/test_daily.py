"""Weekday comparison edge cases and day-level generalisation."""

import datetime as dt

from trenchline.operators import daily
from trenchline.operators.cards import report_texts


def permits_on(spark, days):
    rows = []
    for i, (d, n, e) in enumerate(days):
        for j in range(n):
            rows.append((f"T{i}_{j}", dt.datetime.fromisoformat(d), j < e, "MAIN"))
    return spark.createDataFrame(rows, "dig_ticket_number string, dig_date timestamp_ntz, is_emergency boolean, street_name string")


def test_empty_day_and_no_history(spark):
    # four Tuesdays: 3 permits, nothing, 5 permits, nothing (the reported day)
    p = permits_on(spark, [("2024-01-02", 3, 1), ("2024-01-16", 5, 2), ("2024-01-30", 1, 0)])
    out = {r.day.isoformat(): r for r in daily.weekday_comparison(p).collect()}
    first = out["2024-01-02"]
    assert (first.actual_total, first.avg_total, first.num_days, first.total_diff_percent) == (3, 0.0, 0, 0.0)
    empty = out["2024-01-23"]  # a Tuesday without permits: actual 0, -100 %
    assert empty.day_name == "Tuesday"
    assert (empty.actual_total, empty.num_days, empty.avg_total) == (0, 2, 4.0)
    assert empty.total_diff_percent == -100.0
    assert out["2024-01-09"].num_days == 1  # empty days do not count as history


def test_window_bounds_and_options(spark):
    p = permits_on(spark, [("2020-01-07", 10, 0), ("2022-01-04", 2, 0), ("2022-01-11", 4, 0)])
    out = {r.day.isoformat(): r for r in daily.weekday_comparison(p, start="2022-01-11", end="2022-01-11").collect()}
    r = out["2022-01-11"]
    assert r.num_days == 1 and r.avg_total == 2.0  # 2020-01-07 is 735 days back: outside [d-730, d)
    short = daily.weekday_comparison(p, start="2022-01-11", end="2022-01-11", min_history_days=2).first()
    assert short.avg_total is None and short.total_diff_percent is None
    text = report_texts(daily.weekday_comparison(p, start="2022-01-11", end="2022-01-11", min_history_days=2)).first().text
    assert "Total Permits Starting to Dig: 4\n\n" in text and "avg" not in text
    hol = spark.createDataFrame([(dt.date(2022, 1, 4),)], "day date")
    h = daily.weekday_comparison(p, start="2022-01-11", end="2022-01-11", holidays=hol).first()
    assert h.num_days == 0 and h.avg_total == 0.0


def test_series_zero_fill_and_records(spark):
    p = permits_on(spark, [("2024-03-01", 2, 1), ("2024-03-04", 4, 0), ("2024-03-05", 4, 3)])
    s = {r.date.isoformat(): (r.regular_tickets, r.emergency_tickets) for r in daily.daily_series(p).collect()}
    assert s == {"2024-03-01": (1, 1), "2024-03-02": (0, 0), "2024-03-03": (0, 0), "2024-03-04": (4, 0), "2024-03-05": (1, 3)}
    assert daily.latest_day(daily.daily_series(p)).first().date == dt.date(2024, 3, 5)
    rec = {r.record: (r.day.isoformat(), r["count"]) for r in daily.daily_records(p).collect()}
    assert rec == {"most_tickets": ("2024-03-04", 4), "most_emergency": ("2024-03-05", 3)}


def test_operators_keep_real_types(permits_small):
    from trenchline.operators import geo, rankings, sampling

    kinds = lambda df: {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds(daily.daily_counts(permits_small)) == {"day": "date", "total_permits": "bigint", "emergency_permits": "bigint"}
    assert kinds(daily.daily_series(permits_small)) == {"date": "date", "regular_tickets": "bigint", "emergency_tickets": "bigint"}
    c = kinds(daily.weekday_comparison(permits_small))
    assert c["day"] == "date" and c["avg_total"] == c["total_diff_percent"] == "double" and c["num_days"] == c["actual_total"] == "bigint"
    assert kinds(geo.map_points(permits_small)) == {"day": "date", "layer": "string", "dig_ticket_number": "string", "latitude": "double", "longitude": "double"}
    assert kinds(rankings.leaderboard_by_day(permits_small))["day"] == "date"
    assert kinds(sampling.sampled_permits(permits_small)) == kinds(permits_small)
    assert kinds(permits_small)["dig_date"] == "timestamp_ntz"

"""Plan checks: pushdown, pruning, no Python in the hot path, bounded top-k."""

from trenchline.operators import daily, geo, rankings
from trenchline.session import scratch_path
from trenchline.sources import files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_filter_pushed_to_scan(spark, permits_small):
    path = scratch_path(spark, "stored")
    files.write_parquet(permits_small, path)
    stored = files.read_parquet(spark, path)
    p = plan_of(daily.daily_stats(stored, start="1996-01-01", end="1996-12-31"))
    assert "PushedFilters: [IsNotNull(dig_date), GreaterThanOrEqual(dig_date" in p


def test_column_pruning(spark, permits_small):
    p = plan_of(geo.map_points(permits_small))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in p
    assert "c_name" not in p


def test_per_day_topk_is_limited_before_shuffle(spark, permits_small):
    df = rankings.leaderboard_by_day(permits_small)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_no_python_udfs_anywhere(spark):
    import __spark_entry__ as E

    for key in ["weekday_comparison", "leaderboard_merged", "report_text", "permit_card_text", "page_label_value"]:
        p = plan_of(E.queries()[key](spark, "/root/testdata/sf0.001"))
        assert "EvalPython" not in p, key

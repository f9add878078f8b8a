"""Report rounding equals Python's round(x, 1) followed by '%.0f'."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trenchline.functions.rounding import py_format0, py_round1

TIES = [2.25, 2.35, 2.45, 2.55, 0.05, 0.15, 1.05, -2.25, -2.45, -0.04, 0.0, -0.0, 12.5, 13.5, 99.95, 1e-9, 123456.75]


def _check(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = df.select("x", py_round1(F.col("x")).alias("r"), py_format0(F.abs(py_round1(F.col("x")))).alias("f")).collect()
    for row in got:
        assert row.r == round(row.x, 1), row
        assert row.f == "%.0f" % abs(round(row.x, 1)), row


def test_known_ties(spark):
    _check(spark, TIES)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=50))
def test_random_values(spark, values):
    _check(spark, values)


def test_percent_like_values(spark):
    # (a - s/n) / (s/n) * 100 for small counts: the values the report sees
    vals = []
    for s in range(1, 60):
        for n in (1, 2, 3, 4, 7, 8, 13, 52, 104):
            avg = s / n
            for a in range(0, 12):
                vals.append((a - avg) / avg * 100.0)
    _check(spark, vals)

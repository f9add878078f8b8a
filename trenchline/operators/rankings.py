"""Leaderboards and contractor-name reports (top-k aggregates).

Every report is "aggregate by key, then keep the k largest groups".  The
aggregate is a hash aggregate with partial (map-side) aggregation, so a key
holding a third of all permits is pre-counted in every task before the
shuffle.  A global top-k is planned as TakeOrderedAndProject (each task keeps
k rows, the driver merges k x tasks rows); a per-day top-k is
``row_number() <= k`` which Spark plans with a partial WindowGroupLimit
before the shuffle, so no day ever sends more than k rows per task.

Order within a count is by name (the reference leaves ties open); the output
carries an explicit ``rank`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.functions.dates import day_range_filter, local_day
from trenchline.functions.names import with_clean_name

DAY = "day"
SPECIAL_CHARS = ["*", "(", ")", "-", "&", "/"]  # fixed value: characters flagged in names


def contractor_name(first: str = "contact_first_name", last: str = "contact_last_name") -> Column:
    """'first last', or just the last name when the first is null or empty."""
    f, la = F.col(first), F.col(last)
    return F.when(f.isNull() | (f == F.lit("")), la).otherwise(F.concat(f, F.lit(" "), la))


def _has_last_name(last: str = "contact_last_name") -> Column:
    return F.col(last).isNotNull() & (F.col(last) != F.lit(""))


def _scope(permits: DataFrame, start=None, end=None, emergency_only: bool = False) -> DataFrame:
    cond = day_range_filter("dig_date", start, end)
    p = permits if cond is None else permits.where(cond)
    return p.where(F.col("is_emergency")) if emergency_only else p


def clean_distinct(df: DataFrame, raw: str, dst: str = "name", carry: dict | None = None, strict_suffix: bool = False) -> DataFrame:
    """Clean ``raw`` once per distinct value: ``raw, dst`` (+ carried aggregates).

    ``df`` must already hold one row per ``raw`` value.  The cleaned name
    leaves through an aggregate keyed by the raw name, so it is an aggregate
    *output*: a later filter on it (e.g. "non-empty") cannot be pushed below
    this point, which would otherwise move the whole rule chain into the
    permit scan and run it once per permit instead of once per name.  The
    input is already partitioned by ``raw``, so the barrier adds no shuffle.

    The rows are hash-partitioned by ``raw`` over the session's shuffle
    partitions first: the rule chain is CPU-heavy per row, and without an
    explicit partition count AQE would coalesce a few thousand small rows
    into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cleaned = with_clean_name(df.repartition(n, raw), raw, dst, strict_suffix)
    aggs = [F.max(dst).alias(dst)] + [F.max(c).alias(a) for a, c in (carry or {}).items()]
    return cleaned.groupBy(raw).agg(*aggs)


def _top(counts: DataFrame, k: int, count_col: str, name_col: str) -> DataFrame:
    """Global top-k with an explicit rank (TakeOrderedAndProject, then rank on k rows)."""
    top = counts.orderBy(F.col(count_col).desc(), F.col(name_col).asc_nulls_first()).limit(k)
    w = Window.orderBy(F.col(count_col).desc(), F.col(name_col).asc_nulls_first())
    return top.withColumn("rank", F.row_number().over(w))


def leaderboard(
    permits: DataFrame,
    k: int = 5,
    start=None,
    end=None,
    emergency_only: bool = False,
    merge_names: bool = False,
) -> DataFrame:
    """Top-k contractors by permit count -> ``rank, name, count``.

    ``merge_names=False`` (the reference's behaviour): group by the raw name,
    take the top k, then clean the k names; a name that cleans to '' is
    dropped, so fewer than k rows can come back.  ``merge_names=True``: clean
    first (on the distinct raw names only) and group by the cleaned name, so
    spellings of one company add up.
    """
    p = _scope(permits, start, end, emergency_only).where(_has_last_name())
    counts = p.groupBy(contractor_name().alias("contractor_name")).agg(F.count(F.lit(1)).alias("count"))
    if merge_names:
        cleaned = clean_distinct(counts, "contractor_name", "name", carry={"count": "count"})
        merged = cleaned.groupBy("name").agg(F.sum("count").cast("bigint").alias("count")).where(F.col("name") != F.lit(""))
        return _top(merged, k, "count", "name").select("rank", "name", "count")
    top = counts.orderBy(F.col("count").desc(), F.col("contractor_name").asc()).limit(k)
    cleaned = with_clean_name(top, "contractor_name", "name").where(F.col("name") != F.lit(""))
    w = Window.orderBy(F.col("count").desc(), F.col("contractor_name").asc())
    return cleaned.withColumn("rank", F.row_number().over(w)).select("rank", "name", "count")


def leaderboard_by_day(
    permits: DataFrame, k: int = 5, start=None, end=None, emergency_only: bool = False, merge_names: bool = False
) -> DataFrame:
    """Top-k contractors of every day -> ``day, rank, name, count``
    (permits without a dig date belong to no day)."""
    p = _scope(permits, start, end, emergency_only).where(_has_last_name() & F.col("dig_date").isNotNull())
    counts = p.groupBy(local_day("dig_date").alias(DAY), contractor_name().alias("contractor_name")).agg(
        F.count(F.lit(1)).alias("count")
    )
    if merge_names:
        names = counts.select("contractor_name").distinct()
        lookup = clean_distinct(names, "contractor_name", "name")
        counts = (
            counts.join(lookup, "contractor_name")
            .groupBy(DAY, "name")
            .agg(F.sum("count").cast("bigint").alias("count"))
            .where(F.col("name") != F.lit(""))
            .withColumnRenamed("name", "contractor_name")
        )
    w = Window.partitionBy(DAY).orderBy(F.col("count").desc(), F.col("contractor_name").asc())
    top = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    if merge_names:
        return top.select(DAY, F.col("_r").alias("rank"), F.col("contractor_name").alias("name"), "count")
    # clean each distinct name of the top rows once, then join back
    lookup = clean_distinct(top.select("contractor_name").distinct(), "contractor_name", "name")
    cleaned = top.join(lookup, "contractor_name").where(F.col("name") != F.lit(""))
    return cleaned.select(DAY, F.row_number().over(w).alias("rank"), "name", "count")


def leaderboard_streets(permits: DataFrame, k: int = 5, start=None, end=None) -> DataFrame:
    """Streets with most permits -> ``rank, name, count``."""
    p = _scope(permits, start, end).where(F.col("street_name").isNotNull() & (F.col("street_name") != F.lit("")))
    counts = p.groupBy(F.col("street_name").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return _top(counts, k, "count", "name").select("rank", "name", "count")


def contact_pairs(permits: DataFrame, k: int = 10, start=None, end=None) -> DataFrame:
    """A5: commonest (first, last) contact pairs (nulls form their own group)."""
    p = _scope(permits, start, end)
    counts = p.groupBy("contact_first_name", "contact_last_name").agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col("contact_first_name").asc_nulls_first(), F.col("contact_last_name").asc_nulls_first()]
    top = counts.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def name_frequency(permits: DataFrame, k: int = 100) -> DataFrame:
    """Commonest last names -> ``rank, name, frequency``."""
    counts = permits.where(_has_last_name()).groupBy(F.col("contact_last_name").alias("name")).agg(
        F.count(F.lit(1)).alias("frequency")
    )
    return _top(counts, k, "frequency", "name").select("rank", "name", "frequency")


def name_special_chars(permits: DataFrame, k: int = 20) -> DataFrame:
    """Commonest last names containing any of * ( ) - & /."""
    last = F.col("contact_last_name")
    special = None
    for ch in SPECIAL_CHARS:
        c = last.contains(ch)
        special = c if special is None else special | c
    counts = permits.where(_has_last_name() & special).groupBy(last.alias("name")).agg(F.count(F.lit(1)).alias("frequency"))
    return _top(counts, k, "frequency", "name").select("rank", "name", "frequency")


def name_case_variants(permits: DataFrame, k: int = 20) -> DataFrame:
    """Last names written in more than one letter case.

    Two aggregates: by raw spelling, then by upper-case form.  The second one
    collects the *distinct spellings* of a name (bounded by the spellings, not
    by the permits), sorted and joined with ' | '.
    """
    spellings = permits.where(_has_last_name()).groupBy(F.col("contact_last_name").alias("original_name")).agg(
        F.count(F.lit(1)).alias("frequency")
    )
    groups = (
        spellings.groupBy(F.upper("original_name").alias("upper_name"))
        .agg(
            F.expr("listagg(original_name, ' | ') within group (order by original_name)").alias("variations"),
            F.sum("frequency").cast("bigint").alias("total_frequency"),
            F.count(F.lit(1)).alias("n_spellings"),
        )
        .where(F.col("n_spellings") > 1)
    )
    return _top(groups, k, "total_frequency", "upper_name").select("rank", "variations", "total_frequency", "upper_name")


def normalize_names(permits: DataFrame, column: str = "contact_last_name", strict_suffix: bool = False) -> DataFrame:
    """T1 over a table: every distinct non-empty name, its cleaned form, and
    how many permits carry it.  Cleaning runs once per distinct name."""
    names = permits.where(F.col(column).isNotNull() & (F.col(column) != F.lit(""))).groupBy(
        F.col(column).alias("raw_name")
    ).agg(F.count(F.lit(1)).alias("frequency"))
    return clean_distinct(names, "raw_name", "clean_name", carry={"frequency": "frequency"}, strict_suffix=strict_suffix).select(
        "raw_name", "clean_name", "frequency"
    )

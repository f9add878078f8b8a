"""Data checks and column profiles.

Each check is one aggregate pass; results are small DataFrames.
Raising on a failed gate is a separate, explicit action (``enforce_gate``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trenchline.schema import KEY, REQUIRED_COLUMNS

# fixed values: minimum rows a batch must have before it is stored
MIN_ROWS_FULL_REFRESH = 100
MIN_ROWS_DAILY_UPDATE = 10
PROFILE_MAX_DISTINCT = 10
PROFILE_TOP_VALUES = 5
#: rows looked at to leave out columns that have too many values for certain
PEEK_ROWS = 1000


class DataValidationError(RuntimeError):
    pass


def schema_check(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """``column_name, present, n_rows, n_non_null`` per required column
    (absent columns report 0 non-null values)."""
    present = set(df.columns)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count(F.col(c)).alias(f"nn_{i}") for i, c in enumerate(required) if c in present]
    one = df.agg(*aggs)
    items = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in present).alias("present"),
            F.col("n_rows").alias("n_rows"),
            (F.col(f"nn_{i}") if c in present else F.lit(0).cast("bigint")).alias("n_non_null"),
        )
        for i, c in enumerate(required)
    ]
    return one.select(F.inline(F.array(*items)))


GATE_SCHEMA = "n_rows bigint, null_keys bigint, has_key_column boolean, min_rows bigint, passed boolean"


def quality_gate(df: DataFrame, min_rows: int = MIN_ROWS_DAILY_UPDATE, key: str = KEY) -> DataFrame:
    """One row ``n_rows, null_keys, has_key_column, min_rows, passed``."""
    has_key = key in df.columns
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs.append(F.count_if(F.col(key).isNull()).alias("null_keys") if has_key else F.lit(None).cast("bigint").alias("null_keys"))
    g = df.agg(*aggs)
    return g.select(
        "n_rows",
        "null_keys",
        F.lit(has_key).alias("has_key_column"),
        F.lit(min_rows).cast("bigint").alias("min_rows"),
        # a feed that lacks the ticket column has null tickets throughout once it is conformed
        (F.lit(has_key) & (F.col("n_rows") > F.coalesce("null_keys", F.lit(0))) & (F.col("n_rows") >= min_rows)).alias("passed"),
    )


def require_columns(df: DataFrame, columns: dict[str, tuple[str, ...]]) -> None:
    """Fail fast (no Spark job) when an input lacks a column or has a
    column of the wrong kind; ``columns`` maps name -> accepted type names."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    missing = [c for c in columns if c not in types]
    if missing:
        raise DataValidationError(f"missing columns: {missing}")
    wrong = {c: types[c] for c, ok in columns.items() if ok and types[c] not in ok}
    if wrong:
        raise DataValidationError(f"columns of the wrong type: {wrong}")


NUMERIC = ("double", "float", "long", "integer", "short", "decimal")
TIMESTAMPS = ("timestamp_ntz", "timestamp", "date")


def gate_row(metrics: dict, min_rows: int) -> dict:
    """The gate of ``quality_gate`` from counts that were observed in another pass."""
    n, null_keys = metrics["n_rows"], metrics["null_keys"]
    return {"n_rows": n, "null_keys": null_keys, "has_key_column": True, "min_rows": min_rows, "passed": n > null_keys and n >= min_rows}


def check_gate(row: dict) -> dict:
    """Raise when a gate has failed."""
    if not row["passed"]:
        raise DataValidationError(f"data gate failed: {row}")
    return row


def enforce_gate(gate: DataFrame) -> dict:
    """Run the gate (one small action) and raise when it fails."""
    return check_gate(gate.first().asDict())


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when an input is empty (one action, which stops at the first row)."""
    if df.isEmpty():
        raise DataValidationError("the input has no rows")
    return df


def profile(df: DataFrame) -> DataFrame:
    """``column_name, data_type, n_rows, n_null, null_pct`` for every column."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(cols)])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    items = []
    for i, c in enumerate(cols):
        n_null = F.col("n_rows") - F.col(f"nn_{i}")
        items.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(types[c]).alias("data_type"),
                F.col("n_rows").alias("n_rows"),
                n_null.alias("n_null"),
                F.when(F.col("n_rows") > 0, n_null * F.lit(100.0) / F.col("n_rows")).otherwise(F.lit(0.0)).alias("null_pct"),
            )
        )
    return one.select(F.inline(F.array(*items)))


def profile_values(df: DataFrame, max_distinct: int = PROFILE_MAX_DISTINCT, top: int = PROFILE_TOP_VALUES) -> DataFrame:
    """The ``top`` commonest non-null values of every column with at most
    ``max_distinct`` distinct non-null values -> ``column_name, value,
    frequency, rank`` (values as text).

    Exact, in one scan: grouping sets with one set for each column.  Columns
    that show more than ``max_distinct`` values in the first ``PEEK_ROWS``
    rows have too many for certain and are not counted (a head of the table,
    a hash for each value).  Every task counts the values it sees before the
    shuffle, so a column of few values sends a handful of rows; of a column
    that has many after all only the ``max_distinct`` + 1 commonest values
    leave a task, and one row too many tells.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    # 0.0 and -0.0 are one value
    plain = [F.col(f"`{c}`") + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns]
    peek = df.select([F.when(v.isNotNull(), F.xxhash64(v)).alias(f"_h{i}") for i, v in enumerate(plain)]).head(PEEK_ROWS)
    cols = [c for i, c in enumerate(df.columns) if len({r[i] for r in peek} - {None}) <= max_distinct]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, frequency bigint, rank bigint")
    # names of its own for every column, so that no name clashes with those made here
    named = df.select([F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(cols)])
    # grouping_id has a bit for each column, 0 where it is grouped by; the first column is the highest bit
    grouped = named.groupingSets([[F.col(f"_v{i}")] for i in range(len(cols))], *[F.col(f"_v{i}") for i in range(len(cols))])
    counts = grouped.agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("frequency"))
    full = (1 << len(cols)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        this = F.col("_set") == full - (1 << (len(cols) - 1 - i))
        name = F.when(this, F.lit(c)).otherwise(name)
        value = F.when(this, F.col(f"_v{i}").cast("string")).otherwise(value)
    values = counts.select(name.alias("column_name"), value.alias("value"), "frequency").where(F.col("value").isNotNull())
    order = Window.partitionBy("column_name").orderBy(F.col("frequency").desc(), F.col("value").asc())
    most = values.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= max_distinct + 1)
    per_col = Window.partitionBy("column_name")
    return (
        most.withColumn("_n", F.count(F.lit(1)).over(per_col))
        .where((F.col("_n") <= max_distinct) & (F.col("rank") <= top))
        .select("column_name", "value", "frequency", "rank")
    )

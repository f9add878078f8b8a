"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their SQL oracles.

Each query reads the test tables (or data Spark derives from them) whole;
the oracle is the same computation written as plain SQL for DuckDB over the
same parquet files.  Computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.sources.fixtures import PERMITS_SQL, permits_from_tpch

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, dates=(), stamps=()):
    """Register a query; ``dates`` / ``stamps`` name its DATE / TIMESTAMP
    output columns, which both sides hand over as ISO text (see ``present``)."""

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = present_sql(sql.strip(), dates, stamps)
        return fn

    return deco


def present(df: DataFrame) -> DataFrame:
    """Render DATE as 'yyyy-MM-dd' and timestamps as 'yyyy-MM-dd HH:mm:ss.SSSSSS'.

    The two engines hand dates and timestamps to pandas as different types
    (date objects vs datetime64 of different units); text is identical on
    both sides.  Library operators keep the real types; only registered
    query results are rendered."""
    cols = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
            changed = True
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name))
            changed = True
        else:
            cols.append(F.col(f.name))
    return df.select(*cols) if changed else df


def present_sql(sql: str, dates=(), stamps=()) -> str:
    if not dates and not stamps:
        return sql
    rep = [f"strftime({c}, '%Y-%m-%d') as {c}" for c in dates]
    rep += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') as {c}" for c in stamps]
    return f"select * replace ({', '.join(rep)}) from (\n{sql}\n) as q"


def with_permits(body: str, extra_ctes: str = "") -> str:
    """Oracle SQL over the permit view derived from orders x customer."""
    ctes = f"permits as ({PERMITS_SQL})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"with {ctes}\n{body}"


def permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permits_from_tpch(spark, sf_dir)


# Importing the query modules fills QUERIES / ORACLE.
from trenchline.plans import queries_daily  # noqa: E402,F401
from trenchline.plans import queries_rankings  # noqa: E402,F401
from trenchline.plans import queries_table  # noqa: E402,F401
from trenchline.plans import queries_text  # noqa: E402,F401
from trenchline.plans import queries_quality  # noqa: E402,F401
from trenchline.plans import queries_jobs  # noqa: E402,F401

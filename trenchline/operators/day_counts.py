"""Day counts kept beside the permit table, for the months that changed only.

One small Parquet folder for each table version: month, day, permits and
emergency permits.  Versions share the folders of months that did not change,
so the counts of a version are those of an earlier one with the months
replaced whose folders differ.  Reports over days (A2, W1) then read one row
a day and no permits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trenchline.functions.dates import local_day
from trenchline.operators.table import MONTH, PermitTable, _fs, month_of, rename_new
from trenchline.sources.files import write_parquet

SCHEMA = f"{MONTH} string, day date, total_permits bigint, emergency_permits bigint"


def _count(permits: DataFrame) -> DataFrame:
    dated = permits.where(F.col("dig_date").isNotNull()).withColumn(MONTH, month_of(permits))
    return dated.groupBy(MONTH, local_day("dig_date").alias("day")).agg(
        F.count(F.lit(1)).alias("total_permits"), F.count_if(F.col("is_emergency")).alias("emergency_permits")
    )


def _counted(table: PermitTable) -> list[int]:
    fs, p = _fs(table.spark, f"{table.root}/day_counts")
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def _path(table: PermitTable, version: int) -> str:
    return f"{table.root}/day_counts/v{version:08d}"


def refresh(table: PermitTable, version: int | None = None) -> list[str]:
    """Bring the counts up to ``version`` (default: the current one); returns the months counted anew.

    Written under a name of its own and renamed, so a reader never sees half
    of it and a writer that comes second changes nothing."""
    v = table.current_version() if version is None else version
    counted = _counted(table)
    if v is None or v in counted:
        return []
    known = set(table.versions())
    base = max((c for c in counted if c < v and c in known), default=None)
    months, before = table.months(v), table.months(base) if base is not None else {}
    anew = sorted(m for m, folders in months.items() if before.get(m) != folders)
    rows = _count(table.read(v, months=anew))
    if base is not None:
        old = table.spark.read.schema(SCHEMA).parquet(_path(table, base))
        kept = [m for m in months if m not in anew]
        rows = old.where(F.col(MONTH).isin(kept)).unionByName(rows)
    temporary = f"{table.root}/day_counts/tmp-{uuid.uuid4().hex}"
    # one row for each day with permits
    write_parquet(rows.coalesce(1), temporary)
    if not rename_new(table.spark, temporary, _path(table, v)):
        fs, p = _fs(table.spark, temporary)
        fs.delete(p, True)
    return anew


def read(table: PermitTable, version: int | None = None) -> DataFrame:
    """A2 from the kept counts: day, total_permits, emergency_permits (no permits are read)."""
    v = table.current_version() if version is None else version
    refresh(table, v)
    return table.spark.read.schema(SCHEMA).parquet(_path(table, v)).drop(MONTH)

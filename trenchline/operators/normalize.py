"""Conform raw feeds to the permit schema.

Both feed families (upper-case CSV export, lower-case API) are renamed to
the target names; every value is coerced with ``try_cast``-style parsing, so
a bad value becomes null instead of failing the batch.  Everything is a
single projection: it fuses into the scan's codegen stage and costs one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.schema import (
    API_FIELD_NAMES,
    CSV_FIELD_NAMES,
    DATE_COLUMNS,
    EMERGENCY_TRUE_VALUES,
    FLOAT_COLUMNS,
    INT_COLUMNS,
    PERMIT_SCHEMA,
    TEXT_COLUMNS,
)

# fixed values: text timestamp layouts accepted besides ISO-8601 (which a
# plain cast handles, with or without time / 'T' / fraction)
US_TIMESTAMP_FORMATS = ["MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy"]
# fixed values: the span of nanosecond timestamps; a date outside is a bad value
FIRST_MOMENT, LAST_MOMENT = "1677-09-21 00:12:44", "2262-04-11 23:47:16"
EXPORT_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def rename_source_fields(raw: DataFrame) -> DataFrame:
    """Map either header family to the target names; others pass through."""
    mapping = {**CSV_FIELD_NAMES, **API_FIELD_NAMES}
    renames = {c: mapping[c] for c in raw.columns if c in mapping and mapping[c] != c}
    return raw.withColumnsRenamed(renames) if renames else raw


def parse_wallclock(c: Column, dtype: T.DataType) -> Column:
    """City wall-clock TIMESTAMP_NTZ from text (ISO or US layouts) or from a
    timestamp column; unparsable -> null.  So is a date that nanosecond
    timestamps cannot hold (a year 9999), which would stretch every calendar."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        value = c.cast("timestamp_ntz")
    else:
        text = F.trim(c.cast("string"))
        options = [text.try_cast("timestamp_ntz")]
        options += [F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") for fmt in US_TIMESTAMP_FORMATS]
        value = F.coalesce(*options)
    first, last = (F.lit(m).cast("timestamp_ntz") for m in (FIRST_MOMENT, LAST_MOMENT))
    return F.when(value.between(first, last), value)


def parse_emergency(c: Column) -> Column:
    """Text in {true, t, yes, y, 1} (any case) -> true; anything else, null included -> false."""
    return F.coalesce(F.lower(c.cast("string")).isin(EMERGENCY_TRUE_VALUES), F.lit(False))


def coerce_types(df: DataFrame) -> DataFrame:
    """N2-N5 on the target columns that are present."""
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = {}
    for c in DATE_COLUMNS:
        if c in types:
            exprs[c] = parse_wallclock(F.col(c), types[c])
    if "is_emergency" in types:
        exprs["is_emergency"] = parse_emergency(F.col("is_emergency"))
    for c in INT_COLUMNS:
        if c in types:
            exprs[c] = F.col(c).try_cast("bigint") if not isinstance(types[c], T.LongType) else F.col(c)
    for c in FLOAT_COLUMNS:
        if c in types:
            exprs[c] = F.col(c).try_cast("double") if not isinstance(types[c], T.DoubleType) else F.col(c)
    for c in TEXT_COLUMNS:
        if c in types and not isinstance(types[c], T.StringType):
            exprs[c] = F.col(c).cast("string")
    return df.withColumns(exprs) if exprs else df


def conform(raw: DataFrame, fill_missing: bool = True, keep_extra: bool = False) -> DataFrame:
    """The typed permit table from a raw feed.

    ``fill_missing`` adds absent target columns as typed nulls (so every
    version of the table has one schema); ``keep_extra`` keeps unknown source
    columns after the target ones.
    """
    df = coerce_types(rename_source_fields(raw))
    cols = []
    present = set(df.columns)
    for f in PERMIT_SCHEMA.fields:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif fill_missing:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    if keep_extra:
        target = set(PERMIT_SCHEMA.fieldNames())
        cols += [F.col(f"`{c}`") for c in df.columns if c not in target]
    return df.select(*cols)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Target columns absent after renaming (schema metadata only)."""
    present = set(rename_source_fields(df).columns)
    return [c for c in required if c not in present]


def to_export(permits: DataFrame) -> DataFrame:
    """The text layout the original job stored: dates as
    'yyyy-MM-dd HH:mm:ss' text, the emergency flag as 0/1."""
    exprs = {c: F.date_format(F.col(c), EXPORT_TIMESTAMP_FORMAT) for c in DATE_COLUMNS if c in permits.columns}
    if "is_emergency" in permits.columns:
        exprs["is_emergency"] = F.when(F.col("is_emergency"), F.lit(1)).otherwise(F.lit(0))
    return permits.withColumns(exprs)

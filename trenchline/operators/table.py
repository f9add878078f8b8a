"""The permit table: versions, full refresh, upsert by ticket, merge report,
recent rows (K1-K6, J1-J2, P9).

Storage is plain Parquet, one folder per month of the dig date, rows in the
order of the dig date inside each file.  Every write goes to a folder of its
own (``data/<unique>/_month=...``).  A version is a manifest
``manifests/v00000001`` that names the schema and, for each month, the folder
that holds it.  A manifest is written under a temporary name and renamed,
never over another one, to the number after the version that its content was
made from: of two writers one fails, a failed or killed write leaves nothing
that a reader sees, and a version that another writer is about to publish is
never passed over.  The file system must rename files atomically (HDFS does).

A merge reads the key columns of the table once, rewrites only the months that
hold a replaced row or receive a new one, and takes over the other months by
reference.  Old versions stay readable until ``expire`` is called.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.functions.dates import as_date, day_range_filter, ntz_literal
from trenchline.schema import AUDIT_COLUMNS, KEY, PERMIT_COLUMNS
from trenchline.sources.files import CORRUPT, FeedError, write_parquet

# fixed values: feed window of the incremental fetch (days + overlap)
DAYS_TO_FETCH = 30
OVERLAP_DAYS = 2


class NoDataError(RuntimeError):
    """Raised when a table has no complete version (nothing to analyse)."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename ``source`` to ``target``; False (and no change) if there is a target already."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(source).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(path(source), path(target), never_over)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


MONTH = "_month"
NO_MONTH = "none"
#: the dig day beside each stored row, for skipping row groups; not a column of the table
DAY = "_day"
#: a day of a month falls into few row groups of this size
ROW_GROUP_BYTES = 32 << 20


def month_of(df: DataFrame) -> F.Column:
    """Month of the dig date as text; rows without a date (or text dates) share one folder."""
    kind = df.schema["dig_date"].dataType if "dig_date" in df.columns else None
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(NO_MONTH)
    return F.coalesce(F.date_format("dig_date", "yyyy-MM"), F.lit(NO_MONTH))


class PermitTable:
    """A versioned permit table at ``root`` (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def current_version(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    def _manifest(self, version: int) -> dict:
        fs, p = _fs(self.spark, f"{self.root}/manifests/v{version:08d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def months(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders of each month of a version, relative to the root."""
        v = self.current_version() if version is None else version
        return {} if v is None else self._manifest(v)["months"]

    def read(self, version: int | None = None, months: list[str] | None = None, start=None, end=None) -> DataFrame:
        """The newest version (or a given one, or some of its months); error if none.

        ``start`` / ``end``: rows whose dig day lies in the range; only the
        months of the range are read, and row groups are skipped by day."""
        v = self.current_version() if version is None else version
        if v is None:
            raise NoDataError(f"no complete version under {self.root}")
        found = self._manifest(v)
        schema = T.StructType.fromJson(found["schema"])
        names = [m for m in sorted(found["months"]) if months is None or m in months]
        if start is not None:
            names = [m for m in names if m != NO_MONTH and m >= str(start)[:7]]
        if end is not None:
            names = [m for m in names if m != NO_MONTH and m <= str(end)[:7]]
        paths = [f"{self.root}/{f}" for m in names for f in found["months"][m]]
        days = day_range_filter("dig_date", start, end)
        if not paths:
            return self.spark.createDataFrame([], schema)
        if days is None:
            return self.spark.read.schema(schema).parquet(*paths)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])).parquet(*paths)
        # ranges of dates reach the row groups' statistics, those of TIMESTAMP_NTZ do not;
        # null: a file without the column
        skip = F.lit(True)
        if start is not None:
            skip = skip & (F.col(DAY) >= as_date(start))
        if end is not None:
            skip = skip & (F.col(DAY) <= as_date(end))
        return rows.where(F.col(DAY).isNull() | skip).where(days).drop(DAY)

    def recent(self, as_of=None, days: int = 30, version: int | None = None) -> DataFrame:
        """K5 on the stored table: only months that can hold such rows are read.

        ``as_of`` defaults to the latest dig day, which the newest month has."""
        if as_of is None:
            newest = max((m for m in self.months(version) if m != NO_MONTH), default=None)
            as_of = self.read(version, months=[newest]).agg(F.max(F.to_date("dig_date"))).first()[0] if newest else None
            if as_of is None:
                return self.read(version).where("false")
        day = _dt.date.fromisoformat(str(as_of)[:10])
        return recent_permits(self.read(version, start=day - _dt.timedelta(days=days)), as_of=day, days=days)

    def write(self, df: DataFrame) -> dict[str, list[str]]:
        """Write rows to a new folder, by month and in day order; no version names it yet."""
        folder = f"data/{uuid.uuid4().hex}"
        # few files per month; AQE splits a month that is too large for one task.
        # The writer sorts by month anyway, so the day order costs no second sort
        by_month = df.withColumn(MONTH, month_of(df)).hint("rebalance", MONTH)
        by_day = by_month
        if "dig_date" in df.columns:
            kind = df.schema["dig_date"].dataType
            day = F.to_date("dig_date") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(None).cast("date")
            by_day = by_month.withColumn(DAY, day).sortWithinPartitions(MONTH, "dig_date")
        write_parquet(by_day, f"{self.root}/{folder}", [MONTH], {"parquet.block.size": ROW_GROUP_BYTES})
        fs, p = _fs(self.spark, f"{self.root}/{folder}")
        names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
        return {n.split("=", 1)[1]: [f"{folder}/{n}"] for n in names if n.startswith(f"{MONTH}=")}

    def publish(self, schema: T.StructType, months: dict[str, list[str]], after: int | None) -> int:
        """Create the manifest of the version after ``after`` (the one that the
        content was made from); fails if another writer was first."""
        version = (after or 0) + 1
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        content = json.dumps({"schema": json.loads(nullable.json()), "months": months})
        temporary = f"{self.root}/manifests/tmp-{uuid.uuid4().hex}"
        fs, p = _fs(self.spark, temporary)
        stream = fs.create(p, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        newer = [v for v in self.versions() if v >= version]
        if newer or not rename_new(self.spark, temporary, f"{self.root}/manifests/v{version:08d}"):
            fs.delete(p, False)
            raise RuntimeError("another writer has published a version meanwhile")
        return version

    def commit(self, df: DataFrame) -> int:
        """``df`` as the whole content of the next version; returns its number."""
        after = self.current_version()
        return self.publish(df.schema, self.write(df), after)

    def drop_folder(self, path: str) -> None:
        fs, p = _fs(self.spark, f"{self.root}/{path}")
        fs.delete(p, True)

    def expire(self, keep: int = 2, orphans_after_hours: float = 24) -> list[int]:
        """Drop all but the newest ``keep`` versions, and the folders that no
        version is left to name.  Folders of writes that broke off go once they
        are older than ``orphans_after_hours``: younger ones may be under way."""
        known = self.versions()
        old, left = known[:-keep], known[-keep:]
        folders = lambda versions: {f for v in versions for fs in self.months(v).values() for f in fs}
        used, gone = folders(left), folders(old)
        writes = {f.split("/")[1] for f in used}
        for f in sorted(gone - used):
            write = f.split("/")[1]
            self.drop_folder(f if write in writes else f"data/{write}")
        for v in old:
            self.drop_folder(f"manifests/v{v:08d}")
            self.drop_folder(f"day_counts/v{v:08d}")
        before = _dt.datetime.now().timestamp() - 3600 * orphans_after_hours
        for top in ("data", "staging", "manifests", "day_counts"):
            fs, p = _fs(self.spark, f"{self.root}/{top}")
            for st in fs.listStatus(p) if fs.exists(p) else []:
                name = st.getPath().getName()
                kept = name in writes if top == "data" else name.startswith("v")
                if not kept and st.getModificationTime() / 1000 <= before:
                    self.drop_folder(f"{top}/{name}")
        return old


def with_audit(df: DataFrame, now) -> DataFrame:
    """``created_at = updated_at = now`` (UTC wall clock, NTZ)."""
    ts = ntz_literal(now) if now is not None else F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
    return df.select(*PERMIT_COLUMNS, ts.alias("created_at"), ts.alias("updated_at"))


def batch_metrics(batch: DataFrame) -> list[F.Column]:
    """What a check wants to know of a batch, to be observed in the pass that writes it."""
    null_keys = F.count_if(F.col(KEY).isNull()) if KEY in batch.columns else F.count(F.lit(1))
    unreadable = F.count_if(F.col(CORRUPT).isNotNull()) if CORRUPT in batch.columns else F.count(F.lit(None))
    return [F.count(F.lit(1)).alias("n_rows"), null_keys.alias("null_keys"), unreadable.alias("unreadable")]


def _checked(metrics: dict, check) -> dict:
    if metrics["unreadable"]:
        raise FeedError(f"{metrics['unreadable']} records of the feed cannot be read in the chosen form (JSON Lines or one array per file)")
    if check is not None:
        check(metrics)
    return metrics


def full_refresh(table: PermitTable, permits: DataFrame, now=None, check=None) -> int:
    """K2: the whole feed becomes a new version with fresh audit columns.

    Repeated tickets are reduced to one row (by ``arrival`` if there is such a
    column, else the latest request date); rows without a ticket are kept.
    Unlike a clear-then-load, the old version stays readable until the new
    one is complete.

    The feed is read once: counts of its rows are observed while they are
    written, and ``check`` (n_rows, null_keys, unreadable; raises to refuse)
    and the count of the stored rows decide before the version is published."""
    order = ("arrival",) if "arrival" in permits.columns else ("request_date",)
    read, written = Observation(), Observation()
    one_each = dedupe_batch(permits.observe(read, *batch_metrics(permits)), order=order, keep_null=True).select(*PERMIT_COLUMNS)
    rows = with_audit(one_each, now).observe(written, F.count(F.lit(1)).alias("n"))
    after = table.current_version()
    months = table.write(rows)
    _checked(read.get, check)
    paths = [f"{table.root}/{f}" for folders in months.values() for f in folders]
    stored = table.spark.read.schema(rows.schema).parquet(*paths).count() if paths else 0  # from the files' footers
    if stored != written.get["n"]:
        raise RuntimeError(f"{written.get['n']} rows were written and {stored} are stored")
    return table.publish(rows.schema, months, after)


def dedupe_batch(batch: DataFrame, key: str = KEY, order: tuple[str, ...] = ("arrival",), keep_null: bool = False) -> DataFrame:
    """One row per ticket: the latest copy by ``order`` wins (exact ties: the
    larger content hash, so the choice is repeatable).  Without any column of
    ``order`` there is no latest copy, and this raises.  Rows without a ticket
    go, or stay as they are (``keep_null``).

    ``max_by`` is partially evaluated in every task, so a ticket re-sent a
    million times is reduced before the shuffle."""
    order = tuple(o for o in order if o in batch.columns)
    if not order:
        raise ValueError("the batch has no column that orders copies of a ticket")
    content = [c for c in PERMIT_COLUMNS if c in batch.columns and c != key]
    rank = F.struct(*[F.col(o) for o in order], F.xxhash64(*[F.col(c) for c in content]).alias("_h"))
    loose = []
    if keep_null:  # each row without a ticket is a group of its own
        batch, loose = batch.withColumn("_loose", F.when(F.col(key).isNull(), F.monotonically_increasing_id())), ["_loose"]
    else:
        batch = batch.where(F.col(key).isNotNull())
    picked = batch.groupBy(key, *loose).agg(
        F.max_by(F.struct(*[F.col(c) for c in content]), rank).alias("_r"),
        F.count(F.lit(1)).alias("_copies"),
    )
    return picked.select(key, "_r.*", "_copies")


def _with_audit_columns(existing: DataFrame) -> DataFrame:
    for c in AUDIT_COLUMNS:
        if c not in existing.columns:
            existing = existing.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    return existing


def _fresh(created: DataFrame, batch: DataFrame, now, key: str) -> DataFrame:
    """The deduplicated batch with audit columns; ``created``: first-seen times by ticket."""
    now_c = ntz_literal(now) if now is not None else F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
    old = created.groupBy(key).agg(F.min("created_at").alias("_old_created"))
    return batch.join(old, key, "left").select(*PERMIT_COLUMNS, F.coalesce(F.col("_old_created"), now_c).alias("created_at"), now_c.alias("updated_at"))


def upsert(existing: DataFrame, batch: DataFrame, now=None, key: str = KEY, order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """K3: the merged table (lazy).  New tickets are inserted, existing ones
    replaced; ``created_at`` of a replaced ticket is kept, ``updated_at`` =
    now; the latest copy of a ticket inside the batch wins.

    The joins carry no hint: AQE broadcasts the batch keys if their measured
    size allows, else both sides are shuffled on the ticket and skewed
    partitions are split."""
    existing = _with_audit_columns(existing)
    b = dedupe_batch(batch, key, order).select(*PERMIT_COLUMNS)
    kept = existing.join(b.select(key), key, "left_anti").select(*PERMIT_COLUMNS, *AUDIT_COLUMNS)
    created = existing.select(key, "created_at").join(b.select(key), key, "left_semi")
    return kept.unionByName(_fresh(created, b, now, key))


def merge_report(existing: DataFrame, batch: DataFrame, key: str = KEY) -> DataFrame:
    """K4: one row ``batch_rows`` (all rows), ``inserts``, ``updates`` (distinct new / existing tickets)."""
    bk = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
    hits = existing.select(key).join(bk.select(key), key, "left_semi").distinct().withColumn("_hit", F.lit(True))
    ticket = F.col(key).isNotNull()
    return bk.join(hits, key, "left").agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("bigint").alias("batch_rows"),
        F.count_if(ticket & F.col("_hit").isNull()).alias("inserts"),
        F.count_if(ticket & F.col("_hit").isNotNull()).alias("updates"),
    )


def _unchanged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Tickets of the batch that one stored row holds with the same content."""
    same = F.lit(True)
    for c in PERMIT_COLUMNS:
        if c != KEY:
            same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}"))
    return stored.alias("s").join(batch.alias("b"), KEY).groupBy(KEY).agg(F.bool_and(same).alias("same"), F.count(F.lit(1)).alias("n")).where("same and n = 1").select(KEY)


def merge_batch(
    table: PermitTable, batch: DataFrame, now=None, order: tuple[str, ...] = ("arrival",), check=None, skip_unchanged: bool = False
) -> tuple[int | None, DataFrame]:
    """Merge ``batch`` into the current version (or start the table with it)
    and publish the result; returns (version, report).  A batch that neither
    inserts nor replaces a ticket publishes nothing (version None).

    The batch is read once: it is deduplicated and landed, and its counts are
    observed on the way; ``check`` (see ``full_refresh``) may refuse it then.
    The key columns of the table are read once; the matched rows (ticket,
    month, first-seen time) are landed and serve the touched months, the
    report and the new audit columns.  Only touched months are read in full.

    ``skip_unchanged``: rows that say what the table says already are left as
    they are (their ``updated_at`` too), so a feed that sends its last days
    again rewrites only months with a change."""
    spark = table.spark
    after = table.current_version()
    staging = f"staging/{uuid.uuid4().hex}"
    try:
        seen = Observation()
        reduced = dedupe_batch(batch.observe(seen, *batch_metrics(batch)), order=order)
        write_parquet(reduced, f"{table.root}/{staging}/batch")
        metrics = _checked(seen.get, check)
        b = spark.read.schema(reduced.schema).parquet(f"{table.root}/{staging}/batch").select(*PERMIT_COLUMNS)
        existing = _with_audit_columns(table.read(after)) if after is not None else spark.createDataFrame([], with_audit(b, _dt.datetime(2000, 1, 1)).schema)
        matched = existing.select(KEY, month_of(existing).alias(MONTH), "created_at").join(b.select(KEY), KEY, "left_semi")
        write_parquet(matched, f"{table.root}/{staging}/matched")
        matched = spark.read.schema(matched.schema).parquet(f"{table.root}/{staging}/matched")
        # a set of months is as long as the calendar, not as the table
        hit = matched.agg(F.collect_set(MONTH).alias("months"), F.count_distinct(KEY).alias("n")).first()
        sent = b.agg(F.collect_set(month_of(b)).alias("months"), F.count(F.lit(1)).alias("n")).first()
        keys, updates, unchanged = sent["n"], hit["n"], 0
        months = table.months(after)
        if skip_unchanged and hit["n"]:
            same = _unchanged(_with_audit_columns(table.read(after, sorted(set(hit["months"]) & set(months)))), b)
            write_parquet(same, f"{table.root}/{staging}/unchanged")
            same = spark.read.schema(same.schema).parquet(f"{table.root}/{staging}/unchanged")
            unchanged = same.count()
            if unchanged:
                b, matched = b.join(same, KEY, "left_anti"), matched.join(same, KEY, "left_anti")
                hit = matched.agg(F.collect_set(MONTH).alias("months")).first()
                sent = b.agg(F.collect_set(month_of(b)).alias("months")).first()
        report = spark.createDataFrame([(metrics["n_rows"], keys - updates, updates, unchanged)], "batch_rows bigint, inserts bigint, updates bigint, unchanged bigint")
        if keys == unchanged:
            return None, report
        touched = set(hit["months"]) | set(sent["months"])
        part = _with_audit_columns(table.read(after, sorted(touched & set(months)))) if after is not None else existing
        kept = part.join(b.select(KEY), KEY, "left_anti").select(*PERMIT_COLUMNS, *AUDIT_COLUMNS)
        merged = kept.unionByName(_fresh(matched, b, now, KEY))
        written = table.write(merged)
        rest = {m: f for m, f in months.items() if m not in touched}
        return table.publish(merged.schema, rest | written, after), report
    finally:
        table.drop_folder(staging)


def recent_permits(permits: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """K5: ``dig_date >= as_of - days`` (no upper bound: future digs are
    included), newest first.  ``as_of`` defaults to the latest dig day of the
    table (a scalar subquery, so the plan needs no clock)."""
    ref = as_date(as_of) if as_of is not None else permits.select(F.max(F.to_date("dig_date"))).scalar()
    cutoff = F.date_sub(ref, days).cast("timestamp_ntz")
    return permits.where(F.col("dig_date") >= cutoff).orderBy(F.col("dig_date").desc(), F.col(KEY).desc())


def overlap_window(
    permits: DataFrame,
    as_of=None,
    days: int = DAYS_TO_FETCH,
    overlap_days: int = OVERLAP_DAYS,
    max_rows: int | None = None,
) -> DataFrame:
    """The rows an incremental fetch re-reads: ``request_date >=
    as_of - (days + overlap)``, newest request first.  ``max_rows`` applies a
    feed page limit when asked to; by default the window is returned whole."""
    ref = as_date(as_of) if as_of is not None else permits.select(F.max(F.to_date("request_date"))).scalar()
    cutoff = F.date_sub(ref, days + overlap_days).cast("timestamp_ntz")
    out = permits.where(F.col("request_date") >= cutoff).orderBy(F.col("request_date").desc(), F.col(KEY).desc())
    return out.limit(max_rows) if max_rows else out


def migrate(table: PermitTable, conform_fn, source_version: int | None = None) -> int:
    """K6: rewrite a version in the current schema as a new version; the
    source version is left untouched (it is the backup)."""
    src = table.read(source_version)
    return table.commit(conform_fn(src))


def utc_now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)

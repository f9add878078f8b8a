"""Incremental permit ingest as a Structured Streaming job.

Landed feed files (JSON Lines by default, CSV possible) are a file stream;
each micro-batch is conformed, deduplicated and merged into the versioned
permit table by ticket (``operators.table.upsert``), and one row per batch
is appended to the fetch log (``batch_id, batch_ts, rows``) that
``empty_batch_runs`` reads.

Failure model: the stream's checkpoint (in the shared checkpoint folder)
records which files each batch id covers.  A batch re-run after a crash is
skipped if the fetch log already has its id; if the crash fell between the
table commit and the log append, the re-run merges the same rows again,
which leaves the same table content (merging is idempotent).  There is no
watermark: late or corrected tickets are simply merged (the reference's
overlap window exists for the same reason).  Copies that the overlap sends
again are recognised at the merge, by comparing them with the stored rows of
their months.  A stream-side ``dropDuplicatesWithinWatermark`` on ticket and
content would lose a ticket that goes back to an earlier content within the
window, so it is not used.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trenchline.operators import normalize, table
from trenchline.sources import files

LOG_SCHEMA = "batch_id bigint, batch_ts timestamp_ntz, rows bigint, feed string"


def _read_log(spark: SparkSession, log_path: str) -> DataFrame | None:
    """The log, None if there is none yet; a log that cannot be read is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LOG_SCHEMA).parquet(log_path)


def append_log(spark: SparkSession, log_path: str, batch_id: int | None, now, n: int, feed: str | None = None) -> None:
    now = _dt.datetime.fromisoformat(now) if isinstance(now, str) else now or table.utc_now()
    spark.createDataFrame([(batch_id, now, n, feed)], LOG_SCHEMA).write.mode("append").parquet(log_path)


def make_batch_handler(target: table.PermitTable, log_path: str, clock=None, family: str = "api"):
    """The ``foreachBatch`` function: conform -> merge -> commit -> log.

    The files of a batch are read once (a CSV feed lands its cells first, as
    each file is read by its own header); the log's row count is observed in
    the merge.  Rows that are sent again without a change rewrite nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = _read_log(spark, log_path)
        if log is not None and log.where(F.col("batch_id") == batch_id).limit(1).count() > 0:
            return  # already applied
        now = (clock or table.utc_now)()
        seen: dict = {}
        feed = f"staging/{uuid.uuid4().hex}"
        try:
            rows = files.with_row(batch)
            if family == "csv":
                files.write_parquet(rows, f"{target.root}/{feed}")
                rows = files.by_header(spark.read.schema(rows.schema).parquet(f"{target.root}/{feed}"))
            table.merge_batch(target, normalize.conform(rows, keep_extra=True), now=now, check=seen.update, skip_unchanged=True)
        finally:
            target.drop_folder(feed)
        append_log(spark, log_path, batch_id, now, seen["n_rows"], family)

    return handle


def start_ingest(
    spark: SparkSession,
    landing_dir: str,
    target: table.PermitTable,
    checkpoint_dir: str,
    log_path: str,
    family: str = "api",
    files_per_batch: int | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    clock=None,
) -> StreamingQuery:
    """Start the ingest stream.  ``available_now`` processes what has landed
    and stops (the daily job); ``processing_time`` keeps it running."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if family == "api":
        schema = files.feed_schema(family).add(files.CORRUPT, T.StringType())
        src = reader.schema(schema).option("primitivesAsString", True).option("columnNameOfCorruptRecord", files.CORRUPT).json(landing_dir)
        src = files.with_file(src)
    else:
        src = files.csv_cells(reader, landing_dir)
    writer = src.writeStream.foreachBatch(make_batch_handler(target, log_path, clock, family)).option("checkpointLocation", checkpoint_dir)
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_fetch_log(spark: SparkSession, log_path: str, feed: str | None = None) -> DataFrame:
    """The fetch log as ``batch_ts, rows`` (input of ``empty_batch_runs``), of one feed if named."""
    log = _read_log(spark, log_path)
    if log is None:
        return spark.createDataFrame([], "batch_ts timestamp_ntz, rows bigint")
    if feed is not None:
        log = log.where(F.col("feed").isNull() | (F.col("feed") == feed))
    return log.select("batch_ts", "rows")


def fixed_clock(ts: str):
    """A clock for tests and reruns: always ``ts``."""
    value = _dt.datetime.fromisoformat(ts)
    return lambda: value

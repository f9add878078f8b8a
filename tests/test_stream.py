"""The streaming ingest ends in the same table as one batch merge; re-runs are harmless."""

from pyspark.sql import functions as F

from trenchline.operators import normalize, table
from trenchline.schema import PERMIT_COLUMNS
from trenchline.session import scratch_path
from trenchline.sources import files, fixtures
from trenchline.streaming.ingest import fixed_clock, read_fetch_log, start_ingest


def test_stream_equals_batch_and_logs_batches(spark, permits_small):
    base = scratch_path(spark, "stream-test")
    existing, batch = fixtures.upsert_inputs(permits_small)
    # land the initial load, then the re-sent batch, as separate files
    files.write_json_lines(fixtures.raw_feed(existing, "api").coalesce(1), f"{base}/landing/a")
    # the whole batch, copies of a ticket in the order they were sent
    sent = batch.coalesce(1).sortWithinPartitions("arrival")
    files.write_json_lines(fixtures.raw_feed(sent, "api"), f"{base}/landing/b")
    t = table.PermitTable(spark, f"{base}/table")
    for _ in range(2):  # the second run finds nothing new
        q = start_ingest(spark, f"{base}/landing/*", t, f"{base}/ckpt", f"{base}/log", files_per_batch=1, clock=fixed_clock("2024-02-01 00:00:00"))
        q.awaitTermination()
    streamed = t.read().select(*PERMIT_COLUMNS)
    copies = [normalize.conform(fixtures.raw_feed(batch.where(F.col("arrival") == a), "api")).withColumn("arrival", F.lit(a)) for a in (1, 2)]
    want = table.upsert(
        table.with_audit(normalize.conform(fixtures.raw_feed(existing, "api")), "2024-02-01 00:00:00"),
        copies[0].unionByName(copies[1]),
        now="2024-02-01 00:00:00",
    ).select(*PERMIT_COLUMNS)
    assert streamed.exceptAll(want).count() == 0 and want.exceptAll(streamed).count() == 0
    log = read_fetch_log(spark, f"{base}/log").collect()
    assert len(log) == 2 and all(r.rows > 0 for r in log)


def test_stream_ingest_lands_its_feed_in_bounded_tasks(spark, monkeypatch):
    """However large the feed is against a task's share, more tasks land it, still for three micro-batches."""
    from trenchline.plans import catalog, queries_table  # noqa: F401  the catalog loads first

    base = scratch_path(spark, "stream-size")
    monkeypatch.setattr(queries_table, "scratch_path", lambda spark, name: base)
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for size in sizes:
        spark.conf.set(size, "8k")
    try:
        got = queries_table.q_stream_ingest(spark, "/root/testdata/sf0.001")
        want = queries_table.q_normalize(spark, "/root/testdata/sf0.001").select(*PERMIT_COLUMNS)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        for size in sizes:
            spark.conf.unset(size)
    landed = spark.read.text(f"{base}/landing/*").groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(landed) >= 18 and max(r["count"] for r in landed) * 12 < want.count()
    log = read_fetch_log(spark, f"{base}/log").collect()
    assert len(log) == 3 and sum(r.rows for r in log) == want.count() and min(r.rows for r in log) > 0


def test_a_feed_of_few_rows_has_its_shares(spark):
    base = scratch_path(spark, "shares")
    assert files.write_json_shares(spark.range(40).coalesce(1), f"{base}/few", 3) * 3 == len(spark.read.text(f"{base}/few/*").select(F.input_file_name()).distinct().collect())
    assert files.write_json_shares(spark.range(1), f"{base}/one", 3) == 1
    assert files.write_json_shares(spark.range(0), f"{base}/none", 3) == 1
    assert spark.read.schema("id long").json(f"{base}/few/*").agg(F.sum("id")).first()[0] == 780

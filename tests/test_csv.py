"""CSV exports are read by header name, file by file."""

import pytest

from trenchline.operators import normalize, table
from trenchline.session import scratch_path
from trenchline.sources import files, fixtures


def rows_of(df):
    return sorted(((r["DIG_TICKET#"], r["PERMIT#"], r["EXTRA"]) for r in df.collect()), key=str)


def test_files_with_headers_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DIG_TICKET#,PERMIT#,EMERGENCY\nT1,P1,Y\nT2,,N\n")
    (tmp_path / "b.csv").write_text('﻿PERMIT#,EXTRA,DIG_TICKET#\nP3,"x, ""y""",T3\n')
    (tmp_path / "c.csv").write_text("dig_ticket_,permit_\nT4,P4\n")  # the other family's names
    (tmp_path / "d.csv").write_text("DIG_TICKET#,PERMIT#,EMERGENCY\nT5\nDIG_TICKET#,PERMIT#,EMERGENCY\nT6,P6,Y,more\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text("PERMIT#,DIG_TICKET#\n")
    got = files.read_permits_csv(spark, str(tmp_path))
    assert set(got.columns) == {"DIG_TICKET#", "PERMIT#", "EMERGENCY", "EXTRA"}
    assert rows_of(got) == [("T1", "P1", None), ("T2", None, None), ("T3", "P3", 'x, "y"'), ("T4", "P4", None), ("T5", None, None), ("T6", "P6", None)]
    out = {r.dig_ticket_number: r.is_emergency for r in normalize.conform(got).collect()}
    assert out == {"T1": True, "T2": False, "T3": False, "T4": False, "T5": False, "T6": True}
    whole = files.read_permits_csv(spark, str(tmp_path), multi_line=True)
    assert rows_of(whole) == rows_of(got)


def test_split_files_keep_one_header(spark, tmp_path):
    lines = ["DIG_TICKET#,PERMIT#"] + [f"T{i},P{i}" for i in range(5000)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "b.csv").write_text("\n".join(["PERMIT#,DIG_TICKET#"] + [f"P{i},T{i}" for i in range(5000, 9000)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.read_permits_csv(spark, str(tmp_path))
        assert got.count() == 9000
        assert got.where("substr(`DIG_TICKET#`, 2) <> substr(`PERMIT#`, 2) or `DIG_TICKET#` not like 'T%'").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_that_cannot_be_used(spark, tmp_path):
    (tmp_path / "twice").mkdir()
    (tmp_path / "twice" / "a.csv").write_text("PERMIT#,permit_\n1,2\n")
    with pytest.raises(files.FeedError):
        files.read_permits_csv(spark, str(tmp_path / "twice"))
    (tmp_path / "wide").mkdir()
    (tmp_path / "wide" / "a.csv").write_text(",".join(f"F{i}" for i in range(80)) + "\n1\n")
    with pytest.raises(files.FeedError):
        files.read_permits_csv(spark, str(tmp_path / "wide"))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("")
    assert files.read_permits_csv(spark, str(tmp_path / "none")).count() == 0


def test_stream_reads_by_header(spark, permits_small):
    from trenchline.streaming.ingest import fixed_clock, start_ingest

    base = scratch_path(spark, "csv-stream")
    raw = fixtures.raw_feed(permits_small, "csv")
    files.write_csv(raw.where("`DIG_TICKET#` % 2 = 0"), f"{base}/landing/a")
    files.write_csv(raw.where("`DIG_TICKET#` % 2 = 1").select(*raw.columns[::-1]), f"{base}/landing/b")
    t = table.PermitTable(spark, f"{base}/table")
    q = start_ingest(spark, f"{base}/landing/*", t, f"{base}/ckpt", f"{base}/log", family="csv", clock=fixed_clock("2024-02-01 00:00:00"))
    q.awaitTermination()
    want = normalize.conform(raw)
    got = t.read().select(*want.columns).select(*[c for c in want.columns])
    blank = {"": None}
    assert got.count() == want.count()
    assert got.exceptAll(want.replace(blank)).count() == 0

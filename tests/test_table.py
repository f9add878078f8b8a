"""Feed normalisation and the permit table (the reference's pipeline tests A1-A3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trenchline.operators import normalize, table
from trenchline.session import scratch_path


def csv_batch(spark):
    # A1: bulk-file header style (with the key column the reference's fixture lacks)
    rows = [
        ("TEST001", "P1", "Y", "2024-01-01", "2024-01-02", 41.8, -87.6),
        ("TEST002", "P2", "N", "2024-01-01", "2024-01-02", 41.9, -87.7),
    ]
    return spark.createDataFrame(rows, "`DIG_TICKET#` string, `PERMIT#` string, EMERGENCY string, REQUESTDATE string, DIGDATE string, LATITUDE double, LONGITUDE double")


def api_batch(spark, keys):
    rows = [(k, True, "2024-01-03T08:00:00.000", "2024-01-04T00:00:00.000", 41.7, -87.5) for k in keys]
    return spark.createDataFrame(rows, "dig_ticket_ string, emergency boolean, requestdate string, digdate string, latitude double, longitude double")


def test_initial_load_incremental_merge_and_refresh(spark):
    t = table.PermitTable(spark, scratch_path(spark, "t"))
    with pytest.raises(table.NoDataError):
        t.read()
    first = normalize.conform(csv_batch(spark))
    table.full_refresh(t, first, now="2024-01-01 00:00:00")
    assert t.read().count() == 2 and len(t.versions()) == 1
    # A2: incremental merge of two new API-style rows
    batch = normalize.conform(api_batch(spark, ["TEST003", "TEST004"]))
    rep = table.merge_report(t.read(), batch).first()
    assert (rep.batch_rows, rep.inserts, rep.updates) == (2, 2, 0)
    v, _ = table.merge_batch(t, batch.withColumn("arrival", F.lit(1)), now="2024-01-05 00:00:00")
    assert v == 2 and t.read().count() == 4
    # A3: full refresh replaces everything, older version stays readable
    table.full_refresh(t, normalize.conform(api_batch(spark, ["TEST005", "TEST006"])), now="2024-01-06 00:00:00")
    assert sorted(r.dig_ticket_number for r in t.read().collect()) == ["TEST005", "TEST006"]
    assert t.read(2).count() == 4


def test_upsert_keeps_created_and_last_copy_wins(spark):
    existing = table.with_audit(normalize.conform(api_batch(spark, ["A", "B"])), "2024-01-01 00:00:00")
    b = normalize.conform(api_batch(spark, ["B", "C", "B"])).withColumn("arrival", F.array(F.lit(1), F.lit(2), F.lit(3))[F.monotonically_increasing_id() % 3])
    b = b.withColumn("street_name", F.concat(F.lit("S"), F.col("arrival").cast("string")))
    twice = existing.unionByName(existing.where("dig_ticket_number = 'B'").withColumn("created_at", F.lit("2024-01-09").cast("timestamp_ntz")))
    with pytest.raises(ValueError):
        table.upsert(existing, b.drop("arrival"))
    for base in (existing, twice):  # a ticket that the table holds twice comes out once
        rows = table.upsert(base, b, now="2024-02-01 00:00:00").collect()
        out = {r.dig_ticket_number: r for r in rows}
        assert len(rows) == 3
        assert set(out) == {"A", "B", "C"}
        assert out["A"].updated_at == dt.datetime(2024, 1, 1)
        assert out["B"].created_at == dt.datetime(2024, 1, 1) and out["B"].updated_at == dt.datetime(2024, 2, 1)
        assert out["C"].created_at == dt.datetime(2024, 2, 1)
        last_b = max(r.arrival for r in b.where("dig_ticket_number = 'B'").collect())
        assert out["B"].street_name == f"S{last_b}"


def test_normalize_edge_values(spark):
    rows = [
        ("K1", "Y", "12", "41.5", "01/02/2024 03:04:05 PM"),
        ("K2", "yes", "12.5", "x", "2024-01-02"),
        ("K3", None, "", None, "not a date"),
        ("K4", "1", " 7 ", "-87.1", "2024-01-02T03:04:05.123"),
        ("K5", "False", None, "1e1", "01/02/2024"),
    ]
    raw = spark.createDataFrame(rows, "dig_ticket_ string, emergency string, stnofrom string, latitude string, digdate string")
    got = {r.dig_ticket_number: r for r in normalize.conform(raw).collect()}
    assert [got[k].is_emergency for k in ["K1", "K2", "K3", "K4", "K5"]] == [True, True, False, True, False]
    assert [got[k].street_number_from for k in ["K1", "K2", "K3", "K4", "K5"]] == [12, None, None, 7, None]
    assert got["K2"].latitude is None and got["K5"].latitude == 10.0
    assert got["K1"].dig_date == dt.datetime(2024, 1, 2, 15, 4, 5)
    assert got["K2"].dig_date == dt.datetime(2024, 1, 2)
    assert got["K3"].dig_date is None
    assert got["K4"].dig_date == dt.datetime(2024, 1, 2, 3, 4, 5, 123000)
    assert got["K5"].dig_date == dt.datetime(2024, 1, 2)
    assert got["K1"].request_date is None  # absent column -> typed null
    far = spark.createDataFrame([("A", "9999-12-31"), ("B", "1600-01-01"), ("C", "2262-04-11")], "dig_ticket_ string, digdate string")
    assert [r.dig_date is None for r in normalize.conform(far).orderBy("dig_ticket_number").collect()] == [True, True, False]
    assert normalize.missing_columns(raw, ["dig_ticket_number", "permit_number"]) == ["permit_number"]


def test_export_then_conform_roundtrip(spark, permits_small):
    back = normalize.conform(normalize.to_export(permits_small))
    assert back.exceptAll(permits_small).count() == 0 and permits_small.exceptAll(back).count() == 0


def test_unchanged_batch_commits_nothing_and_inputs_are_checked(spark):
    from trenchline.operators import daily, geo, quality

    t = table.PermitTable(spark, scratch_path(spark, "t2"))
    table.full_refresh(t, normalize.conform(api_batch(spark, ["A"])), now="2024-01-01 00:00:00")
    empty = normalize.conform(api_batch(spark, []))
    v, rep = table.merge_batch(t, empty.withColumn("arrival", F.lit(1)))
    assert v is None and rep.first().inserts == 0 and t.versions() == [1]
    bad = spark.createDataFrame([("x", 1.0)], "dig_date string, latitude double")
    with pytest.raises(quality.DataValidationError):
        geo.map_points(bad)
    with pytest.raises(quality.DataValidationError):
        daily.daily_series(bad)


def month_rows(spark, rows):
    return spark.createDataFrame(rows, "dig_ticket_ string, digdate string, street string, arrival int").transform(
        lambda d: normalize.conform(d.withColumnRenamed("street", "stname"), keep_extra=True)
    )


def test_merge_rewrites_touched_months_only(spark):
    t = table.PermitTable(spark, scratch_path(spark, "months"))
    first = month_rows(spark, [("A", "2024-01-05", "x", 1), ("A", "2024-01-05", "y", 2), ("B", "2024-02-05", "x", 1), ("C", "2024-03-05", "x", 1), (None, "2024-01-01", "x", 1)])
    v, rep = table.merge_batch(t, first, now="2024-01-01 00:00:00")  # a first load is deduplicated too
    assert v == 1 and t.read().count() == 3
    assert {r.dig_ticket_number: r.street_name for r in t.read().collect()}["A"] == "y"
    before = t.months()
    # B moves from February to April: both are written, January and March stay as they are
    v, rep = table.merge_batch(t, month_rows(spark, [("B", "2024-04-05", "z", 1)]), now="2024-01-02 00:00:00")
    after = t.months()
    assert (rep.first().inserts, rep.first().updates) == (0, 1)
    assert after["2024-01"] == before["2024-01"] and after["2024-03"] == before["2024-03"]
    assert "2024-02" not in after and "2024-04" in after
    got = {r.dig_ticket_number: r for r in t.read().collect()}
    assert len(got) == t.read().count() == 3 and got["B"].created_at == dt.datetime(2024, 1, 1)
    assert t.expire(keep=1) == [1] and t.read().count() == 3


def test_failed_write_does_not_block_the_table(spark):
    t = table.PermitTable(spark, scratch_path(spark, "failed"))
    df = month_rows(spark, [("A", "2024-01-05", "x", 1)])
    broken = df.withColumn("street_name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        table.full_refresh(t, broken)
    assert t.current_version() is None
    # a writer that was killed leaves a temporary file, which counts for nothing
    fs, p = table._fs(spark, f"{t.root}/manifests/tmp-killed")
    fs.create(p, False).close()
    assert table.full_refresh(t, df) == 1 and t.read().count() == 1


def test_no_update_is_lost(spark):
    t = table.PermitTable(spark, scratch_path(spark, "race"))
    rows = lambda *keys: month_rows(spark, [(k, "2024-01-05", "x", 1) for k in keys])
    table.full_refresh(t, rows("A"))
    months = t.write(table.with_audit(rows("A", "B"), "2024-01-01 00:00:00").select(*t.read().columns))
    # another writer, also from version 1, is half through publishing version 2
    fs, p = table._fs(spark, f"{t.root}/manifests/v00000002")
    stream = fs.create(p, False)
    stream.write(bytearray(b'{"schema": '))
    stream.close()
    with pytest.raises(RuntimeError):
        t.publish(t.read(1).schema, months, after=1)
    assert not fs.exists(table._fs(spark, f"{t.root}/manifests/v00000003")[1])
    # the other way round: the version is there, the second one from the same base fails
    t2 = table.PermitTable(spark, scratch_path(spark, "race"))
    table.full_refresh(t2, rows("A"))
    schema = t2.read().schema
    one, two = (t2.write(table.with_audit(rows(*k), "2024-01-01 00:00:00")) for k in (("A", "B"), ("A", "C")))
    assert t2.publish(schema, one, after=1) == 2
    with pytest.raises(RuntimeError):
        t2.publish(schema, two, after=1)
    assert sorted(r.dig_ticket_number for r in t2.read().collect()) == ["A", "B"]


def test_expire_drops_orphans_and_staging(spark):
    t = table.PermitTable(spark, scratch_path(spark, "expire"))
    for i in range(3):
        v, _ = table.merge_batch(t, month_rows(spark, [("A", f"2024-0{i + 1}-05", "x", 1), (f"K{i}", "2024-05-01", "x", 1)]), now="2024-01-01 00:00:00")
    kept = t.read().count()
    orphan = t.write(month_rows(spark, [("Z", "2024-01-05", "x", 1)]))
    table._fs(spark, f"{t.root}/staging/left")[0].mkdirs(table._fs(spark, f"{t.root}/staging/left")[1])
    table._fs(spark, f"{t.root}/manifests/tmp-left")[0].create(table._fs(spark, f"{t.root}/manifests/tmp-left")[1], False).close()
    there = lambda p: (lambda fp: fp[0].exists(fp[1]))(table._fs(spark, f"{t.root}/{p}"))
    assert t.expire(keep=1) == [1, 2]  # writes that may be under way stay
    assert there("staging/left") and there(list(orphan.values())[0][0])
    assert t.expire(keep=1, orphans_after_hours=-1) == []
    assert not there("staging/left") and not there("manifests/tmp-left") and not there(list(orphan.values())[0][0])
    assert t.read().count() == kept and t.versions() == [3]


def test_rows_sent_again_rewrite_nothing(spark):
    t = table.PermitTable(spark, scratch_path(spark, "again"))
    rows = [("A", "2024-01-05", "x", 1), ("B", "2024-02-05", "x", 1), ("C", None, None, 1)]
    table.merge_batch(t, month_rows(spark, rows), now="2024-01-01 00:00:00")
    before = t.months()
    v, rep = table.merge_batch(t, month_rows(spark, rows + rows), now="2024-01-02 00:00:00", skip_unchanged=True)
    assert v is None and t.months() == before
    assert tuple(rep.first()) == (6, 0, 3, 3)
    # a change in one month leaves the others; going back to an earlier content counts as a change
    for i, street in enumerate(["y", "x"]):
        v, rep = table.merge_batch(t, month_rows(spark, [("A", "2024-01-05", street, 1)] + rows[1:]), now=f"2024-01-0{3 + i} 00:00:00", skip_unchanged=True)
        assert v == 2 + i and rep.first().unchanged == 2
        assert {r.dig_ticket_number: r.street_name for r in t.read().collect()}["A"] == street
    assert t.months()["2024-02"] == before["2024-02"] and t.months()["none"] == before["none"]
    assert {r.dig_ticket_number: r.created_at.day for r in t.read().collect()} == {"A": 1, "B": 1, "C": 1}


def test_one_day_reads_one_month_in_day_order(spark):
    t = table.PermitTable(spark, scratch_path(spark, "layout"))
    rows = [(f"T{i}", f"2024-{i % 3 + 1:02d}-{i * 7 % 28 + 1:02d}", "x" * 20, 1) for i in range(3000)]
    table.full_refresh(t, month_rows(spark, rows), now="2024-01-01 00:00:00")
    day = t.read(start="2024-02-10", end="2024-02-10")
    assert day.count() == sum(r[1] == "2024-02-10" for r in rows)
    assert all("_month=2024-02" in f for f in day.inputFiles())
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "Or(IsNull(_day)," in plan
    for f in spark.read.parquet(f"{t.root}/{t.months()['2024-02'][0]}").inputFiles():
        got = [r.dig_date for r in spark.read.parquet(f).select("dig_date").coalesce(1).collect()]
        assert got == sorted(got)
    assert {f.split("_month=")[1][:7] for f in t.recent(days=10).inputFiles()} == {"2024-03"}
    assert t.recent(as_of="2024-02-05", days=10).count() == sum(r[1] >= "2024-01-26" for r in rows)


def test_a_day_skips_row_groups(spark, monkeypatch):
    monkeypatch.setattr(table, "ROW_GROUP_BYTES", 2048)
    t = table.PermitTable(spark, scratch_path(spark, "groups"))
    rows = [(f"T{i}", f"2024-01-{i * 5 % 28 + 1:02d}", "x" * 20, 1) for i in range(6000)]
    table.full_refresh(t, month_rows(spark, rows), now="2024-01-01 00:00:00")
    day = t.read(start="2024-01-10", end="2024-01-10")
    got = day.collect()
    plan = day._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("Adaptive"):
        plan = plan.executedPlan()
    leaf = plan.collectLeaves().apply(0)
    scanned = leaf.metrics().get("numOutputRows").get().value()
    assert len(got) == sum(r[1] == "2024-01-10" for r in rows) and len(got) <= scanned < len(rows) / 4


def test_day_counts_follow_the_touched_months(spark):
    from trenchline.operators import daily, day_counts

    t = table.PermitTable(spark, scratch_path(spark, "counts"))
    table.merge_batch(t, month_rows(spark, [("A", "2024-01-05", "x", 1), ("B", "2024-02-05", "x", 1), ("N", None, "x", 1)]), now="2024-01-01 00:00:00")
    assert day_counts.refresh(t) == ["2024-01", "2024-02", "none"] and day_counts.refresh(t) == []
    table.merge_batch(t, month_rows(spark, [("B", "2024-03-05", "x", 1), ("C", "2024-03-06", "x", 1)]), now="2024-01-02 00:00:00")
    table.merge_batch(t, month_rows(spark, [("D", "2024-03-06", "x", 1)]), now="2024-01-03 00:00:00")
    assert day_counts.refresh(t) == ["2024-03"]  # two versions on, only what differs
    want = sorted(map(tuple, daily.daily_counts(t.read()).collect()))
    assert sorted(map(tuple, day_counts.read(t).collect())) == want
    files = daily.weekday_comparison(None, counts=day_counts.read(t)).inputFiles()
    assert files and all("/day_counts/" in f for f in files)
    t.expire(keep=1)
    assert sorted(map(tuple, day_counts.read(t).collect())) == want


def test_feeds_that_cannot_be_read_fail(spark, tmp_path):
    from trenchline.operators import quality
    from trenchline.plans import jobs
    from trenchline.sources import files

    (tmp_path / "array.json").write_text('[\n {"dig_ticket_": "A", "digdate": "2024-01-02"},\n {"dig_ticket_": "B", "digdate": "2024-01-02"}\n]')
    (tmp_path / "none.json").write_text('[\n {"permit_": "A", "digdate": "2024-01-02"}\n]')
    (tmp_path / "empty.json").write_text("[]")
    t = table.PermitTable(spark, scratch_path(spark, "feeds"))
    with pytest.raises(files.FeedError):
        jobs.daily_update(spark, t, str(tmp_path / "array.json"), day="2024-01-02", min_rows=1)
    with pytest.raises(quality.DataValidationError):
        jobs.daily_update(spark, t, str(tmp_path / "none.json"), day="2024-01-02", min_rows=1, multi_line=True)
    out = jobs.daily_update(spark, t, str(tmp_path / "array.json"), day="2024-01-02", min_rows=1, multi_line=True)
    assert out.version == 1 and t.read().count() == 2
    log = scratch_path(spark, "log")
    out = jobs.daily_update(spark, t, str(tmp_path / "empty.json"), day="2024-01-02", min_rows=1, multi_line=True, log_path=log)
    assert out.version is None and spark.read.parquet(log).first().rows == 0
    for _ in range(2):
        out = jobs.daily_update(spark, t, str(tmp_path / "empty.json"), day="2024-01-02", min_rows=1, multi_line=True, log_path=log)
    assert tuple(out.no_data.first()) == (3, True)  # warns at the third


def test_rows_without_a_day_belong_to_no_day(spark):
    from trenchline.operators import daily

    p = month_rows(spark, [("A", "2024-01-05", "x", 1), ("B", "not a date", "x", 1), ("C", "no", "x", 1)]).drop("arrival")
    assert [r.total_permits for r in daily.daily_stats(p).collect()] == [1]
    assert {r.record: str(r.day) for r in daily.daily_records(p).collect()}["most_tickets"] == "2024-01-05"

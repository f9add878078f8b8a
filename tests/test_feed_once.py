"""The jobs read a feed once: rows read by scans of the feed, from Spark's event log."""

import json
import os
import subprocess
import sys

JOB = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
base, family = sys.argv[1:]
SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", base + "/events").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false").config("spark.checkpoint.dir", base + "/shared").getOrCreate()
from trenchline.session import build_session
spark = build_session(None, shuffle_partitions=4)
from trenchline.operators import table
from trenchline.plans import jobs
t = table.PermitTable(spark, base + "/table")
if family == "csv":
    jobs.full_refresh_job(spark, t, base + "/feed", now="2024-01-01 00:00:00")
else:
    jobs.daily_update(spark, t, base + "/feed", day="2024-01-02", now="2024-01-01 00:00:00")
print("ROWS", t.read().count())
spark.stop()
"""


def rows_read(events, kind):
    """Records that tasks of stages with a scan of ``kind`` read from files."""
    scans, read = set(), 0
    for line in open(events):
        e = json.loads(line)
        if e["Event"] == "SparkListenerStageSubmitted":
            scopes = [json.loads(r["Scope"])["name"] for r in e["Stage Info"]["RDD Info"] if "Scope" in r]
            if any(s.strip().startswith(f"Scan {kind}") for s in scopes):
                scans.add(e["Stage Info"]["Stage ID"])
        elif e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in scans:
            read += e["Task Metrics"]["Input Metrics"]["Records Read"]
    return read


def run(tmp_path, family, lines):
    for name in ("events", "feed", "shared"):
        (tmp_path / name).mkdir()
    for i in range(3):
        (tmp_path / "feed" / f"{i}.{family}").write_text("\n".join(lines(i)))
    env = os.environ | {"PYTHONDONTWRITEBYTECODE": "1"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", JOB.format(repo=repo), str(tmp_path), family], capture_output=True, text=True, timeout=300, env=env)
    assert "ROWS 300" in done.stdout, done.stderr[-2000:]
    (events,) = (tmp_path / "events").iterdir()
    return rows_read(events, family)


def test_full_refresh_reads_the_csv_once(tmp_path):
    lines = lambda i: ["DIG_TICKET#,DIGDATE"] + [f"T{i}-{k},2024-01-0{k % 9 + 1}" for k in range(100)]
    assert run(tmp_path, "csv", lines) == 303  # the header lines are cells too


def test_daily_update_reads_the_json_once(tmp_path):
    lines = lambda i: [json.dumps({"dig_ticket_": f"T{i}-{k}", "digdate": f"2024-01-0{k % 9 + 1}"}) for k in range(100)]
    assert run(tmp_path, "json", lines) == 300

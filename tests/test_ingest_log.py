"""Empty-fetch runs against a brute-force scan, including runs across midnight."""

import datetime as dt
import random

from trenchline.operators.ingest_log import empty_batch_runs


def brute(log, threshold=3):
    runs, cur = [], None
    for ts, rows in sorted(log):
        if rows == 0:
            if cur is None:
                cur = [ts, ts, 0, None]
            cur[1] = ts
            cur[2] += 1
            if cur[2] == threshold:
                cur[3] = ts
        elif cur is not None:
            runs.append(tuple(cur))
            cur = None
    if cur is not None:
        runs.append(tuple(cur))
    return sorted(runs)


def test_runs_match_brute_force(spark):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1, 20, 0)
    log = []
    t = t0
    for _ in range(600):
        t += dt.timedelta(minutes=rnd.choice([5, 5, 5, 17, 60]))
        log.append((t, 0 if rnd.random() < 0.55 else rnd.randint(1, 9)))
    df = spark.createDataFrame(log, "batch_ts timestamp_ntz, rows bigint")
    got = sorted((r.run_start, r.run_end, r.empty_batches, r.first_alert_at) for r in empty_batch_runs(df).collect())
    assert got == brute(log)
    assert any(r[0].date() != r[1].date() for r in got)  # some run crosses midnight

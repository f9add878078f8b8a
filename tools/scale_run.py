"""Core operators on the permit view multiplied FACTOR times (default 50).

Usage: python tools/scale_run.py [sf_dir] [factor]; prints one JSON line.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from trenchline.operators import daily, geo, quality, rankings, sampling, table  # noqa: E402
from trenchline.session import build_session, scratch_path  # noqa: E402
from trenchline.sources.fixtures import permits_scaled  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    factor = int(sys.argv[2]) if len(sys.argv) > 2 else 50
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", shuffle_partitions=32)
    # materialise the multiplied input once, as a table would be
    path = scratch_path(spark, f"scaled{factor}")
    permits_scaled(spark, sf, factor).write.parquet(path)
    p = spark.read.parquet(path)
    n = p.count()
    batch = p.where(F.col("dig_date") >= F.lit("2001-07-01").cast("timestamp_ntz")).withColumn("arrival", F.lit(1))
    jobs = {
        "daily_stats": lambda: daily.daily_stats(p),
        "weekday_comparison": lambda: daily.weekday_comparison(p),
        "leaderboard_by_day": lambda: rankings.leaderboard_by_day(p),
        "leaderboard_merged": lambda: rankings.leaderboard(p, merge_names=True),
        "density_grid": lambda: geo.density_grid(geo.map_points(p)),
        "sample_permits": lambda: sampling.sample_permits(p),
        "profile_values": lambda: quality.profile_values(p),
        "upsert": lambda: table.upsert(table.with_audit(p, "2024-01-01 00:00:00"), batch, now="2024-02-01 00:00:00"),
    }
    times = {}
    for k, mk in jobs.items():
        t0 = time.perf_counter()
        mk().write.format("noop").mode("overwrite").save()
        times[k] = round(time.perf_counter() - t0, 2)
        print(f"# {k}: {times[k]}s", file=sys.stderr, flush=True)
    print(json.dumps({"rows": n, "factor": factor, "sf_dir": sf, "seconds": times}))
    spark.stop()


if __name__ == "__main__":
    main()

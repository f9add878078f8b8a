"""Shared folders and tables of the llm operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trenchline.session import scratch_path


#: (folder, table or None) of everything landed by this driver and not dropped yet
MADE: list[tuple[str, str | None]] = []


def drop_made(spark: SparkSession, first: int, last: int) -> None:
    """Delete the scratch folders and tables ``MADE[first:last]``; what was read from them must be written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder, name in MADE[first:last]:
        if name:
            spark.sql(f"drop table if exists {name}")
        at = path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del MADE[first:last]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    MADE.append((path, None))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key``, so that later joins on it do not move it."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"llm_{name}_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, name)
    MADE.append((path, table_name))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table_name)
    return spark.table(table_name)

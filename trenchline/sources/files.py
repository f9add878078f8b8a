"""File sources and sinks for permit data.

Feeds are read as *text* (no inference: a bad value must not change a
column's type between batches), then conformed by ``operators.normalize``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.schema import API_FIELD_NAMES, CSV_FIELD_NAMES
from trenchline.session import scratch_path

#: widest header that a CSV feed may have
MAX_COLUMNS = 64


CORRUPT = "_corrupt_record"


class FeedError(RuntimeError):
    """A landed feed cannot be read as its family says."""


def feed_schema(family: str = "api") -> T.StructType:
    """All-text schema of a feed family."""
    names = API_FIELD_NAMES if family == "api" else CSV_FIELD_NAMES
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_permits_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed API responses.  JSON Lines by default (splittable); set
    ``multi_line`` for files holding one JSON array.  The schema is fixed (no
    inference pass), values arrive as text, and text that is no record of the
    chosen form is kept in ``_corrupt_record`` (see ``require_clean``)."""
    schema = feed_schema("api").add(CORRUPT, T.StringType())
    return spark.read.schema(schema).option("multiLine", multi_line).option("primitivesAsString", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def require_clean(landed: DataFrame) -> DataFrame:
    """Raise if a landed feed holds unreadable records; else drop their column."""
    if CORRUPT not in landed.columns:
        return landed
    bad = landed.where(F.col(CORRUPT).isNotNull()).count()
    if bad:
        raise FeedError(f"{bad} records of the feed cannot be read in the chosen form (JSON Lines or one array per file)")
    return landed.drop(CORRUPT)


def with_file(raw: DataFrame) -> DataFrame:
    """``arrival``: time, name and block of the file that a row is from (also on a stream)."""
    meta = F.col("_metadata")
    return raw.withColumn("arrival", F.struct(meta["file_modification_time"].alias("time"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block")))


def with_row(batch: DataFrame) -> DataFrame:
    """Add the row's position in its block to ``arrival``; to be called on the scan itself."""
    return batch.withColumn("arrival", F.col("arrival").withField("row", F.monotonically_increasing_id()))


def with_arrival(raw: DataFrame) -> DataFrame:
    """Order of the rows of a file feed: file time and name, then position in the file."""
    return with_row(with_file(raw))


# ------------------------------------------------------------------- CSV by header


def csv_cells(reader, path: str, multi_line: bool = False, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """The cells of CSV files by position (c0, c1, ...), header lines among them, and ``arrival``.

    ``reader``: ``spark.read`` or ``spark.readStream``.  ``multi_line`` allows
    quoted newlines but makes each file one task; the default keeps files
    splittable.  A quote inside a quoted cell is written twice."""
    # one more column than allowed: a cell there means that a header is too wide
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max_columns + 1)])
    raw = reader.schema(schema).option("header", False).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return with_file(raw)


def _canonical(name: str) -> str:
    """One spelling for each known field, whichever feed family a header names it by."""
    known = {v: k for k, v in CSV_FIELD_NAMES.items()}
    return known[API_FIELD_NAMES[name]] if name in API_FIELD_NAMES else name


def _cell_columns(cells: DataFrame) -> list[str]:
    return [c for c in cells.columns if c[0] == "c" and c[1:].isdigit()]


def csv_headers(cells: DataFrame) -> DataFrame:
    """(file, header): the first line of each file as an array of its cells.

    ``cells`` is a landed table (``arrival`` with its row numbers).  The first
    line is found by a minimum of row numbers, so no rows are sorted."""
    first = cells.where("arrival.block = 0").groupBy(F.col("arrival.file").alias("file")).agg(F.min("arrival.row").alias("row"))
    at = cells.where("arrival.block = 0").withColumns({"file": F.col("arrival.file"), "row": F.col("arrival.row")})
    names = F.array(*_cell_columns(cells))
    width = F.size(F.filter(names, lambda x: x.isNotNull()))
    return at.join(first, ["file", "row"]).select("file", F.slice(names, 1, width).alias("header"))


def by_header(cells: DataFrame) -> DataFrame:
    """Landed CSV cells as named columns: each file by its own header line.

    A column that a file lacks is null in its rows; a name that no header has
    is no column.  Header lines, also repeated ones, are left out.  Raises
    when a header names a field twice or is wider than the cells.

    Only the different headers come to the driver, as with any schema."""
    headers = csv_headers(cells)
    found = [r["header"] for r in headers.select("header").distinct().collect()]
    columns = _cell_columns(cells)
    names: dict[str, None] = {}
    layouts = []
    for header in found:
        layout = [_canonical((n or "").removeprefix("\ufeff")) for n in header]
        twice = sorted({n for n in layout if n and layout.count(n) > 1})
        if twice:
            raise FeedError(f"a header names fields twice: {twice}")
        if len(header) >= len(columns):
            raise FeedError(f"a header has more than {len(columns) - 1} columns")
        layouts.append(layout)
        names |= dict.fromkeys(n for n in layout if n)
    if not layouts:  # nothing but empty files
        return cells.where("false").select("arrival")

    def line(header: list[str]) -> F.Column:
        same = F.col(columns[0]).eqNullSafe(F.lit(header[0]))
        for c, n in zip(columns[1:], header[1:]):
            same = same & F.col(c).eqNullSafe(F.lit(n))
        return same

    if len(layouts) == 1:
        layout = layouts[0]
        named = [F.col(columns[layout.index(n)]).alias(n) for n in names]
        return cells.where(~line(found[0])).select(*named, "arrival")
    # several headers: every row looks up its file's layout (one row for each file)
    order = sorted(range(len(found)), key=lambda i: layouts[i])
    which = F.lit(None).cast("int")
    for i in order:
        which = F.when(F.col("header") == F.array(*[F.lit(n) for n in found[i]]), F.lit(i)).otherwise(which)
    files = headers.select(F.col("file").alias("_file"), which.alias("_layout"))
    rows = cells.join(files, F.col("arrival.file") == F.col("_file"))
    rows = rows.where(~F.coalesce(*[F.when(F.col("_layout") == i, line(found[i])) for i in order]))
    named = []
    for n in names:
        value = F.lit(None).cast("string")
        for i in order:
            if n in layouts[i]:
                value = F.when(F.col("_layout") == i, F.col(columns[layouts[i].index(n)])).otherwise(value)
        named.append(value.alias(n))
    return rows.select(*named, "arrival")


def land_csv(spark: SparkSession, path: str, folder: str, multi_line: bool = False) -> DataFrame:
    """Read CSV files once, land their cells in ``folder``, and give them back by header."""
    cells = with_row(csv_cells(spark.read, path, multi_line))
    write_parquet(cells, folder)
    return by_header(spark.read.schema(cells.schema).parquet(folder))


def read_permits_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Bulk CSV export, every column as text, each file by its own header row.

    The files are read once and landed in the shared scratch folder."""
    return land_csv(spark, path, scratch_path(spark, "csv-cells"), multi_line).drop("arrival")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3: a Parquet dataset (directory or glob)."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_json_shares(df: DataFrame, path: str, shares: int) -> int:
    """Deal the rows of ``df`` to ``shares`` folders of JSON Lines files
    (``_share=0``, ...) under ``path``; returns how many files are one share.

    A task gets as many rows as AQE advises, however large the feed is, and
    writes one file for every share, so a small feed has all its shares too."""
    spark = df.sparkSession
    dealt = df.hint("rebalance").withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(shares)))
    dealt.write.mode("errorifexists").partitionBy("_share").json(path)
    written = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_share=*/*.json")
    n = len(written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(written) or [])
    return max(1, -(-n // shares))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, options: dict | None = None) -> None:
    """K1: snappy Parquet; never overwrites (new data goes to a new path)."""
    w = df.write.mode("errorifexists").option("compression", "snappy").options(**(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)

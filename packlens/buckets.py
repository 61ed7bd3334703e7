"""Bucket definitions: (label, lowest value, highest value), both inclusive, in decimal units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KB, MB, GB = 1_000, 1_000_000, 1_000_000_000
TOP = 2**63 - 1

# The reported ranges.
FILE_COUNT = [("1", 1, 1), ("2-5", 2, 5), ("6-10", 6, 10), ("11-25", 11, 25), ("26-50", 26, 50), ("51-100", 51, 100), ("101-150", 101, 150), ("151-200", 151, 200), ("201-300", 201, 300), ("301-500", 301, 500), ("501+", 501, TOP)]
FILE_SIZE = [("<1KB", 0, KB - 1), ("1KB-10KB", KB, 10 * KB - 1), ("10KB-100KB", 10 * KB, 100 * KB - 1), ("100KB-1MB", 100 * KB, MB - 1), ("1MB-10MB", MB, 10 * MB - 1), ("10MB+", 10 * MB, TOP)]
ARCHIVE_SIZE = [("<1MB", 0, MB - 1), ("1-10MB", MB, 10 * MB - 1), ("10-100MB", 10 * MB, 100 * MB - 1), ("100MB-1GB", 100 * MB, GB - 1), ("1GB+", GB, TOP)]


def bucket(value: Column, ranges: list[tuple[str, int, int]]) -> Column:
    """The label of the range that holds value; null outside all."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(ranges):
        out = F.when(value.between(low, high), label).otherwise(out)
    return out


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100)


def histogram(df: DataFrame, column: str, ranges: list[tuple[str, int, int]], *extra: Column) -> DataFrame:
    """One row a range, empty ones too: bucket, cnt, pct of all rows (those outside every range included), extras.

    One pass: the rows are reduced to a row for each label before anything is joined to the list of ranges."""
    spark = df.sparkSession
    labels = spark.createDataFrame([(i, x[0]) for i, x in enumerate(ranges)], "pos int, bucket string")
    found = df.groupBy(bucket(F.col(column), ranges).alias("bucket")).agg(F.count("*").alias("cnt"), *extra)
    total = found.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))
    out = labels.join(found, "bucket", "left").crossJoin(F.broadcast(total))  # total is one row
    return out.select("pos", "bucket", F.coalesce("cnt", F.lit(0)).alias("cnt"), percent(F.coalesce("cnt", F.lit(0)), F.col("total")).alias("pct"), *[c for c in found.columns if c not in ("bucket", "cnt")])

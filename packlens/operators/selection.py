"""Dedupe, alignment of folders, lookups and ordered codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_packages(packages: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """First row of each id by order; all rows without id.

    The first order of an id is a minimum, combined before its shuffle, so a hot id is one row a task."""
    named = packages.filter(F.col(key).isNotNull())
    first = named.groupBy(key).agg(F.min(order).alias("__first"))
    kept = named.join(first, key).filter(F.col(order) == F.col("__first")).select(*packages.columns)
    return kept.union(packages.filter(F.col(key).isNull()).select(*packages.columns))


def required_fields(packages: DataFrame) -> DataFrame:
    return packages.filter("name is not null and download_url is not null")


def content_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the order of the first row of equal content, and whether it is that one."""
    first = rows.groupBy(key).agg(F.min(order).alias("first_ord"), F.count("*").alias("copies"))
    return rows.join(first, key).withColumn("is_first", F.col(order) == F.col("first_ord"))


def two_stage_dedupe(rows: DataFrame, content: str, order: str, prefix: int = 4096) -> DataFrame:
    """Short hash of the first `prefix` characters first; only its repeats get a full hash."""
    short = rows.select(order, F.xxhash64(F.substring(content, 1, prefix)).alias("short"), content)
    again = short.groupBy("short").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    full = short.join(again, "short").select(order, F.md5(F.col(content).cast("binary")).alias("full"))
    first = full.groupBy("full").agg(F.min(order).alias("first_ord"))
    found = full.join(first, "full").select(order, "first_ord")
    return rows.select(order).join(found, order, "left").select(order, F.coalesce("first_ord", order).alias("first_ord"))


def align_folders(rows: DataFrame, folders: list[str]) -> DataFrame:
    """rows: folder, rel, size. One row a path, one column a folder (null: absent)."""
    return rows.groupBy("rel").pivot("folder", folders).agg(F.max("size"))


def best_codec(rows: DataFrame) -> DataFrame:
    """Per path: smallest positive size, its folder, the largest, and the saving. Ties: first folder by name."""
    some = rows.filter("size > 0").groupBy("rel").agg(F.min(F.struct("size", "folder")).alias("b"), F.max("size").alias("worst"))
    return some.select("rel", F.col("b.folder").alias("best_folder"), F.col("b.size").alias("best"), "worst", ((F.col("worst") - F.col("b.size")) / F.col("worst") * 100).alias("savings_pct"))


def folder_totals(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("folder").agg(F.sum("size").alias("total"))
    worst = F.max("total").over(Window.partitionBy(F.lit(0)))  # a row for each folder
    return out.select("folder", "total", (worst - F.col("total")).alias("saved"))


def codec_totals(rows: DataFrame) -> DataFrame:
    """rows: codec, original, compressed (null: failed), seconds."""
    done = F.col("compressed").isNotNull()
    out = rows.groupBy("codec").agg(F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), F.sum(F.when(done, F.col("seconds"))).alias("seconds"), F.count_if(~done).alias("failed"))
    return out.select("*", (F.col("compressed") / F.col("original") * 100).alias("ratio_pct"), (F.col("original") / 1e6 / F.col("seconds")).alias("mb_per_s"))


def run_lengths(rows: DataFrame, order: str, code: str, most: int = 255, by: list[str] | None = None) -> DataFrame:
    """Runs of equal codes in order, cut at `most`: by, run_start, code, len. One sequence for each `by` key."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(order) if by else Window.partitionBy(F.lit(0)).orderBy(order)
    new = (F.lag(code).over(w).isNull()) | (F.lag(code).over(w) != F.col(code))
    runs = rows.withColumn("__n", new.cast("int")).withColumn("__run", F.sum("__n").over(w))
    place = F.row_number().over(Window.partitionBy(*by, "__run").orderBy(order)) - 1
    runs = runs.withColumn("__cut", F.floor(place / most))
    return runs.groupBy(*by, "__run", "__cut", code).agg(F.min(order).alias("run_start"), F.count("*").alias("len")).drop("__run", "__cut")


def expand_runs(runs: DataFrame, order: str, code: str, length: str, by: list[str] | None = None) -> DataFrame:
    """Runs back to one row each: by, block_index, code."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(order) if by else Window.partitionBy(F.lit(0)).orderBy(order)
    base = (F.sum(length).over(w) - F.col(length)).alias("__base")
    placed = runs.select(*by, code, length, base)  # before rows multiply
    return placed.select(*by, code, "__base", F.posexplode(F.array_repeat(F.lit(0), F.col(length).cast("int"))).alias("__i", "__z")).select(*by, (F.col("__base") + F.col("__i")).alias("block_index"), code)


def offsets(rows: DataFrame, order: str, length: str, by: list[str]) -> DataFrame:
    """Exclusive prefix sums of length in each `by` group."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("offset", F.sum(length).over(w) - F.col(length))

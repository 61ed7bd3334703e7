"""Sources and sinks: the nested corpus document, directories, byte ranges and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "struct<path: string, original_size: bigint, compressed_size: bigint, xxh3_hash: string>"
MOD = f"struct<name: string, id: string, link: string, original_archive_size: bigint, files: array<{FILE}>>"
DOCUMENT = f"mods array<{MOD}>, summary struct<total_mods_processed: bigint, total_files_analyzed: bigint, processing_errors: bigint, total_download_size: bigint>"
PACKAGES = "Packages array<struct<Name: string, Id: string, DownloadUrl: string, ProjectUri: string>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """mods of a (zstd-compressed) JSON document. One document is one task's read: the rows are dealt out after it."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return docs.select(F.inline("mods")).withColumn("ord", F.monotonically_increasing_id()).repartition(spark.sparkContext.defaultParallelism)


def write_corpus(mods: DataFrame, path: str, form: str = "parquet") -> None:
    """One row a mod, written in parallel: Parquet with zstd, or JSON objects with gzip (Spark's JSON writer has no
    zstd without native Hadoop libraries)."""
    mods.write.option("compression", "zstd" if form == "parquet" else "gzip").mode("error").format(form).save(path)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(PACKAGES).option("multiLine", True).json(path).select(F.posexplode("Packages").alias("ord", "p"))
    return rows.select("ord", F.col("p.Name").alias("name"), F.col("p.Id").alias("id"), F.col("p.DownloadUrl").alias("download_url"), F.col("p.ProjectUri").alias("project_uri"))


def directory(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Regular files below path: relative path, length and, on demand, content (else it isn't read)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").removeprefix("file://") + "/"
    relative = F.substr("path", F.locate(root, F.col("path")) + len(root))
    return rows.select(relative.alias("path"), F.col("length").alias("size"), *(["content"] if content else []))


def directory_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def analyzed_directory(spark: SparkSession, path: str) -> DataFrame:
    """Per file: size, XXH3 and level 16 zstd size."""
    from packlens.operators.codecs import xxh3_hex, zstd16_size

    return directory(spark, path, content=True).select("path", F.col("size").alias("original_size"), zstd16_size("content").alias("compressed_size"), xxh3_hex("content").alias("xxh3_hash"))


def byte_range(content: Column, start: Column, length: Column) -> Column:
    return F.substring(content, start + 1, length)


def split_blocks(files: DataFrame, size: int) -> DataFrame:
    """path, content -> path, block, content of `size` bytes."""
    at = F.posexplode(F.expr(f"sequence(0, octet_length(content) - 1, {size})")).alias("block", "start")
    return files.filter("octet_length(content) > 0").select("path", "content", at).select("path", "block", F.expr(f"substring(content, start + 1, {size})").alias("content"))


def bucket_table(rows: list, title: str) -> str:
    """A report table of (bucket, cnt, pct) rows."""
    if not rows:
        return f"{title}\nNo data available for bucketing\n"
    wide = max(12, *(len(r["bucket"]) for r in rows))
    return "\n".join([title, *(f"{r['bucket']:<{wide}} | {r['cnt']:>10} | {r['pct']:>7.2f}%" for r in rows)]) + "\n"

"""The corpus views over the driver's tables (a mod is an order, a file is a line item), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mod_id"), F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 100).cast("long").alias("archive_size"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = F.floor(F.col("l_extendedprice") * F.col("l_extendedprice") / 800).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mod_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), original.alias("original_size"), F.floor(original * F.col("l_quantity") / 50).cast("long").alias("compressed_size"), F.col("l_discount").alias("discount"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text", F.col("n_chars").alias("size"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    url = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.nullif(F.col("user_id") % 50, F.lit(0)).alias("id"), name.alias("name"), url.alias("download_url"))


SQL = {
    "mods": "mods AS (SELECT o_orderkey AS mod_id, CAST(floor(o_totalprice * o_totalprice / 100) AS BIGINT) AS archive_size FROM orders)",
    "files": "files AS (SELECT l_orderkey AS mod_id, l_partkey AS part, l_suppkey AS supplier, l_discount AS discount, s AS original_size, CAST(floor(s * l_quantity / 50) AS BIGINT) AS compressed_size FROM (SELECT *, CAST(floor(l_extendedprice * l_extendedprice / 800) AS BIGINT) AS s FROM lineitem))",
    "contents": "contents AS (SELECT doc_id, concat(source, '/', doc_id, '.', lang) AS path, text, n_chars AS size FROM documents)",
    "packages": "packages AS (SELECT event_id AS ord, nullif(user_id % 50, 0) AS id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS name, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS download_url FROM events)",
}


def sql(query: str, *views: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[v] for v in views) + (", " if query.lstrip()[:7].upper() != "SELECT " else " ") + query

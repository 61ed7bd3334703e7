"""Corpus reports: histograms, conditional aggregates, ratio statistics and cumulative distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.buckets import FILE_SIZE, GB, MB, bucket, percent
from packlens.functions.scalars import safe_ratio

COUNT = F.count


def files_per(mods: DataFrame, files: DataFrame, key: str = "mod_id") -> DataFrame:
    """One row a mod, those without files too. Files are counted before the join, so it moves a row a mod."""
    counts = files.groupBy(key).agg(F.count("*").alias("n"))
    return mods.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_files"))


def metadata_insight(counts: DataFrame, column: str = "n_files") -> DataFrame:
    c = F.col(column)
    part = {"up_to_200": c <= 200, "from_101_to_150": c.between(101, 150), "from_151_to_200": c.between(151, 200), "from_201_to_300": c.between(201, 300)}
    out = counts.agg(F.count("*").alias("total"), *[F.count_if(v).alias(k) for k, v in part.items()])
    return out.select("*", *[percent(F.col(k), F.col("total")).alias(f"pct_{k}") for k in part], F.lit(4096 // 21).cast("long").alias("fit_4k"))


def size_class(size: Column) -> Column:
    return F.when(size < MB, "<1MB").when(size < 10 * MB, "1-10MB").when(size < 100 * MB, "10-100MB").when(size < GB, "100MB-1GB").otherwise("1GB+")


def storage_share(mods: DataFrame) -> DataFrame:
    """Per class: mods, bytes, and their shares. The window runs over one row a class."""
    out = mods.groupBy(size_class(F.col("archive_size")).alias("class")).agg(F.count("*").alias("cnt"), F.sum("archive_size").alias("bytes"))
    every = Window.partitionBy(F.lit(0))
    return out.select("class", "cnt", "bytes", percent(F.col("cnt"), F.sum("cnt").over(every)).alias("pct_cnt"), percent(F.col("bytes"), F.sum("bytes").over(every)).alias("pct_bytes"))


def archive_summary(mods: DataFrame) -> DataFrame:
    out = mods.agg(F.count("*").alias("cnt"), F.coalesce(F.sum(F.col("archive_size").cast("decimal(38,0)")), F.lit(0)).alias("total"))
    gb = F.col("total").cast("double") / GB
    return out.filter("cnt > 0").select("cnt", F.col("total").cast("long").alias("total_bytes"), F.when(gb >= 1000, gb / 1000).otherwise(gb).alias("shown"), F.when(gb >= 1000, "TB").otherwise("GB").alias("unit"))


def compression_by_size(files: DataFrame) -> DataFrame:
    """Per size bucket that has files: mean of ratios, ratio of sums, savings, excellent and poor shares."""
    ratio = safe_ratio(F.col("compressed_size"), F.col("original_size"))
    out = files.groupBy(bucket(F.col("original_size"), FILE_SIZE).alias("bucket")).agg(
        F.count("*").alias("cnt"), F.avg(ratio).alias("mean_ratio"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed"), F.count_if(ratio < 0.1).alias("excellent"), F.count_if(ratio > 0.8).alias("poor")
    )
    overall = safe_ratio(F.col("compressed"), F.col("original"))
    return out.select("*", overall.alias("ratio_of_sums"), ((1 - overall) * 100).alias("savings_pct"), percent(F.col("excellent"), F.col("cnt")).alias("pct_excellent"), percent(F.col("poor"), F.col("cnt")).alias("pct_poor"))


def compression_summary(files: DataFrame) -> DataFrame:
    out = files.agg(F.count("*").alias("cnt"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed")).filter("cnt > 0")
    saved = F.col("original") - F.col("compressed")
    return out.select("*", F.when(saved >= 0, "saved").otherwise("increase").alias("kind"), F.abs(saved).alias("bytes"), percent(F.abs(saved).cast("double"), F.col("original")).alias("pct"))


def etl_summary(mods: DataFrame) -> DataFrame:
    """mods: ok (boolean), n_files, archive_size."""
    ok = F.col("ok")
    return mods.agg(F.count_if(ok).alias("total_mods_processed"), F.coalesce(F.sum(F.when(ok, F.col("n_files"))), F.lit(0)).alias("total_files_analyzed"), F.count_if(~ok).alias("processing_errors"), F.coalesce(F.sum(F.when(ok, F.col("archive_size"))), F.lit(0)).alias("total_download_size"))


def cdf(df: DataFrame, column: str) -> DataFrame:
    """(value, cum_pct) of every row; ties keep distinct percents.

    Distinct values are counted first; positions come from prefix sums over value ranges (one window a range, and one
    over a row each range), and ties are expanded last. No task sorts the whole input."""
    counts = df.groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("c"))
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = [r for r in dict.fromkeys(counts.approxQuantile("value", [i / ranges for i in range(1, ranges)], 0.01) if ranges > 1 else [])]
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col("value")))
    counts = counts.withColumn("r", part)
    tops = counts.groupBy("r").agg(F.sum("c").alias("t"))
    over = Window.partitionBy(F.lit(0)).orderBy("r")  # a row for each range
    tops = tops.select("r", (F.sum("t").over(over) - F.col("t")).alias("base"), F.sum("t").over(Window.partitionBy(F.lit(0))).alias("n"))
    inside = Window.partitionBy("r").orderBy("value")
    out = counts.withColumn("upto", F.sum("c").over(inside)).join(F.broadcast(tops), "r")  # at most one row a shuffle partition
    rank = F.explode(F.sequence(F.col("base") + F.col("upto") - F.col("c") + 1, F.col("base") + F.col("upto")))
    return out.select("value", "n", rank.alias("i")).select("value", (F.col("i") / F.col("n") * 100).alias("cum_pct"))


def check_cdf(points: DataFrame) -> DataFrame:
    """(points, outside): raises nothing; a caller rejects zero points or any outside 0 to 100."""
    return points.agg(F.count("*").alias("points"), F.count_if((F.col("cum_pct") < 0) | (F.col("cum_pct") > 100)).alias("outside"))


def axis(points: DataFrame) -> DataFrame:
    low, high = F.greatest(F.min("value"), F.lit(1.0)), F.greatest(F.max("value"), F.lit(1.0))
    return points.agg(low.alias("low"), F.when(low == high, high * 10).otherwise(high).alias("high"))


def by_extension(files: DataFrame) -> DataFrame:
    """files: ext, size. Per extension, and the grand total (ext null) in one pass."""
    return files.rollup("ext").agg(F.count("*").alias("cnt"), F.sum("size").alias("bytes"), F.grouping("ext").cast("int").alias("is_total"))

"""Shared plumbing: the documents table, tables written to the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.session import ship


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master may go without: it gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="packlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def forget(spark: SparkSession, path: str, now: bool = False) -> None:
    """Delete the folder: now, or when the driver's JVM ends."""
    fs, p = folder(spark, path)
    fs.delete(p, True) if now else fs.deleteOnExit(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here, and the rows are fixed.

    The table is deleted by spent(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with_cleaning(spark, lambda: df.write.parquet(path))
    forget(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def with_cleaning(spark: SparkSession, write) -> None:
    """Run a write whose plan runs once: its shuffle files go as soon as the table stands."""
    had = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        write()
    finally:
        spark.conf.unset(CLEAN) if had is None else spark.conf.set(CLEAN, had)


def spent(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        forget(t.sparkSession, t.written_at, now=True)


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of a scan's bytes, 0 where it has none; no job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges (long ids): rows (id, component), component the smallest id.

    Alternating large-star and small-star steps on an edge table written to the shared folder each round. Minima are
    combined before their shuffle and written, so that each join meets two plain shuffles: where a hub's edges fill a
    partition, adaptive execution splits them and repeats the hub's one minimum.
    Nodes without edges are not returned. Self loops and repeated edges are allowed, null ends are left out.
    """

    def lowest(e: DataFrame) -> DataFrame:
        return written(e.groupBy("u").agg(F.min("v").alias("m")), "lowest")

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out")).union(e.select("v", F.lit(0)))
        return empty(ends.groupBy("x").agg(F.sum("out").alias("out"), F.count("*").alias("n")).filter("out > 1 or out = 1 and n > 1"))

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = written(e.filter("u <> v").distinct(), "edges")
    while not stars(e):  # some node has two smaller neighbours, or a smaller and a larger one
        # large star: larger neighbours point to the smallest neighbour (or the node itself)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both)
        up = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = written(up, "large")
        spent(e, low)
        # small star: smaller neighbours and the node point to the smallest of them
        low = lowest(large)
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "edges")
        spent(large, low)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")

"""Layout planning: grouping by extension, greedy blocks, chunks and block order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def groups(files: DataFrame, order: str = "ord") -> DataFrame:
    """files: ext, path, size, `order`. One row an extension, its files in input order."""
    items = F.array_sort(F.collect_list(F.struct(order, "path", "size")))
    return files.groupBy("ext").agg(F.count("*").alias("cnt"), items.alias("items"))


def fold_blocks(items: Column, block_size: int, oversized: bool = False) -> Column:
    """Block number of each item of array<struct<size, ...>>: a running sum that starts anew when it would pass
    block_size. An item larger than the block stands alone only with `oversized` (the caller chunks it otherwise)."""

    def step(a: Column, x: Column) -> Column:
        fits = (a["sum"] + x["size"] <= block_size) | (a["n"] == 0)
        block = F.when(fits, a["block"]).otherwise(a["block"] + 1)
        return F.struct(block.alias("block"), F.when(fits, a["sum"] + x["size"]).otherwise(x["size"]).alias("sum"), (a["n"] + 1).alias("n"), F.array_append(a["out"], block).alias("out"))

    start = F.struct(F.lit(0).alias("block"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(items, start, step, lambda a: a["out"])


def solid_blocks(files: DataFrame, block_size: int, by: str = "ext", part: str | None = None) -> DataFrame:
    """files: by, path, size (those that fit). Rows by, block_no, n_items, bytes. Files in a group go by size; which of
    equal size comes first changes no block's count or bytes.

    The files of one size are counted first, and whole runs of equal sizes are packed at once: a group costs a step for
    each distinct size and for each block, and no task holds it. `part` names a column that cuts groups into parts packed
    on their own; a part wastes at most one block."""
    keys = [by, *([part] if part else [])]
    counts = files.groupBy(*keys, F.col("size").cast("long").alias("size")).agg(F.count("*").alias("n")).filter("size is not null")
    rows = counts.repartition(*keys).sortWithinPartitions(*keys, "size")

    def fold(batches):
        held, block, total, items = None, 0, 0, 0
        for b in batches:
            out = []
            columns = [b.column(k).to_pylist() for k in keys]
            for key, size, n in zip(zip(*columns, strict=True), b.column("size").to_pylist(), b.column("n").to_pylist(), strict=True):
                if key != held:
                    if items:
                        out.append((*held, block, items, total))
                    held, block, total, items = key, 0, 0, 0
                while n:
                    room = n if size <= 0 else (block_size - total) // size
                    if room <= 0 or total + size > block_size:
                        if items:
                            out.append((*held, block, items, total))
                            block, total, items = block + 1, 0, 0
                            continue
                        room = 1  # larger than a block: alone in it
                    some = min(n, room)
                    n, items, total = n - some, items + some, total + some * size
            yield from blocks(out)
        if items:
            yield from blocks([(*held, block, items, total)])

    schema = counts.select(*keys).schema.add("block_no", "integer").add("n_items", "long").add("bytes", "long")
    names, kinds = schema.names, to_arrow_schema(schema).types

    def blocks(out):
        for i in range(0, len(out), 1 << 16):
            columns = zip(*out[i : i + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(fold, schema)


def chunks(files: DataFrame, chunk_size: int) -> DataFrame:
    """path, size -> path, chunk_index, start_offset, chunk_size."""
    at = F.posexplode(F.expr(f"sequence(0L, size - 1, {chunk_size}L)")).alias("chunk_index", "start_offset")
    out = files.filter("size > 0").select("path", "size", at)
    return out.select("path", F.col("chunk_index").cast("long").alias("chunk_index"), "start_offset", F.least(F.lit(chunk_size).cast("long"), F.col("size") - F.col("start_offset")).alias("chunk_size"))


def make_blocks(files: DataFrame, block_size: int, chunk_size: int) -> DataFrame:
    """files: ext, path, size, solid (boolean). Rows kind (chunk, single, solid), ext, path or null, block_no, n_items,
    bytes. Rules in order: larger than the block: chunks; not solid: a block of its own; else greedy blocks."""
    large = chunks(files.filter(F.col("size") > block_size), chunk_size)
    large = large.select(F.lit("chunk").alias("kind"), F.lit(None).cast("string").alias("ext"), "path", F.col("chunk_index").alias("block_no"), F.lit(1).cast("long").alias("n_items"), F.col("chunk_size").alias("bytes"))
    rest = files.filter(F.col("size") <= block_size)
    single = rest.filter("not solid").select(F.lit("single").alias("kind"), "ext", "path", F.lit(0).cast("long").alias("block_no"), F.lit(1).cast("long").alias("n_items"), F.col("size").alias("bytes"))
    solid = solid_blocks(rest.filter("solid"), block_size).select(F.lit("solid").alias("kind"), "ext", F.lit(None).cast("string").alias("path"), F.col("block_no").cast("long").alias("block_no"), "n_items", "bytes")
    return large.union(single).union(solid)


def block_order(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Rank of blocks: chunks first, then the largest, within each `by` key."""
    w = Window.partitionBy(*by).orderBy(F.when(F.col("kind") == "chunk", 0).otherwise(1), F.col("bytes").desc(), F.col("path").asc_nulls_last(), "block_no")
    return blocks.withColumn("rank", F.row_number().over(w).cast("long"))

"""Catalogue: lookups by index, statistics, encodings and their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions.scalars import bit_width

NO_DICTIONARY = 255
# Bytes of an entry by format.
ENTRY_BYTES = {"Preset3NoHash": 8, "FEF64NoHash": 8, "Preset1NoHash": 12, "Preset3": 16, "FEF64": 16, "Preset0": 20, "Preset2": 24}
# Largest counts by preset: pool, blocks, files, offset (None: not stored), size.
LIMITS = {
    "Preset0": (2**21 - 1, 2**22 - 1, 2**18 - 1, 2**24 - 1, 2**32 - 1),
    "Preset1": (2**21 - 1, 2**22 - 1, 2**18 - 1, None, 2**32 - 1),
    "Preset2": (2**21 - 1, 2**22 - 1, 2**18 - 1, None, 2**63 - 1),
    "Preset3": (2**20 - 1, 2**16 - 1, 2**16 - 1, 0, 2**32 - 1),
}


def entry_paths(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Path of each entry by index, null out of bounds. No hint: Spark broadcasts paths where they are small."""
    return entries.join(paths, "path_index", "left")


def entry_blocks(entries: DataFrame, blocks: DataFrame, chunk: int) -> DataFrame:
    """One row for each block of each entry: consecutive blocks from the first, by an equi-join."""
    n = F.greatest(F.lit(1).cast("long"), F.floor((F.col("size") + chunk - 1) / F.lit(chunk)).cast("long"))
    each = entries.select("*", F.explode(F.sequence(F.col("first_block"), F.col("first_block") + n - 1)).alias("block_index"))
    return each.join(blocks, "block_index", "left")


def block_dictionaries(blocks: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """255 and unknown indexes have none."""
    known = F.when(F.col("dict_index") != NO_DICTIONARY, F.col("dict_index"))
    return blocks.withColumn("dict_index", known).join(dictionaries, "dict_index", "left")


def toc_stats(entries: DataFrame, chunk: int) -> DataFrame:
    return entries.agg(F.max("size").alias("largest"), F.bool_or(F.col("size") > chunk).alias("any_chunked"), F.max("offset").alias("max_offset"))


def toc_format(pool: Column, offset: Column, blocks: Column, files: Column, largest: Column, hashes: Column) -> Column:
    """The smallest encoding that fits, in fixed order of preference."""
    def within(preset: str) -> Column:
        out = F.lit(True)
        for x, most in zip((pool, blocks, files, offset, largest), LIMITS[preset], strict=True):
            out = out if most is None else out & (x <= most)
        return out

    free = 64 - bit_width(offset) - bit_width(files) - bit_width(blocks)
    flexible = bit_width(largest) <= free
    for x in (pool, offset, files, blocks):
        flexible = flexible & (bit_width(x) <= 31)
    pick = [
        (within("Preset3") & ~hashes, "Preset3NoHash"), (flexible & ~hashes, "FEF64NoHash"), (within("Preset1") & ~hashes, "Preset1NoHash"),
        (within("Preset3"), "Preset3"), (flexible, "FEF64"), (within("Preset0"), "Preset0"), (within("Preset2"), "Preset2"),
    ]
    out = F.lit("Error")
    for when, name in reversed(pick):
        out = F.when(when, name).otherwise(out)
    return out


def toc_size(fmt: Column, files: Column, blocks: Column, pool_bytes: Column) -> Column:
    entry = F.lit(None).cast("long")
    for name, size in ENTRY_BYTES.items():
        entry = F.when(fmt == name, size).otherwise(entry)
    wide = (bit_width(pool_bytes) + bit_width(blocks) + bit_width(files)) > 42  # item counts no longer fit their header
    header = F.when(fmt.startswith("FEF64") & wide, 16).otherwise(8)
    return header + F.coalesce(entry, F.lit(0)) * files + 4 * blocks + pool_bytes


def dictionary_header(maps: Column, dicts: Column, hashes: bool = True) -> Column:
    """8 bytes, two a mapping to a multiple of 4, four a dictionary; with hashes to a multiple of 8, and eight each."""
    up = lambda x, n: F.floor((x + (n - 1)) / n).cast("long") * n
    out = up(8 + 2 * maps, 4) + 4 * dicts
    return up(out, 8) + 8 * dicts if hashes else out


def pool_bytes(paths: DataFrame) -> DataFrame:
    return paths.agg(F.count("*").alias("paths"), F.sum(F.octet_length("path") + 1).cast("long").alias("bytes"))

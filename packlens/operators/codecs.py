"""Codecs and compression experiments: Arrow functions over binary columns, and reports over their sizes."""

from __future__ import annotations

import io

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


@F.pandas_udf(StringType())
def xxh3_hex(content: pd.Series) -> pd.Series:
    """XXH3-64 as 16 lower-case digits."""
    return content.map(lambda x: None if x is None else f"{xxhash.xxh3_64_intdigest(bytes(x)):016x}")


def _compressor(level: int, dictionary: bytes | None = None) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def compress(content: Column, method: str = "zstd", level: int = 12) -> Column:
    """struct<bytes, used_copy>: content itself where compression does not make it smaller. Methods: zstd, lz4, copy."""
    if method not in ("zstd", "lz4", "copy", "none"):
        raise ValueError(f"codec {method} is not available")

    @F.pandas_udf("bytes binary, used_copy boolean")
    def run(content: pd.Series) -> pd.DataFrame:
        codec = pa.Codec("lz4_raw") if method == "lz4" else _compressor(level)
        out = []
        for x in content:
            if x is None:
                out.append((None, None))
                continue
            x = bytes(x)
            y = x if method == "copy" else codec.compress(x, asbytes=True) if method == "lz4" else codec.compress(x)
            out.append((x, True) if method == "copy" or len(y) > len(x) else (y, False))
        return pd.DataFrame(out, columns=["bytes", "used_copy"])

    return run(content)


def decompress(packed: Column, size: Column, method: str = "zstd") -> Column:
    """packed: struct of compress(); size: bytes of the content (a smaller size decodes the beginning only)."""

    @F.pandas_udf("binary")
    def run(packed: pd.DataFrame, size: pd.Series) -> pd.Series:
        out = []
        for x, copied, n in zip(packed["bytes"], packed["used_copy"], size, strict=True):
            if x is None:
                out.append(None)
            elif copied or method == "copy":
                out.append(bytes(x)[: int(n)])
            elif method == "lz4":
                out.append(pa.Codec("lz4_raw").decompress(bytes(x), int(n), asbytes=True))
            else:
                reader = zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS).stream_reader(bytes(x))
                out.append(reader.read(int(n)))
        return pd.Series(out)

    return run(packed, size)


def compress_within(content: Column, most: int, level: int = 12, step: int = 65_536) -> Column:
    """struct<bytes, stopped>: zstd in steps, given up (bytes null) as soon as more than `most` bytes came out."""

    @F.pandas_udf("bytes binary, stopped boolean")
    def run(content: pd.Series) -> pd.DataFrame:
        compressor = _compressor(level)

        def one(x):
            if x is None:
                return None, None
            x, out, size = bytes(x), [], 0
            stream = compressor.compressobj(len(x))
            for i in [*range(0, len(x), step), None]:
                out.append(stream.flush() if i is None else stream.compress(x[i : i + step]) + stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))
                size += len(out[-1])
                if x and size > most:
                    return None, True
            return b"".join(out), False

        return pd.DataFrame([one(x) for x in content], columns=["bytes", "stopped"])

    return run(content)


def decoded_chunks(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """rows: id, packed (struct of compress() by zstd). Rows (id, chunk_index, content): `size` bytes each but the last,
    read one by one; a task holds one packed value and a batch of chunks."""

    def run(batches):
        for b in batches:
            for i, packed in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if packed is None or packed["bytes"] is None:
                    continue
                raw = io.BytesIO(packed["bytes"])
                reader = raw if packed["used_copy"] else zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS).stream_reader(raw)
                for k, chunk in enumerate(iter(lambda: reader.read(size), b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], b.schema.types[0]), pa.array([k], pa.int64()), pa.array([chunk], pa.binary())], [id_col, "chunk_index", "content"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "packed").mapInArrow(run, f"`{id_col}` {kind}, chunk_index long, content binary")


def most_bytes(n: Column) -> Column:
    """Most bytes that n may take with any codec here: the published bounds of zstd and lz4."""
    part = lambda x, d: F.floor(x / F.lit(d)).cast("long")
    zstd = n + part(n, 256) + F.when(n < 131_072, part(131_072 - n, 2048)).otherwise(0)
    return F.greatest(zstd, n + part(n, 255) + 16)


@F.pandas_udf(LongType())
def zstd16_size(content: pd.Series) -> pd.Series:
    """Bytes of an ordinary level 16 frame."""
    c = zstandard.ZstdCompressor(level=16)
    return content.map(lambda x: None if x is None else len(c.compress(bytes(x))))


def dictionary_test(files: DataFrame, dictionary_bytes: int = 65_536, level: int = 16, sample: int = 131_072, least: int = 7, part_files: int = 5000) -> DataFrame:
    """files: ext, path, content. Per part of an extension: plain and dictionary-compressed bytes.

    An extension is cut into parts of about part_files by a hash of the path, each with a dictionary of its own, so no
    task holds a whole extension. Fewer than `least` samples: no dictionary."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        rows = [bytes(x) for x in pdf["content"] if x is not None and len(x)]
        plain = sum(len(zstandard.ZstdCompressor(level=level).compress(x)) for x in rows)
        with_dict = plain
        if len(rows) >= least:
            try:
                d = zstandard.train_dictionary(dictionary_bytes, [x[:sample] for x in rows])
                c = zstandard.ZstdCompressor(level=level, dict_data=d)
                with_dict = sum(len(c.compress(x)) for x in rows)
            except zstandard.ZstdError:
                pass  # too little to train on
        return pd.DataFrame([(pdf["ext"].iloc[0], int(pdf["part"].iloc[0]), len(pdf), sum(map(len, rows)), plain, with_dict)], columns=["ext", "part", "cnt", "original", "plain", "with_dict"])

    counts = files.groupBy("ext").agg(F.ceil(F.count("*") / part_files).cast("int").alias("parts"))
    cut = files.join(counts, "ext").withColumn("part", F.expr("cast(pmod(xxhash64(path), parts) as int)"))
    return cut.groupBy("ext", "part").applyInPandas(run, "ext string, part int, cnt long, original long, plain long, with_dict long")


def block_stats(blocks: DataFrame) -> DataFrame:
    """blocks: original, no_dict, with_dict. Savings in percent, advantage in points, bytes saved."""
    save = lambda c: (1 - F.col(c) / F.col("original")) * 100
    out = blocks.select("*", save("no_dict").alias("savings_no_dict"), save("with_dict").alias("savings_with_dict"), (F.col("no_dict") - F.col("with_dict")).alias("bytes_saved"))
    return out.withColumn("advantage", F.col("savings_with_dict") - F.col("savings_no_dict"))


def block_summary(stats: DataFrame) -> DataFrame:
    over = F.count_if(F.col("bytes_saved") >= 4096)
    each = [f(c).alias(f"{n}_{c}") for c in ("savings_no_dict", "savings_with_dict", "advantage") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return stats.agg(F.count("*").alias("cnt"), *each, over.alias("over_4k"), (over / F.count("*") * 100).alias("pct_over_4k"), F.avg(F.floor(F.col("bytes_saved") / 4096)).alias("avg_pages"))


def strategy_summary(rows: DataFrame) -> DataFrame:
    """rows: individual, individual_dict, solid, solid_dict, original. One row a strategy."""
    names = ["individual", "individual_dict", "solid", "solid_dict"]
    total = rows.agg(F.sum("original").alias("original"), *[F.sum(n).alias(n) for n in names])
    flat = total.selectExpr("original", "individual AS base", f"stack(4, {', '.join(f'{n!r}, {n}' for n in names)}) AS (strategy, bytes)")
    return flat.select("strategy", "bytes", (F.col("original") / F.col("bytes")).alias("ratio"), ((1 - F.col("bytes") / F.col("base")) * 100).alias("savings_pct"))


def weighted_speed(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg((F.sum(F.col("speed") * F.col("size")) / F.sum("size")).alias("speed"))


def with_dictionary_cost(blocks: DataFrame, dictionaries: DataFrame, by: str) -> DataFrame:
    """blocks: by, original, no_dict, with_dict; dictionaries: by, dictionary (its compressed bytes, once a group)."""
    sums = blocks.groupBy(by).agg(*[F.sum(n).alias(n) for n in ("original", "no_dict", "with_dict")]).join(dictionaries, by)
    save = lambda x: (1 - F.col(x) / F.col("original")) * 100
    out = sums.select(by, "original", "no_dict", (F.col("with_dict") + F.col("dictionary")).alias("total_with_dict"))
    return out.select("*", save("no_dict").alias("savings_no_dict"), save("total_with_dict").alias("savings_with_dict"), (save("total_with_dict") - save("no_dict")).alias("difference"))


def speed_averages(rows: DataFrame, by: str) -> DataFrame:
    """rows: by, without_dict, with_dict. Averages of each group and, with a null key, of all rows."""
    more = F.avg(F.col("with_dict") - F.col("without_dict"))
    return rows.rollup(by).agg(F.avg("without_dict").alias("without_dict"), F.avg("with_dict").alias("with_dict"), more.alias("difference"), (more / F.avg("without_dict") * 100).alias("percent"))

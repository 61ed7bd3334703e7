"""Binary tables of contents, file headers and string pools, built and read by column expressions.

A table of contents is one value an archive, so its rows are collected by archive; the limits of the formats bound it.
Numbers are little-endian. Rows that do not fit any format give a null table; tables that are too short an error.
"""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from packlens.functions.scalars import bit_width
from packlens.operators.catalogue import ENTRY_BYTES, toc_format
from packlens.operators.codecs import _compressor

# Numbers of the presets, widths of (offset, path, block) in an entry's last word, by version; file magic;
# largest string pool.
PRESETS = {"Preset0": 0, "Preset1NoHash": 1, "Preset2": 2, "Preset3": 3, "Preset3NoHash": 3}
TUPLE = {1: (26, 20, 18), 2: (24, 18, 22)}
MAGIC = 0x52334100
MOST_POOL = 2**24 - 1
ENTRY = "hash", "size", "offset", "path_index", "first_block"


def left(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x.cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def low(x: Column, shift: Column | int, width: Column | int) -> Column:
    """`width` (below 64) bits of x from `shift`."""
    shift, width = (F.lit(v) if isinstance(v, int) else v for v in (shift, width))
    return F.call_function("shiftrightunsigned", x, shift.cast("int")).bitwiseAND(left(F.lit(1), width) - 1)


def either(*xs: Column) -> Column:
    out = xs[0].cast("long")
    for x in xs[1:]:
        out = out.bitwiseOR(x.cast("long"))
    return out


def le(x: Column, n: int = 8) -> Column:
    """Hexadecimal digits of the low n bytes."""
    h = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(n)])


def number(b: Column, at: Column | int, n: int = 8) -> Column:
    """The number in n bytes of a binary from byte `at`; 64 bits keep their pattern."""

    def whole(h: Column) -> Column:
        digits = [F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))]
        part = lambda d: F.conv(F.concat(*d), 16, 10).cast("long")
        return part(digits) if n <= 4 else either(left(part(digits[: n - 4]), 32), part(digits[n - 4 :]))

    return bound(F.hex(F.substring(b, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(n))), whole)


def bound(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def fixed(rows: DataFrame, *columns) -> DataFrame:
    """The archive and the columns, computed once whatever reads them: a generator that no projection is merged into."""
    return rows.select("archive", F.inline(F.array(F.struct(*columns))))


def file_header(version: Column, chunk: Column, pages: Column, flags: Column) -> Column:
    """8 bytes: magic, then version (7 bits), chunk size as 512 << chunk (5), pages of 4096 bytes (16), flags (4)."""
    word = either(left(version, 25), left(chunk, 20), left(pages, 4), flags)
    return F.unhex(F.concat(le(F.lit(MAGIC), 4), le(word, 4)))


def file_header_fields(b: Column) -> Column:
    """struct<valid, version, chunk_size, header_bytes, flags>."""
    word = number(b, 4, 4)
    return F.struct((number(b, 0, 4) == MAGIC).alias("valid"), low(word, 25, 7).alias("version"), left(F.lit(512), low(word, 20, 5)).alias("chunk_size"), (low(word, 4, 16) * 4096).alias("header_bytes"), low(word, 0, 4).alias("flags"))


def _words(x: Column, fmt: Column, bits: tuple[Column, ...], version: int) -> Column:
    """Hexadecimal digits of one entry."""
    o, p, b = TUPLE[version]
    word = either(left(x["offset"], p + b), left(x["path_index"], b), x["first_block"])
    pair = F.concat(le(x["path_index"], 2), le(x["first_block"], 2))
    if version == 1:
        return F.concat(le(x["hash"]), F.when(fmt == "V0", le(x["size"], 4)).otherwise(le(x["size"])), le(word))
    wo, wp, wb = bits
    flexible = either(left(x["size"], wo + wp + wb), left(x["offset"], wp + wb), left(x["path_index"], wb), x["first_block"])
    body = F.when(fmt.startswith("FEF64"), le(flexible)).when(fmt.startswith("Preset3"), F.concat(le(x["size"], 4), pair))
    body = body.when(fmt == "Preset2", F.concat(le(x["size"]), le(word))).otherwise(F.concat(le(x["size"], 4), le(word)))
    return F.when(fmt.endswith("NoHash"), body).otherwise(F.concat(le(x["hash"]), body))


def serialized(entries: DataFrame, blocks: DataFrame, pools: DataFrame, version: int = 2) -> DataFrame:
    """entries: archive, i, hash, size, offset, path_index, first_block; blocks: archive, block_index, bytes, codec;
    pools: archive, pool (binary), hashes (boolean). Rows (archive, format, toc), entries in order of i. An index of a path
    or block that the archive does not have gives a null table."""
    c = F.col
    e = entries.groupBy("archive").agg(F.count("*").alias("files"), F.max("size").alias("largest"), F.max("offset").alias("far"), F.max("path_index").alias("last_path"), F.max("first_block").alias("last_block"), F.sort_array(F.collect_list(F.struct("i", *ENTRY))).alias("entries"))
    word = le(either(left(c("bytes"), 3), c("codec")), 4)
    b = blocks.groupBy("archive").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_index", word.alias("w")))), lambda x: x["w"]), "").alias("blocks"))
    zero = F.lit(0).cast("long")
    rows = pools.join(e, "archive", "left").join(b, "archive", "left")
    rows = rows.withColumns({n: F.coalesce(c(n), zero) for n in ("files", "largest", "far", "n")} | {"p": F.octet_length("pool").cast("long"), "blocks": F.coalesce("blocks", F.lit(""))})
    if version == 1:
        rows = rows.withColumn("format", F.when(c("largest") > 2**32 - 1, "V1").otherwise("V0"))
        fits = (c("files") < 2**20) & (c("n") < 2**18) & (c("p") <= MOST_POOL)
        head = le(either(left((c("format") == "V1").cast("long"), 62), left(c("p"), 38), left(c("n"), 20), c("files")))
    else:
        rows = rows.withColumn("format", toc_format(c("p"), c("far"), c("n"), c("files"), c("largest"), c("hashes")))
        fits = c("format") != "Error"
        wp, wf, wb, wo = (bit_width(c(n)) for n in ("p", "files", "n", "far"))
        counts = either(left(c("p"), wb + wf), left(c("n"), wf), c("files"))
        wide = wp + wf + wb > 42
        flexible = either(left(F.lit(1), 63), left((~c("format").endswith("NoHash")).cast("long"), 62), left(wp, 57), left(wf, 52), left(wb, 47), left(wo, 42))
        flexible = F.when(wide, F.concat(le(flexible), le(counts))).otherwise(le(either(flexible, counts)))
        preset = F.lit(0)
        for name, n in PRESETS.items():
            preset = F.when(c("format") == name, n).otherwise(preset)
        third = either(left(F.lit(3), 61), left((c("format") == "Preset3").cast("long"), 60), left(c("p"), 40), left(c("n"), 24), left(c("files"), 8))
        other = either(left(preset, 61), left(c("p"), 40), left(c("n"), 18), c("files"))
        head = F.when(c("format").startswith("FEF64"), flexible).when(c("format").startswith("Preset3"), le(third)).otherwise(le(other))
    bits = tuple(bit_width(c(n)) for n in ("far", "files", "n"))
    each = F.coalesce(F.array_join(F.transform("entries", lambda x: _words(x, c("format"), bits, version)), ""), F.lit(""))
    toc = F.unhex(F.concat(head, each, "blocks", F.hex("pool")))
    fits = fits & (F.coalesce("last_path", zero - 1) < c("files")) & (F.coalesce("last_block", zero - 1) < F.greatest(c("n"), zero + 1))
    worded = ~(c("format").startswith("FEF64") | c("format").startswith("Preset3"))  # the offset has a fixed width
    fits = fits & (~worded | (c("far") < 2 ** TUPLE[version][0]))
    return rows.select("archive", "format", F.when(fits, toc).alias("toc"))


def parsed(tables: DataFrame, version: int = 2) -> DataFrame:
    """tables: archive, toc. Rows (archive, format, error, entries, blocks, pool): arrays of structs in their order.
    Tables shorter than their header says have an error and nothing else."""
    c, zero = F.col, F.lit(0).cast("long")
    rows = fixed(tables, "toc", F.when(F.octet_length("toc") >= 8, number(c("toc"), 0)).alias("h"))
    if version == 1:
        rows = fixed(rows, "toc", F.when(low(c("h"), 62, 2) == 1, "V1").otherwise("V0").alias("format"), low(c("h"), 0, 20).alias("files"), low(c("h"), 20, 18).alias("n"), low(c("h"), 38, 24).alias("p"), F.lit(8).alias("start"), zero.alias("wo"), zero.alias("wp"), zero.alias("wb"))
        size = F.when(c("format") == "V1", 24).otherwise(20)
    else:
        flexible, hashed = c("h") < 0, low(c("h"), 62, 1) == 1
        wp, wf, wb, wo = (low(c("h"), at, 5) for at in (57, 52, 47, 42))
        wide = flexible & (wp + wf + wb > 42)
        counts = F.when(wide, number(c("toc"), 8)).otherwise(c("h"))
        preset = low(c("h"), 61, 2)
        third = preset == 3
        name = F.when(flexible, F.when(hashed, "FEF64").otherwise("FEF64NoHash")).when(third, F.when(low(c("h"), 60, 1) == 1, "Preset3").otherwise("Preset3NoHash")).when(preset == 1, "Preset1NoHash").otherwise(F.concat(F.lit("Preset"), preset))
        pick = lambda a, b, d: F.when(flexible, a).when(third, b).otherwise(d)
        files = pick(low(counts, 0, wf), low(c("h"), 8, 16), low(c("h"), 0, 18))
        n = pick(low(counts, wf, wb), low(c("h"), 24, 16), low(c("h"), 18, 22))
        p = pick(low(counts, wf + wb, wp), low(c("h"), 40, 20), low(c("h"), 40, 21))
        rows = fixed(rows, "toc", name.alias("format"), files.alias("files"), n.alias("n"), p.alias("p"), F.when(wide, 16).otherwise(8).alias("start"), wo.alias("wo"), wf.alias("wp"), wb.alias("wb"))
        size = F.lit(0)
        for f, b in ENTRY_BYTES.items():
            size = F.when(c("format") == f, b).otherwise(size)
    rows = fixed(rows, *rows.columns[1:], size.alias("step"))
    rows = fixed(rows, *rows.columns[1:], (c("start") + c("files") * c("step")).alias("at"))
    short = F.octet_length("toc") < c("at") + 4 * c("n") + c("p")
    rows = fixed(rows, *rows.columns[1:], F.when(c("files").isNull() | short, "table of contents is too short").alias("error"))

    def entry(i: Column) -> Column:
        at = c("start") + i * c("step")
        plain = c("format").endswith("NoHash")
        body = F.when(plain, at).otherwise(at + 8)
        last = at + c("step") - 8
        o, p, b = TUPLE[version]
        word = number(c("toc"), last)
        kind = lambda flex, third, other: F.when(c("format").startswith("FEF64"), flex).when(c("format").startswith("Preset3"), third).otherwise(other)
        used = c("wo") + c("wp") + c("wb")
        long_size = c("format").isin("Preset2", "V1")
        rest = F.when(used > 63, 0).otherwise(F.call_function("shiftrightunsigned", word, used.cast("int")))
        return F.struct(
            F.when(~plain, number(c("toc"), at)).alias("hash"),
            kind(rest, number(c("toc"), body, 4), F.when(long_size, number(c("toc"), body)).otherwise(number(c("toc"), body, 4))).alias("size"),
            kind(low(word, c("wp") + c("wb"), c("wo")), zero, low(word, p + b, o)).alias("offset"),
            kind(low(word, c("wb"), c("wp")), number(c("toc"), body + 4, 2), low(word, b, p)).alias("path_index"),
            kind(low(word, 0, c("wb")), number(c("toc"), body + 6, 2), low(word, 0, b)).alias("first_block"),
        )

    def block(i: Column) -> Column:
        w = number(c("toc"), c("at") + 4 * i, 4)
        return F.struct(low(w, 3, 29).alias("bytes"), low(w, 0, 3).alias("codec"))

    def listed(n: Column, f) -> Column:
        return F.when(c("error").isNull(), F.when(n > 0, F.transform(F.sequence(zero, n - 1), f)).otherwise(F.array()))

    pool = F.substring(c("toc"), (c("at") + 4 * c("n") + 1).cast("int"), c("p").cast("int"))
    return rows.select("archive", "format", "error", listed(c("files"), entry).alias("entries"), listed(c("n"), block).alias("blocks"), F.when(c("error").isNull(), pool).alias("pool"))


@F.pandas_udf(BinaryType())
def _pool(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: len(x).to_bytes(4, "little") + (_compressor(16).compress(bytes(x)) if x else b""))


@F.pandas_udf(BinaryType())
def _unpool(pool: pd.Series) -> pd.Series:
    def one(x):
        n = int.from_bytes(x[:4], "little")
        if n > MOST_POOL:
            raise ValueError(f"a string pool of {n} bytes exceeds {MOST_POOL}")
        return zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS).stream_reader(bytes(x[4:])).read(n) if n else b""

    return pool.map(one)


def packed_pools(paths: DataFrame) -> DataFrame:
    """paths: archive, path. Rows (archive, pool): the sorted paths, each closed by a zero byte, compressed after their
    size. Pools over MOST_POOL bytes raise an error."""
    raw = F.concat(F.array_join(F.sort_array(F.collect_list("path")), "\0"), F.lit("\0")).cast("binary")
    rows = paths.groupBy("archive").agg(raw.alias("raw"))
    fits = F.when(F.octet_length("raw") > MOST_POOL, F.raise_error(F.lit("string pool is too large"))).otherwise(F.col("raw"))
    return rows.select("archive", _pool(fits).alias("pool"))


def unpacked_pools(pools: DataFrame) -> DataFrame:
    """Rows (archive, path_index, path). An empty pool has none."""
    raw = pools.select("archive", _unpool("pool").alias("raw")).filter(F.octet_length("raw") > 0)
    names = F.split(F.expr("substring(raw, 1, octet_length(raw) - 1)").cast("string"), "\0")
    return raw.select("archive", F.posexplode(names).alias("path_index", "path"))

"""Scalar expressions on paths, sizes, settings and bit fields. All are column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(compressed: Column, original: Column) -> Column:
    return F.when(original == 0, 0.0).otherwise(compressed / original)


def sanitize_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), F.lit("_"))


def extension(path: Column) -> Column:
    """After the last dot of the whole path, unless that dot is first or last."""
    return F.regexp_extract(path, r"(?s)^.+\.([^.]+)$", 1)


def base_name(path: Column) -> Column:
    """Folder and file name up to its first dot."""
    return F.regexp_extract(path, r"^(.*/)?([^/.]*)", 0)


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def strip_root(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def byte_size(n: Column) -> Column:
    """Decimal units without decimals."""
    x = n.cast("double")
    out = F.concat(F.round(x).cast("long").cast("string"), F.lit("B"))
    for unit, top in (("kB", 1e3), ("MB", 1e6), ("GB", 1e9), ("TB", 1e12)):
        out = F.when(x >= top, F.concat(F.round(x / top).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


def size_difference(size: Column, reference: Column) -> Column:
    """The size and its percentage of the reference with one decimal; null for a reference of 0."""
    tenths = F.when(reference != 0, F.round(size * 1000 / reference).cast("long"))
    return F.concat(byte_size(size), F.lit(" ("), (tenths / 10).cast("long"), F.lit("."), tenths % 10, F.lit("%)"))


def binary_size(n: Column, top: str = "TiB") -> Column:
    """struct<value, unit> in binary units; format at the edge."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    units = units[: units.index(top) + 1]
    out = F.struct(n.cast("double").alias("value"), F.lit("B").alias("unit"))
    for i, u in enumerate(units[1:], 1):
        out = F.when(n >= 1024**i, F.struct((n / 1024**i).alias("value"), F.lit(u).alias("unit"))).otherwise(out)
    return out


def percent_diff(larger: Column, smaller: Column) -> Column:
    return F.when(larger == 0, 0.0).otherwise((larger - smaller) / larger * 100)


def dictionary_size(size: Column, manual: Column | None = None, fixed: bool = False) -> Column:
    own = F.lit(110 * 1024).cast("long") if fixed else F.floor(size / 100).cast("long")
    return own if manual is None else F.coalesce(manual, own)


def last_speed(text: Column) -> Column:
    """The last 'n.n MB/s' of a text; null if none."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+\.\d+)\s*MB/s"), 1)
    return F.try_element_at(found, F.lit(-1)).cast("double")


def bitmask(n: Column) -> Column:
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - n).cast("int"))
    return F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, F.lit(-1).cast("long")).otherwise(ones)


def is_chunked(size: Column, chunk: int) -> Column:
    return size >= chunk


def chunk_count(size: Column, chunk: int) -> Column:
    return F.floor((size + (chunk - 1)) / F.lit(chunk)).cast("long")


def packed(*fields: tuple[Column, int]) -> Column:
    """Fields (value, width) packed with the first lowest, as one 64-bit value; values are cut to their width."""
    out, at = F.lit(0).cast("long"), 0
    for value, width in fields:
        mask = (1 << width) - 1
        cut = value.cast("long") if width >= 64 else value.cast("long").bitwiseAND(F.lit(mask).cast("long"))
        out = out.bitwiseOR(F.shiftleft(cut, at))
        at += width
    return out


def unpacked(word: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(word, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def bit_width(x: Column) -> Column:
    """Bits that x takes; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def clamp_level(codec: Column, level: Column) -> Column:
    bound = lambda low, high: F.least(F.greatest(level, F.lit(low)), F.lit(high))
    return F.when(codec == "zstd", bound(-5, 22)).when(codec == "lz4", bound(1, 12)).when(codec == "lzma", F.lit(0)).otherwise(F.lit(1))


# Bounds of the settings.
MIN_CHUNK, MAX_CHUNK, MIN_SOLID, MAX_SOLID = 32_768, 536_870_912, 4_095, 16_777_215


def _power(x: int) -> int:
    return 1 if x <= 1 else 1 << (x - 1).bit_length()


@dataclass(frozen=True)
class Settings:
    solid_size: int = 1_048_575
    chunk_size: int = 1_048_576
    solid_codec: str = "zstd"
    chunk_codec: str = "zstd"
    solid_level: int = 12
    chunk_level: int = 12
    solid_dedupe: bool = True
    chunk_dedupe: bool = False
    hashes: bool = True

    def sanitized(self) -> Settings:
        """Chunk: a power of two in bounds and above solid. Solid: a power of two less one; 0 turns it off."""
        from dataclasses import replace

        chunk = _power(min(max(self.chunk_size, MIN_CHUNK), MAX_CHUNK))
        solid = 0 if self.solid_size == 0 else _power(min(max(self.solid_size, MIN_SOLID), MAX_SOLID)) - 1
        if solid and chunk <= solid:
            chunk = solid + 1
        bound = {"zstd": (-5, 22), "lz4": (1, 12), "lzma": (0, 0)}
        cut = lambda c, x: min(max(x, bound.get(c, (1, 1))[0]), bound.get(c, (1, 1))[1])
        return replace(self, chunk_size=chunk, solid_size=solid, solid_level=cut(self.solid_codec, self.solid_level), chunk_level=cut(self.chunk_codec, self.chunk_level))


# Presets as name, solid block size, chunk size, codec and level of both, dictionary for each extension.
PRESETS = [
    ("LocalArchivalSSD", 16_777_215, 536_870_912, "lzma", 9, False),
    ("LocalArchivalSSD32BitTarget", 16_777_215, 16_777_216, "lzma", 9, True),
    ("LocalArchivalNVME", 536_870_911, 536_870_912, "zstd", 22, False),
    ("LocalArchivalNVME32BitTarget", 16_777_215, 16_777_216, "zstd", 22, True),
    ("WebUploadGeneric", 1_048_575, 268_435_456, "bzip3", 0, False),
    ("WebUploadSpecialized", 0, 16_777_216, "bzip3", 0, False),
    ("GameBulkLoad", 16_777_215, 536_870_912, "zstd", 12, True),
    ("GameBulkLoad32BitTarget", 16_777_215, 16_777_216, "zstd", 12, True),
    ("LowLatencyVFS", 0, 131_072, "zstd", 12, True),
]


def preset(name: str) -> tuple[Settings, bool]:
    """Settings of a preset, not yet cut to their bounds, and whether extensions have dictionaries."""
    _, solid, chunk, codec, level, dictionaries = next(p for p in PRESETS if p[0] == name)
    return Settings(solid, chunk, codec, codec, level, level), dictionaries

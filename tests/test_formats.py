"""Binary tables of contents and pools: every format of both versions, edges, and the streaming codecs."""

import pytest
from pyspark.sql import functions as F

from packlens.functions import scalars as S
from packlens.operators import codecs as K
from packlens.operators import formats as Z

ENTRIES = "archive long, i int, hash long, size long, offset long, path_index long, first_block long"
POOL = bytes(range(5))


def tables(spark, entries, n_blocks, hashes, pool=POOL):
    e = spark.createDataFrame([(1, i, *x) for i, x in enumerate(entries)], ENTRIES)
    b = spark.createDataFrame([(1, i, 2**29 - 1 - i, i % 8) for i in range(n_blocks)], "archive long, block_index long, bytes long, codec int")
    return e, b, spark.createDataFrame([(1, bytearray(pool), hashes)], "archive long, pool binary, hashes boolean")


@pytest.mark.parametrize(
    ("size", "offset", "pool", "hashes", "version", "name"),
    [
        (2**32 - 1, 0, POOL, False, 2, "Preset3NoHash"), (2**32 - 1, 0, POOL, True, 2, "Preset3"), (2**40, 9, POOL, False, 2, "FEF64NoHash"),
        (2**40, 9, POOL, True, 2, "FEF64"), (2**62, 2**24 - 1, POOL, True, 2, "Preset2"), (7, 2**26 - 1, POOL, True, 1, "V0"), (2**60, 5, POOL, True, 1, "V1"),
    ],
)
def test_round_trip(spark, size, offset, pool, hashes, version, name):
    entries = [(-5, size, offset, 2, 0), (2**63 - 1, 0, 0, 0, 1), (0, 1, 0, 1, 1)]
    made = Z.serialized(*tables(spark, entries, 2, hashes, pool), version)
    assert made.first().format == name
    row = Z.parsed(made.select("archive", "toc"), version).first()
    want = [(None if name.endswith("NoHash") else e[0], *e[1:]) for e in entries]
    assert (row.format, row.error, [tuple(x) for x in row.entries]) == (name, None, want)
    assert [tuple(x) for x in row.blocks] == [(2**29 - 1, 0), (2**29 - 2, 1)] and bytes(row.pool) == pool


def test_middle_presets(spark):
    """Large counts leave no room for the flexible format: 12 and 20 bytes an entry."""
    entries = [(i, 2**32 - 1, 2**24 - 1, i, 0) for i in range(300)]
    for hashes, name in ((False, "Preset1NoHash"), (True, "Preset0")):
        made = Z.serialized(*tables(spark, entries, 1, hashes), 2)
        row = Z.parsed(made.select("archive", "toc")).first()
        assert row.format == name and [x.path_index for x in row.entries] == list(range(300)) and {x.offset for x in row.entries} == {2**24 - 1}


def test_edges(spark):
    e, b, p = tables(spark, [], 0, True, b"")
    made = Z.serialized(e, b, p)
    row = Z.parsed(made.select("archive", "toc")).first()
    assert (row.entries, row.blocks, bytes(row.pool), row.error) == ([], [], b"", None)
    assert Z.serialized(*tables(spark, [(1, 1, 0, 5, 0)], 1, True)).first().toc is None  # no such path
    assert Z.serialized(*tables(spark, [(1, 2**62, 2**30, 0, 0)], 1, True)).first().toc is None  # too large
    short = spark.createDataFrame([(1, bytearray(b"\1\2")), (2, None), (3, bytearray(b"\xff" * 8))], "archive long, toc binary")
    assert all(r.error and r.entries is None and r.pool is None for r in Z.parsed(short).collect())


def test_pools(spark):
    paths = [(1, "b/ü"), (1, "a"), (1, ""), (2, "x")]
    got = Z.unpacked_pools(Z.packed_pools(spark.createDataFrame(paths, "archive long, path string")))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, ""), (1, 1, "a"), (1, 2, "b/ü"), (2, 0, "x")]
    empty = spark.createDataFrame([(1, bytearray(4))], "archive long, pool binary")
    assert not Z.unpacked_pools(empty).collect()


def test_streams(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab" * 200_000)), (2, bytearray()), (3, None)], "id long, raw binary")
    for r in df.select("id", K.compress_within(F.col("raw"), 10).alias("z")).collect():
        assert (r.z.stopped, r.z.bytes is None) == {1: (True, True), 2: (False, False), 3: (None, True)}[r.id]
    chunks = K.decoded_chunks(df.select("id", K.compress(F.col("raw")).alias("packed")), "id", 300_000).collect()
    assert [(r.id, r.chunk_index, len(r.content)) for r in chunks] == [(1, 0, 300_000), (1, 1, 100_000)]


def test_presets():
    settings, dictionaries = S.preset("LowLatencyVFS")
    assert (settings.solid_size, settings.chunk_size, settings.solid_level, dictionaries) == (0, 131_072, 12, True)
    assert S.preset("LocalArchivalNVME")[0].sanitized().solid_size == S.MAX_SOLID

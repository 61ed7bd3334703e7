"""Expected vectors of buckets, expressions, layout, runs, encodings and codecs."""

import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from packlens import buckets as B
from packlens.functions import scalars as S
from packlens.operators import analytics as A
from packlens.operators import catalogue as C
from packlens.operators import codecs as K
from packlens.operators import layout as L
from packlens.operators import selection as D
from packlens.sources import corpus

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(("ranges", "values"), [(B.FILE_COUNT, [1, 3, 7, 15, 35, 75, 125, 175, 225, 350, 600]), (B.FILE_SIZE, [500, 2048, 50000, 500000, 5000000, 50000000]), (B.ARCHIVE_SIZE, [500000, 5 * 10**6, 50 * 10**6, 500 * 10**6, 2 * 10**9])])
def test_buckets(spark, ranges, values):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert [r.cnt for r in B.histogram(df, "x", ranges).orderBy("pos").collect()] == [1] * len(ranges)
    assert [(r.cnt, r.pct) for r in B.histogram(df.limit(0), "x", ranges).collect()] == [(0, 0.0)] * len(ranges)


def test_bucket_outside_stays_in_denominator(spark):
    rows = B.histogram(spark.createDataFrame([(0,), (1,)], "x long"), "x", B.FILE_COUNT).orderBy("pos").collect()
    assert rows[0].cnt == 1 and rows[0].pct == 50.0


def test_expressions(spark):
    assert one(spark, ["Test Mod", "Mod@#$%Name", "Simple-Mod_123", "___Leading Trailing___"], "string", S.sanitize_name) == ["Test_Mod", "Mod____Name", "Simple-Mod_123", "Leading_Trailing"]
    assert one(spark, ["a.txt", ".gitignore", "a/.gitignore", "dir.v1/file", "x.", "a.b.c", "noext"], "string", S.extension) == ["txt", "", "gitignore", "v1/file", "", "c", ""]
    assert one(spark, [0.0, 512.0, 1000.0, 1023.0, 1500.0, 1.5e6, 1e12, 10.5, 10.4], "double", S.byte_size) == ["0B", "512B", "1kB", "1kB", "2kB", "2MB", "1TB", "11B", "10B"]
    assert one(spark, [0, 1, 8, 63, 64], "int", S.bitmask) == [0, 1, 255, 2**63 - 1, -1]
    assert one(spark, ["x 12.5 MB/s 13.25 MB/s", "none"], "string", S.last_speed) == [13.25, None]
    assert one(spark, [100, 200, 300, 1000, 1001], "int", lambda x: F.lit(1000) >= x) == [True, True, True, True, False]
    assert [one(spark, [1000], "long", lambda x, n=n: S.chunk_count(x, n))[0] for n in (100, 200, 300, 1000, 1001)] == [10, 5, 4, 1, 1]


def test_settings():
    assert [S.Settings(chunk_size=x).sanitized().chunk_size for x in (1073741825, 2**32 - 1)] == [2**29, 2**29]
    assert S.Settings(chunk_size=0, solid_size=0).sanitized().chunk_size == 32768
    assert [S.Settings(solid_size=x).sanitized().solid_size for x in (16777216, 2**32 - 1, 4094, 0, 1048576)] == [16777215, 16777215, 4095, 0, 1048575]
    assert [S.Settings(solid_level=x).sanitized().solid_level for x in (23, 0, -(2**31))] == [22, 0, -5]
    assert [S.Settings(solid_codec="lz4", solid_level=x).sanitized().solid_level for x in (13, 0)] == [12, 1]


def test_cdf(spark):
    def points(values):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        return sorted((r.value, r.cum_pct) for r in A.cdf(df, "v").collect())

    assert points([1, 2, 5, 10, 20]) == [(1, 20), (2, 40), (5, 60), (10, 80), (20, 100)]
    assert points([10, 2, 1, 2]) == [(1, 25), (2, 50), (2, 75), (10, 100)]
    assert points([]) == [] and points([42]) == [(42, 100)]
    many = points(range(1, 2000))
    assert len(many) == 1999 and many[-1] == (1999, 100)


def test_empty_reports(spark):
    none = spark.createDataFrame([], "mod_id long, original_size long, compressed_size long, archive_size long")
    assert not A.compression_by_size(none).collect() and not A.compression_summary(none).collect() and not A.archive_summary(none).collect()
    grown = spark.createDataFrame([(1, 10, 15), (1, 0, 5)], "mod_id long, original_size long, compressed_size long")
    assert A.compression_summary(grown).first().kind == "increase"
    assert A.compression_by_size(grown).first().excellent == 1  # the empty file has ratio 0


def test_blocks(spark):
    def blocks(sizes):
        df = spark.createDataFrame([("txt", f"f{i}", s) for i, s in enumerate(sizes)], "ext string, path string, size long")
        items = df.groupBy("ext").agg(F.array_sort(F.collect_list(F.struct("path", "size"))).alias("items"))
        return items.select(L.fold_blocks(F.col("items"), 10)).first()[0]

    assert blocks([1, 8, 1, 1]) == [0, 0, 0, 1]
    assert blocks([1, 8, 5, 1]) == [0, 0, 1, 1]
    rows = spark.createDataFrame([("a.bin", 25)], "path string, size long")
    assert [tuple(r)[1:] for r in L.chunks(rows, 10).orderBy("chunk_index").collect()] == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]


def test_blocks_of_large_groups(spark):
    """As a plain fold makes them, from counts of sizes: no task gathers a group's files."""
    rng = random.Random(4)
    rows = [(e, f"f{i}", rng.choice([0, 1, 1, 2, 3, 7, 9, 10, 12, 25])) for e, n in (("txt", 3000), ("bin", 41), (None, 1)) for i in range(n)]
    got = L.solid_blocks(spark.createDataFrame(rows, "ext string, path string, size long"), 10)
    want: dict = {}
    for ext in {r[0] for r in rows}:
        block, total, n = 0, 0, 0
        for size in sorted(r[2] for r in rows if r[0] == ext):
            block, total = (block, total + size) if not n or total + size <= 10 else (block + 1, size)
            n += 1
            want[ext, block] = (want.get((ext, block), (0,))[0] + 1, total)
    assert {(r.ext, r.block_no): (r.n_items, r.bytes) for r in got.collect()} == want and got.count() == len(want)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_run_lengths(spark, codes):
    df = spark.createDataFrame(list(enumerate(codes)), "i long, code int")
    runs = D.run_lengths(df, "i", "code", 3)
    back = D.expand_runs(runs, "run_start", "code", "len").orderBy("block_index").collect()
    assert [r.code for r in back] == codes and all(r.len <= 3 for r in runs.collect())


def test_run_limit(spark):
    df = spark.createDataFrame([(i, 1) for i in range(300)], "i long, code int")
    assert [r.len for r in D.run_lengths(df, "i", "code").orderBy("run_start").collect()] == [255, 45]


def test_encodings(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (5, 3), (3, 2), (1000, 100)], "m long, d long")
    assert sorted(r[0] for r in df.select(C.dictionary_header(F.col("m"), F.col("d"))).collect()) == [8, 24, 40, 56, 3208]
    rows = spark.createDataFrame([(2**20 - 1, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, False), (2**21 - 1, 1000, 2**22 - 1, 2**18 - 1, 2**32 - 1, False)], "p long, o long, b long, f long, s long, h boolean")
    assert [r[0] for r in rows.select(C.toc_format(*map(F.col, "pobfsh"))).collect()] == ["Preset3NoHash", "Preset1NoHash"]


def test_first_packages_keep_null_ids(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "a"), (3, None)], "ord long, id string")
    assert sorted(r.ord for r in D.first_packages(df).collect()) == [0, 1, 3]


def test_codecs(spark):
    df = spark.createDataFrame([(b"thisdoenatcmpres",), (b"a" * 999,), (b"",), (None,)], "x binary")
    for method in ("zstd", "lz4"):
        out = df.select("x", K.compress(F.col("x"), method).alias("z")).withColumn("y", K.decompress(F.col("z"), F.octet_length("x"), method)).collect()
        assert [r.x for r in out] == [r.y for r in out] and out[0].z.used_copy and not out[1].z.used_copy
    with pytest.raises(ValueError):
        K.compress(F.col("x"), "lzma")


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "file1.txt").write_text("content1")
    (tmp_path / "sub" / "file2.txt").write_text("content2")
    rows = sorted((r.path, r.original_size) for r in corpus.analyzed_directory(spark, str(tmp_path)).collect())
    assert rows == [("file1.txt", 8), ("sub/file2.txt", 8)]
    assert corpus.directory_totals(corpus.directory(spark, str(tmp_path))).first().bytes == 16
    doc = tmp_path / "corpus.json"
    doc.write_text('{"mods": [{"name": "Test Mod", "id": "test-123", "link": "https://example.com", "original_archive_size": 12345, "files": [{"path": "test.txt", "original_size": 100, "compressed_size": 80, "xxh3_hash": "abcdef1234567890"}]}], "summary": {"total_mods_processed": 1}}')
    mod = corpus.read_corpus(spark, str(doc)).first()
    assert (mod.id, mod.original_archive_size, mod.files[0].compressed_size) == ("test-123", 12345, 80)
    corpus.write_corpus(corpus.read_corpus(spark, str(doc)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def norm(v):
    return "null" if v is None else repr(round(v, 5)) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [k for k in entry.queries() if not k.startswith(("op", "pipeline"))])
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in entry.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall())

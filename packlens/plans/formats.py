"""Registered queries over binary formats, chunked codecs and reports, with independent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from packlens.fixtures import contents, files, sql, table
from packlens.functions import scalars as S
from packlens.operators import codecs as K
from packlens.operators import formats as Z
from packlens.plans.queries import ARGS, BLOCKS, FORMAT, _b, _unit, blocks, query, rounded

c = F.col

# -- tables of contents: an archive is an order, its files are the line items
LINES = "ln AS (SELECT * EXCLUDE l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_linenumber, l_partkey * 1000003 AS hash, CAST(floor(l_extendedprice * l_extendedprice / CASE WHEN l_orderkey % 7 = 0 THEN 0.0001 ELSE 800 END) AS BIGINT) AS size, CASE WHEN l_orderkey % 3 = 0 THEN 0 WHEN l_orderkey % 5 = 0 THEN 16000000 ELSE l_partkey * 10 END AS far FROM lineitem), "
STATS = LINES + "args AS (SELECT l_orderkey, strlen(CAST(l_orderkey AS VARCHAR)) AS pool, max(far) AS off, count(*) AS blk, count(*) AS fil, max(size) AS big, l_orderkey % 2 = 0 AS hashes FROM ln GROUP BY l_orderkey)" + FORMAT[len(ARGS) :]


def archives(s, d):
    key = c("l_orderkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    size = F.floor(c("l_extendedprice") * c("l_extendedprice") / F.when(key % 7 == 0, 0.0001).otherwise(800)).cast("long")
    far = F.when(key % 3 == 0, 0).when(key % 5 == 0, 16_000_000).otherwise(c("l_partkey") * 10).cast("long")
    rows = table(s, d, "lineitem").select(key.alias("archive"), n.alias("i"), (c("l_partkey") * 1000003).cast("long").alias("hash"), size.alias("size"), far.alias("offset"), (n - 1).cast("long").alias("path_index"), (n - 1).cast("long").alias("first_block"))
    blk = rows.select("archive", c("first_block").alias("block_index"), (c("size") % 2**29).alias("bytes"), (c("i") % 5).alias("codec"))
    pools = rows.select("archive").distinct().select("archive", c("archive").cast("string").cast("binary").alias("pool"), (c("archive") % 2 == 0).alias("hashes"))
    return rows, blk, pools


HEAD = f"""CASE WHEN format LIKE 'FEF64%' THEN 9223372036854775808::HUGEINT + CASE WHEN format = 'FEF64' THEN 4611686018427387904::HUGEINT ELSE 0 END + {_b('pool')}::HUGEINT * 144115188075855872 + {_b('fil')}::HUGEINT * 4503599627370496 + {_b('blk')}::HUGEINT * 140737488355328 + {_b('off')}::HUGEINT * 4398046511104
 + pool::HUGEINT * (1::BIGINT << CAST({_b('blk')} + {_b('fil')} AS INTEGER)) + blk * (1::BIGINT << CAST({_b('fil')} AS INTEGER)) + fil
 WHEN format LIKE 'Preset3%' THEN 3::HUGEINT * 2305843009213693952 + CASE WHEN format = 'Preset3' THEN 1152921504606846976 ELSE 0 END + pool::HUGEINT * 1099511627776 + blk::HUGEINT * 16777216 + fil * 256
 ELSE CASE format WHEN 'Preset1NoHash' THEN 1 WHEN 'Preset2' THEN 2 ELSE 0 END::HUGEINT * 2305843009213693952 + pool::HUGEINT * 1099511627776 + blk::HUGEINT * 262144 + fil END"""
query("f6_toc_bytes", f"WITH {STATS} SELECT l_orderkey AS archive, format, CAST(8 + fil * CASE format WHEN 'Preset3NoHash' THEN 8 WHEN 'FEF64NoHash' THEN 8 WHEN 'Preset1NoHash' THEN 12 WHEN 'Preset3' THEN 16 WHEN 'FEF64' THEN 16 WHEN 'Preset0' THEN 20 ELSE 24 END + 4 * blk + pool AS BIGINT) AS bytes, hex(CAST({HEAD} AS UBIGINT)) AS header FROM fm")(lambda s, d: Z.serialized(*archives(s, d)).select("archive", "format", F.octet_length("toc").cast("long").alias("bytes"), F.hex(Z.number(c("toc"), 0)).alias("header")))
back = lambda s, d, v: Z.parsed(Z.serialized(*archives(s, d), version=v).select("archive", "toc"), v)
entries = lambda s, d, v: back(s, d, v).select("archive", "format", F.inline("entries"))
FILES = "l_linenumber - 1 AS path_index, l_linenumber - 1 AS first_block"
query("f7_toc_entries", f"WITH {STATS} SELECT l_orderkey AS archive, format, CASE WHEN format NOT LIKE '%NoHash' THEN hash END AS hash, size, far AS \"offset\", {FILES} FROM ln JOIN fm USING (l_orderkey)")(lambda s, d: entries(s, d, 2))
query("f7_toc_blocks", f"WITH {STATS} SELECT l_orderkey AS archive, CAST(l_linenumber - 1 AS INTEGER) AS block_index, CAST(size % 536870912 AS BIGINT) AS bytes, CAST(l_linenumber % 5 AS BIGINT) AS codec FROM ln")(lambda s, d: back(s, d, 2).select("archive", F.posexplode("blocks").alias("block_index", "x")).select("archive", "block_index", "x.*"))
query("z15_v1_entries", f"WITH {STATS} SELECT l_orderkey AS archive, CASE WHEN big > 4294967295 THEN 'V1' ELSE 'V0' END AS format, hash, size, far AS \"offset\", {FILES} FROM ln JOIN fm USING (l_orderkey)")(lambda s, d: entries(s, d, 1))
query("z24_short_tables", "SELECT l_orderkey AS archive, 'table of contents is too short' AS error FROM lineitem GROUP BY 1")(lambda s, d: Z.parsed(Z.serialized(*archives(s, d)).select("archive", F.expr("substring(toc, 1, octet_length(toc) - 1)").alias("toc"))).select("archive", "error"))

# -- string pools: bounded by ranges of ids within a source
pool_paths = lambda s, d: contents(s, d).select(F.concat_ws("/", F.substring_index("path", "/", 1), F.expr("doc_id div 1000")).alias("archive"), "path")
query("f8_string_pools", sql("SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY path) - 1 AS INTEGER) AS path_index, path FROM (SELECT concat(split_part(path, '/', 1), '/', doc_id // 1000) AS archive, path FROM contents)", "contents"))(lambda s, d: Z.unpacked_pools(Z.packed_pools(pool_paths(s, d))))
query("z13_pool_lengths", sql("SELECT concat(split_part(path, '/', 1), '/', doc_id // 1000) AS archive, CAST(count(*) AS BIGINT) AS paths, CAST(sum(strlen(path) + 1) AS BIGINT) AS bytes FROM contents GROUP BY 1", "contents"))(lambda s, d: Z.packed_pools(pool_paths(s, d)).select("archive", Z.number(c("pool"), 0, 4).alias("bytes"), "pool").join(Z.unpacked_pools(Z.packed_pools(pool_paths(s, d))).groupBy("archive").agg(F.count("*").alias("paths")), "archive").select("archive", "paths", "bytes"))

# -- file headers
query("p23_file_headers", "SELECT p_partkey, lpad(hex(1379090688::BIGINT), 8, '0') AS magic, true AS valid, CAST(p_partkey % 128 AS BIGINT) AS version, 512::BIGINT << (p_size % 21) AS chunk_size, CAST(p_size * 4096 AS BIGINT) AS header_bytes, CAST(p_size % 16 AS BIGINT) AS flags FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", Z.file_header(c("p_partkey") % 128, c("p_size") % 21, c("p_size"), c("p_size") % 16).alias("b")).select("p_partkey", F.lpad(F.hex(Z.number(c("b"), 0, 4)), 8, "0").alias("magic"), Z.file_header_fields(c("b")).alias("x")).select("p_partkey", "magic", "x.*"))

# -- presets
PRESETS = "name, solid_size, chunk_size, codec, level, dictionaries"
query("b10_presets", f"SELECT CAST(solid_size AS BIGINT) AS solid_size, CAST(chunk_size AS BIGINT) AS chunk_size, name, codec, level, dictionaries FROM (VALUES {', '.join(str(x).replace('True', 'true').replace('False', 'false') for x in S.PRESETS)}) t({PRESETS})")(lambda s, d: s.createDataFrame(S.PRESETS, "name string, solid_size long, chunk_size long, codec string, level int, dictionaries boolean"))

# -- codecs
raw = lambda s, d: contents(s, d).select("doc_id", c("text").cast("binary").alias("raw"))
query("c5_stopped_streams", "SELECT doc_id, strlen(text) > 0 AS stopped_at_once, false AS stopped, sha256(text) AS decoded FROM documents WHERE text IS NOT NULL")(lambda s, d: raw(s, d).filter("raw is not null").select("doc_id", "raw", K.compress_within(c("raw"), 0)["stopped"].alias("stopped_at_once"), K.compress_within(c("raw"), 2**31).alias("z")).select("doc_id", "stopped_at_once", "z.stopped", F.sha2(K.decompress(F.struct(c("z.bytes"), F.lit(False).alias("used_copy")), F.octet_length("raw")), 256).alias("decoded")))
query("c6_decoded_chunks", "SELECT doc_id, k AS chunk_index, hex(encode(text)[k * 1000 + 1:k * 1000 + 1000]) AS content FROM (SELECT doc_id, text, unnest(range((strlen(text) + 999) // 1000)) AS k FROM documents)")(lambda s, d: K.decoded_chunks(raw(s, d).select("doc_id", K.compress(c("raw"), "zstd", 3).alias("packed")), "doc_id", 1000).select("doc_id", "chunk_index", F.hex("content").alias("content")))
query("c10_most_bytes", "SELECT p_partkey, n, greatest(n + n // 256 + CASE WHEN n < 131072 THEN (131072 - n) // 2048 ELSE 0 END, n + n // 255 + 16) AS most FROM (SELECT p_partkey, CAST(p_size * p_size * 100 AS BIGINT) AS n FROM part)")(lambda s, d: table(s, d, "part").select("p_partkey", (c("p_size") * c("p_size") * 100).cast("long").alias("n")).select("p_partkey", "n", K.most_bytes(c("n")).alias("most")))

# -- reports
query("g20_with_dictionary_cost", sql(f"{BLOCKS} SELECT part, original, no_dict, total_with_dict, round((1 - no_dict / original::DOUBLE) * 100, 6) AS savings_no_dict, round((1 - total_with_dict / original::DOUBLE) * 100, 6) AS savings_with_dict, round((1 - total_with_dict / original::DOUBLE) * 100 - (1 - no_dict / original::DOUBLE) * 100, 6) AS difference FROM (SELECT part, CAST(sum(original) AS BIGINT) AS original, CAST(sum(no_dict) AS BIGINT) AS no_dict, CAST(sum(with_dict) + any_value(p_size) * 64 AS BIGINT) AS total_with_dict FROM blocks JOIN part ON p_partkey = part GROUP BY part)", "files"))(lambda s, d: rounded(K.with_dictionary_cost(blocks(s, d), table(s, d, "part").select(c("p_partkey").alias("part"), (c("p_size") * 64).cast("long").alias("dictionary")), "part")))
query("g21_speeds", sql("SELECT part, round(avg(a), 6) AS without_dict, round(avg(b), 6) AS with_dict, round(avg(b - a), 6) AS difference, round(avg(b - a) / avg(a) * 100, 6) AS percent FROM (SELECT part, original_size / 16384.0::DOUBLE AS a, compressed_size / 8192.0::DOUBLE AS b FROM files) GROUP BY ROLLUP (part)", "files"))(lambda s, d: rounded(K.speed_averages(files(s, d).select("part", (c("original_size") / 16384).alias("without_dict"), (c("compressed_size") / 8192).alias("with_dict")), "part")))
TENTHS = "CAST(round(compressed_size * 1000 / original_size::DOUBLE) AS BIGINT)"
query("p13_size_difference", sql(f"SELECT mod_id, part, original_size, concat(CASE WHEN x >= 1e9 THEN {_unit('1e9', 'GB')} WHEN x >= 1e6 THEN {_unit('1e6', 'MB')} WHEN x >= 1e3 THEN {_unit('1e3', 'kB')} ELSE {_unit('1', 'B')} END, ' (', {TENTHS} // 10, '.', {TENTHS} % 10, '%)') AS difference FROM (SELECT *, compressed_size::DOUBLE AS x FROM files) WHERE original_size > 0", "files"))(lambda s, d: files(s, d).filter("original_size > 0").select("mod_id", "part", "original_size", S.size_difference(c("compressed_size"), c("original_size")).alias("difference")))

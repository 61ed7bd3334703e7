"""Registered queries over the driver's tables, and independent SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens import buckets as B
from packlens.fixtures import contents, files, mods, packages, sql, table
from packlens.functions import scalars as S
from packlens.operators import analytics as A
from packlens.operators import catalogue as C
from packlens.operators import codecs as K
from packlens.operators import layout as L
from packlens.operators import selection as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def case(value: str, ranges) -> str:
    return "CASE " + " ".join(f"WHEN {value} BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in ranges) + " END"


def hist_sql(rows: str, value: str, ranges, *views: str) -> str:
    labels = ", ".join(f"({i}, '{n}')" for i, (n, _, _) in enumerate(ranges))
    return sql(f"labels(pos, bucket) AS (VALUES {labels}), f AS (SELECT {case(value, ranges)} AS bucket, count(*) AS n FROM {rows} GROUP BY 1) SELECT CAST(pos AS INTEGER) AS pos, labels.bucket, coalesce(n, 0) AS cnt, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT sum(n) FROM f)::DOUBLE, 6) AS pct FROM labels LEFT JOIN f USING (bucket)", *views)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


# -- projections
def nested(s, d):
    one = F.struct(F.lit(None).cast("string").alias("path"), "original_size", "compressed_size")
    f = files(s, d).groupBy("mod_id").agg(F.collect_list(one).alias("files"))
    return mods(s, d).join(f, "mod_id", "left")


query("p1_unnest_files", sql("SELECT mod_id, original_size, compressed_size FROM files WHERE mod_id IN (SELECT mod_id FROM mods)", "mods", "files"))(lambda s, d: nested(s, d).select("mod_id", F.inline("files")).drop("path"))
query("p2_files_per_mod", sql("SELECT mod_id, count(original_size) AS n_files FROM mods LEFT JOIN files USING (mod_id) GROUP BY 1", "mods", "files"))(lambda s, d: A.files_per(mods(s, d), files(s, d)))
query("p3_safe_ratio", sql("SELECT mod_id, original_size, round(CASE WHEN original_size = 0 THEN 0.0 ELSE compressed_size / original_size::DOUBLE END, 6) AS ratio FROM files", "files"))(lambda s, d: rounded(files(s, d).select("mod_id", "original_size", S.safe_ratio(c("compressed_size"), c("original_size")).alias("ratio"))))
query("p4_ranges", sql("SELECT mod_id, archive_size FROM mods WHERE archive_size >= 1000000 AND archive_size < 10000000", "mods"))(lambda s, d: mods(s, d).filter((c("archive_size") >= B.MB) & (c("archive_size") < 10 * B.MB)))
query("p5_required_fields", sql("SELECT * FROM packages WHERE name IS NOT NULL AND download_url IS NOT NULL", "packages"))(lambda s, d: D.required_fields(packages(s, d)))
query("p6_sanitized_names", "SELECT p_partkey, trim(regexp_replace(concat('_', p_name, '#', p_type), '[^A-Za-z0-9_-]', '_', 'g'), '_') AS name FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", S.sanitize_name(F.concat(F.lit("_"), "p_name", F.lit("#"), "p_type")).alias("name")))
query("p7_extensions", "SELECT page_id, regexp_extract(url, '(?s)^.+\\.([^.]+)$', 1) AS ext FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", S.extension(c("url")).alias("ext")))
query("p8_separators", "SELECT page_id, replace(replace(url, '/', '\\'), '\\', '/') AS path FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", S.forward_slashes(F.replace("url", F.lit("/"), F.lit("\\"))).alias("path")))
query("p9_unknown", sql("SELECT ord, coalesce(CAST(id AS VARCHAR), 'unknown') AS id FROM packages", "packages"))(lambda s, d: packages(s, d).select("ord", F.coalesce(c("id").cast("string"), F.lit("unknown")).alias("id")))
query("p10_content_hash")(lambda s, d: contents(s, d).select("path", K.xxh3_hex(c("text").cast("binary")).alias("xxh3_hash")))
_unit = lambda t, u: f"concat(CAST(CAST(round(x / {t}) AS BIGINT) AS VARCHAR), '{u}')"
query("p11_byte_size", sql(f"SELECT mod_id, CASE WHEN x >= 1e12 THEN {_unit('1e12', 'TB')} WHEN x >= 1e9 THEN {_unit('1e9', 'GB')} WHEN x >= 1e6 THEN {_unit('1e6', 'MB')} WHEN x >= 1e3 THEN {_unit('1e3', 'kB')} ELSE {_unit('1', 'B')} END AS shown FROM (SELECT mod_id, archive_size::DOUBLE AS x FROM mods)", "mods"))(lambda s, d: mods(s, d).select("mod_id", S.byte_size(c("archive_size")).alias("shown")))
query("p12_binary_size", sql("SELECT mod_id, round(archive_size / pow(1024, k), 6) AS value, CASE k WHEN 0 THEN 'B' WHEN 1 THEN 'KiB' WHEN 2 THEN 'MiB' WHEN 3 THEN 'GiB' ELSE 'TiB' END AS unit FROM (SELECT *, CASE WHEN archive_size >= 1099511627776 THEN 4 WHEN archive_size >= 1073741824 THEN 3 WHEN archive_size >= 1048576 THEN 2 WHEN archive_size >= 1024 THEN 1 ELSE 0 END AS k FROM mods)", "mods"))(lambda s, d: rounded(mods(s, d).select("mod_id", S.binary_size(c("archive_size")).alias("x")).select("mod_id", "x.*")))
query("p14_percent_diff", sql("SELECT mod_id, original_size, round(CASE WHEN original_size = 0 THEN 0.0 ELSE (original_size - compressed_size) * 100.0::DOUBLE / original_size END, 6) AS pct FROM files", "files"))(lambda s, d: rounded(files(s, d).select("mod_id", "original_size", S.percent_diff(c("original_size"), c("compressed_size")).alias("pct"))))
query("p15_base_names", "SELECT page_id, regexp_extract(url, '^(.*/)?([^/.]*)', 0) AS base FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", S.base_name(c("url")).alias("base")))
query("p16_dictionary_size", sql("SELECT mod_id, original_size, coalesce(nullif(supplier % 3, 0), original_size // 100) AS auto, 112640::BIGINT AS fixed FROM files", "files"))(lambda s, d: files(s, d).select("mod_id", "original_size", S.dictionary_size(c("original_size"), F.nullif(c("supplier") % 3, F.lit(0))).alias("auto"), S.dictionary_size(c("original_size"), fixed=True).alias("fixed")))
query("p17_last_speed", "SELECT o_orderkey, CAST(o_orderkey % 977 AS DOUBLE) + 0.5 AS speed FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", S.last_speed(F.concat(F.lit("1.5 MB/s, then "), (c("o_orderkey") % 977).cast("string"), F.lit(".5 MB/s"))).alias("speed")))
query("p18_bitmask", "SELECT DISTINCT p_size, (1::BIGINT << p_size) - 1 AS mask FROM part")(lambda s, d: table(s, d, "part").select("p_size").distinct().select("p_size", S.bitmask(c("p_size")).alias("mask")))
query("p20_clamped_levels", "SELECT p_partkey, least(greatest(p_size - 20, -5), 22) AS zstd, least(greatest(p_size - 20, 1), 12) AS lz4 FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", S.clamp_level(F.lit("zstd"), c("p_size") - 20).alias("zstd"), S.clamp_level(F.lit("lz4"), c("p_size") - 20).alias("lz4")))
query("p22_chunks", sql("SELECT mod_id, original_size, original_size >= 1048576 AS chunked, (original_size + 1048575) // 1048576 AS chunks FROM files", "files"))(lambda s, d: files(s, d).select("mod_id", "original_size", S.is_chunked(c("original_size"), 1 << 20).alias("chunked"), S.chunk_count(c("original_size"), 1 << 20).alias("chunks")))
query("p23_header_sizes", "SELECT p_partkey, 512::BIGINT << (p_size % 21) AS chunk_size, (p_size * 4096)::BIGINT AS header_bytes FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.call_function("shiftleft", F.lit(512).cast("long"), (c("p_size") % 21).cast("int")).alias("chunk_size"), (c("p_size") * 4096).cast("long").alias("header_bytes")))
query("p24_bit_fields", "SELECT l_orderkey, l_linenumber, (l_orderkey % 1024) + ((l_partkey % 4096) << 10) + ((l_suppkey % 1024) << 22) AS word, l_partkey % 4096 AS blocks FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.packed((c("l_orderkey"), 10), (c("l_partkey"), 12), (c("l_suppkey"), 10)).alias("word")).select("*", S.unpacked(c("word"), 10, 12).alias("blocks")))
query("p25_entry_words", sql("SELECT mod_id, part, supplier, ((original_size % 268435456) << 34) + (supplier % 1024 << 24) + (part % 4096 << 12) + (mod_id % 4096) AS word FROM files", "files"))(lambda s, d: files(s, d).select("mod_id", "part", "supplier", S.packed((c("mod_id"), 12), (c("part"), 12), (c("supplier"), 10), (c("original_size"), 28)).alias("word")))
query("p26_preset_tuple", sql("SELECT mod_id, part, supplier, (mod_id % 4194304) + ((part % 262144) << 22) + ((supplier % 16777216) << 40) AS word FROM files", "files"))(lambda s, d: files(s, d).select("mod_id", "part", "supplier", S.packed((c("mod_id"), 22), (c("part"), 18), (c("supplier"), 24)).alias("word")))
query("p27_block_words", sql("SELECT mod_id, part, (least(compressed_size, 536870911) << 3) + (part % 5) AS word FROM files", "files"))(lambda s, d: files(s, d).select("mod_id", "part", S.packed((c("part") % 5, 3), (F.least("compressed_size", F.lit(536870911).cast("long")), 29)).alias("word")))


# -- layout
def doc_files(s, d):
    return contents(s, d).select(c("doc_id").alias("ord"), S.extension(c("path")).alias("ext"), "path", "size", (c("doc_id") % 10 != 0).alias("solid"))


DOC_FILES = "df AS (SELECT doc_id AS ord, regexp_extract(path, '(?s)^.+\\.([^.]+)$', 1) AS ext, path, size, doc_id % 10 <> 0 AS solid FROM contents)"
FOLD = "q AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY size, path) AS i FROM src), fold AS (SELECT ext, i, size, 0 AS block_no, size AS total FROM q WHERE i = 1 UNION ALL SELECT q.ext, q.i, q.size, CASE WHEN fold.total + q.size <= {0} THEN fold.block_no ELSE fold.block_no + 1 END, CASE WHEN fold.total + q.size <= {0} THEN fold.total + q.size ELSE q.size END FROM fold JOIN q ON q.ext = fold.ext AND q.i = fold.i + 1)"
query("b1_groups", sql(f"{DOC_FILES} SELECT ext, count(*) AS cnt, string_agg(CAST(size AS VARCHAR), ',' ORDER BY ord) AS sizes FROM df GROUP BY 1", "contents"))(lambda s, d: L.groups(doc_files(s, d)).select("ext", "cnt", F.array_join(F.transform("items", lambda x: x["size"].cast("string")), ",").alias("sizes")))
query("b2_solid_blocks", sql(f"{DOC_FILES}, src AS (SELECT * FROM df WHERE size <= 65536), {FOLD.format(65536)} SELECT ext, block_no, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS bytes FROM fold GROUP BY 1, 2", "contents", recursive=True))(lambda s, d: L.solid_blocks(doc_files(s, d).filter("size <= 65536"), 65536))
query("b2_make_blocks", sql(f"{DOC_FILES}, src AS (SELECT * FROM df WHERE size <= 8192 AND solid), {FOLD.format(8192)} SELECT 'solid' AS kind, ext, NULL AS path, CAST(block_no AS BIGINT) AS block_no, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS bytes FROM fold GROUP BY 2, 4 UNION ALL SELECT 'single', ext, path, 0, 1, size FROM df WHERE size <= 8192 AND NOT solid UNION ALL SELECT 'chunk', NULL, path, k, 1, least(4096, size - k * 4096) FROM (SELECT path, size, unnest(range((size + 4095) // 4096)) AS k FROM df WHERE size > 8192)", "contents", recursive=True))(lambda s, d: L.make_blocks(doc_files(s, d), 8192, 4096))
query("b3_chunks", sql("SELECT path, k AS chunk_index, k * 4096 AS start_offset, least(4096, size - k * 4096) AS chunk_size FROM (SELECT path, size, unnest(range((size + 4095) // 4096)) AS k FROM contents)", "contents"))(lambda s, d: L.chunks(contents(s, d), 4096))
query("b4_block_order", sql("SELECT source, path, CASE WHEN size > 8192 THEN 'chunk' ELSE 'solid' END AS kind, size AS bytes, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN size > 8192 THEN 0 ELSE 1 END, size DESC, path) AS rank FROM (SELECT path, size, split_part(path, '/', 1) AS source FROM contents)", "contents"))(lambda s, d: L.block_order(contents(s, d).select(F.substring_index("path", "/", 1).alias("source"), "path", F.when(c("size") > 8192, "chunk").otherwise("solid").alias("kind"), c("size").alias("bytes"), F.lit(0).alias("block_no")), ["source"]).drop("block_no"))
query("b5_emit_once", "SELECT l_partkey AS file, min(l_orderkey) AS block FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy(c("l_partkey").alias("file")).agg(F.min("l_orderkey").alias("block")))
query("b7_small_files", sql("SELECT path, size FROM contents WHERE size <= 1000", "contents"))(lambda s, d: contents(s, d).filter("size <= 1000").select("path", "size").orderBy("size", "path"))
query("b8_trimmed", sql("SELECT path, md5(left(text, 100)) AS head FROM contents", "contents"))(lambda s, d: contents(s, d).select("path", F.md5(F.substring("text", 1, 100)).alias("head")))
query("b9_joined_blocks", sql("SELECT doc_id // 50 AS block, md5(string_agg(text, '' ORDER BY doc_id)) AS content FROM contents GROUP BY 1", "contents"))(lambda s, d: contents(s, d).groupBy(F.expr("doc_id div 50").alias("block")).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "")).alias("content")))
query("b6_python_blocks", sql("q AS (SELECT split_part(path, '/', 1) AS ext, size, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY size, path) AS i FROM contents), fold AS (SELECT ext, i, size, 0 AS block_no, size AS total FROM q WHERE i = 1 UNION ALL SELECT q.ext, q.i, q.size, CASE WHEN fold.total + q.size <= 20000 THEN fold.block_no ELSE fold.block_no + 1 END, CASE WHEN fold.total + q.size <= 20000 THEN fold.total + q.size ELSE q.size END FROM fold JOIN q ON q.ext = fold.ext AND q.i = fold.i + 1) SELECT ext AS source, block_no, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS bytes FROM fold GROUP BY 1, 2", "contents", recursive=True))(lambda s, d: L.solid_blocks(contents(s, d).withColumn("source", F.substring_index("path", "/", 1)), 20000, by="source"))

# -- lookups
entries = lambda s, d: table(s, d, "lineitem").select(c("l_orderkey").alias("entry"), "l_linenumber", (c("l_partkey") * 2 % 3000).alias("path_index"), (c("l_suppkey") % 40).alias("first_block"), (c("l_quantity") * 1000).cast("long").alias("size"), c("l_suppkey").alias("offset"))
ENTRIES = "entries AS (SELECT l_orderkey AS entry, l_linenumber, l_partkey * 2 % 3000 AS path_index, l_suppkey % 40 AS first_block, CAST(l_quantity * 1000 AS BIGINT) AS size, l_suppkey AS \"offset\" FROM lineitem)"
paths = lambda s, d: table(s, d, "part").select(c("p_partkey").alias("path_index"), c("p_name").alias("path"))
query("j1_entry_paths", f"WITH {ENTRIES} SELECT entry, l_linenumber, path_index, p_name AS path FROM entries LEFT JOIN part ON p_partkey = path_index")(lambda s, d: C.entry_paths(entries(s, d).select("entry", "l_linenumber", "path_index"), paths(s, d)))
query("j2_entry_blocks", f"WITH {ENTRIES} SELECT entry, l_linenumber, s_suppkey AS block_index, s_nationkey AS code FROM (SELECT *, first_block + unnest(range(greatest(1, (size + 16383) // 16384))) AS b FROM entries) JOIN supplier ON s_suppkey = b")(lambda s, d: C.entry_blocks(entries(s, d), table(s, d, "supplier").select(c("s_suppkey").alias("block_index"), c("s_nationkey").alias("code")), 16384).filter("code is not null").select("entry", "l_linenumber", "block_index", "code"))
query("j3_block_dictionaries", "SELECT s_suppkey AS block, n_name AS dictionary FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND s_nationkey < 20")(lambda s, d: C.block_dictionaries(table(s, d, "supplier").select(c("s_suppkey").alias("block"), F.when(c("s_nationkey") >= 20, 255).otherwise(c("s_nationkey")).alias("dict_index")), table(s, d, "nation").select(c("n_nationkey").alias("dict_index"), c("n_name").alias("dictionary"))).select("block", "dictionary"))
query("j4_path_index", "SELECT p_name AS path, max(p_partkey) AS path_index FROM part GROUP BY 1")(lambda s, d: table(s, d, "part").groupBy(c("p_name").alias("path")).agg(F.max("p_partkey").alias("path_index")))
folders = lambda s, d: table(s, d, "lineitem").groupBy(c("l_returnflag").alias("folder"), c("l_partkey").alias("rel")).agg(F.sum((c("l_quantity") % 7).cast("long")).alias("size"))
FOLDERS = "folders AS (SELECT l_returnflag AS folder, l_partkey AS rel, CAST(sum(CAST(l_quantity % 7 AS BIGINT)) AS BIGINT) AS size FROM lineitem GROUP BY 1, 2)"
query("j5_aligned_folders", f"WITH {FOLDERS} SELECT rel, max(size) FILTER (folder = 'A') AS a, max(size) FILTER (folder = 'N') AS n, max(size) FILTER (folder = 'R') AS r FROM folders GROUP BY 1")(lambda s, d: D.align_folders(folders(s, d), ["A", "N", "R"]).select("rel", c("A").alias("a"), c("N").alias("n"), c("R").alias("r")))
query("j6_block_pairs", "SELECT a.l_orderkey AS block, a.l_quantity AS plain, b.l_quantity AS other FROM (SELECT * FROM lineitem WHERE l_linenumber = 1) a JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey)")(lambda s, d: table(s, d, "lineitem").filter("l_linenumber = 1").select(c("l_orderkey").alias("block"), c("l_quantity").alias("plain")).join(table(s, d, "lineitem").filter("l_linenumber = 2").select(c("l_orderkey").alias("block"), c("l_quantity").alias("other")), "block"))
query("j7_contains", "SELECT p_partkey FROM part WHERE p_name LIKE '%1%' AND p_partkey IN (SELECT l_partkey FROM lineitem)")(lambda s, d: table(s, d, "part").filter(c("p_name").contains("1")).join(table(s, d, "lineitem").select(c("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey"))

# -- dedupe
query("e1_first_packages", sql("SELECT ord, id, name, download_url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM packages) WHERE rn = 1 OR id IS NULL", "packages"))(lambda s, d: D.first_packages(packages(s, d)))
query("e2_all_paths", f"WITH {FOLDERS} SELECT DISTINCT rel FROM folders WHERE folder IN ('A', 'R')")(lambda s, d: folders(s, d).filter("folder = 'A'").select("rel").union(folders(s, d).filter("folder = 'R'").select("rel")).distinct())
query("e3_content_first", sql("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_ord, count(*) OVER (PARTITION BY md5(text)) AS copies FROM contents", "contents"))(lambda s, d: D.content_first(contents(s, d).select("doc_id", F.md5("text").alias("hash")), "hash", "doc_id").select("doc_id", "first_ord", "copies"))
query("e4_two_stage_dedupe", sql("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_ord FROM contents", "contents"))(lambda s, d: D.two_stage_dedupe(contents(s, d), "text", "doc_id"))
query("e5_sorted_pool", "SELECT p_name AS path FROM part")(lambda s, d: table(s, d, "part").select(c("p_name").alias("path")).orderBy("path"))

# -- aggregates
per_mod = lambda s, d: A.files_per(mods(s, d), files(s, d))
query("g1_file_count_buckets", hist_sql("(SELECT mod_id, count(original_size) AS n FROM mods LEFT JOIN files USING (mod_id) GROUP BY 1)", "n", B.FILE_COUNT, "mods", "files"))(lambda s, d: rounded(B.histogram(per_mod(s, d), "n_files", B.FILE_COUNT)))
query("g1_file_count_buckets_by_part", hist_sql("(SELECT part, count(*) AS n FROM files GROUP BY 1)", "n", B.FILE_COUNT, "files"))(lambda s, d: rounded(B.histogram(files(s, d).groupBy("part").agg(F.count("*").alias("n")), "n", B.FILE_COUNT)))
query("g2_file_size_buckets", hist_sql("files", "original_size", B.FILE_SIZE, "files"))(lambda s, d: rounded(B.histogram(files(s, d), "original_size", B.FILE_SIZE)))
query("g2_compressed_size_buckets", hist_sql("files", "compressed_size", B.FILE_SIZE, "files"))(lambda s, d: rounded(B.histogram(files(s, d), "compressed_size", B.FILE_SIZE)))
query("g3_archive_size_buckets", hist_sql("mods", "archive_size", B.ARCHIVE_SIZE, "mods"))(lambda s, d: rounded(B.histogram(mods(s, d), "archive_size", B.ARCHIVE_SIZE)))
_i = {"up_to_200": "n <= 200", "from_101_to_150": "n BETWEEN 101 AND 150", "from_151_to_200": "n BETWEEN 151 AND 200", "from_201_to_300": "n BETWEEN 201 AND 300"}
_insight = "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _i.items()) + ", " + ", ".join(f"round(count(*) FILTER ({v}) * 100.0::DOUBLE / count(*), 6) AS pct_{k}" for k, v in _i.items()) + ", 195::BIGINT AS fit_4k FROM "
query("g5_metadata_insight", sql(_insight + "(SELECT mod_id, count(original_size) AS n FROM mods LEFT JOIN files USING (mod_id) GROUP BY 1)", "mods", "files"))(lambda s, d: rounded(A.metadata_insight(per_mod(s, d))))
query("g7_storage_share", sql("SELECT class, cnt, bytes, round(cnt * 100.0::DOUBLE / sum(cnt) OVER (), 6) AS pct_cnt, round(bytes * 100.0::DOUBLE / sum(bytes) OVER (), 6) AS pct_bytes FROM (SELECT CASE WHEN archive_size < 1000000 THEN '<1MB' WHEN archive_size < 10000000 THEN '1-10MB' WHEN archive_size < 100000000 THEN '10-100MB' WHEN archive_size < 1000000000 THEN '100MB-1GB' ELSE '1GB+' END AS class, count(*) AS cnt, CAST(sum(archive_size) AS BIGINT) AS bytes FROM mods GROUP BY 1)", "mods"))(lambda s, d: rounded(A.storage_share(mods(s, d))))
query("g6_size_classes", hist_sql("mods", "archive_size", B.ARCHIVE_SIZE, "mods").replace("CAST(pos AS INTEGER) AS pos, ", ""))(lambda s, d: rounded(B.histogram(mods(s, d), "archive_size", B.ARCHIVE_SIZE)).drop("pos"))
query("g8_archive_summary", sql("SELECT cnt, total AS total_bytes, round(CASE WHEN total / 1e9 >= 1000 THEN total / 1e12 ELSE total / 1e9 END, 6) AS shown, CASE WHEN total / 1e9 >= 1000 THEN 'TB' ELSE 'GB' END AS unit FROM (SELECT count(*) AS cnt, CAST(sum(archive_size) AS BIGINT) AS total FROM mods)", "mods"))(lambda s, d: rounded(A.archive_summary(mods(s, d))))
_ratio = "CASE WHEN original_size = 0 THEN 0.0 ELSE compressed_size / original_size::DOUBLE END"
COMPRESSION = sql(f"g AS (SELECT {case('original_size', B.FILE_SIZE)} AS bucket, count(*) AS cnt, avg({_ratio}) AS m, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed, count(*) FILTER ({_ratio} < 0.1) AS excellent, count(*) FILTER ({_ratio} > 0.8) AS poor FROM files GROUP BY 1) SELECT bucket, cnt, round(m, 6) AS mean_ratio, original, compressed, excellent, poor, round(compressed / original::DOUBLE, 6) AS ratio_of_sums, round((1 - compressed / original::DOUBLE) * 100, 6) AS savings_pct, round(excellent * 100.0::DOUBLE / cnt, 6) AS pct_excellent, round(poor * 100.0::DOUBLE / cnt, 6) AS pct_poor FROM g", "files")
query("g9_compression_by_size", COMPRESSION)(lambda s, d: rounded(A.compression_by_size(files(s, d))))
query("g11_compression_summary", sql("SELECT count(*) AS cnt, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed, CASE WHEN sum(original_size) >= sum(compressed_size) THEN 'saved' ELSE 'increase' END AS kind, CAST(abs(sum(original_size) - sum(compressed_size)) AS BIGINT) AS bytes, round(abs(sum(original_size) - sum(compressed_size)) * 100.0::DOUBLE / sum(original_size), 6) AS pct FROM files", "files"))(lambda s, d: rounded(A.compression_summary(files(s, d))))
query("g13_etl_counters", sql("m AS (SELECT mod_id, archive_size, mod_id % 17 <> 0 AS ok, count(original_size) AS n FROM mods LEFT JOIN files USING (mod_id) GROUP BY 1, 2) SELECT count(*) FILTER (ok) AS total_mods_processed, CAST(sum(n) FILTER (ok) AS BIGINT) AS total_files_analyzed, count(*) FILTER (NOT ok) AS processing_errors, CAST(sum(archive_size) FILTER (ok) AS BIGINT) AS total_download_size FROM m", "mods", "files"))(lambda s, d: A.etl_summary(mods(s, d).join(per_mod(s, d), "mod_id").withColumn("ok", c("mod_id") % 17 != 0)))
query("g14_by_extension", sql(f"{DOC_FILES} SELECT ext, count(*) AS cnt, CAST(sum(size) AS BIGINT) AS bytes, CAST(grouping(ext) AS INTEGER) AS is_total FROM df GROUP BY ROLLUP (ext)", "contents"))(lambda s, d: A.by_extension(doc_files(s, d)))
BLOCKS = "blocks AS (SELECT mod_id, part, original_size AS original, compressed_size AS no_dict, CAST(floor(compressed_size * (1 - discount)) AS BIGINT) AS with_dict FROM files)"
blocks = lambda s, d: files(s, d).select("mod_id", "part", c("original_size").alias("original"), c("compressed_size").alias("no_dict"), F.floor(c("compressed_size") * (1 - c("discount"))).cast("long").alias("with_dict"))
STATS = BLOCKS + ", stats AS (SELECT *, (1 - no_dict / original::DOUBLE) * 100 AS savings_no_dict, (1 - with_dict / original::DOUBLE) * 100 AS savings_with_dict, no_dict - with_dict AS bytes_saved FROM blocks), st AS (SELECT *, savings_with_dict - savings_no_dict AS advantage FROM stats)"
query("g15_by_group", sql(f"{BLOCKS} SELECT part % 25 AS ext, CAST(sum(no_dict - with_dict) AS BIGINT) AS improvement, CAST(sum(original) AS BIGINT) AS original, CAST(sum(no_dict) AS BIGINT) AS compressed, round(avg(no_dict / original::DOUBLE), 6) AS mean_ratio, round(avg(with_dict / original::DOUBLE), 6) AS mean_ratio_dict FROM blocks GROUP BY ROLLUP (part % 25)", "files"))(lambda s, d: rounded(blocks(s, d).withColumn("ext", c("part") % 25).rollup("ext").agg(F.sum(c("no_dict") - c("with_dict")).alias("improvement"), F.sum("original").alias("original"), F.sum("no_dict").alias("compressed"), F.avg(c("no_dict") / c("original")).alias("mean_ratio"), F.avg(c("with_dict") / c("original")).alias("mean_ratio_dict"))))
query("g17_block_stats", sql(f"{STATS} SELECT mod_id, part, original, no_dict, with_dict, round(savings_no_dict, 6) AS savings_no_dict, round(savings_with_dict, 6) AS savings_with_dict, bytes_saved, round(advantage, 6) AS advantage FROM st", "files"))(lambda s, d: rounded(K.block_stats(blocks(s, d))))
_mma = ", ".join(f"round({f}({x}), 6) AS {f}_{x}" for x in ("savings_no_dict", "savings_with_dict", "advantage") for f in ("min", "max", "avg"))
query("g18_block_summary", sql(f"{STATS} SELECT count(*) AS cnt, {_mma}, count(*) FILTER (bytes_saved >= 4096) AS over_4k, round(count(*) FILTER (bytes_saved >= 4096) * 100.0::DOUBLE / count(*), 6) AS pct_over_4k, round(avg(floor(bytes_saved / 4096.0::DOUBLE)), 6) AS avg_pages FROM st", "files"))(lambda s, d: rounded(K.block_summary(K.block_stats(blocks(s, d)))))
query("g19_extreme_blocks", sql(f"{BLOCKS}, x AS (SELECT part, mod_id, (no_dict - with_dict) / original::DOUBLE AS x FROM blocks WHERE original > 0) SELECT part, round(max(x) * 100, 6) AS most, round(min(x) * 100, 6) AS least, arg_max(mod_id, (x, -mod_id)) AS best, arg_min(mod_id, (x, mod_id)) AS worst FROM x GROUP BY 1", "files"))(lambda s, d: rounded(blocks(s, d).filter("original > 0").withColumn("x", (c("no_dict") - c("with_dict")) / c("original")).groupBy("part").agg((F.max("x") * 100).alias("most"), (F.min("x") * 100).alias("least"), F.max_by("mod_id", F.struct("x", -c("mod_id"))).alias("best"), F.min_by("mod_id", F.struct("x", "mod_id")).alias("worst"))))
query("g22_weighted_speed", "SELECT l_returnflag AS flag, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 4) AS speed FROM lineitem GROUP BY 1")(lambda s, d: rounded(K.weighted_speed(table(s, d, "lineitem").select(c("l_returnflag").alias("flag"), c("l_quantity").alias("speed"), c("l_extendedprice").alias("size")), "flag"), 4))
query("g24_best_codec", f"WITH {FOLDERS} SELECT rel, arg_min(folder, concat(lpad(CAST(size AS VARCHAR), 12, '0'), folder)) AS best_folder, min(size) AS best, max(size) AS worst, round((max(size) - min(size)) * 100.0::DOUBLE / max(size), 6) AS savings_pct FROM folders WHERE size > 0 GROUP BY 1")(lambda s, d: rounded(D.best_codec(folders(s, d))))
query("g25_folder_totals", f"WITH {FOLDERS} SELECT folder, total, max(total) OVER () - total AS saved FROM (SELECT folder, CAST(sum(size) AS BIGINT) AS total FROM folders GROUP BY 1)")(lambda s, d: D.folder_totals(folders(s, d)))
query("g26_codec_totals", sql("t AS (SELECT supplier % 4 AS codec, original_size AS o, CASE WHEN part % 10 <> 0 THEN compressed_size END AS z, 1.0 + part % 3 AS sec FROM files) SELECT codec, CAST(sum(o) AS BIGINT) AS original, CAST(sum(z) AS BIGINT) AS compressed, CAST(sum(sec) FILTER (z IS NOT NULL) AS DOUBLE) AS seconds, count(*) FILTER (z IS NULL) AS failed, round(sum(z) * 100.0::DOUBLE / sum(o), 6) AS ratio_pct, round(sum(o) / 1e6 / CAST(sum(sec) FILTER (z IS NOT NULL) AS DOUBLE), 6) AS mb_per_s FROM t GROUP BY 1", "files"))(lambda s, d: rounded(D.codec_totals(files(s, d).select((c("supplier") % 4).alias("codec"), c("original_size").alias("original"), F.when(c("part") % 10 != 0, c("compressed_size")).alias("compressed"), (F.lit(1.0) + c("part") % 3).alias("seconds")))))
query("g27_toc_stats", f"WITH {ENTRIES} SELECT max(size) AS largest, bool_or(size > 16384) AS any_chunked, max(\"offset\") AS max_offset FROM entries")(lambda s, d: C.toc_stats(entries(s, d), 16384))
query("g28_needed_bytes", f"WITH {ENTRIES} SELECT first_block, max(\"offset\" + size) AS needed FROM entries GROUP BY 1")(lambda s, d: entries(s, d).groupBy("first_block").agg(F.max(c("offset") + c("size")).alias("needed")))
query("g29_pool_bytes", "SELECT count(*) AS paths, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes FROM part")(lambda s, d: C.pool_bytes(paths(s, d)))

# -- ordered
CDF = "SELECT value, round(row_number() OVER (ORDER BY value) * 100.0::DOUBLE / count(*) OVER (), 6) AS cum_pct FROM (SELECT CAST({0} AS DOUBLE) AS value FROM {1})"
query("w1_cdf_original", sql(CDF.format("original_size", "files"), "files"))(lambda s, d: rounded(A.cdf(files(s, d), "original_size")))
query("w2_cdf_compressed", sql(CDF.format("compressed_size", "files"), "files"))(lambda s, d: rounded(A.cdf(files(s, d), "compressed_size")))
query("w2_cdf_archive", sql(CDF.format("archive_size", "mods"), "mods"))(lambda s, d: rounded(A.cdf(mods(s, d), "archive_size")))
query("w2_cdf_file_count", sql(CDF.format("n", "(SELECT mod_id, count(original_size) AS n FROM mods LEFT JOIN files USING (mod_id) GROUP BY 1)"), "mods", "files"))(lambda s, d: rounded(A.cdf(per_mod(s, d), "n_files")))
query("w3_cdf_check", sql("SELECT count(*) AS points, 0::BIGINT AS outside FROM files", "files"))(lambda s, d: A.check_cdf(A.cdf(files(s, d), "original_size")))
query("w4_axis", sql("SELECT greatest(min(archive_size), 1)::DOUBLE AS low, greatest(max(archive_size), 1)::DOUBLE AS high FROM mods", "mods"))(lambda s, d: A.axis(mods(s, d).select(c("archive_size").cast("double").alias("value"))))
RUNS = "ev AS (SELECT user_id, event_id, event_type AS code FROM events), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY user_id ORDER BY event_id) = code THEN 0 ELSE 1 END AS n FROM ev)), k AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1) // 2 AS cut FROM r)"
runs = lambda s, d: D.run_lengths(table(s, d, "events").select("user_id", "event_id", c("event_type").alias("code")), "event_id", "code", 2, ["user_id"])
query("w5_run_lengths", f"WITH {RUNS} SELECT user_id, code, min(event_id) AS run_start, count(*) AS len FROM k GROUP BY user_id, run, cut, code")(lambda s, d: runs(s, d))
query("w6_expanded_runs", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS block_index, event_type AS code FROM events")(lambda s, d: D.expand_runs(runs(s, d), "run_start", "code", "len", ["user_id"]))
query("w7_offsets", sql("SELECT path, source, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT *, split_part(path, '/', 1) AS source FROM contents)", "contents"))(lambda s, d: D.offsets(contents(s, d).withColumn("source", F.substring_index("path", "/", 1)), "path", "size", ["source"]).select("path", "source", "offset"))
query("w8_string_offsets", "SELECT p_partkey, p_brand, CAST(coalesce(sum(strlen(p_name) + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM part")(lambda s, d: D.offsets(table(s, d, "part").withColumn("len", (F.octet_length("p_name") + 1).cast("long")), "p_partkey", "len", ["p_brand"]).select("p_partkey", "p_brand", "offset"))
query("o1_sorted_paths", sql("SELECT path FROM contents", "contents"))(lambda s, d: contents(s, d).select("path").orderBy("path"))
query("o5_first_paths", sql("SELECT path FROM contents ORDER BY path LIMIT 256", "contents"))(lambda s, d: contents(s, d).select("path").orderBy("path").limit(256))

# -- encodings
_fmt = "pool, off, blk, fil, big, hashes"
args = lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") * 900).alias("pool"), F.when(c("l_suppkey") % 3 == 0, 0).otherwise(c("l_suppkey") * 70000).cast("long").alias("off"), (c("l_orderkey") * 13 % 5000000).alias("blk"), (c("l_partkey") * 7 % 300000).alias("fil"), (c("l_quantity") * 100000000).cast("long").alias("big"), (c("l_linenumber") % 2 == 0).alias("hashes"))
ARGS = "args AS (SELECT l_orderkey, l_linenumber, l_partkey * 900 AS pool, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey * 70000 END AS off, l_orderkey * 13 % 5000000 AS blk, l_partkey * 7 % 300000 AS fil, CAST(l_quantity * 100000000 AS BIGINT) AS big, l_linenumber % 2 = 0 AS hashes FROM lineitem)"
_b = lambda x: f"(CASE WHEN {x} = 0 THEN 0 ELSE CAST(floor(log2({x})) AS BIGINT) + 1 END)"
FORMAT = ARGS + f", w AS (SELECT *, {_b('off')} + {_b('blk')} + {_b('fil')} + {_b('big')} <= 64 AS flex, pool <= 1048575 AND blk <= 65535 AND fil <= 65535 AND off <= 0 AND big <= 4294967295 AS p3, pool <= 2097151 AND blk <= 4194303 AND fil <= 262143 AS p2 FROM args), fm AS (SELECT *, CASE WHEN p3 AND NOT hashes THEN 'Preset3NoHash' WHEN flex AND NOT hashes THEN 'FEF64NoHash' WHEN p2 AND big <= 4294967295 AND NOT hashes THEN 'Preset1NoHash' WHEN p3 THEN 'Preset3' WHEN flex THEN 'FEF64' WHEN p2 AND off <= 16777215 AND big <= 4294967295 THEN 'Preset0' WHEN p2 THEN 'Preset2' ELSE 'Error' END AS format FROM w)"
fmt = lambda s, d: args(s, d).withColumn("format", C.toc_format(c("pool"), c("off"), c("blk"), c("fil"), c("big"), c("hashes")))
query("f1_toc_format", f"WITH {FORMAT} SELECT l_orderkey, l_linenumber, pool, format FROM fm")(lambda s, d: fmt(s, d).select("l_orderkey", "l_linenumber", "pool", "format"))
query("f4_toc_size", f"WITH {FORMAT} SELECT l_orderkey, l_linenumber, pool, CAST((CASE WHEN format LIKE 'FEF64%' AND {_b('pool')} + {_b('blk')} + {_b('fil')} > 42 THEN 16 ELSE 8 END) + CASE format WHEN 'Preset3NoHash' THEN 8 WHEN 'FEF64NoHash' THEN 8 WHEN 'Preset1NoHash' THEN 12 WHEN 'Preset3' THEN 16 WHEN 'FEF64' THEN 16 WHEN 'Preset0' THEN 20 WHEN 'Preset2' THEN 24 ELSE 0 END * fil + 4 * blk + pool AS BIGINT) AS bytes FROM fm")(lambda s, d: fmt(s, d).select("l_orderkey", "l_linenumber", "pool", C.toc_size(c("format"), c("fil"), c("blk"), c("pool")).cast("long").alias("bytes")))
query("f5_v1_toc_size", sql("SELECT mod_id, CASE WHEN max(original_size) > 4294967295 THEN 1 ELSE 0 END AS version, CAST(CASE WHEN max(original_size) > 4294967295 THEN 24 ELSE 20 END * count(*) + 8 AS BIGINT) AS bytes FROM files GROUP BY 1", "files"))(lambda s, d: files(s, d).groupBy("mod_id").agg(F.max("original_size").alias("m"), F.count("*").alias("n")).select("mod_id", F.when(c("m") > 2**32 - 1, 1).otherwise(0).alias("version"), (F.when(c("m") > 2**32 - 1, 24).otherwise(20) * c("n") + 8).cast("long").alias("bytes")))
query("f10_dictionary_header", "SELECT p_partkey, CAST((((8 + 2 * p_partkey + 3) // 4 * 4 + 4 * p_size) + 7) // 8 * 8 + 8 * p_size AS BIGINT) AS bytes FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", C.dictionary_header(c("p_partkey"), c("p_size")).cast("long").alias("bytes")))


# -- codecs: sizes depend on the library, so only what must hold is compared
@query("c1_codec_round_trip", "SELECT doc_id, sha256(text) AS zstd, sha256(text) AS lz4, sha256(text) AS copied FROM documents")
def codec_round_trip(s, d):
    rows = contents(s, d).select("doc_id", c("text").cast("binary").alias("raw"))
    rows = rows.select("doc_id", "raw", *[K.compress(c("raw"), m, 3).alias(m) for m in ("zstd", "lz4", "copy")])
    n = F.octet_length("raw")
    return rows.select("doc_id", *[F.sha2(K.decompress(c(m), n, m), 256).alias(a) for m, a in (("zstd", "zstd"), ("lz4", "lz4"), ("copy", "copied"))])


query("c2_partial_decode", "SELECT doc_id, hex(encode(text)[1:64]) AS head FROM documents")(lambda s, d: contents(s, d).select("doc_id", c("text").cast("binary").alias("raw")).select("doc_id", "raw", K.compress(c("raw"), "zstd", 3).alias("z")).select("doc_id", F.hex(K.decompress(c("z"), F.least(F.lit(64), F.octet_length("raw")))).alias("head")))
query("c11_file_metadata")(lambda s, d: contents(s, d).select("path", "size", K.zstd16_size(c("text").cast("binary")).alias("compressed_size")))
query("c12_dictionary_test")(lambda s, d: K.dictionary_test(contents(s, d).select(S.extension(c("path")).alias("ext"), "path", c("text").cast("binary").alias("content"))))
query("g23_strategies", sql(f"{BLOCKS}, t AS (SELECT CAST(sum(original) AS BIGINT) AS o, CAST(sum(no_dict) AS BIGINT) AS a, CAST(sum(with_dict) AS BIGINT) AS b FROM blocks) SELECT strategy, bytes, round(o / bytes::DOUBLE, 6) AS ratio, round((1 - bytes / a::DOUBLE) * 100, 6) AS savings_pct FROM (SELECT o, a, unnest(['individual', 'individual_dict', 'solid', 'solid_dict']) AS strategy, unnest([a, b, a - 1000, b - 1000]) AS bytes FROM t)", "files"))(lambda s, d: rounded(K.strategy_summary(blocks(s, d).agg(F.sum("original").alias("original"), F.sum("no_dict").alias("individual"), F.sum("with_dict").alias("individual_dict")).withColumns({"solid": c("individual") - 1000, "solid_dict": c("individual_dict") - 1000}))))

"""Operator 7: exact deduplication by exchanging Golomb-coded fingerprints.

1. Each task fingerprints its texts (whitespace removed), and sends each owner of a fingerprint range the sorted
   distinct fingerprints as Golomb-Rice coded gaps, with a bitmap of those that it holds more than once. However
   often a text occurs in a task, its fingerprint is sent once.
2. An owner answers each sender with a bitmap of the fingerprints that occur elsewhere too.
3. Only rows marked as suspects bring their texts to a shuffle, where equal bytes meet (combined before the
   shuffle, so a hot text crosses once per task); a fingerprint collision ends here.

Null counts as empty text. Of equal texts the row with the most code points stays, then the smallest id; of
repeated rows with one id exactly one stays. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import documents, written

WHITE = b" \t\n\x0b\x0c\r"
#: Rows of one message at most: what a task holds before it sends.
MESSAGE_ROWS = 1 << 20


def golomb_encode(values: np.ndarray, universe: int) -> bytes:
    """Sorted distinct values below universe: count (4 bytes), Rice parameter (1 byte), coded gaps."""
    n = len(values)
    if not n:
        return b""
    k = max(0, (universe // n).bit_length() - 1)
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1 + k)
    bits = np.zeros(int(ends[-1]), np.uint8)
    stop = ends - k - 1  # the zero after each unary part
    mark = np.zeros(len(bits) + 1, np.int8)
    np.add.at(mark, stop - high, 1)
    np.add.at(mark, stop, -1)
    bits[:] = np.cumsum(mark[:-1])
    for i in range(k):
        bits[stop + 1 + i] = ((gaps >> np.uint64(k - 1 - i)) & np.uint64(1)).astype(np.uint8)
    return n.to_bytes(4, "little") + bytes([k]) + np.packbits(bits).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, k = int.from_bytes(data[:4], "little"), data[4]
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=5))
    zeros = np.flatnonzero(bits == 0)
    stop, at, z = np.empty(n, np.int64), 0, 0
    starts = np.empty(n, np.int64)
    for i in range(n):  # the next zero at or after `at` ends the unary part
        z = z + int(np.searchsorted(zeros[z : z + k + 2], at))
        starts[i], stop[i] = at, zeros[z]
        at = int(zeros[z]) + 1 + k
    low = np.zeros(n, np.uint64)
    for i in range(k):
        low = (low << np.uint64(1)) | bits[stop + 1 + i].astype(np.uint64)
    return np.cumsum(((stop - starts).astype(np.uint64) << np.uint64(k)) | low)


def range_start(owner: int, owners: int) -> int:
    return -(-(owner << 64) // owners)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    owners = owners or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cuts = np.array([range_start(o, owners) for o in range(1, owners)], np.uint64)

    def send(batches):
        part = TaskContext.get().partitionId()
        held, seq = [], 0

        def flush():
            nonlocal held, seq
            if not held:
                return
            fps = np.concatenate([h[0] for h in held])
            ids, shas, chars = (pa.concat_arrays([h[i] for h in held]) for i in (1, 2, 3))
            order = np.argsort(fps, kind="stable")
            fps = fps[order]
            bounds = np.searchsorted(fps, cuts)
            for o, (a, b) in enumerate(zip(np.append(0, bounds), np.append(bounds, len(fps)), strict=True)):
                if a == b:
                    continue
                own, counts = np.unique(fps[a:b], return_counts=True)
                base = range_start(o, owners)
                take = pa.array(order[a:b])
                one = lambda x: pa.array([x.to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 32) + seq]), pa.array([o], pa.int32()),
                        pa.array([golomb_encode(own - np.uint64(base), range_start(o + 1, owners) - base)], pa.binary()),
                        pa.array([np.packbits(counts > 1).tobytes()], pa.binary()),
                        pa.array([counts.astype(np.int32).tolist()], pa.list_(pa.int32())),
                        one(ids.take(take)).cast(pa.list_(pa.int64())), one(shas.take(take)), one(chars.take(take)).cast(pa.list_(pa.int64())),
                    ],
                    ["sender", "owner", "coded", "again", "counts", "ids", "shas", "chars"],
                )
            held, seq = [], seq + 1

        rows = 0
        for b in batches:
            texts = b.column("text").fill_null("") if b.column("text").null_count else b.column("text")
            fps, shas, chars = np.empty(len(texts), np.uint64), [], []
            for i, t in enumerate(texts.to_pylist()):
                norm = t.encode().translate(None, WHITE)
                fps[i] = xxhash.xxh3_64_intdigest(norm)
                shas.append(hashlib.sha256(norm).hexdigest())
                chars.append(len(t))
            held.append((fps, b.column("id").cast(pa.int64()), pa.array(shas, pa.string()), pa.array(chars, pa.int64())))
            rows += len(texts)
            if rows >= MESSAGE_ROWS:
                yield from flush()
                rows = 0
        yield from flush()

    sent = written(docs.mapInArrow(send, "sender long, owner int, coded binary, again binary, counts array<int>, ids array<long>, shas array<string>, chars array<long>"), "sent")

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [golomb_decode(bytes(c)) for c in pdf["coded"]]
        found, n = np.unique(np.concatenate(each), return_counts=True)
        common = found[n > 1]
        out = []
        for fps, again in zip(each, pdf["again"], strict=True):
            twice = np.unpackbits(np.frombuffer(bytes(again), np.uint8))[: len(fps)].astype(bool)
            at = np.searchsorted(common, fps)
            at[at == len(common)] = 0
            out.append(np.packbits(twice | (common[at] == fps if len(common) else False)).tobytes())
        return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "marks": out})

    marks = sent.select("sender", "owner", "coded", "again").groupBy("owner").applyInPandas(answer, "sender long, owner int, marks binary")

    def apply(batches):
        for b in batches:
            for r in b.to_pylist():
                bits = np.unpackbits(np.frombuffer(r["marks"], np.uint8))[: len(r["counts"])].astype(bool)
                n = len(r["ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], pa.int64()), pa.array([(r["sender"] << 20) + r["owner"]] * n, pa.int64()), pa.array(np.arange(n)), pa.array(r["shas"], pa.string()), pa.array(r["chars"], pa.int64()), pa.array(np.repeat(bits, r["counts"]))],
                    ["id", "message", "place", "sha", "chars", "suspect"],
                )

    rows = sent.drop("coded", "again").join(marks, ["sender", "owner"]).mapInArrow(apply, "id long, message long, place long, sha string, chars long, suspect boolean")
    rows = written(rows, "rows")
    suspects = docs.join(rows.filter("suspect").select("id").distinct(), "id", "left_semi")
    norm = F.translate(F.coalesce("text", F.lit("")), WHITE.decode(), "")
    groups = suspects.select("id", norm.alias("norm"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    groups = groups.groupBy("norm").agg(F.min(F.struct(-F.col("chars"), "id")).alias("best"), F.count("*").alias("size"))
    groups = groups.filter("size > 1").select(F.sha2("norm", 256).alias("sha"), F.col("best.id").alias("keep"), "size")
    doubtful = rows.filter("suspect")
    first = doubtful.groupBy("sha", "id").agg(F.min(F.struct("message", "place")).alias("first"))
    found = doubtful.join(groups, "sha", "left").join(first, ["sha", "id"]).select(
        F.col("id").alias(id_col), F.coalesce("keep", "id").alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        ((F.coalesce("keep", "id") == F.col("id")) & (F.struct("message", "place") == F.col("first"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    alone = rows.filter("not suspect").select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return found.union(alone)


def op7(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""

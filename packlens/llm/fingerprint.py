"""Operator 9: document fingerprints by Order MinHash, and how an edit moves them.

Every k-mer of code points gets its occurrence number, so repeats differ. The hashes of (k-mer, number) fall into
BINS ranges; each range keeps its TAKE smallest, put back in text order and hashed as a tuple: moving or changing
text changes tuples, so agreement of bins follows edit distance rather than set overlap. A text shorter than k is
one k-mer. Likeness is the share of equal bins among those that are not empty in both; two empty texts are alike.

Each text is met with the text of the next id: the rows are range-partitioned and sorted by id, so all neighbours
but those across partition borders meet in one pass; two rows a partition are then joined. Repeated ids are ordered
by a hash of the text. Null texts are empty. A single row is its own next. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm import textvec as tv
from packlens.llm.common import documents, written

K, BINS, TAKE = 7, 64, 2


def bins(text: str, k: int = K, n_bins: int = BINS, take: int = TAKE) -> np.ndarray:
    """One 16-bit value for each bin, 0 where it is empty."""
    out = np.zeros(n_bins, np.uint16)
    if not text:
        return out
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(1, len(x) - k + 1)
    at = np.arange(n)
    grams = tv.rolled(tv.mix(x, 31), at, np.minimum(at + k, len(x)))
    low = np.uint64(n.bit_length())
    sort = np.sort(tv.mix(grams, 32) >> low << low | at.astype(np.uint64))  # equal k-mers together, in text order
    pos = (sort & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    name = sort >> low
    first = np.flatnonzero(np.diff(name, prepend=name[0] + np.uint64(1)))
    number = np.arange(n) - np.repeat(first, np.diff(first, append=n))
    h = tv.mix(grams[pos] + number.astype(np.uint64) * np.uint64(tv.BASE), 33)
    shift = np.uint64(64 - (n_bins - 1).bit_length())
    if n > 64 * n_bins * take:  # only small hashes within a bin can win
        rest = h << (np.uint64(64) - shift)
        near = rest < np.uint64(min(2**64 - 1, 2**64 * 16 * n_bins * take // n))
        if (np.bincount((h[near] >> shift).astype(np.int64), minlength=n_bins) >= take).all():
            h, pos = h[near], pos[near]
    order = np.argsort(h, kind="stable")
    h, pos = h[order], pos[order]
    bin_ = (h >> shift).astype(np.int64)
    start = np.searchsorted(bin_, np.arange(n_bins))
    size = np.minimum(np.searchsorted(bin_, np.arange(n_bins), "right") - start, take)
    for b in np.flatnonzero(size < take):  # few k-mers: whatever the bin has
        if size[b]:
            some = np.arange(start[b], start[b] + size[b])
            some = some[np.argsort(pos[some])]
            out[b] = int(tv.rolled(h[some], np.array([0]), np.array([len(some)]))[0] >> np.uint64(49)) + 1
    full = np.flatnonzero(size == take)
    if len(full):
        pick = start[full][:, None] + np.arange(take)
        turn = np.argsort(pos[pick], 1)
        picked = np.take_along_axis(h[pick], turn, 1).ravel()
        at = np.arange(len(full)) * take
        out[full] = (tv.rolled(picked, at, at + take) >> np.uint64(49)).astype(np.uint16) + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    some = (a > 0) | (b > 0)
    return float((a[some] == b[some]).mean()) if some.any() else 1.0


def compare(text: str, nxt: str, own: np.ndarray | None = None, other: np.ndarray | None = None) -> tuple:
    q = len(text) // 4
    edited = text[: len(text) - q] + nxt[:q]
    own = bins(text) if own is None else own
    other = bins(nxt) if other is None else other
    moved = bins(edited)
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(), moved.tobytes().hex(), likeness(own, moved), likeness(own, other)


FIELDS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange(parts, F.col("id"), tie).sortWithinPartitions(F.col("id"), tie)

    def walk(batches):
        part = TaskContext.get().partitionId()
        first = last = None
        for b in batches:
            cols: list[list] = [[] for _ in range(10)]

            def put(kind, i, text, result, cols=cols):
                for c, v in zip(cols, (kind, part, i, text, *(result or [None] * 6)), strict=True):
                    c.append(v)

            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = (i, text, bins(text))
                if last is None:
                    first = now
                    put(1, i, text, None)
                else:
                    put(0, last[0], None, compare(last[1], text, last[2], now[2]))
                last = now
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.int64(), pa.string(), *KINDS], strict=True)], ["kind", "part", "id", "text", *FIELDS])
        if first is not None:
            row = [2, part, last[0], last[1], *[None] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.string(), *KINDS], strict=True)], ["kind", "part", "id", "text", *FIELDS])

    rows = written(ordered.mapInArrow(walk, f"kind int, part int, id long, text string, {DDL}"), "neighbours")
    # borders: one row for each partition on either side
    firsts = rows.filter("kind = 1").select("part", F.col("text").alias("next_text"))
    one = Window.partitionBy(F.lit(0)).orderBy("part")
    turn = rows.filter("kind = 1").select("part").withColumns({"to": F.lead("part").over(one), "low": F.min("part").over(Window.partitionBy(F.lit(0)))})
    turn = turn.select("part", F.coalesce("to", "low").alias("to"))
    borders = rows.filter("kind = 2").select("part", "id", "text").join(turn, "part").join(firsts.withColumnRenamed("part", "to"), "to").select("id", "text", "next_text")

    def meet(batches):
        for b in batches:
            out = [compare(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("next_text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate(KINDS))], ["id", *FIELDS])

    inner = rows.filter("kind = 0").select("id", *FIELDS)
    return inner.union(borders.mapInArrow(meet, f"id long, {DDL}")).withColumnRenamed("id", id_col)


def op9(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))

"""Operator 10: repeated spans through a compacted De Bruijn graph of token k-mers.

A window of `window` words is an edge of the graph. Consecutive edges of a text that share their minimal inner
k-mer (the anchor; equal windows choose it alike) form a path without branches; a path is named by its anchor and
the hash of all its words.

1. Paths of all texts are counted by name, and names by anchor: one row per path, not per window, is shuffled, and
   counts are combined before the shuffle. Anchors that occur once have no repeated edge and leave.
2. A path that occurs twice under one name is repeated as a whole. Where an anchor has several names, the graph
   branches: single paths, and one occurrence of each repeated one, are opened into their edges, which are counted.
3. The repeated paths and edges go back to their source coordinates (row, first word), where the words they cover
   are removed.

Names and edges are pairs of independent 64-bit hashes. Null texts have no words. Rows with equal id and text share
one answer but count as two occurrences. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import textvec as tv
from packlens.llm.common import documents, written

INNER = 8  # words of an anchor


def paths(w: np.ndarray, window: int, inner: int) -> tuple[np.ndarray, ...]:
    """Anchors, contents, first windows and numbers of windows of the paths of one text (word hashes w)."""
    n = len(w) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = tv.grams(w, inner)
    order = tv.mix(grams, 5)
    wide = window - inner + 1
    at = np.empty(n, np.int64)
    for i in range(0, n, 1 << 15):
        view = np.lib.stride_tricks.sliding_window_view(order[i : i + (1 << 15) + wide - 1], wide)[: n - i]
        at[i : i + len(view)] = view.argmin(1) + np.arange(i, i + len(view))
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(first, append=n)
    return grams[at[first]], tv.rolled(tv.mix(w, 21), first, first + count + window - 1), first, count


def word_hashes(col: pa.Array):
    """For each row its word hashes, with the bytes and bounds of its words."""
    offs, data = tv.utf8(col)
    for i, j in tv.pieces(offs):
        part = data[offs[i] : offs[j]]
        starts, ends, first = tv.words(offs[i : j + 1] - offs[i], part)
        w = tv.rolled(tv.BYTES[part], starts, ends)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            yield w[a:b], part, starts[a:b], ends[a:b]


def repeated_spans(docs: DataFrame, window: int = 35, inner: int = INNER) -> DataFrame:
    """docs: id, text, th (a hash of the text). Rows (id, th, spans): spans array<struct<first, n>> of windows
    (first word, number of consecutive windows) that occur more than once."""

    def cut(batches):
        part, seq = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            each = [paths(w, window, inner) for w, *_ in word_hashes(b.column("text"))]
            lens = [len(e[0]) for e in each]
            n = sum(lens)
            own = pa.array(np.repeat(np.arange(len(each)), lens))
            cols = [pa.array(np.concatenate([e[i] for e in each]).astype(np.int64) if each else np.zeros(0, np.int64)) for i in range(4)]
            out = pa.RecordBatch.from_arrays([b.column("id").take(own), b.column("th").take(own), pa.array(np.arange(part + seq, part + seq + n)), *cols], ["id", "th", "uid", "anchor", "content", "first", "n"])
            seq += n
            for i in range(0, n, 1 << 16):
                yield out.slice(i, 1 << 16)

    every = written(docs.mapInArrow(cut, "id long, th long, uid long, anchor long, content long, first long, n long"), "paths")
    names = every.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min("uid").alias("one"))
    branching = names.groupBy("anchor").agg(F.sum("times").alias("total"), F.count("*").alias("names")).filter("total > 1").drop("total")
    names = names.join(branching, "anchor")
    found = every.join(names, ["anchor", "content"]).select("id", "th", "first", "n", (F.col("times") > 1).alias("whole"), ((F.col("names") > 1) & ((F.col("times") == 1) | (F.col("uid") == F.col("one")))).alias("open"))
    found = written(found, "repeated")
    opened = found.filter("open").groupBy("id", "th").agg(F.collect_list(F.struct("first", "n", "whole")).alias("spans"))

    def edges(batches):
        for b in batches:
            for (w, *_), spans, i, th in zip(word_hashes(b.column("text")), b.column("spans").to_pylist(), b.column("id").to_pylist(), b.column("th").to_pylist(), strict=True):
                at = np.concatenate([np.arange(s["first"], s["first"] + s["n"]) for s in spans])
                whole = np.repeat([s["whole"] for s in spans], [s["n"] for s in spans])
                e = [tv.rolled(x, at, at + window).astype(np.int64) for x in (w, tv.mix(w, 22))]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array([th] * len(at), pa.int64()), pa.array(at), pa.array(whole), pa.array(e[0]), pa.array(e[1])], ["id", "th", "first", "whole", "e1", "e2"])

    edge = written(docs.select("id", "th", "text").distinct().join(opened, ["id", "th"]).mapInArrow(edges, "id long, th long, first long, whole boolean, e1 long, e2 long"), "edges")
    twice = edge.groupBy("e1", "e2").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    single = edge.filter("not whole").join(twice, ["e1", "e2"]).select("id", "th", "first", F.lit(1).cast("long").alias("n"))
    return found.filter("whole").select("id", "th", "first", "n").union(single).groupBy("id", "th").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, inner: int = INNER) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_text (kept words joined by a space), kept_sha256."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    spans = repeated_spans(docs, window, inner)

    def keep(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for (w, part, starts, ends), spans in zip(word_hashes(b.column("text")), b.column("spans").to_pylist(), strict=True):
                step = np.zeros(len(w) + 1, np.int64)
                for s in spans or ():
                    step[s["first"]] += 1
                    step[s["first"] + s["n"] + window - 1] -= 1
                stay = np.cumsum(step[:-1]) == 0
                raw = part.tobytes() if not len(w) else part[starts[0] : ends[-1]].tobytes()
                base = starts[0] if len(w) else 0
                kept.append(b" ".join(raw[x - base : y - base] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)))
                n_words.append(len(w))
                n_removed.append(len(w) - int(stay.sum()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    out = docs.join(spans, ["id", "th"], "left").select("id", "text", "spans").mapInArrow(keep, "id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


OP10_SQL = r"""WITH cut AS MATERIALIZED (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS MATERIALIZED (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM cut)),
spans AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
out AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM spans),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM cut),
marked AS (SELECT doc_id, count(*) AS n, count(out.i) AS gone, coalesce(string_agg(CASE WHEN out.i IS NULL THEN word END, ' ' ORDER BY i), '') AS kept FROM each LEFT JOIN out USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM cut LEFT JOIN marked USING (doc_id)"""


def op10(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept_text")

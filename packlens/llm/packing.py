"""Operator 5: mixture-controlled packing by deficit round-robin.

Every source is a queue of its documents' tokens. Window w takes from source s the tokens up to
floor(w * W * T_s / T) of its queue: the quantum W * T_s / T plus the deficit that the earlier windows left, the
fraction below one token that is carried on. (T_s: tokens of the source, T: of all.) The closed form lets each
document find its windows by itself, so deficits are carried across partitions without a sequential pass. A
`mixture` of weights can replace the sources' own shares; a source that runs out before the others then leaves its
part of later windows to them.

Windows follow each other as one stream, which is cut every `length` tokens; the remainder is cut into powers of
two, which need no padding. Queue order is a hash block of the id, then id; queues, windows and the stream get
their offsets by prefix sums over blocks of bounded size.

Null texts are empty: their only token is the end id. Null sources share the queue of the empty source. Repeated
ids are separate rows. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm import textvec as tv
from packlens.llm.bpe import Known, distinct, from_planes, pack, planes, ranges, unpack, vocabulary, word_hashes
from packlens.llm.common import documents, written

#: Words that a worker keeps encoded.
CACHE_WORDS = 1_000_000
_known: dict[str, Known] = {}


def tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Written table: uid, id, source, n (tokens with the end id), packed (uint32 ids, compressed)."""

    def encode(batches):
        uid = TaskContext.get().partitionId() << 36
        known = _known.setdefault(path, Known(path, CACHE_WORDS))
        for b in batches:
            offs, data = tv.utf8(b.column("text"))
            n, out = [], []
            for i, j in tv.pieces(offs, 4 << 20):
                part = data[offs[i] : offs[j]]
                starts, ends, first = tv.words(offs[i : j + 1] - offs[i], part)
                h, check = word_hashes(part, starts, ends)
                one, number = distinct(h, check)
                every, at, size = known.encode(part, starts[one], ends[one], h[one], check[one])
                for k in range(j - i):
                    own = number[first[k] : first[k + 1]]
                    ids = np.append(every[ranges(at[own], size[own])], np.uint32(end_id))
                    n.append(len(ids))
                    out.append(pack(planes(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(n))), b.column("id"), b.column("source"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["uid", "id", "source", "n", "packed"])
            uid += len(n)

    return written(docs.mapInArrow(encode, "uid long, id long, source string, n long, packed binary"), "tokens")


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = 1000) -> DataFrame:
    """df with `out`: the sum of `value` over rows of the keys with smaller `order` (unique, not negative). Windows
    span `block` rows, and one row for each block above them."""
    df = df.withColumn("_b", F.expr(f"{order} div {block}"))
    top = df.groupBy(*keys, "_b").agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    top = top.withColumn("_base", F.sum("_t").over(w.orderBy("_b")) - F.col("_t")).drop("_t")
    inner = Window.partitionBy(*keys, "_b").orderBy(order)
    df = df.withColumn("_in", F.sum(value).over(inner) - F.col(value))
    return df.join(top, [*keys, "_b"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_b", "_base", "_in")


def shares(queues: dict[str, int], mixture: dict[str, float] | None, window: int) -> list[tuple[str, int, int, int, int]]:
    """Phases of the round-robin as (source, first window, first token, numerator, denominator): from that window on
    the source gives floor(windows since * numerator / denominator) tokens more. Without a mixture, one phase."""
    if mixture is None:
        total = sum(queues.values())
        return [(s, 0, 0, window * t, total) for s, t in queues.items()]
    given, start, out = dict.fromkeys(queues, 0), 0, []
    open_ = {s for s, t in queues.items() if t}
    while open_:
        weight = {s: max(0, round(mixture.get(s, 0) * 1_000_000)) for s in open_}
        if not any(weight.values()):
            weight = {s: queues[s] - given[s] for s in open_}
        whole = sum(weight.values())
        live = {s: w for s, w in weight.items() if w}
        spans = {s: -(-(queues[s] - given[s]) * whole // (window * w)) for s, w in live.items()}
        step = max(1, min(spans.values()))
        for s, w in live.items():
            out.append((s, start, given[s], window * w, whole))
        for s, w in live.items():
            given[s] = min(queues[s], given[s] + step * window * w // whole)
        start += step
        open_ = {s for s in open_ if given[s] < queues[s]}
    return out


def packed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None, end_id: int = 1, length: int = 2048, window_sequences: int = 64, mixture: dict[str, float] | None = None, block_rows: int = 500) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the window it lies in."""
    path = path or vocabulary()
    window = length * window_sequences
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    table = tokens(docs, path, end_id)
    rows = table.count()
    blocks = max(1, rows // block_rows)
    queue = table.select("uid", "id", "source", "n", F.expr(f"pmod(xxhash64(id, uid), {blocks})").alias("block"))
    sizes = queue.groupBy("source", "block").agg(F.sum("n").alias("t"))
    totals = {r["source"]: r["t"] for r in sizes.groupBy("source").agg(F.sum("t").alias("t")).collect()}  # a row for each source
    total = sum(totals.values())
    spark = docs.sparkSession
    phased: dict[str, list] = {}
    for source, w0, c0, num, den in shares(totals, mixture, window):
        phased.setdefault(source, []).append((w0, c0, num, den))
    phased = [(s, [(*x, y[1]) for x, y in zip(v, [*v[1:], (0, totals[s])], strict=True)]) for s, v in phased.items()]
    phases = spark.createDataFrame(phased, "source string, phases array<struct<w0: long, c0: long, num: long, den: long, c1: long>>")
    base = prefix_sums(sizes, ["source"], "block", "t", "base").drop("t").join(phases, "source")
    inside = Window.partitionBy("source", "block").orderBy("id", "uid")
    queue = queue.withColumn("c", F.sum("n").over(inside) - F.col("n")).join(base, ["source", "block"])
    queue = queue.select("uid", "source", "n", (F.col("base") + F.col("c")).alias("c"), F.inline("phases"))
    # the part of the document in each phase, then in each window
    p = queue.filter("c < c1 and c + n > c0").withColumns({"a": F.greatest("c", "c0"), "z": F.least(F.col("c") + F.col("n"), "c1")})
    window_of = lambda t: f"((cast({t} - c0 + 1 as decimal(19,0)) * cast(den as decimal(19,0)) + num - 1) div num)"
    upto = lambda k: f"(c0 + ((cast({k} as decimal(19,0)) * cast(num as decimal(19,0))) div den))"
    p = p.withColumn("k", F.explode(F.expr(f"sequence({window_of('a')}, {window_of('(z - 1)')})")))
    p = p.select("uid", "source", "n", "c", (F.col("w0") + F.col("k")).alias("w"), F.expr(f"greatest(a, {upto('(k - 1)')})").alias("a"), F.expr(f"least(z, {upto('k')})").alias("z")).filter("z > a")
    fill = prefix_sums(p.groupBy("w").agg(F.sum(F.col("z") - F.col("a")).alias("t")), [], "w", "t", "base").drop("t")
    line = Window.partitionBy("w").orderBy("source", "a")
    p = p.withColumn("at", F.sum(F.col("z") - F.col("a")).over(line) - (F.col("z") - F.col("a"))).join(fill, "w")
    p = p.select("uid", "n", "w", (F.col("a") - F.col("c")).alias("s"), (F.col("z") - F.col("a")).alias("len"), (F.col("base") + F.col("at")).alias("g"))
    # cut the stream: full sequences, then powers of two
    full, rest = divmod(total, length)
    tail, at = [], full * length
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            tail.append(at)
            at += 1 << bit
    starts = f"array({', '.join(f'{t}L' for t in [*tail, at])})"
    sequence_of = lambda g: f"if({g} < {full * length}, ({g}) div {length}, {full} + size(filter({starts}, x -> x <= {g})) - 1)"
    start_of = lambda q: f"if({q} <= {full}, ({q}) * {length}, element_at({starts}, cast({q} - {full} + 1 as int)))"
    p = p.withColumn("q", F.explode(F.expr(f"sequence({sequence_of('g')}, {sequence_of('(g + len - 1)')})")))
    p = p.withColumns({"from": F.expr(f"greatest(g, {start_of('q')})"), "to": F.expr(f"least(g + len, {start_of('(q + 1)')})")})
    p = p.select("uid", "w", (F.col("s") + F.col("from") - F.col("g")).alias("start"), (F.col("to") - F.col("from")).alias("length"), F.col("q").alias("sequence_id"), F.expr(f"`from` - {start_of('q')}").alias("offset"))
    each = p.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "w")).alias("pieces"))

    def digest(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for i, n, packed, pieces in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("packed").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                raw = from_planes(unpack(packed)).tobytes()
                for x in sorted(pieces, key=lambda x: x["start"]):
                    crc = zlib.crc32(raw[4 * x["start"] : 4 * (x["start"] + x["length"])])
                    for c, v in zip(cols, (i, x["start"], x["length"], crc, n, x["sequence_id"], x["offset"], x["w"]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"])

    out = table.select("uid", "id", "n", "packed").join(each, "uid").mapInArrow(digest, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long")
    return out.withColumnRenamed("id", id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    return packed_pieces(documents(spark, sf_dir))

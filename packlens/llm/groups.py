"""Components inside groups of rows that may link, however large a group is.

A group is cut into blocks of bounded weight. Each block is searched by an index; then blocks of one group meet by
sending the rows that are outside the group's largest component to the other blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import components, empty, spent, written

#: Rows that are sent to a block at once.
ASKS = 2000
#: Bytes of text of small groups that are searched in one call, about.
LOT_BYTES = 1_000_000


class Forest:
    """Edges kept only where they join two trees: at most one for each node."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        some = a != b
        if not some.any():
            return
        pairs = np.unique(np.stack([a[some], b[some]], 1), axis=0)
        for x, y in pairs.tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def edges(self, size: int = 1 << 16):
        nodes = np.array(list(self.up), np.int64)
        tops = np.array([self.find(x) for x in nodes.tolist()], np.int64)
        for i in range(0, len(nodes), size):
            yield nodes[i : i + size], tops[i : i + size]


def local_components(items: list, index) -> np.ndarray:
    """The component number of each item. In the end only items of the largest component may stay unasked: a link
    between two components is found from whichever is not the largest."""
    n = len(items)
    index.hold(items)
    label, size, asked = np.arange(n), np.ones(n, np.int64), np.zeros(n, bool)
    turn = list(range(n))
    while turn:
        for i in turn:
            if i and label[i] == np.argmax(size) and size[label[i]] > 1:
                continue
            asked[i] = True
            hits = np.unique(label[index.linked(items[i], label, label[i])])
            if len(hits := hits[hits != label[i]]):
                merged = np.append(hits, label[i])
                to, total = int(merged.min()), int(size[merged].sum())
                label[np.isin(label, merged)] = to
                size[merged] = 0
                size[to] = total
        turn = np.flatnonzero(~asked & (label != np.argmax(size))).tolist()
    return label


def grouped_links(rows: DataFrame, index, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """rows: id (long, unique), grp, blocks (int), block (int), text. Edges (a, b) whose components are those of all
    links inside each group. index: items(texts), hold(items), linked(item, label, own): held items that link with the
    item, which may leave out those of label `own` and, of each other label, all but one; it may have a components(items)
    of its own in place of local_components()."""
    parted = getattr(index, "components", lambda items: local_components(items, index))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grp", "id"], ignore_index=True)
        items, grp, ids = index.items(pdf["text"]), pdf["grp"].to_numpy(), pdf["id"].to_numpy()
        starts = np.append(0, np.flatnonzero(np.diff(grp)) + 1)
        part = np.concatenate([ids[i:j][parted(items[i:j])] for i, j in zip(starts, np.append(starts[1:], len(ids)), strict=True)])
        return pd.DataFrame({"id": ids, "grp": grp, "blocks": pdf["blocks"], "block": pdf["block"], "part": part})

    # groups of one block share calls, of about lot_bytes of text
    lots = 1 + (rows.filter("blocks = 1").agg(F.sum(F.length("text"))).first()[0] or 0) // lot_bytes
    lot = F.when(F.col("blocks") == 1, F.expr(f"pmod(xxhash64(grp), {lots})")).otherwise(F.lit(-1))
    own = F.when(F.col("blocks") > 1, F.col("grp"))
    # a fixed number of tasks: few bytes are much work, and adaptive execution would make one task of them
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns({"lot": lot, "own": own}).repartition(tasks, "lot", "own", "block")
    parts = written(dealt.groupBy("lot", "own", "block").applyInPandas(search, "id long, grp long, blocks int, block int, part long"), "parts")
    links = parts.filter("id <> part").select(F.col("id").alias("a"), F.col("part").alias("b"))
    wide = parts.filter("blocks > 1")
    return links if empty(wide) else links.union(across(rows.select("id", "text"), wide, index))


def across(texts: DataFrame, parts: DataFrame, index) -> DataFrame:
    """Links between blocks of one group: first one row of each part of two or more goes to the block with the group's
    largest part, then every row that is still outside the group's largest component to each other block."""
    edges = None
    label = parts.select("id", "grp", "blocks", "block", "part")
    for step in ("first", "rest"):
        # written minima and counts: a large group's partition can be split where it joins them
        count = written(label.groupBy("grp", "part").agg(F.count("*").alias("size"), F.min(F.struct("id", "block")).alias("one")), "count")
        top = written(count.groupBy("grp").agg(F.max_by(F.struct("part", F.col("one.block").alias("block")), F.struct("size", "part")).alias("top")), "top")
        if step == "first":
            heads = count.filter("size > 1").select("grp", "part", F.col("one.id").alias("id"), F.col("one.block").alias("block")).join(top.hint("merge"), "grp")
            asked = heads.filter("part <> top.part and block <> top.block").select("id", "grp", "part", F.col("top.block").alias("to"))
        else:
            asked = label.join(top.hint("merge"), "grp").filter("part <> top.part")
            asked = asked.select("id", "grp", "part", F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b <> block)")).alias("to"))
        asked = written(asked, "asked")
        n_ask = written(asked.groupBy("grp", F.col("to").alias("block")).agg(F.ceil(F.count("*") / ASKS).cast("int").alias("lots")), "asks")
        held = label.join(n_ask.hint("merge"), ["grp", "block"])
        held = held.select("id", "grp", "block", "part", F.explode(F.expr("sequence(0, lots - 1)")).alias("lot"), F.lit(False).alias("asks"))
        asks = asked.withColumnRenamed("to", "block").join(n_ask.hint("merge"), ["grp", "block"])
        asks = asks.select("id", "grp", "block", "part", F.expr("cast(pmod(xxhash64(id, 7), lots) as int)").alias("lot"), F.lit(True).alias("asks"))
        rows = held.union(asks).join(texts, "id")

        def probe(pdf: pd.DataFrame) -> pd.DataFrame:
            mine, theirs = pdf[~pdf["asks"]].reset_index(drop=True), pdf[pdf["asks"]].reset_index(drop=True)
            index.hold(index.items(mine["text"]))
            own, out = mine["part"].to_numpy(), set()
            for part, x in zip(theirs["part"], index.items(theirs["text"]), strict=True):
                out |= {(int(part), int(p)) for p in np.unique(own[index.linked(x, own, part)]) if p != part}
            return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

        new = written(rows.groupBy("grp", "block", "lot").applyInPandas(probe, "a long, b long"), "across")
        edges = new if edges is None else edges.union(new)
        spent(count, top, asked, n_ask)
        if step == "first":
            merged = components(new).select(F.col("id").alias("part"), "component")
            label = written(label.join(merged.hint("merge"), "part", "left").select("id", "grp", "blocks", "block", F.coalesce("component", "part").alias("part")), "label")
    return edges

"""Operator 6: n-gram Jaccard self-join by T-occurrence search (DivideSkip).

A document's set is its distinct word n-gram shingles. Documents link when 100 * |x & y| >= percent * |x | y|.

1. Rows with equal sets form classes; one representative each goes on.
2. Lossless grouping. Shingles are ordered by hash; a set's prefix are its first size - need + extra shingles. Two
   linked sets share `extra` shingles of their prefixes at least (the smaller one's), so a row stays only if that many
   of its prefix shingles are shared with rows of a size that may link. The shared ones that are so frequent that
   linked rows share a rarer one too go next (prefixes again, under the exact frequency order): passages that many
   texts hold connect nothing. Rows that stay are chained along each shared shingle, sorted by size: neighbours of
   linkable size join, which joins all that may link. No pairs are emitted, and the rows of a frequent shingle are
   spread over tasks by size and id.
3. In each group, cut into blocks of a bounded number of shingles, an inverted index answers T-occurrence queries:
   short lists are merged, candidates are probed in the long ones. Blocks of one group meet by sending the documents
   that are not yet in the group's largest component to the other blocks.

Empty and null texts have no shingle and stay alone, as do rows whose id is null (their component is null). Extra
columns are ignored. Repeated ids are one document: rows with one id share its component. Ties do not arise: a
component is named by its smallest id. An empty table gives no rows. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm import textvec as tv
from packlens.llm.common import components, documents, spent, written
from packlens.llm.groups import Forest, grouped_links

#: Shingles that one block of a group holds at most, but for a single longer text.
BLOCK_SHINGLES = 300_000
#: Keys that one task sorts and walks over, about.
TASK_KEYS = 3_000_000
#: Prefix shingles beyond the shortest prefix, in hundredths of a set.
EXTRA = 10
#: DivideSkip's cost of a probe beside that of a merged posting.
MU = 0.0085


def need(n, percent: int):
    """Shingles that a set of n must share to link."""
    return (percent * n + 99) // 100


def extra(n):
    return 1 + n * EXTRA // 100


def prefix(x: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set (sorted hashes)."""
    return x[: len(x) - need(len(x), percent) + extra(len(x))] if len(x) else x


def neighbours(percent: int, forest: bool):
    """Rows sorted by (key, n, id): those with a neighbour of the same key and a linkable size, as (key, n, id, part, side),
    side 0; and each task's first and last row, side 1 and 2. With `forest` instead of the former the links (a, b) between
    neighbours (in id and n, side 3), at most one for each id."""

    def walk(batches):
        part, last, first = TaskContext.get().partitionId(), None, None
        links = Forest()

        def rows(key, n, id_, side):
            m = len(key)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(id_, pa.int64()), pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, side, np.int32))], ["key", "n", "id", "part", "side"])

        pending = None  # the last row, whose fate the next batch decides
        for b in batches:
            if not b.num_rows:
                continue
            key, n, id_ = (c.to_numpy() for c in b.columns)
            if first is None:
                first = key[:1], n[:1], id_[:1]
            if pending is not None:
                key, n, id_ = (np.append(p, c) for p, c in zip(pending[:3], (key, n, id_), strict=True))
            met = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
            if forest:
                links.add(id_[1:][met], id_[:-1][met])
            else:
                has = np.append(met, False)
                has[1:] |= met
                has[0] |= pending is not None and pending[3]
                done = has[:-1]
                yield rows(key[:-1][done], n[:-1][done], id_[:-1][done], 0)
            pending = key[-1], n[-1], id_[-1], bool(len(met) and met[-1])
        if pending is None:
            return
        if forest:
            for a, b in links.edges():
                yield rows(np.zeros(len(a), np.int64), b, a, 3)
        elif pending[3]:
            yield rows(*([x] for x in pending[:3]), 0)
        yield rows(*first, 1)
        yield rows(*([x] for x in pending[:3]), 2)

    return walk


def borders(met: DataFrame, percent: int) -> DataFrame:
    """Links across tasks: the last row of one and the first row of the next (one row a task), as (key, n, id, other_n, other)."""
    ends = met.filter("side = 1 or side = 2").select("part", "side", "key", "n", "id")
    each = ends.groupBy("part").agg(F.min(F.when(F.col("side") == 1, F.struct("key", "n", "id"))).alias("head"), F.min(F.when(F.col("side") == 2, F.struct("key", "n", "id"))).alias("tail"))
    turn = each.withColumn("next", F.lead("head").over(Window.partitionBy(F.lit(0)).orderBy("part")))
    at = turn.filter(F.col("tail.key") == F.col("next.key")).filter(100 * F.col("tail.n") >= percent * F.col("next.n"))
    return at.select("tail.key", "tail.n", "tail.id", F.col("next.n").alias("other_n"), F.col("next.id").alias("other"))


def walked(keys: DataFrame, count: int, percent: int, forest: bool, name: str) -> DataFrame:
    parts = max(1, -(-count // TASK_KEYS))
    ordered = keys.select("key", "n", "id").repartitionByRange(parts, "key", "n", "id").sortWithinPartitions("key", "n", "id")
    return written(ordered.mapInArrow(neighbours(percent, forest), "key long, n long, id long, part int, side int"), name)


class DivideSkip:
    """Inverted lists over sets (sorted arrays); search() answers T-occurrence queries."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets], np.int64)
        tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.posts = tokens[order], owner[order]
        self.tokens, first = np.unique(tokens, return_index=True)
        self.bounds = np.append(first, len(tokens))
        self.sizes, self.sets = sizes, sets

    def search(self, x: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets that share at least `need` (one or more) tokens with x, and how many they share."""
        at = np.searchsorted(self.tokens, x)
        at = at[at < len(self.tokens)] if len(at) and at[-1] >= len(self.tokens) else at
        at = at[self.tokens[at] == x[: len(at)]]
        if len(at) < need:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.bounds[at + 1] - self.bounds[at]
        order = at[np.argsort(size, kind="stable")]
        # DivideSkip's number of long lists: more probes, or more postings to merge
        n_long = min(need - 1, int(need / (MU * math.log2(max(2, int(size.max()))) + 1)))
        n_short = len(order) - n_long
        short = [self.posts[self.bounds[i] : self.bounds[i + 1]] for i in order[:n_short]]
        long = order[n_short:]
        if sum(map(len, short)) <= 512:  # heap merge
            found, count = [], []
            for doc in heapq.merge(*(s.tolist() for s in short)):
                if found and found[-1] == doc:
                    count[-1] += 1
                else:
                    found.append(doc)
                    count.append(1)
            found, count = np.array(found, np.int64), np.array(count, np.int64)
        else:  # the same merge, by sorting
            merged = np.sort(np.concatenate(short), kind="stable")  # timsort merges the sorted lists as they are
            first = np.flatnonzero(np.diff(merged, prepend=-1))
            found, count = merged[first], np.diff(first, append=len(merged))
        keep = count + len(long) >= need
        found, count = found[keep], count[keep]
        if len(found) <= len(long):  # binary probes of one document in all long lists
            tokens = np.sort(self.tokens[long])
            for j, doc in enumerate(found.tolist()):
                own = self.sets[doc]
                p = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                count[j] += int((own[p] == tokens).sum())
            long = long[:0]
        for left, i in zip(range(len(long), 0, -1), long, strict=True):  # of all documents in one list, shortest first
            posts = self.posts[self.bounds[i] : self.bounds[i + 1]]
            keep = count + left >= need
            if not keep.all():
                found, count = found[keep], count[keep]
            if not len(found):
                break
            p = np.minimum(np.searchsorted(posts, found), len(posts) - 1)
            count = count + (posts[p] == found)
        keep = count >= need
        return found[keep], count[keep]


class JaccardIndex:
    """What groups.search needs: items of texts, and the numbers of the held items that link with an item."""

    def __init__(self, percent: int, words: int):
        self.percent, self.words = percent, words

    def items(self, texts: pd.Series) -> list[np.ndarray]:
        offs, data = tv.utf8(pa.array(texts, pa.large_string()))
        return list(tv.shingle_sets(offs, data, self.words))

    def hold(self, items: list[np.ndarray]) -> None:
        self.index = DivideSkip(items)

    def linked(self, x: np.ndarray, label: np.ndarray | None = None, own: int | None = None) -> np.ndarray:
        return linked(self.index, x, self.percent)


def linked(index: DivideSkip, x: np.ndarray, percent: int) -> np.ndarray:
    """Numbers of the indexed sets that link with x."""
    need = max(1, -(-percent * len(x) // 100))
    found, both = index.search(x, need)
    return found[100 * both >= percent * (len(x) + index.sizes[found] - both)]


def chained(keys: DataFrame, percent: int) -> DataFrame:
    """Written links (a, b) that connect the ids of each key along their sizes."""
    met = walked(keys, keys.count(), percent, True, "chains")
    inner = met.filter("side = 3").select(F.col("id").alias("a"), F.col("n").alias("b"))
    links = written(inner.union(borders(met, percent).select(F.col("id").alias("a"), F.col("other").alias("b"))), "links")
    spent(met)
    return links


def grouped(base: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Rows (id, grp) of representatives that may link with others of their group. base: with `keys`."""
    keys = base.join(classes.select(F.col("rep").alias("id"), "n", "k1", "k2").hint("merge"), ["id", "n", "k1", "k2"], "left_semi")
    keys = written(keys.dropDuplicates(["id", "n", "k1", "k2"]).select("id", "n", "keys"), "keys")
    count = keys.agg(F.sum(F.size("keys"))).first()[0] or 0
    spent(base)
    met = walked(keys.select(F.explode("keys").alias("key"), "n", "id"), count, percent, False, "shared")
    over = borders(met, percent)
    shared = met.filter("side = 0").select("key", "n", "id").union(over.select("key", "n", "id")).union(over.select("key", F.col("other_n").alias("n"), F.col("other").alias("id")))
    # of linked sets x and y, x shares as many prefix shingles as the smaller set's extra: y has need(x) shingles at least
    least = F.expr(f"1 + ((({percent} * n + 99) div 100) * {EXTRA}) div 100")
    enough = written(shared.groupBy("id", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("id", "n"), "enough")
    live = written(shared.join(enough.hint("merge"), ["id", "n"]).select("key", "n", "id"), "live")
    spent(keys, met, enough)
    # so x and y also share one of the first c - least + 1 of the c that x has, in the order of their frequency
    often = written(live.groupBy("key").agg(F.count("*").alias("df")), "often")
    sets = live.join(often.hint("merge"), "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))
    rare = written(sets.select("id", "n", F.explode(F.slice("s", 1, F.greatest(F.lit(0), F.size("s") - least.cast("int") + 1))).alias("x")).select("x.key", "n", "id"), "rare")
    spent(live, often)
    links = chained(rare, percent)
    spent(rare)
    out = written(components(links).withColumnRenamed("component", "grp"), "groups")
    spent(links)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, its own included)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def signed(batches):
        for b in batches:
            offs, data = tv.utf8(b.column("text"))
            n, k1, k2, each, seen = [], [], [], [], set()
            for i, x in zip(b.column("id").to_pylist(), tv.shingle_sets(offs, data, words), strict=True):
                n.append(len(x))
                k1.append(tv.mix(x, 1).sum().astype(np.int64))
                k2.append(np.bitwise_xor.reduce(tv.mix(x, 2)).astype(np.int64) if len(x) else 0)
                key = (n[-1], k1[-1], k2[-1])
                # of equal sets in a batch one brings its keys; the class links the others
                each.append(x[:0] if i is None or key in seen else prefix(x, percent).copy())
                if i is not None:
                    seen.add(key)
            flat = np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64)
            keys = pa.ListArray.from_arrays(np.cumsum([0, *map(len, each)]).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), keys], ["id", "n", "k1", "k2", "keys"])

    base = written(docs.mapInArrow(signed, "id long, n long, k1 long, k2 long, keys array<long>"), "sets")
    rows = written(base.select("id", "n", "k1", "k2"), "rows")
    holds = F.when(F.size("keys") > 0, F.col("id"))
    classes = base.filter("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min(holds).alias("rep"), F.min("id").alias("low"))
    classes = written(classes, "classes")
    groups = grouped(base, classes, percent)
    # a representative of several classes (a repeated id) brings each of its sets
    reps = written(classes.join(groups.hint("merge"), F.col("rep") == groups["id"]).select("rep", "n", "grp"), "reps")
    sizes = reps.groupBy("grp").agg(F.sum("n").alias("total"), F.count_distinct("rep").alias("members")).filter("members > 1")
    sizes = written(sizes, "sizes")  # plain: a large group's partition can be split where it joins
    members = reps.join(sizes.hint("merge"), "grp").select("rep", "grp", F.ceil(F.col("total") / block_shingles).cast("int").alias("blocks")).distinct()
    members = members.withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    texts = written(docs.join(members.withColumnRenamed("rep", "id").hint("merge"), "id"), "members")

    links = written(grouped_links(texts, JaccardIndex(percent, words)).union(classes.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))), "links")
    spent(texts)
    # rows of one id are one document, whatever their sets: classes meet at their ids
    same = rows.filter("n > 0 and id is not null").join(classes.hint("merge"), ["n", "k1", "k2"]).select("id", "n", "low")
    twice = same.groupBy("id").agg(F.min("low").alias("a"), F.max("low").alias("z")).filter("a <> z").select("id")
    twice = same.select("id", "low").distinct().join(twice, "id", "left_semi")
    found = written(components(links.union(twice)).withColumnRenamed("id", "low"), "found")
    per_row = same.join(found.hint("merge"), "low", "left").select("id", "n", F.coalesce("component", "low").alias("component_id"))
    alone = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return per_row.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


OP6_SQL = r"""WITH RECURSIVE cut AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
    JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * met >= 85 * (s.n + t.n - met)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM cut LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""


def op6(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return jaccard_components(docs, words=4, percent=85)

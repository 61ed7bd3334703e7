"""Operator 4: fuzzy line deduplication.

Lines are normalised (case folded, white space collapsed). Empty lines always stay. Equal normalised lines of any
length are one distinct line. Distinct lines of `min_chars` or more link when their edit similarity (1 - Levenshtein
distance / longer length) is at least `similarity` and they meet. Of each connected group the first occurrence
(smallest id, then line number) stays.

A line's SimHash has 192 bits: 64 of votes of its words, and 128 of votes of its distinct words, whose frequent ones
sway fewer bits. It also has blocks: its words are dealt by hash to as many blocks as there
are three to six words for each; each block is named by the SimHash (64 bits) and the sum of its own words. A changed word changes
its own block only, so lines that differ in fewer words than they have blocks agree on one (the pigeonhole join); more blocks than
BLOCKS are not compared. Lines of few words have two blocks, their first and their last words. Lines that meet in a
block and whose whole SimHashes differ in WHOLE bits at most, RADIUS of the first 64, are verified by edit distance. The
first 64 bits alone bring lines together that share frequent words only, more of them the more lines there are. Edits that touch most words
of a line can be missed.

Blocks are ordered by key, size and line. A run of equal keys, however long, gives every pair that may link by size and
SimHash. Only pairs of two lines that each have more than RUN such partners in one run (near copies) are not listed: they
connect those lines, and the groups so made are searched exactly, in blocks. So are runs at a task's border, and runs of more than HELD
lines, which are connected along their sizes.

Null texts have no lines. Repeated rows count as further occurrences. Other columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

from hashlib import blake2b
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm import textvec as tv
from packlens.llm.common import components, documents, spent, written
from packlens.llm.groups import Forest, grouped_links

#: Blocks of a line that are compared, words in one at least, and bits in which two SimHashes may differ: the first 64 and all 192.
BLOCKS, WORDS, RADIUS, WHOLE = 6, 3, 18, 56
#: Lines with one key of which all pairs are listed at once, and partners of a line in a longer run above which it is searched in a group.
RUN = 32
#: Lines with one key that a task holds.
HELD = 200_000
#: Pairs of runs that are compared at once.
PAIRS = 1 << 18
#: Keys that one task sorts and walks over, about.
TASK_KEYS = 2_000_000
#: Bytes of lines in a block of a group.
BLOCK_BYTES = 1_000_000
#: Bytes of lines of small groups that are searched in one call, about.
LOT_BYTES = 50_000
#: Pairs whose edit distances are sought at once, characters of lines held for that, and pairs a word below which they are sought one by one.
LOT, CELLS, FEW = 16_384, 1 << 20, 12
#: Bins of a line's trigram profile, and pairs that are sifted by it at once.
PROFILE, SIFTED = 1024, 2048
#: Pairs of a group that are tested first.
FIRST = 256
#: For each byte, its bits in eight lanes.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def simhash(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each run of word hashes, the bits that more than half of them have."""
    n = np.diff(starts, append=len(h))
    # lanes count up to 255: longer runs are summed in parts
    parts = -(-n // 255)
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    sums = np.add.reduceat(LANES[h.view(np.uint8).reshape(-1, 8)], cuts, axis=0).view(np.uint8)
    if len(sums) > len(starts):
        sums = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int32)
    return np.packbits(2 * sums.astype(np.int32) > n[:, None], axis=1).view(np.uint64).ravel()


def simhashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three rows: the first, second and third 64 bits of each line's SimHash. h: hashes of all words; first: the first
    word's number of each line (one more at the end). Lines have a word at least."""
    n, bits = len(first) - 1, np.uint64(20)
    if n > 1 << 20:
        cuts = [*range(0, n, 1 << 20), n]
        return np.concatenate([simhashes(h[first[i] : first[j]], first[i : j + 1] - first[i]) for i, j in zip(cuts, cuts[1:])], axis=1)
    # a word hash keeps 44 bits, however many lines there are: a line's SimHash is its own
    word = np.sort(np.repeat(np.arange(n, dtype=np.uint64), np.diff(first)) << (np.uint64(64) - bits) | h >> bits)
    word = word[np.append(True, word[1:] != word[:-1])]
    starts = np.searchsorted(word >> (np.uint64(64) - bits), np.arange(n, dtype=np.uint64))
    word = word << bits
    return np.stack([simhash(h, first[:-1]), simhash(tv.mix(word, 77), starts), simhash(tv.mix(word, 91), starts)])


def alike(x, y, radius: int):
    """Which SimHashes differ in few enough bits. x, y: their first 64 bits, or all three parts of them."""
    far = np.bitwise_count(x[0] ^ y[0])
    may = far <= radius
    if len(x) > 1:
        may &= sum((np.bitwise_count(a ^ b) for a, b in zip(x[1:], y[1:], strict=True)), far) <= WHOLE + 3 * (radius - RADIUS)
    return may


def blocks(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The SimHashes of all lines (simhashes()), and keys of blocks with the line of each. Lines have a word at least."""
    offs = np.cumsum([0, *map(len, lines)])
    data = np.frombuffer(b"".join(lines), np.uint8)
    starts, ends, first = tv.words(offs, data)
    h, n = tv.rolled(tv.BYTES[data], starts, ends), np.diff(first)
    line = np.repeat(np.arange(len(lines)), n)
    keys, owner = [], []
    deal = tv.mix(h, 51)
    few = n < 4 * WORDS
    # a line has 2**k blocks; those of the next k too where a similar line may have more words
    own_k, next_k = (np.maximum(2, np.log2(n * x / WORDS).astype(np.int64)) for x in (1, 1.12))
    for some, k in ((~few, own_k), (~few & (next_k > own_k), next_k), (few & (n * 1.12 >= 4 * WORDS), next_k)):
        word = np.flatnonzero(some[line])
        at = (deal[word] & ((np.uint64(1) << k[line[word]].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        word, at = word[at < BLOCKS], at[at < BLOCKS]
        if not len(word):
            continue
        code = line[word] * BLOCKS + at
        order = np.argsort(code, kind="stable")
        code = code[order]
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        of, which = np.divmod(code[begin], BLOCKS)
        bag = np.add.reduceat(tv.mix(h[word[order]], 55), begin)  # a frequent word that outvotes the others names no block
        keys.append(tv.mix(simhash(h[word[order]], begin) ^ bag ^ tv.mix((which + 64 * k[of]).astype(np.uint64), 52), 53))
        owner.append(of)
    some = np.flatnonzero(few)
    span = np.minimum(n[some] + 1, 7) // 2  # 1 word of up to 2, 2 of up to 4, 3 of more
    span = np.where(n[some] < 6, np.maximum(1, n[some] // 2), span)
    for side, at in enumerate((first[some], first[some + 1] - span)):
        keys.append(tv.mix(tv.rolled(h, at, at + span) ^ np.uint64(99 + side), 54))
        owner.append(some)
    return simhashes(h, first), np.concatenate(keys), np.concatenate(owner)


def levenshtein(a: str, b: str, most: int) -> int:
    """Edit distance by bit-parallel columns, or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for j, c in enumerate(b):
        eq = where.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | (~(d | plus) & full), plus & d
        distance += bool(up & top) - bool(down & top)
        if distance - (len(b) - j - 1) > most:
            return most + 1
        up = (up << 1 | 1) & full
        plus, minus = (down << 1 & full) | (~(x | up) & full), up & x
    return min(distance, most + 1)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their common head and tail, which cost no edits."""
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    return a[: len(a) - tail], b[: len(b) - tail]


def by_words(a: str, b: str, most: int) -> bool:
    """Whether words changed in place, with no word more or less, already explain a distance of `most` at most."""
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y, strict=True) if u != v) <= most


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`."""
    if by_words(a, b, most):
        return True
    a, b = trimmed(a, b)
    return max(len(a), len(b)) <= most or levenshtein(a, b, most) <= most


def columns(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Edit distances of pairs, exact up to `most` and above it where they are larger. All of a take equally many 64-bit
    words; the pairs are sorted by length of b, longest first. One column of all pairs at a time, as vertical steps in
    words; words further than `most` from the diagonal are left out."""
    pairs, n_a, n_b = len(a), np.array([*map(len, a)]), np.array([*map(len, b)])
    flat_a, flat_b = (np.frombuffer("".join(x).encode("utf-32-le"), "<u4").astype(np.int64) for x in (a, b))
    seen = np.bincount(flat_a, minlength=int(flat_b.max()) + 1) > 0
    code, words = np.cumsum(seen) * seen, -(-int(n_a[0]) // 64)
    row, place = np.repeat(np.arange(pairs), n_a), np.arange(len(flat_a)) - np.repeat(np.cumsum(n_a) - n_a, n_a)
    size = (int(code.max()) + 1) * pairs
    equal = np.zeros(words * size, np.uint64)
    np.bitwise_or.at(equal, (place >> 6) * size + code[flat_a] * pairs + row, np.uint64(1) << (place & 63).astype(np.uint64))
    row, place = np.repeat(np.arange(pairs), n_b), np.arange(len(flat_b)) - np.repeat(np.cumsum(n_b) - n_b, n_b)
    cell = np.zeros((int(n_b[0]), pairs), np.int64)
    cell[place, row] = code[flat_b] * pairs + row
    active = pairs - np.searchsorted(n_b[::-1], np.arange(int(n_b[0])), "right")
    one, top = np.uint64(1), np.uint64(63)
    plus, minus = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64)
    last, score = min(words - 1, most // 64), np.zeros(pairs, np.int64)
    score += 64 * (last + 1)
    for j, n in enumerate(active.tolist()):
        if last < min(words - 1, (j + most) // 64):
            last += 1
            score += 64
        up, down = np.ones(n, np.uint64), np.zeros(n, np.uint64)
        for w in range(max(0, (j - most) // 64), last + 1):
            p, m, eq = plus[w, :n], minus[w, :n], equal[w * size : (w + 1) * size].take(cell[j, :n])
            x = eq | m
            eq |= down
            d = (((eq & p) + p) ^ p) | eq
            rise, fall = m | ~(d | p), p & d
            out = rise >> top, fall >> top
            rise, fall = rise << one | up, fall << one | down
            plus[w, :n], minus[w, :n] = fall | ~(x | rise), rise & x
            up, down = out
        score[:n] += up.astype(np.int64) - down.astype(np.int64)
    # from the last word's last row back to the row of the last character
    over = ~np.uint64(0) << ((n_a - 1) & 63).astype(np.uint64) << one
    return score - np.bitwise_count(plus[-1] & over) + np.bitwise_count(minus[-1] & over)


def all_within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """within() of each pair; pairs of like lengths are compared together."""
    ok, some = np.zeros(len(a), bool), []
    for i in range(len(a)):
        if by_words(a[i], b[i], most[i]):
            ok[i] = True
            continue
        x, y = trimmed(a[i], b[i])
        if max(len(x), len(y)) <= most[i]:
            ok[i] = True
        elif abs(len(x) - len(y)) <= most[i]:  # neither is empty
            some.append((-(-len(x) // 64), -len(y), i, x, y))
    if not some:
        return ok
    some.sort()
    starts = [k for k in range(len(some)) if not k or some[k][0] != some[k - 1][0]]
    for k, end in zip(starts, [*starts[1:], len(some)], strict=True):
        words, far = some[k][0], max(most[t[2]] for t in some[k:end])
        step = max(1, CELLS // max(words * 64, -some[k][1]))
        for k in range(k, end, step):
            own = some[k : min(end, k + step)]
            x, y = [t[3] for t in own], [t[4] for t in own]
            letters = len(set().union(*x))
            if len(own) < FEW * min(words, far // 32 + 2) or letters * words * len(own) > 2 * CELLS:
                for _, _, i, x, y in own:
                    ok[i] = levenshtein(x, y, int(most[i])) <= most[i]
            else:
                which = [t[2] for t in own]
                ok[which] = columns(x, y, int(far)) <= most[which]
    return ok


def profiles(lines: list[str]) -> np.ndarray:
    """How many of each line's trigrams fall in each of PROFILE bins, up to 255."""
    out = np.zeros((len(lines), PROFILE), np.uint8)
    for i in range(0, len(lines), 512):
        some = lines[i : i + 512]
        c = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").astype(np.uint64)
        n = np.array([*map(len, some)])
        if len(c) < 3:
            continue
        line = np.repeat(np.arange(len(some)), n)
        grams = (c[:-2] * np.uint64(961) + c[1:-1] * np.uint64(31) + c[2:]) * np.uint64(2654435761) >> np.uint64(7)
        whole = line[:-2] == line[2:]
        at = line[:-2][whole] * PROFILE + (grams[whole] % np.uint64(PROFILE)).astype(np.int64)
        out[i : i + 512] = np.minimum(np.bincount(at, minlength=len(some) * PROFILE), 255).reshape(-1, PROFILE)
    return out


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how many trigrams the profiles differ, at least. One edit changes three trigrams of each line at most."""
    return (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)


class LineIndex:
    def __init__(self, similarity: float, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius

    def items(self, texts: pd.Series) -> list[tuple[str, np.ndarray, np.uint64]]:
        offs, data = tv.utf8(pa.array(texts, pa.large_string()))
        starts, ends, first = tv.words(offs, data)
        sims = simhashes(tv.rolled(tv.BYTES[data], starts, ends), first)
        return list(zip(texts, profiles(list(texts)), sims.T, strict=True))

    def hold(self, items: list) -> None:
        self.held = items
        self.sims = np.array([x[2] for x in items], np.uint64).reshape(-1, 3).T.copy()
        self.lens = np.array([len(x[0]) for x in items], np.int64)
        self.grams = np.array([x[1] for x in items], np.uint8).reshape(-1, PROFILE)

    def linked(self, x, label: np.ndarray | None = None, own: int | None = None) -> np.ndarray:
        """Numbers of the held lines that link with x. With labels: one at least of each label but `own` that has any."""
        longer = np.maximum(self.lens, len(x[0]))
        most = ((1 - self.similarity) * longer + 1e-9).astype(np.int64)
        may = (np.abs(self.lens - len(x[0])) <= most) & alike(self.sims, x[2], self.radius)
        may = np.flatnonzero(may if label is None else may & (label != own))
        far = apart(self.grams[may], x[1])
        may, far = may[far <= 6 * most[may]], far[far <= 6 * most[may]]
        out, seen = [], set()
        for i in may[np.argsort(far, kind="stable")].tolist():
            if label is not None and label[i] in seen:
                continue
            if within(x[0], self.held[i][0], int(most[i])):
                out.append(i)
                if label is not None:
                    seen.add(label[i])
        return np.array(out, np.int64)

    def components(self, items: list) -> np.ndarray:
        """The component number of each item. All pairs are sifted by arrays, PAIRS at once; the likely ones are tested
        first, many together, and none that is joined by then."""
        self.hold(items)
        n, lens, label = len(items), self.lens, np.arange(len(items))
        step = max(1, PAIRS // max(1, n))
        for k in range(0, n, step):
            own = slice(k, min(n, k + step))
            i, j = np.nonzero(label[own, None] != label[None, k:])
            i, j = k + i[j > i], k + j[j > i]
            most = ((1 - self.similarity) * np.maximum(lens[i], lens[j]) + 1e-9).astype(np.int64)
            may = (np.abs(lens[i] - lens[j]) <= most) & alike(self.sims[:, i], self.sims[:, j], self.radius)
            i, j, most = i[may], j[may], most[may]
            far = np.concatenate([np.zeros(0, np.int64), *(apart(self.grams[i[x : x + SIFTED]], self.grams[j[x : x + SIFTED]]) for x in range(0, len(i), SIFTED))])
            order = np.argsort(far / np.maximum(most, 1), kind="stable")
            order, size = order[far[order] <= 6 * most[order]], FIRST
            while len(order):
                order = order[label[i[order]] != label[j[order]]]
                some, order, size = order[:size], order[size:], min(SIFTED, 2 * size)
                met = all_within([items[x][0] for x in i[some].tolist()], [items[x][0] for x in j[some].tolist()], most[some])
                for x, y in zip(i[some[met]].tolist(), j[some[met]].tolist(), strict=True):
                    if label[x] != label[y]:
                        label[label == max(label[x], label[y])] = min(label[x], label[y])
        return label


def normal_lines(text: str) -> list[str]:
    return [" ".join(line.split()) for line in text.lower().split("\n")]


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """Written table: uid, line, id, k1, k2 (hash of the normalised line; null if it is empty), text (normalised; null if it is too short)."""

    def cut(batches):
        part = TaskContext.get().partitionId() << 40
        seq = 0
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 1024):
                some = [normal_lines(t) if t is not None else [] for t in texts[i : i + 1024]]
                count, text = np.array([*map(len, some)]), [x for own in some for x in own]
                ids = b.column("id").slice(i, 1024).take(pa.array(np.repeat(np.arange(len(some)), count)))
                line = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                uid = part + seq + np.arange(len(text))
                seq += len(text)
                digests = b"".join([blake2b(x.encode(), digest_size=16).digest() for x in text])
                bare = np.array([not x for x in text], bool)
                k1, k2 = (pa.array(k, mask=bare) for k in np.frombuffer(digests, "<i8").reshape(-1, 2).T.copy())
                text = [x if x and len(x) >= min_chars else None for x in text]
                yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), ids.cast(pa.int64()), pa.array(line, pa.int64()), k1, k2, pa.array(text, pa.string())], ["uid", "id", "line", "k1", "k2", "text"])

    return written(docs.mapInArrow(cut, "uid long, id long, line long, k1 long, k2 long, text string"), "lines")


def hashed(batches):
    """Rows (uid, text): the line's characters, SimHash (three parts) and block keys."""
    for b in batches:
        for i in range(0, b.num_rows, 2048):
            uid, texts = b.column("uid").slice(i, 2048), b.column("text").slice(i, 2048).to_pylist()
            sims, keys, owner = blocks([x.encode() for x in texts])
            turn = np.argsort(owner, kind="stable")
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(owner, minlength=len(uid)))).astype(np.int32), pa.array(keys[turn].view(np.int64)))
            yield pa.RecordBatch.from_arrays([uid, pa.array([len(x) for x in texts], pa.int32()), *(pa.array(x.view(np.int64)) for x in sims), lists], ["uid", "size", *SIMS, "keys"])


def lots(batches, size: int = 200_000):
    """The columns of about `size` rows at once."""
    own = []
    for b in batches:
        own.append(b)
        if sum(x.num_rows for x in own) >= size:
            yield [np.concatenate([x.column(i).to_numpy() for x in own]) for i in range(b.num_columns)]
            own = []
    if sum(x.num_rows for x in own):
        yield [np.concatenate([x.column(i).to_numpy() for x in own]) for i in range(own[0].num_columns)]


#: The parts of a SimHash.
SIMS = ["sim", "sim2", "sim3"]
MET = "side int, a long, b long, part int, key long, size int"


def meeting(similarity: float, radius: int, along: bool):
    """Rows (key, size, uid, and a SimHash's first part or all), sorted: the pairs (a, b) of each run that may link by size and SimHash (side 0); of lines
    with many such partners in a run, and of runs at the task's borders or too long to hold, edges that connect what may
    link (side 3); with `along`, of all runs of more than RUN. The task's first and last row (side 1 and 2)."""

    def near(x, y):
        return np.abs(x - y) <= ((1 - similarity) * np.maximum(x, y) + 1e-9).astype(np.int64)

    def listed(side, a, b, part, key=0, size=0):
        n = len(a)
        every = (np.full(n, side, np.int32), a, b, np.full(n, part, np.int32), np.zeros(n, np.int64) + key, np.zeros(n, np.int32) + size)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in every], ["side", "a", "b", "part", "key", "size"])

    def by_sizes(rows, part):
        key, size, uid = rows[:3]
        met = np.flatnonzero((key[1:] == key[:-1]) & near(size[1:], size[:-1]))
        return listed(3, uid[met], uid[met + 1], part)

    def close(size, sims):
        """Places (i, j), i before j, of the pairs of a run that may link."""
        n = len(size)
        end = np.searchsorted(size, size / max(similarity, 1e-9) + 1, "right")
        step = max(1, PAIRS // n)
        for k in range(0, n, step):
            last, own = int(end[min(n, k + step) - 1]), slice(k, min(n, k + step))
            i, j = np.nonzero(np.bitwise_count(sims[0][own, None] ^ sims[0][None, k:last]) <= radius)
            i, j = k + i[j > i], k + j[j > i]
            may = near(size[i], size[j]) & alike([x[i] for x in sims], [x[j] for x in sims], radius)
            yield i[may], j[may]

    def long_run(rows, part):
        _, size, uid, *sims = rows
        n, sims = len(uid), [x.view(np.uint64) for x in sims]
        pairs = lambda i, j: listed(0, *np.sort(np.stack([uid[i], uid[j]]), axis=0), part)
        found, partners = [], np.zeros(n, np.int64)
        for i, j in close(size, sims):
            partners += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            if found is not None:
                found.append((i, j))
                found = found if partners.sum() <= 2 * RUN * n else None
        if found is not None:
            yield pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return
        many, label, forest = partners > RUN, np.arange(n), Forest()
        for i, j in close(size, sims):
            both = many[i] & many[j]
            yield pairs(i[~both], j[~both])
            x, y = label[i[both]], label[j[both]]
            x, y = x[x != y], y[x != y]
            if len(x):
                forest.add(x, y)
                ends, to = np.unique(np.append(x, y)), np.arange(n)
                to[ends] = [forest.find(v) for v in ends.tolist()]
                label = to[label]
        for x, y in forest.edges():
            yield listed(3, uid[x], uid[y], part)

    def runs(rows, part):
        key, size, uid, *sims = rows
        if not len(key):
            return
        starts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
        count = np.diff(starts, append=len(key))
        every, (sims, found, n_found) = rows, ([x.view(np.uint64) for x in sims], [], 0)  # bitwise_count takes signed numbers' absolute values
        for n in np.unique(count[(count > 1) & (count <= RUN)]).tolist():
            own, (i, j) = starts[count == n], np.triu_indices(n, 1)
            step = max(1, PAIRS // len(i))
            for k in range(0, len(own), step):
                a, b = ((own[k : k + step, None] + x).ravel() for x in (i, j))
                may = near(size[a], size[b]) & alike([x[a] for x in sims], [x[b] for x in sims], radius)
                found.append(np.stack([uid[a[may]], uid[b[may]]]))
                n_found += len(found[-1][0])
                if n_found > PAIRS:
                    yield listed(0, *np.sort(np.concatenate(found, axis=1), axis=0), part)
                    found, n_found = [], 0
        if n_found:
            yield listed(0, *np.sort(np.concatenate(found, axis=1), axis=0), part)
        for k, n in zip(starts[count > RUN].tolist(), count[count > RUN].tolist(), strict=True):
            own = [x[k : k + n] for x in every]
            if along:
                yield by_sizes(own, part)
            else:
                yield from long_run(own, part)

    def walk(batches):
        part, held, border, ends = TaskContext.get().partitionId(), None, True, []
        for rows in lots(batches):
            if held is None:
                ends.append([x[:1] for x in rows])
            else:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last and border:  # the task's first run, or one too long to hold
                end = int(np.searchsorted(rows[0], rows[0][0], "right"))
                yield by_sizes([x[:end] for x in rows], part)
                yield from runs([x[end:last] for x in rows], part)
                border = False
            else:
                yield from runs([x[:last] for x in rows], part)
            held = [x[last:] for x in rows]
            if len(held[0]) > HELD:
                yield by_sizes(held, part)
                held, border = [x[-1:] for x in held], True
        if held is not None:
            yield by_sizes(held, part)
            for side, (key, size, uid, *_) in ((1, ends[0]), (2, [x[-1:] for x in held])):
                yield listed(side, uid, uid, part, key[0], size[0])

    return walk


def tested(similarity: float):
    """Rows (a, b, x, y): a forest of the pairs whose lines x and y link. Likely pairs are tested first; pairs that the
    forest joins by then need no test."""

    def test(batches):
        forest = Forest()
        for batch in batches:
            for i in range(0, batch.num_rows, LOT):
                a, b, x, y = (c.to_pylist() for c in batch.slice(i, LOT).columns)
                at = {u: t for u, t in zip(a + b, x + y, strict=True)}
                place, profile = dict(zip(at, range(len(at)), strict=True)), profiles(list(at.values()))
                most = ((1 - similarity) * np.array([max(map(len, t)) for t in zip(x, y, strict=True)]) + 1e-9).astype(np.int64)
                one, two = (np.array([place[u] for u in ids]) for ids in (a, b))
                far = np.concatenate([apart(profile[one[k : k + SIFTED]], profile[two[k : k + SIFTED]]) for k in range(0, len(a), SIFTED)])
                order = np.argsort(far / np.maximum(most, 1), kind="stable")
                order = order[far[order] <= 6 * most[order]]
                for n in range(0, len(order), SIFTED):
                    some = [k for k in order[n : n + SIFTED].tolist() if forest.find(a[k]) != forest.find(b[k])]
                    met = all_within([x[k] for k in some], [y[k] for k in some], most[some])
                    linked = [k for k, ok in zip(some, met.tolist(), strict=True) if ok]
                    forest.add(np.array([a[k] for k in linked], np.int64), np.array([b[k] for k in linked], np.int64))
        for a, b in forest.edges():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return test


def turn(rows: DataFrame, count: int, similarity: float, radius: int, along: bool = False) -> DataFrame:
    """Written table of what meets (see meeting()); with the links (side 3) across tasks: the last row of one and the first of the next."""
    parts = max(1, -(-count // TASK_KEYS))
    sims = [c for c in SIMS if c in rows.columns]
    rows = rows.repartitionByRange(parts, "key", "size", "uid").sortWithinPartitions("key", "size", "uid").select("key", "size", "uid", *sims)
    met = written(rows.mapInArrow(meeting(similarity, radius, along), MET), "met")
    ends = met.filter("side in (1, 2)").groupBy("part").agg(F.min(F.when(F.col("side") == 1, F.struct("key", "size", "a"))).alias("head"), F.min(F.when(F.col("side") == 2, F.struct("key", "size", "a"))).alias("tail"))
    ends = ends.withColumn("next", F.lead("head").over(Window.partitionBy(F.lit(0)).orderBy("part"))).filter("tail.key = next.key")
    out = met.unionByName(ends.select(F.lit(3).alias("side"), F.col("tail.a").alias("a"), F.col("next.a").alias("b"), "part", "tail.key", "tail.size"))
    out.written_at = met.written_at
    return out


def similar(every: DataFrame, copies: DataFrame, similarity: float, radius: int, block_bytes: int) -> DataFrame:
    """Links (a, b) of distinct lines. every: line_rows(), which are deleted when they have been read; copies: uid of the
    lines that an equal one stands for. No table is sent to all tasks: the plan is the same at every size."""
    texts = every.filter("text is not null").select("uid", "text")
    keys = texts.mapInArrow(hashed, "uid long, size int, sim long, sim2 long, sim3 long, keys array<long>").join(copies.hint("merge"), "uid", "left_anti")
    keys = written(keys.select("uid", "size", *SIMS, "keys"), "keys")
    met = turn(keys.select(F.explode("keys").alias("key"), "size", "uid", *SIMS), keys.agg(F.sum(F.size("keys"))).first()[0] or 0, similarity, radius)
    spent(keys)
    pairs = written(met.filter("side = 0").select("a", "b").distinct(), "pairs")
    groups = components(met.filter("side = 3").select("a", "b")).select(F.col("id").alias("uid"), F.col("component").alias("grp"))
    groups = written(groups, "groups")
    spent(met)
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("uid")).union(groups.select("uid")).distinct(), "needed")
    found = written(texts.join(needed.hint("merge"), "uid", "left_semi"), "sought")
    spent(every, needed)
    both = pairs.join(found.select(F.col("uid").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    both = both.join(found.select(F.col("uid").alias("b"), F.col("text").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
    links = written(both.mapInArrow(tested(similarity), "a long, b long"), "links")
    rows = written(found.join(groups.hint("merge"), "uid").select(F.col("uid").alias("id"), "grp", "text"), "members")
    spent(pairs, found, groups)
    sizes = written(rows.groupBy("grp").agg(F.ceil(F.sum(F.length("text")) / block_bytes).cast("int").alias("blocks")), "sizes")
    rows = rows.join(sizes.hint("merge"), "grp").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    return links.union(grouped_links(rows, LineIndex(similarity, radius), LOT_BYTES))


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.9, min_chars: int = 24, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per line: id, line, group (uid of its group's first known line; null if empty), size, kept."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = line_rows(docs, min_chars)
    every = written(texts.drop("text"), "numbered")  # the texts go when they have been compared
    named = every.filter("k1 is not null")
    distinct = written(named.groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.count("*").alias("n")), "distinct")
    many = distinct.filter("n > 1").select("k1", "k2", F.col("uid").alias("one"))
    copies = written(named.select("uid", "k1", "k2").join(many.hint("merge"), ["k1", "k2"]).filter("uid <> one").select("uid"), "copies")
    found = components(similar(texts, copies, similarity, radius, block_bytes)).select(F.col("id").alias("uid"), "component")
    groups = written(distinct.join(found.hint("merge"), "uid", "left").select("k1", "k2", F.coalesce("component", "uid").alias("grp")), "groups")
    lines = written(named.select("uid", "id", "line", "k1", "k2").join(groups.hint("merge"), ["k1", "k2"]).select("uid", "id", "line", "grp"), "grouped")
    first = written(lines.groupBy("grp").agg(F.min(F.struct("id", "line", "uid")).alias("first"), F.count("*").alias("size")), "first")
    marked = lines.join(first.hint("merge"), "grp").select("id", "line", F.col("grp").alias("group"), "size", (F.col("uid") == F.col("first.uid")).alias("kept"))
    bare = every.filter("k1 is null").select("id", "line", F.lit(None).cast("long").alias("group"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"))
    return marked.union(bare).withColumnRenamed("id", id_col)


def op4(spark, sf_dir: str) -> DataFrame:
    return fuzzy_lines(documents(spark, sf_dir))

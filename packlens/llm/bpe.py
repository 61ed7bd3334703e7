"""Operator 2: BPE encoding and decoding through a table of distinct words.

White space bounds every token of the vocabulary, so a text's ids are the ids of its words (runs outside space and
0x09-0x0D) in order.

1. Tasks cut chunks of texts into words: per chunk the distinct words, dealt by hash to owners, and for each text
   the positions (numbers of its words in the chunk's list). Positions are written bucketed by chunk.
2. An owner encodes each of its words once, however many chunks hold it, and answers each chunk.
3. Only the answers are shuffled, to the buckets of the positions: ids are joined back by position, and pieces by id
   (the vocabulary's fixed id-to-piece table), which gives the decoded text.

A word crosses the shuffle once per chunk, a text never. Null counts as empty text: no tokens. Repeated ids are separate
rows; equal texts get equal results. A text longer than a chunk is a chunk of its own. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import textvec as tv
from packlens.llm.common import documents, forget, input_bytes, shared_folder, written

#: Bytes of text in a chunk, but for a single longer text.
CHUNK_BYTES = 8 << 20
#: Bytes of input for which there is an owner of words, if the shuffle partitions are fewer.
OWNER_BYTES = 256 << 20
#: Pre-tokens of more bytes are merged one by one.
LONG = 48
#: Distinct words that a task keeps encoded.
KNOWN_WORDS = 1_000_000
INF = np.int32(1 << 30)
_tokenizers: OrderedDict = OrderedDict()
_coders: dict = {}

# What the vocabulary's file says of its normaliser and splitter, which are rebuilt here.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
KIND = np.full(256, 2, np.uint8)  # letters 0, digits 1, others 2
KIND[97:123], KIND[48:58] = 0, 1
ODD = np.zeros(256, bool)  # bytes of words that are not cut by kinds alone
ODD[128:] = True
ODD[[39, 60]] = True
_ascii = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_latin = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_unsafe = regex.compile("[\x00-\x20\x7f-\xa0\u0130\u0180-\U0010ffff]")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(x: np.ndarray) -> bytes:
    """Four-byte numbers with their first bytes together, then their second, and so on: they compress better."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def coded(x: np.ndarray) -> bytes:
    """Numbers below 2**31, small ones often: their bit lengths, compressed, then the bits after the first of all numbers
    of one length, packed."""
    x = x.astype(np.int64)
    size = np.zeros(len(x), np.uint8)
    for k in range(int(x.max(initial=0)).bit_length()):
        size += x >> k > 0
    head = pack(size.tobytes())
    out = [len(head).to_bytes(4, "little"), head]
    for k in range(2, int(size.max(initial=0)) + 1):
        own = x[size == k]
        bits = own[:, None] >> np.arange(k - 2, -1, -1) & 1 if k <= 9 else None
        if bits is None:  # whole low bytes as they are, the rest as bits
            bits = own[:, None] >> np.arange(k - 2, 7, -1) & 1
            out.append((own & 255).astype(np.uint8).tobytes())
        out.append(np.packbits(bits.astype(np.uint8)).tobytes())
    return b"".join(out)


def decoded(data: bytes) -> np.ndarray:
    at = 4 + int.from_bytes(data[:4], "little")
    size = np.frombuffer(unpack(data[4:at]), np.uint8)
    out = np.where(size > 0, 1, 0).astype(np.int64)
    for k in range(2, int(size.max(initial=0)) + 1):
        own = np.flatnonzero(size == k)
        low, n = 0, k - 1
        if k > 9:
            low, n = np.frombuffer(data, np.uint8, len(own), at).astype(np.int64), k - 9
            at += len(own)
        used = -(-len(own) * n // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, used, at))[: len(own) * n].reshape(-1, n).astype(np.int64)
        at += used
        value = np.ones(len(own), np.int64)
        for i in range(n):
            value = value << 1 | bits[:, i]
        out[own] = value << 8 | low if k > 9 else value
    return out


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lens)
    out = np.arange(ends[-1] if len(ends) else 0)
    return out + np.repeat(starts - (ends - lens), lens)


class Merges:
    """The vocabulary's merges over the symbols of many pre-tokens at once: in each round, every pre-token merges its
    pair of lowest rank, wherever it occurs."""

    BITS = (20, 16, 15, 14, 13, 12)

    def __init__(self, vocab: dict[str, int], merges: list):
        # the byte alphabet: printable bytes stand for themselves, the others take the code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        char = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.first = np.array([[vocab[char[b]], vocab[char[b] + "</w>"]] for b in range(256)], np.int32).T
        code = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.to = np.array([vocab[a + b] for a, b in merges], np.int32)
        # a table by hash of the pair; the next ones hold what found its place taken
        self.tables, rest = [], np.arange(len(code))
        for bits in self.BITS:
            keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, INF, np.int32)
            at = self.slot(code[rest], bits)
            _, one = np.unique(at, return_index=True)
            keys[at[one]], ranks[at[one]] = code[rest[one]], rest[one]
            self.tables.append((bits, keys, ranks))
            rest = np.delete(rest, one)
            if not len(rest):
                break
        if len(rest):
            raise ValueError("the pairs find no place")

    @staticmethod
    def slot(code: np.ndarray, bits: int) -> np.ndarray:
        return (code * np.int64(-7046029254386353131 + 2 * bits)) >> np.int64(64 - bits) & np.int64((1 << bits) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) << 20 | b
        out = np.full(len(code), INF, np.int32)
        for bits, keys, ranks in self.tables:
            at = self.slot(code, bits)
            np.copyto(out, ranks[at], where=keys[at] == code)
        return out

    def merge(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sym: symbols of all pre-tokens, starts: where each begins. Their ids, and how many each pre-token has."""
        n, first = len(starts), starts
        seg = np.repeat(np.arange(n), np.diff(starts, append=len(sym)))
        rank = np.full(len(sym), INF, np.int32)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        ids, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        while len(sym):
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(sym)))
            live = lowest < INF
            if not live.all():
                ids.append(sym[~live])
                owner.append(seg[~live])
                sym, seg, rank, lowest = sym[live], seg[live], rank[live], lowest[live]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == lowest)
            if (np.diff(pick) == 1).any():  # a run of one symbol: every second pair
                run = np.cumsum(np.diff(pick, prepend=-9) != 1)
                pick = pick[(np.arange(len(pick)) - np.searchsorted(run, run)) % 2 == 0]
            sym[pick] = self.to[rank[pick]]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            at = (np.cumsum(keep) - 1)[pick]
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            again = np.concatenate([at, at[at > 0] - 1])
            rank[again] = INF
            again = again[again + 1 < len(sym)]
            again = again[seg[again] == seg[again + 1]]
            rank[again] = self.rank(sym[again], sym[again + 1])
            first = np.flatnonzero(np.diff(seg, prepend=-1))
        owner = np.concatenate(owner)
        return np.concatenate(ids)[np.argsort(owner, kind="stable")].astype(np.uint32), np.bincount(owner, minlength=n)


def pre_tokens(w: bytes) -> list[bytes] | None:
    """A word as the vocabulary's normaliser and splitter cut it; None for rare scripts and marks."""
    if w.isascii():
        w = w.lower()
        return [w] if w.isalpha() else None if b"<|" in w else _ascii.findall(w)
    t = w.decode()
    if _unsafe.search(t) or "<|" in t:
        return None
    t = t.lower()
    return [t.encode()] if t.isalpha() else [x.encode() for x in _latin.findall(t)]


class Coder:
    """Ids of words, as the tokenizers library gives them."""

    def __init__(self, path: str):
        self.whole = tokenizer(path)
        d = json.loads(self.whole.to_str())
        if any(d[k] != v for k, v in RULES.items()) or d["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{path}: only vocabularies with the word rules in RULES can be encoded by words")
        self.merges = Merges(d["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]])

    def one_by_one(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.whole.encode_batch_fast([w.decode() for w in found], add_special_tokens=False)]
        return np.array([i for e in got for i in e], np.uint32), np.array([len(e) for e in got], np.int64)

    def merged(self, data: np.ndarray, starts: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens (bytes and where each begins; `own`: the word of each), and how many each of n words has."""
        end = np.zeros(len(data), np.int8)
        end[starts[1:] - 1] = 1
        end[-1:] = 1
        ids, count = self.merges.merge(self.merges.first[end, data], starts)
        return ids, np.bincount(own, count, n).astype(np.int64)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[start:end], one word after the other, and how many each has."""
        n, lens = len(starts), ends - starts
        bad = np.concatenate([[0], np.cumsum(ODD[data])])
        plain = (bad[ends] == bad[starts]) & (lens <= LONG)
        parts = []
        some = np.flatnonzero(plain)
        if len(some):
            b = tv.LOWER[data[ranges(starts[some], lens[some])]]
            first = np.zeros(len(b), bool)
            first[np.cumsum(lens[some]) - lens[some]] = True
            word = np.cumsum(first) - 1
            kind = KIND[b]
            first[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 1)
            at = np.flatnonzero(first)
            parts.append((some, *self.merged(b, at, word[at], len(some))))
        rest = np.flatnonzero(~plain)
        if len(rest):
            words = [data[a:z].tobytes() for a, z in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            cut = [pre_tokens(w) for w in words]
            slow = np.array([c is None or any(len(x) > LONG for x in c) for c in cut])
            fast = [c for c, s in zip(cut, slow, strict=True) if not s]
            pieces = [x for c in fast for x in c]
            if fast:
                size = np.array([len(x) for x in pieces], np.int64)
                own = np.repeat(np.arange(len(fast)), [len(c) for c in fast])
                parts.append((rest[~slow], *self.merged(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, own, len(fast))))
            if slow.any():
                parts.append((rest[slow], *self.one_by_one([w for w, s in zip(words, slow, strict=True) if s])))
        count = np.zeros(n, np.int64)
        for which, _, c in parts:
            count[which] = c
        first = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.uint32)
        for which, got, c in parts:
            ids[ranges(first[which], c)] = got
        return ids, count


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_words(path: str, found: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The ids of all words in one array, and the bounds of each word in it."""
    size = np.array([len(w) for w in found], np.int64)
    ends = np.cumsum(size)
    ids, count = coder(path).encode(np.frombuffer(b"".join(found), np.uint8), ends - size, ends)
    return ids, np.cumsum([0, *count]).tolist()


def distinct(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal hashes one index each, and for each hash the number of its own. `check`: a second hash, which must agree."""
    rep = np.empty(len(h), np.int64)
    rest, turn = np.arange(len(h)), 0
    bits = max(8, len(h).bit_length() + 1)
    table = np.empty(1 << bits, np.int32)
    while len(rest):
        own = h[rest]
        slot = (own * np.uint64(2 * turn + 1) + np.uint64(turn) >> np.uint64(64 - bits)).astype(np.int64)
        table[slot] = rest
        at = table[slot]
        same = h[at] == own
        rep[rest[same]] = at[same]
        rest, turn = rest[~same], turn + 1
    if (check[rep] != check).any():  # two words of one hash
        _, first, number = np.unique(np.stack([h, check], 1), axis=0, return_index=True, return_inverse=True)
        return first, number.ravel()
    mark = np.zeros(len(h), bool)
    mark[rep] = True
    return np.flatnonzero(mark), (np.cumsum(mark) - 1)[rep]


OTHER = tv.mix(tv.BYTES, 41)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, check = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # in pieces: the sums take eight bytes for each byte
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 19))))
        a, z = starts[i], ends[j - 1]
        part = data[a:z]
        h[i:j] = tv.rolled(tv.BYTES[part], starts[i:j] - a, ends[i:j] - a)
        check[i:j] = tv.rolled(OTHER[part], starts[i:j] - a, ends[i:j] - a)
        i = j
    return h, check


class Known:
    """Words that were encoded, by hash: at most `most`; the words that come first stay."""

    def __init__(self, path: str, most: int):
        self.coder, self.most = coder(path), most
        self.h = self.check = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, data, starts, ends, h, check) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and for each word (distinct) where its ids begin and how many they are."""
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        had = (self.h[at] == h) & (self.check[at] == check) if len(self.h) else np.zeros(len(h), bool)
        new = np.flatnonzero(~had)
        ids, count = self.coder.encode(data, starts[new], ends[new])
        first, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        first[had], size[had] = self.at[at[had]], self.size[at[had]]
        base = len(self.ids)
        first[new], size[new] = base + np.cumsum(count) - count, count
        every = np.concatenate([self.ids, ids])
        if len(self.h) + len(new) <= self.most:
            order = np.argsort(np.concatenate([self.h, h[new]]), kind="stable")
            self.h, self.check = (np.concatenate(x)[order] for x in ((self.h, h[new]), (self.check, check[new])))
            self.at, self.size = (np.concatenate(x)[order] for x in ((self.at, first[new]), (self.size, size[new])))
            self.ids = every
        return every, first, size


def chunks(batches, size: int):
    """(ids, offsets, bytes) of about `size` bytes of whole texts."""
    ids, offs, parts, held = [], [np.zeros(1, np.int64)], [], 0
    for b in batches:
        col_offs, data = tv.utf8(b.column(1))
        own = b.column(0).to_pylist()
        for i, j in tv.pieces(col_offs, size):
            while i < j:  # no further than the chunk's size
                k = min(j, max(i + 1, int(np.searchsorted(col_offs, col_offs[i] + size - held, "right")) - 1))
                ids += own[i:k]
                offs.append(col_offs[i + 1 : k + 1] - col_offs[i] + held)
                parts.append(data[col_offs[i] : col_offs[k]])
                held += len(parts[-1])
                i = k
                if held >= size // 2 and (i < j or held >= size):
                    yield ids, np.concatenate(offs), np.concatenate(parts)
                    ids, offs, parts, held = [], [np.zeros(1, np.int64)], [], 0
    if ids:
        yield ids, np.concatenate(offs), np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, each followed by a space."""
    lens = ends - starts
    out = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
    out[ranges(np.cumsum(lens + 1) - lens - 1, lens)] = data[ranges(starts, lens)]
    return out.tobytes()


class Pieces:
    """Strings of ids by number, as bytes with a space after each."""

    def __init__(self, strings: list[str]):
        raw = [s.encode() + b" " for s in strings]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each ends."""
        size = self.size[ids]
        return self.data[ranges(self.at[ids], size)], np.cumsum(size)


def bucketed(df: DataFrame, buckets: int) -> tuple[str, str]:
    """df (kind, chunk, ...) as a table in the shared folder by kind and in buckets by chunk; its name and path."""
    spark = df.sparkSession
    name = f"positions_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.partitionBy("kind").bucketBy(buckets, "chunk").option("path", path).format("parquet").saveAsTable(name)
    forget(spark, path)
    return name, path


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, owners: int | None = None, texts: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; with `texts` also ids (array<int>) and decoded."""
    spark = docs.sparkSession
    path = path or vocabulary()
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    owners = owners or max(buckets, input_bytes(docs) // OWNER_BYTES)

    def split(batches):
        part = TaskContext.get().partitionId() << 32
        for seq, (ids, offs, data) in enumerate(chunks(batches, CHUNK_BYTES)):
            starts, ends, first = tv.words(offs, data)
            h, check = word_hashes(data, starts, ends)
            one, number = distinct(h, check)
            order = np.argsort(-np.bincount(number, minlength=len(one)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(one), np.int64)
            rank[order] = np.arange(len(one))
            one = one[order]
            owner = ((h[one] >> np.uint64(20)) % np.uint64(owners)).astype(np.int64)
            out = {"kind": [0], "chunk": [part + seq], "owner": [-1], "payload": [coded(rank[number])], "owned": [pack(planes(owner))], "ids": [ids], "counts": [np.diff(first).tolist()]}
            turn = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[turn], np.arange(owners + 1))
            for o in np.flatnonzero(np.diff(cuts)).tolist():
                mine = one[turn[cuts[o] : cuts[o + 1]]]
                for k, v in (("kind", 1), ("chunk", part + seq), ("owner", o), ("payload", pack(joined(data, starts[mine], ends[mine]))), ("owned", None), ("ids", None), ("counts", None)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("owner", pa.int32()), ("payload", pa.binary()), ("owned", pa.binary()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))

    fields = "kind int, chunk long, owner int, payload binary, owned binary, ids array<long>, counts array<long>"
    name, place = bucketed(docs.mapInArrow(split, fields), buckets)
    sent = spark.table(name)

    def encode(batches):
        known = Known(path, KNOWN_WORDS)
        for b in batches:
            out = []
            for p in b.column("payload"):
                data = np.frombuffer(unpack(p.as_py()), np.uint8)
                starts, ends, _ = tv.words(np.array([0, len(data)]), data)
                ids, at, size = known.encode(data, starts, ends, *word_hashes(data, starts, ends))
                out.append(pack(planes(np.concatenate([size, ids[ranges(at, size)]]))))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("owner"), pa.array(out, pa.binary())], ["chunk", "owner", "payload"])

    words = sent.filter("kind = 1").select("chunk", "owner", "payload").repartition(owners, "owner").sortWithinPartitions("owner", "chunk")
    answers = written(words.mapInArrow(encode, "chunk long, owner int, payload binary"), "answers")
    forget(spark, f"{place}/kind=1", now=True)
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("owner", "payload")).alias("answers"))
    # the positions lie in buckets by chunk: only the answers move
    met = sent.filter("kind = 0").select("chunk", "payload", "owned", "ids", "counts").join(answers.hint("merge"), "chunk", "left")

    def put_back(batches):
        whole = tokenizer(path)
        piece = [whole.id_to_token(i) or "" for i in range(whole.get_vocab_size())]
        number, piece = Pieces([str(i) for i in range(len(piece))]), Pieces(piece)
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                owner = from_planes(unpack(r["owned"]))
                at, size, pool, held = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), [np.zeros(0, np.uint32)], 0
                for a in r["answers"] or ():
                    own = np.flatnonzero(owner == a["owner"])
                    got = from_planes(unpack(a["payload"]))
                    size[own] = got[: len(own)]
                    at[own] = held + np.cumsum(size[own]) - size[own]
                    pool.append(got[len(own) :])
                    held += len(pool[-1])
                pool, codes = np.concatenate(pool), decoded(r["payload"])
                bounds = np.cumsum([0, *r["counts"]])
                total = np.concatenate([[0], np.cumsum(size[codes])])
                rows = [(hashlib.sha256(), hashlib.sha256(), [], []) for _ in r["ids"]]
                for low, high, a, z in lots(bounds):
                    ids = pool[ranges(at[codes[a:z]], size[codes[a:z]])]
                    both = [x.join(ids) for x in (number, piece)]
                    for d in range(low, high):
                        i, j = total[max(a, bounds[d])] - total[a], total[min(z, bounds[d + 1])] - total[a]
                        if i == j:
                            continue
                        for (data, ends), digest in zip(both, rows[d], strict=False):
                            if total[max(a, bounds[d])] > total[bounds[d]]:  # an earlier lot had some of it
                                digest.update(b" ")
                            digest.update(data[ends[i - 1] if i else 0 : ends[j - 1] - 1])
                        if texts:
                            rows[d][2].extend(ids[i:j].tolist())
                n = total[bounds[1:]] - total[bounds[:-1]]
                every = [whole.id_to_token(i) for i in range(whole.get_vocab_size())] if texts else None
                cols = [r["ids"], n, [x[0].hexdigest() for x in rows], [x[1].hexdigest() for x in rows], [x[2] for x in rows] if texts else [None] * len(rows), [" ".join([every[i] for i in x[2]]) for x in rows] if texts else [None] * len(rows)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    out = met.mapInArrow(put_back, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    return (out if texts else out.drop("ids", "decoded")).withColumnRenamed("id", id_col)


def lots(bounds: np.ndarray, most: int = 100_000):
    """(first document, end, first word, end): whole documents of about `most` words, or parts of a longer one."""
    d, n = 0, len(bounds) - 1
    while d < n:
        if bounds[d + 1] - bounds[d] > most:
            for a in range(int(bounds[d]), int(bounds[d + 1]), most):
                yield d, d + 1, a, min(a + most, int(bounds[d + 1]))
            d += 1
        else:
            e = int(np.searchsorted(bounds, bounds[d] + most, "right")) - 1
            yield d, e, int(bounds[d]), int(bounds[e])
            d = e


def op2(spark, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))

"""Operator 1: language identification with interpolated Kneser-Ney character models.

Training draws a bounded sample: about `sample` labelled texts of each language (a hash of the id decides), whole
texts, counted on the driver; a fifth of them is kept apart for calibration. Each language gets models of order 1 to
ORDER over letters of words (case folded, padded by word ends), stored as sorted arrays of 64-bit n-gram hashes with
discounted probabilities, and of context hashes with back-off weights. The arrays are broadcast: their size is bound
by the sample. A text's score for a language is its cross-entropy for each letter; the lowest wins.

`rejected`: the winner's cross-entropy is above what the calibration texts of that language show (mean plus z times
a deviation that falls with length, and at least `margin` nats), or the text has no letter (then lang_pred is `und`). Null, empty and letterless
texts are `und` with score 0. Languages tie by name. Without any labelled text every row is `und`. Repeated ids are
separate rows. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import textvec as tv
from packlens.llm.common import documents

ORDER = 4
#: Labelled texts of each language in the sample, about.
SAMPLE = 400
#: Words whose scores a worker keeps, and words that are scored at once.
CACHE_WORDS, NEW_WORDS = 200_000, 20_000
#: Texts, and their bytes, that a worker holds as words at once.
LOT_TEXTS, LOT_BYTES = 256, 1 << 20
PAD, END = 1, 2
LETTERS = re.compile(r"[^\W\d_]+")


def letters(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each after ORDER - 1 pads and before an end mark; the word each belongs to."""
    raw = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.array([len(w) for w in found], np.int64)
    own = np.repeat(np.arange(len(found)), lens + ORDER)
    out = np.full(len(own), PAD, np.uint64)
    first = np.cumsum(lens + ORDER) - (lens + ORDER)
    at = np.arange(len(raw)) + np.repeat((np.arange(len(found)) * ORDER) + ORDER - 1, lens)
    out[at] = raw
    out[first + ORDER - 1 + lens] = END
    return out, own


def gram_hashes(x: np.ndarray) -> list[np.ndarray]:
    """For n = 0 .. ORDER the hash of the n letters that end at each place."""
    out = [np.zeros(len(x), np.uint64)]
    for n in range(1, ORDER + 1):
        before = np.zeros(len(x), np.uint64)
        before[n - 1 :] = x[: len(x) - n + 1]
        out.append(tv.mix(out[-1] * np.uint64(tv.BASE) + before, n))
    return out


def lookup(keys: np.ndarray, values: np.ndarray, x: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), default)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], default)


class KneserNey:
    """One language's model: per order, sorted n-gram hashes with discounted probabilities, and sorted context
    hashes with the weight of the next lower order."""

    def __init__(self, words: list[str], alphabet: int):
        x, _ = letters(words)
        here = x != PAD
        grams = gram_hashes(x)
        before = [np.concatenate([[np.uint64(0)], g[:-1]]) for g in grams]  # the context ends one place earlier
        self.base = 1.0 / (alphabet + 1)
        self.grams, self.weights = [], []
        upper = None
        for n in range(ORDER, 0, -1):
            if upper is None:
                keys, first, count = np.unique(grams[n][here], return_index=True, return_counts=True)
                first = np.flatnonzero(here)[first]
            else:  # continuation counts: distinct longer grams that end in this one
                keys, at, count = np.unique(grams[n][upper], return_index=True, return_counts=True)
                first = upper[at]
            upper = first
            n1, n2 = int((count == 1).sum()), int((count == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, of = np.unique(before[n - 1][first] if n > 1 else np.zeros(len(first), np.uint64), return_inverse=True)
            total, kinds = np.bincount(of, count), np.bincount(of)
            self.grams.insert(0, (keys, ((count - d) / total[of])))
            self.weights.insert(0, (context, d * kinds / total))

    def log_probs(self, grams: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(grams[0]), self.base)
        for n in range(1, ORDER + 1):
            context = before[n - 1] if n > 1 else np.zeros(len(p), np.uint64)
            p = lookup(*self.grams[n - 1], grams[n], 0.0) + lookup(*self.weights[n - 1], context, 1.0) * p
        return np.log(p)


class Model:
    def __init__(self, texts: dict[str, list[str]], held: dict[str, list[str]], z: float = 8.0, margin: float = 0.75):
        self.langs = sorted(texts)
        words = {k: LETTERS.findall("\n".join(v).lower()) for k, v in texts.items()}
        alphabet = len(set().union(*(set("".join(w)) for w in words.values()))) if words else 0
        self.models = [KneserNey(words[k], alphabet) for k in self.langs if words[k]]
        self.langs = [k for k in self.langs if words[k]]
        self.limits, self.margin = [], margin
        for k, lang in enumerate(self.langs):
            rows = [self.word_scores(w).sum(0) for t in held.get(lang, []) + texts[lang][:50] if (w := LETTERS.findall(t.lower()))]
            s = np.array(rows).reshape(-1, len(self.langs) + 1)
            ce, n = -s[:, k] / s[:, -1], s[:, -1]
            mean = float((ce * n).sum() / n.sum())
            # deviation for each letter, and between texts
            self.limits.append((mean, z * float(np.sqrt(((ce - mean) ** 2 * n).mean())), z * float(ce[n >= np.median(n)].std() if len(n) > 3 else 0.1)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Per word: the log-probability in each language, and the number of letters and end marks."""
        x, own = letters(words)
        here = x != PAD
        grams = gram_hashes(x)
        before = [np.concatenate([[np.uint64(0)], g[:-1]])[here] for g in grams]
        grams, own = [g[here] for g in grams], own[here]
        cols = [np.bincount(own, m.log_probs(grams, before), len(words)) for m in self.models]
        return np.stack([*cols, np.bincount(own, minlength=len(words)).astype(float)], 1)

    def judge(self, sums: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each row of summed word scores."""
        n = sums[:, -1]
        some = n > 0
        ce = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
        best = ce.argmin(1)
        low = ce[np.arange(len(n)), best]
        # how likely the winner is, as if every tenth letter counted
        score = 1 / np.exp((low[:, None] - ce) * np.maximum(1, n / 10)[:, None]).sum(1)
        mean, letter, text = (np.array([x[i] for x in self.limits])[best] for i in range(3))
        rejected = ~some | (low > mean + np.maximum(self.margin, np.sqrt(letter**2 / np.maximum(n, 1) + text**2)))
        return [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0), np.where(some, low, 0.0), rejected


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: id, text, lang; the caller leaves out what must not be learned from."""
    docs = docs.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Model({}, {})
    bound = F.lit(0)
    for lang, n in counts.items():
        bound = F.when(F.col("lang") == lang, int(min(1.0, sample / n) * 1_000_000)).otherwise(bound)
    draw = F.expr("pmod(xxhash64(id, 77), 1000000)")
    rows = docs.filter(draw < bound).select("id", "text", "lang", F.expr("pmod(xxhash64(id, 78), 5) = 0").alias("held")).toPandas().sort_values(["id", "text"])
    texts = {k: list(g["text"]) for k, g in rows[~rows["held"]].groupby("lang")}
    return Model(texts, {k: list(g["text"]) for k, g in rows[rows["held"]].groupby("lang")})


_words: dict = {}


def lots(texts: pa.Array):
    """(start, count) of runs of at most LOT_TEXTS texts and, but for single texts, LOT_BYTES bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start == LOT_TEXTS or held + n > LOT_BYTES):
            yield start, i - start
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with __lang_pred, __score, __cross_entropy and __rejected; `keep`: the columns of docs to return, else id only."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    keep = keep or [id_col]
    own = text_col if text_col in keep else "__text"  # no text is sent twice
    docs = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias(own)]))
    schema = docs.select(*keep).schema
    names = [f.name for f in schema.fields]

    def score(batches):
        model = sent.value
        if _words.get("model") is not model:
            _words.clear()
            _words.update(model=model, at={}, scores=np.zeros((1 << 10, len(model.langs) + 1)))
        for whole in batches:
            for start, count in lots(whole.column(own)):
                b = whole.slice(start, count)
                texts, sums = b.column(own).to_pylist(), []
                rows = [LETTERS.findall(t.lower()) if t else [] for t in texts]
                every = set().union(*rows)
                new = [w for w in every if w not in _words["at"]]
                if new and len(_words["at"]) + len(new) > CACHE_WORDS:
                    _words["at"] = {}
                    new = list(every)
                at = _words["at"]
                if new and model.langs:
                    n = len(at)
                    if n + len(new) > len(_words["scores"]):
                        _words["scores"] = np.concatenate([_words["scores"], np.zeros((n + len(new), _words["scores"].shape[1]))])
                    for k in range(0, len(new), NEW_WORDS):
                        part = new[k : k + NEW_WORDS]
                        _words["scores"][n + k : n + k + len(part)] = model.word_scores(part)
                    at.update(zip(new, range(n, n + len(new)), strict=True))
                scores = _words["scores"]
                for r in rows:
                    sums.append(scores[np.fromiter(map(at.__getitem__, r), np.int64, len(r))].sum(0) if r and model.langs else np.zeros(scores.shape[1]))
                lang, sure, ce, rejected = model.judge(np.array(sums).reshape(len(texts), -1))
                cols = [b.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(ce, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "__lang_pred", "__score", "__cross_entropy", "__rejected"])

    out = schema.add("__lang_pred", "string").add("__score", "double").add("__cross_entropy", "double").add("__rejected", "boolean")
    return docs.mapInArrow(score, out)


def held_out(col: str = "doc_id"):
    return F.expr(f"coalesce(crc32(cast({col} as string)) % 5 = 0, false)")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    out = predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), *(F.col(f"__{c}").alias(c) for c in ("lang_pred", "score", "cross_entropy", "rejected")))

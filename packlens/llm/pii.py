"""Operator 3: personal data by base patterns and bootstrapped contexts. DataFrame functions only.

Base spans are those of four patterns (leftmost, not overlapping within a kind), checked: IP parts up to 255, cards
of 12 to 19 digits passing Luhn, phones of 9 to 15 digits. The regular expressions here find the same spans in
linear time and without recursion on long texts: runs are possessive and start where a run starts, and separators
that can or cannot join two parts are marked beforehand, character for character. Offsets come from the lengths of
what lies between matches.

Bootstrapping: every word with a digit or an @ is an instance; its patterns are the word before it, and the two words
before it (digits masked, lower case, "^" at the start of a text; CONTEXT code points are looked at). Instances that hold a
base span are seeds of its kind; long words of letters and digits are seeds of a fifth kind, `secret`, which has no base
spans. In each round a pattern's score for a kind is the mean score of its distinct instances, and an instance takes the
best score of its patterns; instances found in one round support further patterns in the next. Patterns with enough
support and score give their instances, trimmed of punctuation, as new spans of that kind; these must look like it: an @
within for email, dots for ip, letters and digits for secrets, otherwise as many digits as the kind has. Scores are sums by
key, combined before each shuffle and written, so that a frequent pattern's rows can be split where they are joined.

Null texts are empty: no spans. Repeated ids are separate rows. Other columns are ignored. A span is start and end
in code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import documents, written

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
#: Code points before an instance in which its patterns are sought.
CONTEXT = 128
SECRET = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_-]{24,}$"
MARK = "\ue000"
LOCAL = "A-Za-z0-9._%+" + MARK + "-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def spans(text: Column, pattern: str, may: Column, kind: int) -> Column:
    """array<struct<s, k, e, m>> of the matches; `may` is a cheap condition without which there are none."""
    z = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))
    none = F.expr("cast(array() as array<struct<s: int, k: int, e: int, m: string>>)")

    def step(a: Column, x: Column) -> Column:
        gap, match = x["gap"], x["match"]
        start = a["p"] + F.length(gap)
        one = F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + F.length(match)).alias("e"), match.alias("m"))
        return F.struct((start + F.coalesce(F.length(match), F.lit(0))).alias("p"), F.when(match.isNull(), a["o"]).otherwise(F.concat(a["o"], F.array(one))).alias("o"))

    return F.when(may, F.aggregate(z, F.struct(F.lit(0).alias("p"), none.alias("o")), step, lambda a: a["o"])).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


def valid_ip(m: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """All checked base spans by start, then kind."""
    neutral = F.translate(text, MARK, "\n")
    dotted = F.regexp_replace(neutral, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    joined = F.regexp_replace(text, "(?<![0-9])[ -]|[ -](?![0-9])", "\n")
    some = text.rlike("[0-9]")
    email = spans(dotted, EMAIL, text.contains("@"), 0)
    ip = F.filter(spans(text, IP, text.rlike(r"[0-9]\.[0-9]"), 1), lambda x: valid_ip(x["m"]))
    card = F.filter(spans(joined, CARD, some, 2), lambda x: F.length(digits(x["m"])).between(12, 19) & luhn(digits(x["m"])))
    phone = F.filter(spans(text, PHONE, text.contains("+"), 3), lambda x: F.length(digits(x["m"])).between(9, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def instances(text: Column) -> Column:
    """array<struct<s, e, m, before>>: words with a digit or an @, and the word before each."""
    found = spans(text, INSTANCE, text.rlike("[0-9@]"), 0)
    near = lambda x: F.substring(text, F.greatest(F.lit(1), x["s"] - CONTEXT + 1), F.least(F.lit(CONTEXT), x["s"]))
    words = lambda x: F.regexp_extract(F.lower(near(x)), r"((?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]*)[\x20\x09-\x0D]*$", 1)
    two = lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(words(x), r"[\x20\x09-\x0D]+", " ")), "[0-9]", "#"), "^$", "^")
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), two(x).alias("before")))


def body(m: Column) -> Column:
    """An instance without the punctuation around it."""
    return F.regexp_replace(F.regexp_replace(m, r"^[^A-Za-z0-9+]+", ""), r"[^A-Za-z0-9]+$", "")


def named(x: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), F.lit(":"), x["s"], F.lit(":"), x["e"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_seeds: int = 5, min_score: float = 0.8) -> DataFrame:
    """Per row: id, th (hash of the text), base and spans: arrays of struct<s, k, e> (k an index of KINDS)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    base = rows.select("id", F.xxhash64("t").alias("th"), base_spans(F.col("t")).alias("base"), instances(F.col("t")).alias("found"))
    base = written(base.withColumn("uid", F.monotonically_increasing_id()), "pii")
    each = base.select("uid", "base", F.inline("found"))
    held = F.transform(F.filter("base", lambda b: (b["s"] < F.col("e")) & (F.col("s") < b["e"])), lambda b: b["k"])
    secret = F.when(body(F.col("m")).rlike(SECRET), F.array(F.lit(4))).otherwise(F.expr("cast(array() as array<int>)"))
    each = each.select("uid", "s", "e", "m", F.explode(F.array_distinct(F.array("before", F.substring_index("before", " ", -1)))).alias("before"), F.array_distinct(F.concat(held, F.when(F.size(held) == 0, secret).otherwise(F.expr("cast(array() as array<int>)")))).alias("held"))
    each = written(each.withColumn("node", F.xxhash64("m")).withColumn("pattern", F.xxhash64("before")), "instances")
    # the graph: distinct (pattern, instance); seeds have score 1 for their kinds
    every = range(len(KINDS))
    graph = each.groupBy("pattern", "node").agg(*[F.max(F.array_contains("held", k).cast("double")).alias(f"k{k}") for k in every])
    graph = graph.select("pattern", "node", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("seed")) for k in every])).alias("x"))
    graph = written(graph.select("pattern", "node", "x.k", "x.seed"), "graph")
    seeds = written(graph.groupBy("node", "k").agg(F.max("seed").alias("seed")), "seeds")
    score, patterns = seeds.select("node", "k", F.col("seed").alias("score")), None
    for _ in range(rounds):
        live = graph.select("pattern", "node", "k").join(score.hint("merge"), ["node", "k"])
        patterns = written(live.groupBy("pattern", "k").agg(F.avg("score").alias("p"), F.sum((F.col("score") >= min_score).cast("long")).alias("support")), "patterns")
        good = patterns.filter((F.col("p") >= min_score) & (F.col("support") >= min_seeds)).select("pattern", "k", "p")
        best = written(graph.select("pattern", "node", "k").join(good.hint("merge"), ["pattern", "k"]).groupBy("node", "k").agg(F.max("p").alias("p")), "best")
        score = written(seeds.join(best.hint("merge"), ["node", "k"], "left").select("node", "k", F.greatest("seed", F.coalesce("p", F.lit(0.0))).alias("score")), "scores")
    good = good.select("pattern", "k")
    lead = F.length(F.regexp_extract("m", r"^[^A-Za-z0-9+]*", 0))
    n = F.length(digits(F.col("body")))
    like = F.when(F.col("k") == 0, F.col("body").rlike(".@.")).when(F.col("k") == 1, F.col("body").rlike(r"[0-9]\.[0-9]")).when(F.col("k") == 2, n.between(12, 19)).when(F.col("k") == 3, n.between(7, 15)).otherwise(F.col("body").rlike("^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_-]{16,}$"))
    free = each.filter((F.size("held") == 0) | F.array_contains("held", 4))
    new = free.join(good.hint("merge"), "pattern").withColumns({"s": F.col("s") + lead, "body": body(F.col("m"))})
    new = new.filter(like).groupBy("uid").agg(F.collect_set(F.struct("s", F.col("k").cast("int").alias("k"), (F.col("s") + F.length("body")).alias("e"))).alias("more"))
    slim = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    none = F.expr("cast(array() as array<struct<s: int, k: int, e: int>>)")
    out = base.select("uid", "id", "th", slim.alias("base")).join(new, "uid", "left")
    return out.select(F.col("id").alias(id_col), "th", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span inside an earlier one is dropped."""
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(a: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, a["p"] + 1, F.greatest(x["s"] - a["p"], F.lit(0))), F.element_at(label, x["k"] + 1))
        ahead = x["s"] >= a["p"]
        return F.struct(F.when(ahead, x["e"]).otherwise(F.greatest(a["p"], x["e"])).alias("p"), F.when(ahead, F.concat(a["o"], piece)).otherwise(a["o"]).alias("o"))

    return F.aggregate(found, F.struct(F.lit(0).alias("p"), F.lit("").alias("o")), step, lambda a: F.concat(a["o"], F.substring(text, a["p"] + 1, F.length(text))))


def op3(spark, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, named), ",")
    number = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))

"""Operators of the llm subpackage on small tables, against brute force; nulls, ties, repeats and clashing columns."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from packlens.llm import bpe, dedup, fingerprint, jaccard, langid, licenses, lines, packing, pii, queries, substrings
from packlens.llm.groups import local_components
from packlens.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, rejected string"
BASE = " ".join(f"w{i}" for i in range(120))
TEXTS = [None, "", " ", "one two", BASE, BASE, BASE.replace("w50 ", "zz "), "intro " + BASE, BASE.upper(), "mail a@b.co, 1.2.3.4 or +49 30 1234567 card 4111 1111 1111 1111", "x" * 5000, "Released under the MIT License.\nOther line of some length here.", BASE + " " + BASE]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i % 3 else "s", 0, 7, 7, "x") for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def test_jaccard(docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words=4, percent=85, block_shingles=150).collect()}
    sets = []
    for t in TEXTS:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    up = list(range(len(sets)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 85 * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert not jaccard.jaccard_components(none).collect()


@pytest.mark.parametrize("name", ["op6_jaccard_join", "op10_substring_dedup"])
def test_sql_of_queries(spark, tmp_path, name):
    """The query and its SQL over texts with copies, near copies, nulls and a text that repeats itself."""
    ship(spark)
    near = [BASE.replace(f"w{i} ", "zz ") for i in range(0, 60, 7)]
    spark.createDataFrame(list(enumerate(TEXTS + near)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == sorted(want.fetchall())


def test_golomb():
    for n in (1, 2, 50, 3000):
        x = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
        assert (dedup.golomb_decode(dedup.golomb_encode(x, 2**63)) == x).all()


def test_exact(docs, none):
    con = duckdb.connect()
    frame = docs.toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    want = sorted(con.execute(dedup.OP7_SQL).fetchall())
    assert sorted(tuple(r) for r in dedup.exact_groups(docs).collect()) == want
    twice = docs.union(docs.filter("doc_id = 4"))
    assert sum(r.kept for r in dedup.exact_groups(twice).filter("doc_id in (4, 5)").collect()) == 1
    assert not dedup.exact_groups(none).collect()


def test_repeats(docs, none):
    seen: dict = {}
    for t in TEXTS:
        for i in range(len(words(t)) - 34):
            key = tuple(words(t)[i : i + 35])
            seen[key] = seen.get(key, 0) + 1
    for r in substrings.remove_repeats(docs).collect():
        w = words(TEXTS[r.doc_id])
        out = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in out)
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(out), kept)
    assert not substrings.remove_repeats(none).collect()


def test_bpe(docs, none):
    t = bpe.tokenizer(bpe.vocabulary())
    for r in bpe.encoded(docs, texts=True).collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    odd = ["it's", "<|endoftext|>x", "ΟΔΟΣ", "İst", "é́", "x\x00y", "日本語", "½", "a b", "\u0085"]
    ids, bounds = bpe.encode_words(bpe.vocabulary(), [w.encode() for w in odd])
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [t.encode(w, add_special_tokens=False).ids for w in odd]
    assert not bpe.encoded(none).collect()


@pytest.mark.parametrize("mixture", [None, {"s": 3.0, "": 1.0}])
def test_packing(docs, none, mixture):
    t = bpe.tokenizer(bpe.vocabulary())
    rows = packing.packed_pieces(docs, length=64, window_sequences=2, mixture=mixture).collect()
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for q in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == q), key=lambda r: r.offset)
        size = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and size & (size - 1) == 0
    assert not packing.packed_pieces(none).collect()


def test_personal_data(docs, none):
    row = next(r for r in pii.personal_data(docs).collect() if r.doc_id == 9)
    text = TEXTS[9]
    assert [(pii.KINDS[x.k], text[x.s : x.e]) for x in row.base] == [("email", "a@b.co"), ("ip", "1.2.3.4"), ("phone", "+49 30 1234567"), ("card", "4111 1111 1111 1111")]
    assert not pii.personal_data(none).collect()


def test_contexts_find_new_identifiers(spark):
    seeds = [(i, f"write to contact: user{i}@site.org now") for i in range(9)]
    found = pii.personal_data(spark.createDataFrame([*seeds, (99, "write to contact: bob@intranet now")], "doc_id long, text string"))
    row = found.filter("doc_id = 99").first()
    assert not row.base and [(x.s, x.e, x.k) for x in row.spans] == [(18, 30, 0)]


def test_fingerprints(docs, none):
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    for i, text in enumerate(TEXTS):
        text, nxt = text or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        edited = text[: len(text) - len(text) // 4] + nxt[: len(text) // 4]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[4].fingerprint == rows[5].fingerprint and rows[4].near_next == 1.0 and rows[7].near_next < 0.5
    assert not fingerprint.fingerprints(none).collect()


def test_lines(spark, docs, none):
    text = ["a line of words that is long enough to count", "short", "A line  of words that is long enough to count"]
    got = {r.line: r.kept for r in lines.fuzzy_lines(spark.createDataFrame([(1, "\n".join(text))], "doc_id long, text string")).collect()}
    assert got == {0: True, 1: True, 2: False}
    assert lines.levenshtein("kitten", "sitting", 9) == 3 and lines.levenshtein("kitten", "sitting", 2) == 3
    assert lines.fuzzy_lines(docs).count() and not lines.fuzzy_lines(none).collect()


def edited_lines():
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(3, 8))))
    out = []
    for n in [10, 12, 20, 30, 60] * 8:
        one = [word() for _ in range(n)]
        two = one.copy()
        two[int(rng.integers(n))] = word()
        out += [" ".join(one), " ".join(two)]
    return out


def test_similar_lines_are_found(spark):
    """Of all pairs of edit similarity 0.9, by brute force, at least 0.9; no line too many is dropped."""
    text = edited_lines()
    up = list(range(len(text)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in enumerate(text):
        for j, b in enumerate(text[:i]):
            if lines.levenshtein(a, b, 99) <= 0.1 * max(len(a), len(b)):
                up[max(find(i), find(j))] = min(find(i), find(j))
    assert len({find(i) for i in up}) < len(text) - 30
    df = spark.createDataFrame([(1, "\n".join(text))], "doc_id long, text string")
    rows = lines.fuzzy_lines(df).collect()
    stay = {r.line for r in rows if r.kept}
    assert stay >= {find(i) for i in up} and len(text) - len(stay) >= 0.9 * (len(text) - len({find(i) for i in up}))
    near = [text[0][:-3] + f"{i:03d}" for i in range(200)]  # wide runs
    wide = spark.createDataFrame([(i, x) for i, x in enumerate(near)], "doc_id long, text string")
    assert [r.doc_id for r in lines.fuzzy_lines(wide).collect() if r.kept] == [0]


@pytest.mark.parametrize("letters,low,high", [("abc", 1, 30), ("abcdé日", 50, 80), ("abcdefgh ", 60, 300)])
def test_edit_distances_of_many_pairs(letters, low, high):
    """Equal to one pair at a time, of which small ones are compared with the plain recurrence."""
    rng = np.random.default_rng(high)
    a = ["".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(700)]
    b = []
    for x in a:
        y = list(x)
        for i in rng.integers(0, len(y) + 1, rng.integers(0, 2 + len(y) // 5)).tolist():
            y[i : i + int(rng.integers(2))] = list(rng.choice(list(letters), rng.integers(2)))
        b.append("".join(y))
    most = np.array([max(len(x), len(y)) // 10 for x, y in zip(a, b, strict=True)])
    want = [lines.levenshtein(x, y, m) <= m for x, y, m in zip(a, b, most.tolist(), strict=True)]
    assert not len(lines.all_within([], [], most[:0])) and lines.all_within(["ab"], ["ab"], most[:1]).all()
    assert lines.all_within(a, b, most).tolist() == want and 0 < sum(want) < len(a)
    for x, y in zip(a[:20], b[:20], strict=True):
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, d[0] = d[0], i
            for j, e in enumerate(y, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (c != e))
        assert lines.levenshtein(x, y, 999) == d[-1]


def test_simhashes_that_differ_in_the_highest_bit(spark):
    """Two lines with one key are listed as a pair; neighbours on either side keep the run from the task's border."""
    keys = [(4, 40, 0, 0), (5, 40, 1, 3), (5, 40, 2, 3 - 2**63), (6, 40, 3, 0)]
    rows = spark.createDataFrame(keys, "key long, size int, uid long, sim long")
    got = {(r.a, r.b) for r in lines.turn(rows, 4, 0.9, lines.RADIUS, False).filter("side = 0").collect()}
    assert got == {(1, 2)}


def test_lines_of_one_frequent_block_are_all_compared(spark):
    """A run of one key that is longer than RUN, between two other keys: every pair within the radius is listed, or, of
    near copies, connected."""
    rng = np.random.default_rng(5)
    sims = [int(x) for x in rng.integers(-(2**63), 2**63, 120)]
    sims[90] = sims[10] ^ 7
    rows = [(4, 40, -1, 0), *[(5, 40, i, x) for i, x in enumerate(sims)], (6, 40, -2, 0)]
    met = lines.turn(spark.createDataFrame(rows, "key long, size int, uid long, sim long"), len(rows), 0.9, lines.RADIUS, False).collect()
    want = {(i, j) for j in range(120) for i in range(j) if (sims[i] ^ sims[j]).bit_count() <= lines.RADIUS and (sims[i] < 0) == (sims[j] < 0)}
    assert (10, 90) in want and {(r.a, r.b) for r in met if r.side == 0} == want
    rows = [(4, 40, -1, 0), *[(5, 40, i, 1 << i % 60) for i in range(200)], *[(5, 40, 1000 + i, x) for i, x in enumerate(sims)], (6, 40, -2, 0)]
    met = lines.turn(spark.createDataFrame(rows, "key long, size int, uid long, sim long"), len(rows), 0.9, lines.RADIUS, False).collect()
    joined = lines.Forest()
    joined.add(*(np.array([getattr(r, c) for r in met if r.side == 3]) for c in "ab"))
    assert len({joined.find(i) for i in range(200)}) == 1 and (1010, 1090) in {(r.a, r.b) for r in met if r.side == 0}


def test_lines_that_share_frequent_words_only_do_not_meet(spark):
    """The first 64 bits alone list both pairs; the whole SimHash lists the one that is near in all parts."""
    rows = [(4, 40, 0, 0, 0, 0), (5, 40, 1, 3, 0, 0), (5, 40, 2, 0, 5, 9), (5, 40, 3, 1, 2**40 - 1, 2**30 - 1), (6, 40, 4, 0, 0, 0)]
    met = lines.turn(spark.createDataFrame(rows, "key long, size int, uid long, sim long, sim2 long, sim3 long"), 5, 0.9, lines.RADIUS, False)
    assert {(r.a, r.b) for r in met.filter("side = 0").collect()} == {(1, 2)}


def test_a_simhash_is_the_line_s_own():
    """Whatever lines are hashed beside it; words that are repeated have one vote in its second and third part."""
    text = [x.encode() for x in edited_lines()]
    every, _, _ = lines.blocks(text)
    assert every.shape == (3, len(text)) and all((lines.blocks([x])[0][:, 0] == every[:, i]).all() for i, x in enumerate(text))
    one, _, _ = lines.blocks([b"the cat sat on a mat", b"the the the cat sat on a mat the the"])
    assert one[0, 0] != one[0, 1] and (one[1:, 0] == one[1:, 1]).all()


def test_lines_of_a_group_are_searched_together():
    """The same components as by one search after another, in groups with few links and of near copies."""
    text = edited_lines()
    rng = np.random.default_rng(8)
    head = " ".join(text[0].split()[:4])
    for own in (text, [text[0][:-3] + f"{i:03d}" for i in range(700)], [f"{head} " + "".join(map(chr, rng.integers(97, 100, 12))) for _ in range(300)], text[:1]):
        index = lines.LineIndex(0.9, 192)
        items = index.items(own)
        want, got = local_components(items, lines.LineIndex(0.9, 192)), index.components(items)
        first = lambda x: [x.tolist().index(v) for v in x.tolist()]
        assert first(got) == first(want)


def test_lines_are_joined_alike_at_every_size(spark, monkeypatch):
    """No join sends a small table to all tasks, which would be another plan, with other costs, than at size."""
    plans, write = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    df = spark.createDataFrame([(i, "\n".join(edited_lines())) for i in range(3)], "doc_id long, text string")
    assert lines.fuzzy_lines(df).count() == 240
    assert len(plans) > 10 and not any("Broadcast" in x for x in plans)


def test_short_lines_are_grouped_exactly(spark):
    df = spark.createDataFrame([(1, "Read more\n\nRead  mode"), (2, "read more\n\n \nread more")], "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.kept, r.size) for r in lines.fuzzy_lines(df).collect()}
    assert got == {(1, 0): (True, 3), (1, 1): (True, 1), (1, 2): (True, 1), (2, 0): (False, 3), (2, 1): (True, 1), (2, 2): (True, 1), (2, 3): (False, 3)}


def test_licenses(docs, none):
    rows = {r.doc_id: r.blocks for r in licenses.licenses(docs).collect()}
    assert [(b.line, b.license, b.confirmed, b.lacks) for b in rows[11]] == [(0, "MIT", True, [])] and not rows[0]
    assert not licenses.licenses(none).collect()


def test_notices_within_longer_lines(spark):
    notice = {k: t if isinstance(t, str) else t[0] for k, t in licenses.TEMPLATES.items()}
    fill = "some other words of the page that stand around a notice, " * 8
    rows = [(i, fill + notice[k] + " " + fill) for i, k in enumerate(sorted(notice))]
    two = (99, f"{fill}{notice['MIT']} {fill}{notice['Apache-2.0']}")
    got = {r.doc_id: [b.license for b in r.blocks if b.confirmed] for r in licenses.licenses(spark.createDataFrame([*rows, two], "doc_id long, text string")).collect()}
    assert got == {i: [k] for i, k in enumerate(sorted(notice))} | {99: ["MIT", "Apache-2.0"]}


def test_table_lines_meet():
    """Lines of repeated marks that differ in one cell share a key."""
    one = " | ".join(f"cell{i} |" for i in range(12))
    pair = [one.encode(), one.replace("cell5", "other").encode()]
    _, keys, owner = lines.blocks(pair)
    assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_compression_finds_notices():
    """A notice is found through what its template saves; without that, equal words confirm nothing."""
    held, notice = licenses.Templates(licenses.TEMPLATES), licenses.TEMPLATES["MPL-2.0"]
    text = f"some words before it. {notice} And some after it."
    assert [held.names[k] for _, _, k in held.notices(text, 2)] == ["MPL-2.0"]
    held.given = [held.alone] * len(held.names)
    assert held.notices(text, 2) == []


def test_wrapped_headers():
    held = licenses.Templates(licenses.TEMPLATES)
    for k, name in enumerate(held.names):
        w = held.words[k]
        text = "int main;\n/*\n" + "\n".join(" * " + " ".join(w[i : i + 6]) for i in range(0, len(w), 6)) + "\n */\nreturn 0;"
        assert [held.names[n] for _, _, n in held.notices(text, 2)] == [name]
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n"
    assert licenses.HINT.search(mit) and not held.notices(mit, 2)


def test_language_memory_is_bounded(spark):
    """Texts are sent to the workers once, and held as words in lots of bounded bytes."""
    texts = pa.array(["x" * 700_000, "y" * 700_000, None, "z" * 3_000_000, *["short"] * 600])
    cut = list(langid.lots(texts))
    assert [(a, n) for a, n in cut[:3]] == [(0, 1), (1, 2), (3, 1)] and sum(n for _, n in cut) == len(texts) and max(n for _, n in cut) <= 256
    df = spark.createDataFrame([(1, "the quick brown fox", "en")], "doc_id long, text string, lang string")
    out = langid.predicted(df, langid.Model({"en": ["the quick brown fox and the dog"]}, {}), keep=df.columns)
    assert out._jdf.queryExecution().analyzed().toString().count("__text") == 0
    assert out.columns == ["doc_id", "text", "lang", "__lang_pred", "__score", "__cross_entropy", "__rejected"] and out.first().text == "the quick brown fox"


def test_workers_get_batches_of_bounded_bytes(spark):
    """However many rows a batch may have, ten thousand texts do not come at once."""
    ship(spark)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    try:
        sizes = lambda batches: (pa.RecordBatch.from_pylist([{"n": b.nbytes}]) for b in batches)
        seen = [r.n for r in spark.range(0, 10_000, 1, 1).selectExpr("repeat('x', 2000) as text").mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert sum(seen) > 20_000_000 and max(seen) < 5_000_000


def test_language(spark, none):
    ship(spark)
    en, de = "the quick brown fox and the lazy dog of this house ", "der schnelle braune fuchs und das faule pferd dieses hauses "
    rows = [(i, (en, de)[i % 2] * 3, ("en", "de")[i % 2]) for i in range(80)] + [(100, None, "en"), (101, "123 !!", None), (102, en, None), (103, "zzqx ъыэ ღღღ ωωω" * 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.selectExpr("doc_id as id", "text", "lang"))
    got = {r.doc_id: r for r in langid.predicted(df, model).collect()}
    assert all(got[i]["__lang_pred"] == ("en", "de")[i % 2] for i in range(80)) and got[102]["__lang_pred"] == "en"
    assert got[100]["__lang_pred"] == got[101]["__lang_pred"] == "und" and got[103]["__rejected"] and not got[102]["__rejected"]
    assert not langid.predicted(none, langid.train(none.selectExpr("doc_id as id", "text", "lang"))).collect()


def test_stages(spark, docs):
    now = docs.drop("id", "th").cache()
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, now, "")
        assert out.columns == now.columns, name
        now = spark.createDataFrame(out.collect(), out.schema)
    text = now.filter("doc_id = 9").first().text
    assert text == "mail [EMAIL], [IP] or [PHONE] card [CARD]" and now.filter("doc_id = 5").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() >= now.count()


def test_pipeline(spark, tmp_path):
    """run() over a small table with nulls, repeated rows, a very long text and clashing names."""
    ship(spark)
    en = "the quick brown fox and the lazy dog of this house go over there with some more words "
    rows = [(i, en * 3 + f"number{i} ends here", "en", "s", 1, "x", "y") for i in range(60)]
    rows += [(60, None, None, None, None, None, None), (61, "", "en", "s", 0, "x", "y"), (None, en, "en", None, 1, "x", "y"), rows[0], (63, " ".join(f"the lazy dog of house number{i} go over there" for i in range(20_000)), "en", "s", 1, "x", "y")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, __id string, __rejected string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out if r.doc_id is not None} >= {0, 63} and not {60, 61} & {r.doc_id for r in out}
    assert sum(r.length for r in out if r.doc_id == 63) == next(r.doc_tokens for r in out if r.doc_id == 63)


def test_secrets_are_found(spark):
    rows = [(i, f'some words here token = "{hashlib.sha1(str(i).encode()).hexdigest()}" more words') for i in range(9)] + [(9, 'other words token = "abcd1234abcd1234" end')]
    got = {r.doc_id: [(x.k, x.s, x.e) for x in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [(4, 25, 65)] for i in range(9)) and got[9] == [(4, 21, 37)]


def test_tokens_are_the_library_s():
    """Words of every kind and long words, and numbers coded for the positions."""
    rng = np.random.default_rng(1)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789'.,-<|>éüñ日")
    found = ["".join(rng.choice(alphabet, rng.integers(1, 14))) for _ in range(3000)] + ["aaaa" * 40, "ab" * 500, "a" * 7, "<|endoftext|>"]
    t = bpe.tokenizer(bpe.vocabulary())
    ids, bounds = bpe.encode_words(bpe.vocabulary(), [w.encode() for w in found])
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [e.ids for e in t.encode_batch(found, add_special_tokens=False)]
    for x in (np.zeros(0, np.int64), np.array([0, 1, 2, 3, 255, 256, 511, 512, 99999, 2**30]), rng.integers(0, 5000, 1000)):
        assert (bpe.decoded(bpe.coded(x)) == x).all()

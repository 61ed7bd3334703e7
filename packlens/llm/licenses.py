"""Operator 8: license scans by conditional compression.

Lines with a license word are candidate blocks. Around each such word, over line ends and comment marks, the words of the
text (case folded, without punctuation) are compressed with every template as a zstandard raw dictionary and without one:
templates that save half of `min_saved` of their own compressed size are ranked by that share, and only these are aligned with the
words, as an exact check. A stretch that lacks and adds at most `most` words, in order, and of which the template saves
`min_saved`, is confirmed; a line may hold several. What surrounds the stretch does not count. `saved` is the share of
bytes that the template saves for the stretch. A candidate line outside every
confirmed stretch is reported with the template that saves most of the whole line, not confirmed.

Texts are read whole; a row needs no other row, so nothing is shuffled. Null and empty texts have no blocks. Ties go to
the first template by name. Repeated ids are separate rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import documents

# Usual short notices, and headers.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal.",
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
HINT = re.compile(r"licen[sc]e|copyright|creative[\W_]+commons|redistribut|permission[\W_]+to[\W_]+use|permission[\W_]+is[\W_]+hereby|\bcc[ -]?(by|0)", re.I)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def aligned(a: list[str], b: list[str], at: int) -> tuple[int, int, int]:
    """(differences, start, end) of the stretch of b over word `at` that lacks and adds the fewest words of a."""
    row = [(0, j) for j in range(len(b) + 1)]
    for i, w in enumerate(a):
        new = [(i + 1, 0)]
        for j, v in enumerate(b):
            skip = min((row[j + 1][0] + 1, -row[j + 1][1]), (new[j][0] + 1, -new[j][1]))
            new.append(min(row[j], (skip[0], -skip[1])) if w == v else (skip[0], -skip[1]))
        row = new
    return min(((d, s, e) for e, (d, s) in enumerate(row) if s <= at < e), default=(len(a) + len(b), 0, 0))


class Templates:
    def __init__(self, templates: dict[str, str | tuple[str, ...]]):
        pairs = sorted((n, x) for n, t in templates.items() for x in ((t,) if isinstance(t, str) else t))
        self.names = [n for n, _ in pairs]
        self.words = [WORD.findall(x.lower()) for _, x in pairs]
        self.counts, self.texts = [Counter(w) for w in self.words], [" ".join(w).encode() for w in self.words]
        dicts = [zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in self.texts]
        make = lambda d: zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone, self.given = make(None), [make(d) for d in dicts]
        self.own = [len(self.alone.compress(x)) for x in self.texts]

    def likely(self, words: list[str], at: int, most: int, min_saved: float) -> list[tuple[float, int, int, list[str]]]:
        """(share, template, first word, words): stretches about word `at` for which the template saves half of min_saved
        of its own compressed size (what surrounds a notice may cost a part of it), the best first."""
        out = []
        for k, a in enumerate(self.words):
            low = max(0, at - len(a) - most)
            near = words[low : at + len(a) + most + 1]
            x = " ".join(near).encode()
            share = (len(self.alone.compress(x)) - len(self.given[k].compress(x))) / self.own[k]
            if share >= min_saved / 2:
                out.append((share, k, low, near))
        return sorted(out, key=lambda r: (-r[0], r[1]))

    def notices(self, text: str, most: int, min_saved: float = 0.2) -> list[tuple[int, int, int]]:
        """(start, end, template) in characters of the text: stretches that compression finds likely and whose words
        differ in `most` at most, of each license the longest."""
        found = list(WORD.finditer(text))
        words, begin = [m[0].lower() for m in found], [m.start() for m in found]
        out: dict[tuple[int, int, int], int] = {}
        for hint in HINT.finditer(text):
            at = bisect_right(begin, hint.start()) - 1
            if at < 0:
                continue
            for _, k, low, near in self.likely(words, at, most, min_saved):
                a, count, have = self.words[k], self.counts[k], Counter(near)
                if sum(min(n, have[w]) for w, n in count.items()) < len(a) - most:  # more words lack than may
                    continue
                far, i, j = aligned(a, near, at - low)
                if far <= most:
                    out[low + i, low + j, k] = far
        best: list[tuple[int, int, int]] = []
        for i, j, k in sorted(out, key=lambda x: (out[x] - 2 * len(self.words[x[2]]), x)):
            if not any(self.names[k] == self.names[n] and i < z and a < j for a, z, n in best):
                best.append((i, j, k))
        return [(begin[i], found[j - 1].end(), k) for i, j, k in sorted(best)]

    def saved(self, block: str, k: int) -> float:
        x = " ".join(WORD.findall(block.lower())).encode()
        return 1 - len(self.given[k].compress(x)) / len(self.alone.compress(x))

    def rank(self, block: str) -> list[tuple[float, int]]:
        """(saved share, template) for all templates, the best first."""
        x = " ".join(WORD.findall(block.lower())).encode()
        whole = len(self.alone.compress(x))
        return sorted(((1 - len(c.compress(x)) / whole, k) for k, c in enumerate(self.given)), key=lambda r: (-r[0], r[1]))

    def differences(self, block: str, k: int) -> tuple[list[str], list[str]]:
        """Words of the template that the block lacks, and the other way round, about the stretch where they agree."""
        a, b = self.words[k], WORD.findall(block.lower())
        agree = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        if not agree:
            return a, b
        low, high = agree[0].b, agree[-1].b + agree[-1].size  # what surrounds the notice in its line is not wording
        in_a = {i for m in agree for i in range(m.a, m.a + m.size)}
        in_b = {i for m in agree for i in range(m.b, m.b + m.size)}
        return [w for i, w in enumerate(a) if i not in in_a], [w for i, w in enumerate(b) if low <= i < high and i not in in_b]


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str | tuple[str, ...]] = TEMPLATES, min_saved: float = 0.2, most: int = 2) -> DataFrame:
    """Per row: id, blocks: array<struct<line, license, saved, lacks, adds, confirmed>> of its notices and other candidate lines; line is
    that of the first word."""
    block = "line long, license string, saved double, lacks array<string>, adds array<string>, confirmed boolean"
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("line", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("lacks", pa.list_(pa.string())), ("adds", pa.list_(pa.string())), ("confirmed", pa.bool_())]))

    def scan(batches):
        held = Templates(templates)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                found = []
                if text and HINT.search(text):
                    ends = [m.start() for m in re.finditer("\n", text)]
                    sure = held.notices(text, most, min_saved)
                    for i, j, k in sure:
                        lacks, adds = held.differences(text[i:j], k)
                        saved = held.saved(text[i:j], k)
                        found.append({"line": bisect_right(ends, i), "license": held.names[k], "saved": saved, "lacks": lacks, "adds": adds, "confirmed": saved >= min_saved})
                    inside = [(bisect_right(ends, i), bisect_right(ends, j - 1)) for i, j, _ in sure]
                    lines = text.split("\n")
                    for n in sorted({bisect_right(ends, m.start()) for m in HINT.finditer(text)}):
                        if not any(a <= n <= z for a, z in inside):
                            saved, k = held.rank(lines[n])[0]
                            lacks, adds = held.differences(lines[n], k)
                            found.append({"line": n, "license": held.names[k], "saved": saved, "lacks": lacks, "adds": adds, "confirmed": False})
                    found.sort(key=lambda x: x["line"])
                out.append(found)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "blocks"])

    return docs.mapInArrow(scan, f"id long, blocks array<struct<{block.replace(' ', ': ').replace(',:', ',')}>>").withColumnRenamed("id", id_col)


def op8(spark, sf_dir: str) -> DataFrame:
    found = licenses(documents(spark, sf_dir))
    sure = F.filter("blocks", lambda x: x["confirmed"])
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["license"]))), ",")
    return found.select("doc_id", F.size(F.array_distinct(F.transform("blocks", lambda x: x["line"]))).cast("long").alias("n_blocks"), F.size(sure).cast("long").alias("n_confirmed"), names.alias("licenses"))

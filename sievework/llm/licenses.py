"""Licence scans with a positional index of rare template words.

The document frequency of each word of the licence templates is counted over all documents, and an index
has every template word's postings (template, position). A file's licence words are ranked by inverse
document frequency; for each template whose mandatory phrases' words the file has, its RARE highest-ranked
words that the template has too are looked up. Each of their places gives, through the postings, a place where
the template would begin; places on which enough of these words agree are candidates. A candidate becomes
a label if every mandatory phrase stands at its relative position, and scores by the share of template
words in place. Both passes are narrow; only word counts of the templates' vocabulary are gathered.

The base labels are exact phrases wherever they stand, and always stay.

Cases: null and empty texts have no words, no labels and score 0; a template repeated in a text counts
once as a label; repeated rows are scanned alike; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: A file's highest-ranked words that are looked up for a template, and the share of their places that must agree.
RARE, AGREE = 8, 0.6
#: Least share of a template's words in place.
LEAST_SCORE = 0.6

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"

#: Label, text, mandatory phrases. The texts are public licences, their openings and common notices.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "SPDX-License-Identifier: MIT", ("license identifier mit",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", ("apache license version 2 0", "in compliance with the license")),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache", "SPDX-License-Identifier: Apache-2.0", ("license identifier apache",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("redistribute it and or modify it", "gnu general public license")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", "SPDX-License-Identifier: GPL-3.0", ("license identifier gpl",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("mit", _MIT + _AS_IS, ("permission is hereby granted free of charge", "this permission notice shall be included in all copies or substantial portions")),
    ("bsd-2-clause", _BSD + _BSD_AS_IS, ("redistribution and use in source and binary forms", "provided with the distribution this software is provided")),
    ("bsd-3-clause", _BSD + _BSD_3 + _BSD_AS_IS, ("redistribution and use in source and binary forms", "provided with the distribution 3 neither the name")),
    ("isc", _ISC, ("with or without fee is hereby granted", "this permission notice appear in all copies")),
    ("zlib", _ZLIB, ("provided as is without any express or implied warranty", "alter it and redistribute it freely")),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("proprietary", "All rights reserved", ("all rights reserved",)),
]


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # of bytes: A-Z only


def places(found: list[bytes], phrase: list[bytes], by: dict[bytes, list[int]] | None = None) -> list[int]:
    """Where phrase's words stand consecutively."""
    first, rest, n = phrase[0], phrase, len(phrase)
    starts = by.get(first, []) if by is not None else [i for i, w in enumerate(found) if w == first]
    return [i for i in starts if found[i : i + n] == rest]


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[tuple[int, list[bytes]]]
    needed: frozenset[bytes]
    postings: dict[bytes, list[int]]


class Index:
    """Postings of the template words, ranked by their document frequencies."""

    def __init__(self, frequency: dict[bytes, int], documents: int, templates=None):
        self.templates: list[Template] = []
        for label, text, phrases in TEMPLATES if templates is None else templates:
            own = words(text.encode())
            at = []
            for p in phrases:
                want = words(p.encode())
                at.append((places(own, want)[0], want))
            postings: dict[bytes, list[int]] = {}
            for i, w in enumerate(own):
                postings.setdefault(w, []).append(i)
            self.templates.append(Template(label, own, at, frozenset(w for _, p in at for w in p), postings))
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for t in self.templates for w in t.postings}
        self.phrases = [(words(p.encode()), label) for p, label in BASE.items()]
        self.base = frozenset(p[0] for p, _ in self.phrases)
        self.wanted = frozenset(self.idf) | self.base

    def scan(self, found: list[bytes]) -> tuple[int, int | None, int | None, list[str], list[str], float]:
        """n_base, first_word, last_word, base labels, labels, score of a text's words."""
        present = self.wanted.intersection(found)
        ranked = sorted((w for w in present if w in self.idf), key=lambda w: (-self.idf[w], w))
        looked = []  # the templates that the file can hold, and its highest-ranked words that they have
        for k, t in enumerate(self.templates):
            if t.needed <= present:
                looked.append((k, list(islice((w for w in ranked if w in t.postings), RARE))))
        need = (self.base & present).union(*(own for _, own in looked))
        if not need:
            return 0, None, None, [], [], 0.0
        by: dict[bytes, list[int]] = {}
        for i, w in enumerate(found):
            if w in need:
                by.setdefault(w, []).append(i)
        base, starts, labels, best = set(), [], set(), 0.0
        for phrase, label in self.phrases:
            if got := places(found, phrase, by):
                starts += got
                base.add(label)
        votes: Counter = Counter()
        least = {}
        for k, own in looked:
            postings = self.templates[k].postings
            least[k] = AGREE * sum(len(postings[w]) for w in own)
            for w in own:
                for q in postings[w]:
                    for i in by[w]:
                        votes[k, i - q] += 1
        for (t, at), n in votes.items():
            template = self.templates[t]
            if n < least[t]:
                continue
            if any(found[max(0, at + q) : at + q + len(p)] != p for q, p in template.phrases):
                continue
            lo = max(0, -at)
            same = sum(x == y for x, y in zip(template.words[lo:], found[at + lo :]))
            score = same / len(template.words)
            if score >= LEAST_SCORE:
                labels.add(template.label)
                best = max(best, score)
        if base:
            best = 1.0
        return len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | labels), best


def frequencies(docs: DataFrame, text: str = "text", templates=None) -> tuple[dict[bytes, int], int]:
    """Documents that hold each word of the templates, over all of docs, and the number of docs."""
    vocabulary = frozenset(w for _, t, _ in (TEMPLATES if templates is None else templates) for w in words(t.encode()))

    def work(batches):
        total, rows = Counter(), 0
        for b in batches:
            data, offs = shared.utf8_view(b.column(0))
            raw, at = data.tobytes().lower(), offs.tolist()
            for i, j in zip(at[:-1], at[1:]):
                total.update(vocabulary.intersection(WORD.findall(raw, i, j)))
            rows += len(at) - 1
        yield pa.RecordBatch.from_arrays([pa.array([*total, b""], pa.binary()), pa.array([*total.values(), rows], pa.int64())], ["w", "n"])

    got = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(work, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # a row a template word
    sums = {bytes(r["w"]): r["n"] for r in got}
    return sums, sums.pop(b"", 0)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=None) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for each of docs."""
    index = docs.sparkSession.sparkContext.broadcast(Index(*frequencies(docs, text, templates), templates))
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def work(batches):
        for b in batches:
            data, offs = shared.utf8_view(b.column(1))
            raw, at, rows = data.tobytes().lower(), offs.tolist(), []
            for i, j in zip(at[:-1], at[1:]):
                found = WORD.findall(raw, i, j)
                n, first, last, base, labels, score = index.value.scan(found)
                rows.append((len(found), n, first, last, ",".join(base), ",".join(labels), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["k", *names])
        shared.tidy()

    out = slim.mapInArrow(work, shared.with_key(docs.schema[key].dataType, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"))
    return out.withColumnRenamed("k", key)



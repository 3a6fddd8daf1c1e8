"""Licence scans: an exact set-similarity join of text blocks with licence templates.

A template is a set of words. A block is a window of words that fits it: where the template's text has up to M words (M is ``STEP``, or that doubled as often as needed), blocks of 2 M words start
every M words, so a template that stands anywhere in a text stands in one block as a whole. A pair matches when the block holds at least ``CONTAINMENT`` of the template's words. The template words are put in the order of the number of
documents that hold them, rarest first, over the whole corpus. Then

* prefix filter: a matching block holds one of the template's first ``m - needed + 1`` words in that order,
* length filter: it has at least ``needed`` distinct words,
* positional filter: the words that stand after the first one found must suffice,

and the pairs that are left are counted. Nothing is missed: each filter only drops pairs that can't match.

Templates are a short list, sent to every task and refused above ``MAX_TEMPLATES``; whole licence texts and notices stand in it, and single statements. Counting is one pass that leaves a row for each template
word and task, matching another, both ``mapInArrow``; documents are not shuffled.

Beside the join, places are found where given phrases stand word by word. Null and empty texts have no words, texts of any length are scanned whole, repeated rows give repeated results, an empty table an empty one; other
columns are kept, those with names of outputs are replaced.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

STEP, CONTAINMENT, MAX_TEMPLATES = 20, 0.8, 1000

#: Phrases that must stand word by word, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public texts and notices of well-known licences, and statements that name them, with their labels.
TEMPLATES = {
    "this work is released under the terms of the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
    restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
    furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
    PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
    SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
    OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the
    above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
    DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
    IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
    all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
    AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
    TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""": "isc",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
    CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""": "apache-2",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
    or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
    PARTICULAR PURPOSE. See the GNU General Public License for more details.""": "gpl-3",
}

#: Words: runs of a-z, 0-9 and anything beyond ASCII, after A-Z have been lower-cased.
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def fitting_step(text: str) -> int:
    """Words between the starts of the blocks that a template is held against; the blocks are twice as long."""
    step = STEP
    while step < len(words(text)):
        step *= 2
    return step


class Templates:
    """Templates with their words in global order."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], containment: float):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.of_prefix: dict[bytes, list[int]] = {}
        self.all: list[tuple[str, list[int], int, int]] = []
        self.verified, self.stopped = 0, 0  # pairs that passed the length filter, and those that their words' places ended
        every = {w for text in templates for w in words(text)}
        self.place = {w: i for i, w in enumerate(sorted(every, key=lambda w: (frequency.get(w, 0), w)))}  # the global order, rare words first
        for text, label in templates.items():
            if not words(text):
                raise ValueError("a template without words")
            ordered = sorted(set(words(text)), key=self.place.__getitem__)
            needed = max(1, math.ceil(containment * len(ordered) - 1e-9))
            for w in ordered[: len(ordered) - needed + 1]:
                self.of_prefix.setdefault(w, []).append(len(self.all))
            self.all.append((label, [self.place[w] for w in ordered], needed, fitting_step(text)))
        self.prefixes = self.of_prefix.keys()

    def matches(self, found: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, containment) of each matching block."""
        hits = self.prefixes & set(found)
        if not hits:
            return []
        pairs, held = set(), {}
        for at, w in enumerate(found):
            if w in hits:
                for t in self.of_prefix[w]:
                    step = self.all[t][3]
                    pairs.update((block * step, t) for block in range(max(0, at // step - 1), at // step + 1))
        out = []
        for begin, t in sorted(pairs):
            label, ordered, needed, step = self.all[t]
            if (begin, step) not in held:  # words of no template can be in no overlap
                held[begin, step] = sorted({self.place[w] for w in found[begin : begin + 2 * step] if w in self.place})
            block = held[begin, step]
            if len(block) < needed:
                continue
            self.verified += 1
            overlap = self._overlap(ordered, block, needed)
            if overlap >= needed:
                out.append((label, begin, min(len(found), begin + 2 * step) - 1, overlap / len(ordered)))
        return out

    def _overlap(self, a: list[int], b: list[int], needed: int) -> int:
        """Words in common of two lists in the global order. It ends as soon as what is common so far and the shorter rest of the two can't come to needed: the positional filter, at each word."""
        i = j = common = 0
        n, m = len(a), len(b)
        while i < n and j < m:
            if common + min(n - i, m - j) < needed:
                self.stopped += 1
                return 0
            if a[i] == b[j]:
                common, i, j = common + 1, i + 1, j + 1
            elif a[i] < b[j]:
                i += 1
            else:
                j += 1
        return common


def frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents each template word stands, over all documents."""

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(text).to_pylist():
                total.update(vocabulary & set(words(t)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    common.small_batches(docs.sparkSession)
    rows = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word
    return {bytes(r.word): r.n for r in rows}


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first:int,last:int,containment:double>>"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT, text: str = "text") -> DataFrame:
    """docs without their text, with the phrases' places, the labels of both, and the matching blocks.

    ``score`` is 1 with a phrase, else the greatest containment of a matching block, else 0.
    """
    vocabulary = {w for t in templates for w in words(t)}
    known = Templates(templates, frequencies(docs, vocabulary, text), containment)
    sought = [(words(p), b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases.items()]
    added = T.StructType.fromDDL(SCAN)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("containment", pa.float64())]))]

    def row(value: str | None) -> tuple:
        found = words(value)
        joined = b" " + b" ".join(found) + b" "
        places, base = [], set()
        for phrase, spaced, label in sought:
            if spaced in joined:
                k, first = len(phrase), phrase[0]
                own = [i for i, w in enumerate(found) if w == first and found[i : i + k] == phrase]
                places += own
                base.add(label)
        blocks = known.matches(found)
        every = base | {b[0] for b in blocks}
        score = 1.0 if base else max((b[3] for b in blocks), default=0.0)
        return (
            len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(every)), score,
            [dict(zip(("label", "first", "last", "containment"), b, strict=True)) for b in blocks],
        )

    def run(batches):
        for batch in batches:
            rows = [row(t) for t in batch.column(text).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            kept = {k: c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k != text and k not in added.names}
            yield pa.RecordBatch.from_pydict(kept | {n: pa.array(list(c), k) for n, c, k in zip(added.names, columns, kinds, strict=True)})

    fields = [f for f in docs.schema if f.name != text and f.name not in added.names]
    return docs.mapInArrow(run, T.StructType(fields + list(added)))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and templates."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).drop("blocks")


def _sql() -> str:
    values = lambda d, more: ", ".join(f"('{' '.join(w.decode() for w in words(t))}', '{label}'{more(t)})" for t, label in d.items())
    return rf"""
WITH t AS (
  SELECT label, step, list_distinct(string_split(phrase, ' ')) AS tw FROM (VALUES {values(TEMPLATES, lambda t: f", {fitting_step(t)}")}) v(phrase, label, step)
), p AS (
  SELECT label, string_split(phrase, ' ') AS pw FROM (VALUES {values(PHRASES, lambda t: '')}) v(phrase, label)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w,
         row_number() OVER () AS rid
  FROM documents
), b AS (
  SELECT rid, p.label, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = pw[1] AND list_slice(w, i + 1, i + len(pw)) = pw)) AS place FROM d, p
), bb AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM b GROUP BY rid
), k AS (
  SELECT rid, step, unnest(range((len(w) + step - 1) // step)) * step AS b, w FROM d, (SELECT DISTINCT step FROM t)
), m AS (
  SELECT rid, label, len(list_intersect(tw, list_slice(w, b + 1, b + 2 * k.step))) / len(tw)::DOUBLE AS held
  FROM k JOIN t ON t.step = k.step WHERE len(list_intersect(tw, list_slice(w, b + 1, b + 2 * k.step))) >= {CONTAINMENT} * len(tw) - 1e-9
), l AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION SELECT rid, label FROM m) GROUP BY rid
), bl AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid
), s AS (
  SELECT rid, max(held) AS held FROM m GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(held, 0) END::DOUBLE AS score
FROM d LEFT JOIN bb USING (rid) LEFT JOIN l USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN s USING (rid)
"""


OP3_SQL = _sql()

"""Operator 5: licence notices in texts.

Method: a positional index of rare tokens. Words are lower-cased and numbered; only those that
occur in a licence template are looked at. The document frequency of every template word is
counted over all documents, rarest words first. Each slice of texts gets postings: the places of
each template word, in order. A file's licence words are looked up from the rarest on; a word opens
the templates whose rarest key word it is, where the file holds all the other words of the key,
too. The postings of the template's words, each shifted by its position in the template, are
intersected, rarest first: what is left after those of the key is a key phrase in full. The share
of the whole template found at that shift is the notice's coverage.

Templates of one phrase (the base) are covered wholly or not at all, so every place where their
words stand consecutively is found.

Defined cases: null or empty text has no words; places lie within one text; equal places of
different templates all count; notices are listed by start, then template; rows with null or repeated ``doc_id`` stay rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.bytewise import lower_ascii, owners, prefix_hash, runs, text_slices

_HASH = prefix_hash(5)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Template:
    label: str
    #: Words in order; the key phrase is a part of it that must stand in the text in full.
    text: str
    key: str
    base: bool = False


#: Texts of public licences, as words (fixed values).
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
    " and this permission notice shall be included in all copies or substantial portions of the software the software is"
    " provided as is without warranty of any kind express or implied including but not limited to the warranties of"
    " merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright"
    " holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
    " arising from out of or in connection with the software or the use or other dealings in the software"
)
ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    " provided that the above copyright notice and this permission notice appear in all copies the software is provided"
    " as is and the author disclaims all warranties with regard to this software including all implied warranties of"
    " merchantability and fitness in no event shall the author be liable for any special direct indirect or"
    " consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of"
    " contract negligence or other tortious action arising out of or in connection with the use or performance of this"
    " software"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met 1 redistributions of source code must retain the above copyright notice this list of"
    " conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice"
    " this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
    " distribution"
)
BSD_3 = (
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission"
)
ZLIB = (
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter"
    " it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be"
    " misrepresented you must not claim that you wrote the original software"
)
APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
    " license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by"
    " applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
    " without warranties or conditions of any kind either express or implied see the license for the specific language"
    " governing permissions and limitations under the license"
)
GPL = (
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free"
    " software foundation either version 2 of the license or at your option any later version this program is"
    " distributed in the hope that it will be useful but without any warranty without even the implied warranty of"
    " merchantability or fitness for a particular purpose see the gnu general public license for more details"
)

#: Phrases, notices and texts of public licences (fixed values).
TEMPLATES = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "under the terms of the eclipse public license", "eclipse public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "this program is free software you can redistribute it"),
    Template("gpl-version", "licensed under the gnu general public license version", "gnu general public license version"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc-by", "creative commons attribution", "creative commons attribution"),
    Template("mit", MIT, "the above copyright notice and this permission notice shall be included in all copies"),
    Template("isc", ISC, "the above copyright notice and this permission notice appear in all copies"),
    Template("bsd", BSD, "redistributions in binary form must reproduce the above copyright notice"),
    Template("bsd-3-clause", BSD_3, "may be used to endorse or promote products derived from this software"),
    Template("zlib", ZLIB, "the origin of this software must not be misrepresented"),
    Template("apache-2.0", APACHE, "you may not use this file except in compliance with the license"),
    Template("gpl", GPL, "under the terms of the gnu general public license as published by the free software foundation"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


@dataclass(frozen=True)
class Plan:
    """A template as numbers of words, and the positions of its key in it, rarest words first."""

    template: Template
    words: np.ndarray
    key_at: int
    key_length: int
    rarest_first: tuple[int, ...]


class Index:
    """Words of templates as numbers, and the templates that each word opens."""

    def __init__(self, templates: tuple[Template, ...], documents_with: dict[int, int]) -> None:
        self.words = sorted({w for t in templates for w in t.text.split()})
        number = {w: i for i, w in enumerate(self.words)}
        joined = "".join(self.words).encode()
        ends = np.cumsum([len(w.encode()) for w in self.words])
        starts = np.r_[0, ends[:-1]]
        hashes = _HASH.spans(_HASH.sums(np.frombuffer(joined, np.uint8)), starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[hashes & np.uint64(0xFFFF)] = True
        frequency = lambda n: (documents_with.get(n, 0), n)
        self.plans, opens = [], {}
        for t in templates:
            text, key = t.text.split(), t.key.split()
            at = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
            numbers = np.array([number[w] for w in text])
            order = sorted(range(at, at + len(key)), key=lambda i: frequency(int(numbers[i])))
            opens.setdefault(int(numbers[order[0]]), []).append(len(self.plans))
            self.plans.append(Plan(t, numbers, at, len(key), tuple(order)))
        #: (word, templates whose rarest key word it is), rarest word first.
        self.opens = sorted(opens.items(), key=lambda item: frequency(item[0]))

    def numbers_of(self, hashes: np.ndarray) -> np.ndarray:
        """Template word of each hash, else -1."""
        out = np.full(len(hashes), -1, np.int32)
        near = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[near]
        out[near[same]] = self.order[place[same]]
        return out


def _words(data: np.ndarray, bounds: np.ndarray, index: Index):
    """Template word at each word position, and each row's first word position (and the end)."""
    low = lower_ascii(data)
    start, end = runs(_IN_WORD[low], bounds)
    first = np.searchsorted(start, bounds)
    return index.numbers_of(_HASH.spans(_HASH.sums(low), start, end)), first, owners(start, bounds)


def _document_counts(docs: DataFrame, templates: tuple[Template, ...]) -> dict[int, int]:
    """Documents that hold each template word; as many numbers as the templates have words."""

    def count(batches):
        index = Index(templates, {})
        total = np.zeros(len(index.words), np.int64)
        for batch in batches:
            for _, last, data, bounds in text_slices(batch.column(0)):
                words, _, row = _words(data, bounds, index)
                there = np.flatnonzero(words >= 0)
                pairs = np.unique(row[there] * len(total) + words[there])
                total += np.bincount(pairs % len(total), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class _Postings:
    """Places of each template word in a slice of texts, in order, and which words each row holds."""

    def __init__(self, words: np.ndarray, row: np.ndarray, rows: int, size: int) -> None:
        at = np.flatnonzero(words >= 0)
        held = words[at]
        order = np.argsort(held, kind="stable")
        self.at = at[order]
        self.bounds = np.searchsorted(held[order], np.arange(size + 1))
        self.holds = np.zeros((rows, size), bool)
        self.holds[row[at], held] = True

    def of(self, word: int) -> np.ndarray:
        return self.at[self.bounds[word] : self.bounds[word + 1]]

    def meets(self, word: int, places: np.ndarray) -> np.ndarray:
        """Which of the places the word stands at."""
        own = self.of(word)
        if not len(own):
            return np.zeros(len(places), bool)
        return own[np.minimum(np.searchsorted(own, places), len(own) - 1)] == places


def _places(words: np.ndarray, first: np.ndarray, row: np.ndarray, index: Index):
    """(row, template, start in the row, coverage) of every notice."""
    postings = _Postings(words, row, len(first) - 1, len(index.words))
    for word, opened in index.opens:
        found = postings.of(word)
        for number in opened if len(found) else ():
            plan = index.plans[number]
            key = plan.words[plan.key_at : plan.key_at + plan.key_length]
            at = found[postings.holds[row[found]][:, np.unique(key)].all(axis=1)]
            shift, own = at - plan.rarest_first[0], row[at]
            inside = (shift + plan.key_at >= first[own]) & (shift + plan.key_at + plan.key_length <= first[own + 1])
            shift, own = shift[inside], own[inside]
            for i in plan.rarest_first[1:]:
                meets = postings.meets(plan.words[i], shift + i)
                shift, own = shift[meets], own[meets]
            if not len(shift):
                continue
            begin, end = first[own], first[own + 1]
            there = np.zeros(len(shift), np.int64)
            for i, wanted in enumerate(plan.words):
                there += postings.meets(wanted, shift + i) & (shift + i >= begin) & (shift + i < end)
            starts, shares = shift + plan.key_at - begin, there / len(plan.words)
            for r, s, c in zip(own.tolist(), starts.tolist(), shares.tolist(), strict=True):
                yield r, number, s, c


def find_notices(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and ``notices``: (label, base, start, words, coverage) of each place.

    ``start`` is the word at which the key phrase starts, ``words`` the key phrase's length.
    """
    counts = _document_counts(docs, templates)

    def scan(batches):
        index = Index(templates, counts)
        for batch in batches:
            for begin, last, data, bounds in text_slices(batch.column(1)):
                words, first, row = _words(data, bounds, index)
                notices = [[] for _ in range(last - begin)]
                for r, number, start, coverage in sorted(_places(words, first, row, index), key=lambda n: (n[2], n[1])):
                    t = templates[number]
                    notices[r].append(
                        {"label": t.label, "base": t.base, "start": start, "words": len(t.key.split()), "coverage": coverage}
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, last - begin),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(notices, _NOTICES),
                    ],
                    ["doc_id", "n_words", "notices"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(
        scan,
        "doc_id long, n_words long,"
        " notices array<struct<label:string,base:boolean,start:long,words:long,coverage:double>>",
    )


_NOTICES = pa.list_(
    pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64())])
)


def report(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: base places, labels, and the highest coverage of any notice."""
    found = find_notices(docs, templates).withColumn("base", F.filter("notices", lambda n: n["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda n: n["label"]))), ",")
    starts = F.transform("base", lambda n: n["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("notices").alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["coverage"])), F.lit(0.0)).alias("score"),
    )

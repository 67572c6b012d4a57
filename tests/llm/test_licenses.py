"""Notices by postings against a plain scan of every template at every word."""

from __future__ import annotations

import random
import re

import pytest
from documents_fixture import make_docs, pairs, small_docs  # noqa: F401

from caselight.llm import licenses


def plain(text: str | None, templates) -> list[tuple]:
    """(start, template, coverage) of every place of a key phrase."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    found = []
    for number, t in enumerate(templates):
        whole, key = t.text.split(), t.key.split()
        at = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        for s in range(len(words) - len(key) + 1):
            if words[s : s + len(key)] == key:
                there = sum(0 <= s - at + i < len(words) and words[s - at + i] == w for i, w in enumerate(whole))
                found.append((s, number, there / len(whole)))
    return sorted(found)


def _texts():
    rng = random.Random(8)
    templates = licenses.TEMPLATES
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choices(["license", "the", "software", "gnu", "of", "Public", "x", "é"], k=rng.randint(0, 6))
            part = rng.choice(templates).text.split()
            a, b = sorted(rng.choices(range(len(part) + 1), k=2)) if rng.random() < 0.5 else (0, len(part))
            part = part[a:b]
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = "changed"
            words += part
        yield rng.choice([" ", ", ", "\n"]).join(words)
    yield from ("", None, "mit license " * 400, "gnu general public", "CC-BY cc by, cc.by nc")


def test_method_s_own_notices(make_docs, pairs):
    rows = [*pairs[:60], *((10_000 + i, t) for i, t in enumerate(_texts()))]
    got = {r.doc_id: r for r in licenses.find_notices(make_docs(*rows)).collect()}
    reported = {r.doc_id: r for r in licenses.report(make_docs(*rows)).collect()}
    for doc_id, text in rows:
        wanted = plain(text, licenses.TEMPLATES)
        key_lengths = [len(t.key.split()) for t in licenses.TEMPLATES]
        assert [(n.start, n.label, n.base, n.words) for n in got[doc_id].notices] == [
            (s, licenses.TEMPLATES[k].label, licenses.TEMPLATES[k].base, key_lengths[k]) for s, k, _ in wanted
        ]
        assert [n.coverage for n in got[doc_id].notices] == pytest.approx([c for *_, c in wanted])
        assert reported[doc_id].labels == ",".join(sorted({licenses.TEMPLATES[k].label for _, k, _ in wanted}))
        assert reported[doc_id].score == pytest.approx(max((c for *_, c in wanted), default=0.0))


@pytest.mark.parametrize("text, label", [
    (licenses.MIT, "mit"), (licenses.ISC, "isc"), (licenses.BSD, "bsd"), (licenses.APACHE, "apache-2.0"),
    (licenses.ZLIB, "zlib"), (licenses.BSD_3, "bsd-3-clause"), ("this program is free software " + licenses.GPL, "gpl"),
])
def test_whole_texts_are_covered_in_full(make_docs, text, label):
    row = licenses.report(make_docs((1, "Copyright (c) someone\n\n" + text.upper()))).first()
    assert label in row.labels.split(",") and row.score == 1.0

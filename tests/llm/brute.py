"""Plain versions of the text operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re

LICENCES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def repeats(docs, length: int = 100) -> dict:
    """doc_id -> n_bytes, n_removed, n_spans, kept_sha256 for (doc_id, text) in corpus order."""
    seen, out = set(), {}
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(data[i : i + length])
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc_id] = (len(data), sum(gone), spans, sha(kept))
    return out


def edit_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def kept_lines(docs, edits: int, least: int) -> dict:
    seen, out = [], {}
    for doc_id, text in docs:
        lines = [] if text is None else text.split("\n")
        kept = []
        for line in lines:
            data = line.encode()
            if len(data) >= least:
                again = any(abs(len(x) - len(data)) <= edits and edit_distance(x, data) <= edits for x in seen)
                seen.append(data)
                if again:
                    continue
            kept.append(line)
        out[doc_id] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def kept_lines_of_any_length(docs, edits: int) -> dict:
    """Exact repeats of lines that are not blank, and near ones in characters above the edits."""
    seen, out = [], {}
    for doc_id, text in docs:
        lines = [] if text is None else text.split("\n")
        kept = []
        for line in lines:
            long_enough = [x for x in seen if min(len(x), len(line)) > edits and abs(len(x) - len(line)) <= edits]
            again = line in seen or any(edit_distance(x, line) <= edits for x in long_enough)
            if line.strip(" \t\n\v\f\r"):
                seen.append(line)
                if again:
                    continue
            kept.append(line)
        out[doc_id] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def licence_places(text: str | None):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text or ""))
    places = []
    for label, phrase in LICENCES:
        phrase = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    starts = [i for i, _ in places]
    return (
        len(words),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({label for _, label in places})),
    )


def shingles(text: str | None, n: int = 3) -> frozenset:
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def similar_groups(docs, least: int = 90, words: int = 3) -> dict:
    """doc_id -> size of the set, smallest doc_id of the group."""
    sets = {k: shingles(t, words) for k, t in docs}
    group = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= least * len(x | y) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {k: (len(sets[k]), group[k]) for k in sets}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def personal_data(text: str | None) -> list[tuple]:
    """(start, rank, end, kind) of the base kinds."""
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)

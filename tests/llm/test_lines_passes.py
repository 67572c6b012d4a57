"""Lines are split, hashed and met once for all that needs them, and repeats within a slice are settled there."""

import random

import brute
import pyarrow as pa
import pytest
from documents_fixture import make_docs  # noqa: F401

from caselight.llm import lines


@pytest.fixture
def passes(monkeypatch, tmp_path):
    """Rows that each of the operator's Python stages has taken in, all of its runs together."""
    take = lines.lean

    def counting(operator, run):
        name, folder = run.__qualname__.split(".")[0], str(tmp_path)

        def counted(batches):
            for batch in batches:
                with open(f"{folder}/{name}", "a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield batch

        return take(operator, lambda batches: run(counted(batches)))

    monkeypatch.setattr(lines, "lean", counting)
    return lambda name: sum(map(int, (tmp_path / name).read_text().split()))


def test_each_text_is_hashed_and_met_once(make_docs, passes):  # noqa: F811
    rng = random.Random(31)
    base = ["".join(rng.choice("abcdé xyz") for _ in range(30)) for _ in range(20)]
    rows = [(i, "\n".join(rng.choice(base)[: rng.choice([30, 29, 28])] for _ in range(4))) for i in range(50)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.report(make_docs(*rows), 2, None).collect()}
    assert got == brute.kept_lines_of_any_length(rows, 2) and sum(n for _, n, _ in got.values()) > 100
    assert passes("_occurrences") == passes("_meetings") == len(rows)


def test_repeats_within_a_slice(make_docs):  # noqa: F811
    """Only the first of equal lines of a slice keeps its hash; rows equal in id and text are one document."""
    rows = [(5, "b\na\na\n "), (1, "a\nc"), (1, "a\nc"), (3, "\tb\nb"), (None, "a"), (None, "a"), (None, "c\nd")]
    docs = lines.identified(make_docs(*rows).coalesce(1))
    found = lines._occurrences(docs, None).collect()
    assert sum(r.h2 is not None for r in found) == 7 and sum(r.h2 is None for r in found) == 6
    assert {(r.d, r.number) for r in found if r.h2 is None and r.d < 9} == {(5, 0), (5, 1), (5, 2)}
    dropped = sorted((r.doc_id is None, r.doc_id, r.n_lines, r.n_dropped) for r in lines.report(make_docs(*rows), 0, None).collect() if r.doc_id)
    assert dropped == [(False, 1, 2, 0), (False, 1, 2, 0), (False, 3, 2, 0), (False, 5, 4, 3)]


def test_lines_that_are_blank():
    texts = ["", " ", "\t\n \r", "  a", "a ", " ", "\x1f", "\x0b\x0c", "b\n\n \nc"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(range(9)), pa.array(texts)], ["d", "tie", "text"])
    found = [(int(r) + f, int(n)) for _, f, _, _, _, _, row, number in lines._each_slice([batch], None) for r, n in zip(row, number, strict=True)]
    blank = " \t\n\r\x0b\x0c"
    assert found == [(r, n) for r, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if line.strip(blank)]

"""Fixtures of the text operators' tests; a second conftest would hide the first one's names."""

import pytest

from caselight.llm.shared import let_workers_import

DOCS = "/root/testdata/sf0.001/documents.parquet"
#: Names that the operators use themselves.
CLASHING = "d tie node size text_x lot h1 key c0 x0 n copy stretch dropped pii_spans trigger lang"


@pytest.fixture(scope="session")
def small_docs(spark):
    let_workers_import(spark)
    return spark.read.parquet(DOCS)


@pytest.fixture(scope="session")
def pairs(small_docs):
    """(doc_id, text) in order of ids."""
    return [tuple(r) for r in small_docs.select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def make_docs(spark):
    let_workers_import(spark)

    def build(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, text string")

    return build


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    from pyspark.sql import functions as F

    long_text = "lorem ipsum dolor " * 3000 + "x" * 30_000
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long_text), (5, long_text), (6, "word"), (6, "word"),
        (7, "one text here"), (7, "another text there"), (None, "no id at all"), (None, None),
        (8, "mail a@b.co \U0001f600 x"), (9, "é é <|endoftext|> \x00\x01"),
    ]
    docs = make_docs(*rows)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING.split())])

"""The corpus pipeline: documents pass five stages, each written and read again.

toxicity    documents scored as toxic go; learnt from the labels beside the documents;
            all stay where no labelled document or only one class was there to learn from
line dedup  lines that repeat an earlier one, exactly or by a small edit, are cut out, however short
near dedup  of each group of documents with nearly equal word n-grams one stays: five words, similarity
            0.8 or more
pii         personal data and secrets in the texts are replaced by their kind
packing     token pieces of the documents are laid out in training sequences

Each stage takes all that the one before kept and returns the columns of documents, but for the last,
which returns one row per piece. ``run`` writes what a stage returns to the session's checkpoint folder,
so no stage is computed again for the reads of the next one. ``n_chars`` follows the text. A document whose lines all repeat
stays, with an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import jaccard, lines, packing, pii, toxicity
from caselight.llm.shared import checkpointed, let_workers_import

#: Words of an n-gram and least similarity in hundredths of the near dedup.
NEAR_WORDS = 5
NEAR_LEAST = 80


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    length = F.length("text").cast("long")
    return docs.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.learnt:
        return docs
    return toxicity.score(docs, model).filter("toxicity < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return _measured(lines.drop_repeated_lines(docs, least_bytes=None), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return jaccard.one_of_each_group(docs, NEAR_WORDS, NEAR_LEAST)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.mask(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = (
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_each_group),
    ("pii", mask_personal_data),
    ("packing", pack),
)
#: SQL expresses neither the classifier nor the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""What a session's executors share: this package, and the folder for intermediate results."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.bytewise import forget_tables

_NO_ID = (1 << 63) - 1
#: What lets go of things that one operator's tasks keep in their Python worker for its later tasks.
_FORGET: list[Callable[[], None]] = [forget_tables]
_latest: str | None = None


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, too.

    On a cluster the package is installed or sent with --py-files; a local session may have been
    started from any folder.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the session's checkpoint folder and read from there.

    The folder is the one in ``spark.checkpoint.dir``. Where that is unset, only a session on one
    machine, such as a test's, makes a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def forgets(forget: Callable[[], None]) -> None:
    """Have ``forget`` called in a worker when another operator's task comes to it."""
    _FORGET.append(forget)


def take_over(operator: str) -> None:
    """Let go of what other operators have kept in this process."""
    global _latest
    if _latest != operator:
        for forget in _FORGET:
            forget()
        _latest = operator


def give_back() -> None:
    """Return memory that is free, but still held by Arrow's pool or the allocator, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def lean(operator: str, run: Callable) -> Callable:
    """``run``, a function for mapInArrow, that leaves little behind in its Python worker.

    Workers live on for the tasks of other stages, and executors have room for one stage's needs, not
    for all that went before.
    """

    def fed(batches):
        for batch in batches:
            yield batch
            pa.default_memory_pool().release_unused()

    def task(batches):
        take_over(operator)
        yield from run(fed(batches))
        give_back()

    return task


def identified(docs: DataFrame) -> DataFrame:
    """d, tie, text and the other columns as x0, x1 and so on.

    d and tie tell documents apart and order them: by id, those without id last, rows with equal
    ids by a hash of their text. tie is odd where the id is missing, and 0 or 1 where ids are unique.
    """
    others = [n for n in docs.columns if n not in ("doc_id", "text")]
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d")
    tie = F.col("doc_id").isNull().cast("long")
    if not docs.groupBy(d).count().filter("count > 1").isEmpty():
        tie = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(-2)).bitwiseOR(tie)
    rest = [F.col(f"`{n}`").alias(f"x{i}") for i, n in enumerate(others)]
    return docs.select(d, tie.alias("tie"), F.col("text").cast("string").alias("text"), *rest)

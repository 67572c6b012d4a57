"""Deliveries made of the star tables: the cases written as two folders of CSV files and taken in again.

The files have the delivered headers, in two orders, and some of their numbers and stamps are spoilt by a rule
on the case id. They are written to a new folder under the session's checkpoint folder, and nothing else is left there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight import schema
from caselight.functions import fixed_values as fv
from caselight.operators import capacity, prepare, series
from caselight.sources import files, intake, readers, star_tables, store, writers

BAD_STAMP = "(case_id % 101 = 7)"
BAD_NUMBER = "(case_id % 103 = 5)"
AS_OF = date(1998, 6, 15)
#: Most rows of a delivered file.
RECORDS = 500_000
#: The cases of a header are joined and written in so many shares, one after the other.
SHARES = 2
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """A new folder that the session's executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="deliveries-")
    return f"{base.rstrip('/')}/delivery-{uuid.uuid4().hex}"


def _as_text(field: T.StructField) -> Column:
    """The delivered text of a field; stamps are text already."""
    value = F.col(field.name)
    if isinstance(field.dataType, T.TimestampNTZType):
        # Years of four digits are cut at fixed places; a pattern takes much longer.
        cut = [F.substring(value, 9, 2), F.substring(value, 6, 2), F.substring(value, 1, 4)]
        short = F.concat(F.concat_ws("/", *cut), F.substring(value, 11, 30))
        other = F.regexp_replace(value, r"^(\d+)-(\d+)-(\d+) ", "$3/$2/$1 ")
        value = F.when(F.substring(value, 5, 1) == "-", short).otherwise(other)
    for word, code in fv.CASE_CODES.get(field.name, {}).items():
        value = F.when(F.col(field.name) == code, F.lit(word)).otherwise(value)
    return value.cast("string")


def deliver(spark: SparkSession, sf_dir: str) -> str:
    """Write the cases as CSV files of two headers; returns their folder."""
    path = _folder(spark)
    headers = {name: header for header, name in fv.CASE_HEADERS.items()}
    odd = "case_id % 2 = 1"
    # A packed file is read by one task, so files are kept short.
    settings = {"sep": ";", "encoding": "ISO-8859-1", "header": "true", "compression": "gzip"}
    # The lines of a header are told by the case id before any join, so none is joined for both and nothing is
    # stored between. The shuffle files of one share are gone before those of the next are written.
    for name, chosen, order in (("odd", odd, 1), ("even", f"NOT ({odd})", -1)):
        named = [F.col(c).alias(headers[c]) for c in schema.CASE_COLUMNS[::order]]
        for share in range(SHARES):
            cases = star_tables.cases_by_narrow_rows(spark, sf_dir, chosen, share, SHARES)
            with _shuffles_removed(spark):
                out = _spoilt(cases).select(*named).write.mode("append")
                out.options(**settings, maxRecordsPerFile=RECORDS).csv(f"{path}/{name}")
    return path


def _spoilt(cases: DataFrame) -> DataFrame:
    """The delivered texts of cases, some of them no numbers and no times."""
    stamps = [f.name for f in schema.CASES.fields if isinstance(f.dataType, T.TimestampNTZType)]
    cases = cases.withColumns({n: F.col(n).cast("string") for n in stamps})
    columns = [_as_text(f).alias(f.name) for f in schema.CASES.fields]
    text = cases.select(*columns, F.expr(BAD_STAMP).alias("_stamp"), F.expr(BAD_NUMBER).alias("_number"))
    return text.withColumns(
        {
            "due_at": F.when(F.col("_stamp"), F.lit("31/31/1998 10:00:00")).otherwise(F.col("due_at")),
            "met_sla": F.when(F.col("_number"), F.lit("sí")).otherwise(F.col("met_sla")),
        }
    )


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs begun within remove their shuffle files when they end, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def good_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.take_in_cases(spark, deliver(spark, sf_dir)).rows


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows by reason, the value left out, and by the order of their file's columns."""
    found = intake.take_in_cases(spark, deliver(spark, sf_dir)).rejects
    kinds = F.transform(F.split("reason", "; "), lambda r: F.split_part(r, F.lit(":"), F.lit(1)))
    return (
        found.select(F.array_join(kinds, ", ").alias("reason"), F.col("file").contains("/odd/").alias("odd"))
        .groupBy("reason", "odd")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def _store(spark: SparkSession, source: str) -> str:
    target = _folder(spark)
    writers.refresh_snapshot(spark, source, target, reject_limit=1 << 62)
    return target


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot stored of a delivery, whose files go once they are taken in."""
    source = deliver(spark, sf_dir)
    target = _store(spark, source)
    files.remove(spark, source)
    return readers.read_snapshot(spark, target)


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after a refresh by the delivered files."""
    return _refreshed(spark, sf_dir)


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and rows of the store after a refresh that was refused for its rejects.

    One delivery is taken in twice: with its rejects, and with none allowed.
    """
    source = deliver(spark, sf_dir)
    target = _store(spark, source)
    try:
        writers.refresh_snapshot(spark, source, target, reject_limit=0)
        outcome = "accepted"
    except writers.TooManyRejects:
        outcome = "refused"
    held = readers.read_snapshot(spark, target).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("case_id").alias("first_id"), F.max("case_id").alias("last_id")
    )
    return held.select(
        F.lit(outcome).alias("outcome"), "*", F.lit(store.history(spark, target).count()).cast("bigint").alias("n_versions")
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlog per area from the stored snapshot, with the day of its last case."""
    cases = prepare.with_missed(_refreshed(spark, sf_dir))
    last = series.latest_day(cases, AS_OF).scalar()
    return capacity.backlog_by_area(cases).select("area", "total", "due", "solved", last.alias("as_of"))

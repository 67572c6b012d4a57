"""Readers for the delivered CSV tables (``;``, latin1, header)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight import schema
from caselight.functions import fixed_values as fv
from caselight.functions.columns import decimal_comma, parse_stamp, strict_stamp
from caselight.functions.contract import mark_absent
from caselight.sources import store

#: Header names of all files of a folder must agree, and rows must have as many fields as the header.
CSV_OPTIONS = {
    "sep": ";",
    "header": "true",
    "encoding": "ISO-8859-1",
    "enforceSchema": "false",
    "mode": "FAILFAST",
}


def normalise_columns(df: DataFrame, headers: dict[str, str] = fv.CASE_HEADERS) -> DataFrame:
    """Rename delivered headers to the names used here.

    Delivered headers carry blanks, ``?`` and brackets; each such character counts as
    a dot, so both the raw header and its dotted form are found. Unknown columns keep
    their name.
    """
    renames = {n: headers[dotted(n)] for n in df.columns if dotted(n) in headers}
    return df.withColumnsRenamed(renames)


def dotted(header: str) -> str:
    """A header with every character but letters, digits, dots and underscores as a dot."""
    return re.sub(r"[^\w.]", ".", header)


def typed_columns(
    df: DataFrame, layout: T.StructType, codes: dict[str, dict[str, str]], strict: bool = True
) -> list[Column]:
    """Text columns as values of the layout, in its order.

    Blanks stay ``''`` in text and are NULL elsewhere. A column that the table lacks is
    blank or NULL throughout. ``strict`` makes a solve time that is no time an error.
    """
    given = set(df.columns)

    def typed(field: T.StructField) -> Column:
        raw = F.col(field.name) if field.name in given else F.lit(None).cast("string")
        if isinstance(field.dataType, T.StringType):
            value = F.coalesce(raw, F.lit(""))
            for word, code in codes.get(field.name, {}).items():
                value = F.when(raw == word, F.lit(code)).otherwise(value)
            return value
        if isinstance(field.dataType, T.TimestampNTZType):
            # A solve time that is lost would turn a solved case into an open one.
            return strict_stamp(raw) if strict and field.name == "solved_at" else parse_stamp(raw)
        if isinstance(field.dataType, T.DoubleType):
            return decimal_comma(raw)
        return F.trim(raw).try_cast(field.dataType)

    return [typed(f) for f in layout.fields]


def _typed(df: DataFrame, layout: T.StructType, codes: dict[str, dict[str, str]]) -> DataFrame:
    """Project text columns to the layout; columns that were not delivered are marked."""
    values = typed_columns(df, layout, codes)
    rows = df.select(*[v.alias(f.name) for f, v in zip(layout.fields, values)])
    return mark_absent(rows, [f.name for f in layout.fields if f.name not in df.columns])


def _read(
    spark: SparkSession,
    path: str,
    layout: T.StructType,
    headers: dict[str, str],
    required: tuple[str, ...],
    codes: dict[str, dict[str, str]] | None = None,
    **options: str,
) -> DataFrame:
    # Columns are bound by name: delivered files carry further columns, in any order that is
    # the same in all files of a folder. Nothing is inferred; every column is read as text and
    # cast to the layout. What the files do not say plainly is an error, not a guess: files of
    # different headers, rows with too few fields (such as those cut by a line break inside
    # quotes, unless multiLine is set), a missing column, a solve time that is no time.
    text = spark.read.options(**{**CSV_OPTIONS, **options}).csv(path, inferSchema=False)
    named = normalise_columns(text, headers)
    missing = [f.name for f in layout.fields if f.name in required and f.name not in named.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {text.columns}")
    return _typed(named, layout, codes or {})


def read_cases(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Case extract as the ``cases`` layout. Further options go to the CSV reader.

    A file with line breaks inside quotes needs ``multiLine="true"``; it is then not split.
    """
    required = ("case_id", "area", "registered_at", "solved_at")
    return _read(spark, path, schema.CASES, fv.CASE_HEADERS, required, fv.CASE_CODES, **options)


def read_capacity(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Capacity table: one row per area and day of the month."""
    return _read(spark, path, schema.CAPACITY, fv.CAPACITY_HEADERS, ("area", "day", "p0"), **options)


def read_client_pending(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Cases that wait for the client."""
    required = ("area", "specialist", "case_id")
    return _read(
        spark, path, schema.CLIENT_PENDING, fv.CLIENT_PENDING_HEADERS, required, **options
    )


def read_snapshot(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Stored snapshot written by ``refresh_snapshot``: the current version, or the named one.

    Columns that were not delivered are marked. A plain folder of Parquet files is read as it is.
    """
    stored = store.find(spark, path, version)
    rows = spark.read.schema(schema.CASES).parquet(stored.folder if stored else path)
    rows = rows.select(*schema.CASE_COLUMNS)
    return mark_absent(rows, stored.absent) if stored else rows


def snapshot_freshness(df: DataFrame) -> DataFrame:
    """Latest modification time over the files behind a file-based DataFrame."""
    return df.select(F.col("_metadata.file_modification_time").alias("modified_at")).agg(
        F.max("modified_at").alias("modified_at")
    )


def path_freshness(spark: SparkSession, path: str) -> DataFrame:
    """The same from the file listing alone: the files themselves are not opened."""
    stored = store.find(spark, path)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(stored.folder if stored else path)
        .agg(F.max("modificationTime").alias("modified_at"))
    )

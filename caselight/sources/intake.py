"""Delivered CSV files, row by row judged: good rows in the layout, all others in a table of rejects.

A row is rejected if it has another number of fields than its header, or if a field that should be a number or
a time holds other text. Rejects keep their file, their text and every reason. Files of one folder may differ in
their headers: those with the same first line are read together, and columns are bound by name.

A line break inside quotes cuts a row in two unless ``multiLine`` is set. The first part is rejected then; the
second one is, too, unless it happens to have the right number of fields.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight import schema
from caselight.functions import fixed_values as fv
from caselight.functions.contract import mark_absent
from caselight.sources import files
from caselight.sources.readers import CSV_OPTIONS, dotted, typed_columns

_BROKEN, _FILE, _ROW, _REASONS = "_broken", "_file", "_row", "_reasons"
#: Tells rejects from good rows where both are written at once.
REJECTED = "rejected_row"
REJECTS_LAYOUT = "file string, row_text string, reason string"


@dataclass(frozen=True)
class Delivery:
    """A kind of delivered table: layout, header names, columns it must have, codes of texts."""

    layout: T.StructType
    headers: dict[str, str]
    required: tuple[str, ...]
    codes: dict[str, dict[str, str]]


CASES = Delivery(schema.CASES, fv.CASE_HEADERS, ("case_id", "area", "registered_at", "solved_at"), fv.CASE_CODES)
CAPACITY = Delivery(schema.CAPACITY, fv.CAPACITY_HEADERS, ("area", "day", "p0"), {})
CLIENT_PENDING = Delivery(
    schema.CLIENT_PENDING, fv.CLIENT_PENDING_HEADERS, ("area", "specialist", "case_id"), {}
)


@dataclass(frozen=True)
class Delivered:
    """A delivery, judged. Lazy: nothing but first lines has been read."""

    #: All rows: the layout, the file, and text and reasons of a reject, which are NULL in good rows.
    judged: DataFrame
    layout: T.StructType
    #: Columns of the layout that at least one file lacks.
    absent: tuple[str, ...]

    @property
    def rows(self) -> DataFrame:
        """Good rows; columns that were not delivered are marked (see ``contract``)."""
        good = self.judged.filter(F.col(_REASONS).isNull()).select(*self.layout.fieldNames())
        return mark_absent(good, self.absent)

    def _told(self) -> list[Column]:
        """file, row_text and reason of a reject; NULL in good rows."""
        told = {"file": F.col(_FILE), "row_text": F.col(_ROW), "reason": F.col(_REASONS)}
        return [F.when(F.col(_REASONS).isNotNull(), value).alias(name) for name, value in told.items()]

    @property
    def rejects(self) -> DataFrame:
        """file, row_text and reason; of several reasons each is told."""
        return self.judged.filter(F.col(_REASONS).isNotNull()).select(*self._told())

    def observed(self, note: Callable[..., DataFrame]) -> DataFrame:
        """All rows, good and rejected ones told apart by ``REJECTED``, with the number of rejects noted.

        Beside the layout, rejects have file, row_text and reason.
        """
        counted = note(self.judged, F.count_if(F.col(_REASONS).isNotNull()).alias("rejected"))
        return counted.select(*self.layout.fieldNames(), (F.col(_REASONS).isNotNull()).alias(REJECTED), *self._told())


def take_in(spark: SparkSession, path: str, delivery: Delivery, **options: str) -> Delivered:
    """Judge the files under a path. Options go to the CSV reader.

    A needed column that any file lacks is an error here, before any job.
    """
    # Without pruning every row is cut into all its fields; else a wrong number of them goes unseen
    # where a query needs but some columns.
    settings = {
        **CSV_OPTIONS, **options,
        "mode": "PERMISSIVE", "enforceSchema": "true", "columnNameOfCorruptRecord": _BROKEN, "columnPruning": "false",
    }
    groups = files.files_by_first_line(spark, path, settings["encoding"])
    if not groups:
        raise ValueError(f"{path} holds no rows and no header")
    parts, absent = [], set()
    for line, paths in groups.items():
        names = _bound(line, settings["sep"], settings.get("quote", '"'), delivery, paths[0])
        absent |= {f.name for f in delivery.layout.fields} - set(names)
        layout = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BROKEN]])
        text = spark.read.schema(layout).options(**settings).csv(paths)
        parts.append(_judged(text, names, delivery, settings["sep"]))
    in_order = tuple(f.name for f in delivery.layout.fields if f.name in absent)
    return Delivered(reduce(DataFrame.unionByName, parts), delivery.layout, in_order)


def take_in_cases(spark: SparkSession, path: str, **options: str) -> Delivered:
    return take_in(spark, path, CASES, **options)


def take_in_capacity(spark: SparkSession, path: str, **options: str) -> Delivered:
    return take_in(spark, path, CAPACITY, **options)


def take_in_client_pending(spark: SparkSession, path: str, **options: str) -> Delivered:
    return take_in(spark, path, CLIENT_PENDING, **options)


def _bound(line: str, sep: str, quote: str, delivery: Delivery, file: str) -> list[str]:
    """Names of the fields of a file with this header; fields that no report knows get a number."""
    header = next(csv.reader([line], delimiter=sep, quotechar=quote or None), [])
    names = [delivery.headers.get(dotted(h), f"_other{i}") for i, h in enumerate(header)]
    lacking = [c for c in delivery.required if c not in names]
    if lacking:
        raise ValueError(f"{file} lacks the columns {lacking}; it has {header}")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"{file} has more than one column for {twice}")
    return names


def _judged(text: DataFrame, names: list[str], delivery: Delivery, sep: str) -> DataFrame:
    fields = delivery.layout.fields
    # Values first, each computed once: they are told and looked at for reasons after it.
    values = typed_columns(text, delivery.layout, delivery.codes, strict=False)
    read = text.select(
        *[v.alias(f"_value_{f.name}") for f, v in zip(fields, values)],
        *names,
        _BROKEN,
        F.col("_metadata.file_path").alias(_FILE),
    )
    value = {f.name: F.col(f"_value_{f.name}") for f in fields}
    checked = [f for f in fields if f.name in names and not isinstance(f.dataType, T.StringType)]
    broken = F.col(_BROKEN).isNotNull()
    few = F.lit(f"the row has not as many fields as its header ({len(names)})")
    # Plain comparisons tell a good row; texts of reasons are made of the others only, in a form that keeps
    # them out of the code that is generated for every row.
    bad = reduce(Column.__or__, [_lost(F.col(f.name), value[f.name]) for f in checked], broken)
    reasons = F.array(*[_wrong(f, F.col(f.name), value[f.name]) for f in checked]).cast("array<string>")
    told = F.array_join(F.filter(reasons, lambda r: r.isNotNull()), "; ")
    rewritten = F.to_csv(F.struct(*[F.col(n) for n in names]), {"sep": sep})
    return read.select(
        *[value[f.name].alias(f.name) for f in fields],
        F.col(_FILE),
        F.when(bad, F.coalesce(F.col(_BROKEN), rewritten)).alias(_ROW),
        F.when(broken, few).when(bad, told).alias(_REASONS),
    )


def _lost(raw: Column, value: Column) -> Column:
    """Whether there is a text that is no value."""
    return value.isNull() & (F.trim(F.coalesce(raw, F.lit(""))) != "")


def _wrong(field: T.StructField, raw: Column, value: Column) -> Column:
    """Why the text is no value of the field, or NULL."""
    kind = "time" if isinstance(field.dataType, T.TimestampNTZType) else "number"
    said = F.concat(F.lit(f"{field.name} is no {kind}: "), raw)
    return F.when(_lost(raw, value), said)

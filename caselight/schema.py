"""Table layouts and named projections."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _STAMP = T.StringType(), T.IntegerType(), T.TimestampNTZType()


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


CASES = _struct(
    [("case_id", T.LongType())]
    + [
        (name, _TEXT)
        for name in (
            "area", "grp", "subgrp", "specialist", "service", "service_type", "case_type",
            "state", "category_path", "category", "ci", "site", "inclusion",
        )
    ]
    + [(name, _INT) for name in ("elapsed_minutes", "sla_minutes", "met_sla")]
    + [(name, _STAMP) for name in ("registered_at", "due_at", "solved_at")]
    + [("progress_text", _TEXT)]
    + [
        (name, _INT)
        for name in (
            "closed_in_period", "closed_met_sla", "solved_pending_close",
            "solved_pending_close_met_sla", "still_pending", "still_pending_met_sla",
            "due_in_month", "overdue_prev_months", "closed_early_prev", "closed_early_next",
            "solved_early_next",
        )
    ]
)

CAPACITY = _struct([("area", _TEXT), ("day", _INT), ("p0", T.DoubleType())])

CLIENT_PENDING = _struct(
    [
        ("area", _TEXT),
        ("specialist", _TEXT),
        ("case_id", T.LongType()),
        ("category", _TEXT),
        ("service", _TEXT),
    ]
)

TARGETS = _struct(
    [("area", _TEXT), ("kpi", _TEXT), ("target", T.DoubleType()), ("tolerance", T.DoubleType())]
)

CASE_COLUMNS = tuple(CASES.fieldNames())

WORKLIST_COLUMNS = (
    "case_id", "case_type", "state", "area", "grp", "subgrp", "specialist", "service",
    "registered_at", "due_at", "elapsed_minutes", "sla_minutes", "met_sla", "progress",
    "site", "ci",
)
SELECTION_COLUMNS = (
    "case_id", "area", "grp", "specialist", "service", "progress", "elapsed_minutes",
)
SCATTER_COLUMNS = ("case_id", "area", "case_type", "progress", "elapsed_minutes", "label")
PIVOT_COLUMNS = (
    "area", "grp", "subgrp", "specialist", "service", "case_type", "state",
    "level_1", "level_2", "level_3", "level_4", "missed", "met_sla",
)
